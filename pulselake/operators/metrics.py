"""Error metrics, agreement and calibration as aggregates (survey F). All combine before they shuffle."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from ..functions.numeric import clip, corr, ratio, rounded
from ..sources.shared import checkpointed


def at_least(n: int, x: Column) -> Column:
    """x, null for groups of fewer rows (T4)."""
    return F.when(F.count("*") >= n, x)


def errors(df: DataFrame, keys: list[str], measured: str = "measured", reference: str = "reference", least: int = 10) -> DataFrame:
    """n, mae, rmse, bias, pearson, loa_low, loa_high (sample deviation) by keys; null below `least` pairs.

    Rows where either side is null don't count.
    """
    m, r = F.col(measured), F.col(reference)
    d = m - r
    df = df.where(m.isNotNull() & r.isNotNull())
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), at_least(least, F.avg(F.abs(d))).alias("mae"), at_least(least, F.sqrt(F.avg(d * d))).alias("rmse"), at_least(least, F.avg(d)).alias("bias"),
        at_least(least, corr(m, r)).alias("pearson"), at_least(least, F.avg(d) - 1.96 * F.stddev_samp(d)).alias("loa_low"), at_least(least, F.avg(d) + 1.96 * F.stddev_samp(d)).alias("loa_high"),
    )


def bland_altman(df: DataFrame, keys: list[str], sample: bool = True, least: int = 3) -> DataFrame:
    """bias, sigma, limits and proportional bias; sample or population deviation."""
    d, mid = F.col("measured") - F.col("reference"), (F.col("measured") + F.col("reference")) / 2
    std = F.stddev_samp(d) if sample else F.stddev_pop(d)
    return df.groupBy(*keys).agg(at_least(least, F.avg(d)).alias("bias"), at_least(least, std).alias("sigma"), at_least(least, F.avg(d) - 1.96 * std).alias("loa_low"),
                                 at_least(least, F.avg(d) + 1.96 * std).alias("loa_high"), at_least(least, corr(d, mid)).alias("proportional"))


def contributions(found: DataFrame, name: str, full: str, most: float = 1.0) -> DataFrame:
    """of errors() by configuration `name` the changes against the `full` one: of the mean error (critical beyond `most`), of the
    root mean square, and the loss of correlation."""
    base = found.where(F.col(name) == full).select(F.col("mae").alias("__a"), F.col("rmse").alias("__b"), F.col("pearson").alias("__c"))
    x = found.where(F.col(name) != full).crossJoin(F.broadcast(base))  # one row on the right
    x = x.withColumns({"change": F.col("mae") - F.col("__a"), "rmse_change": F.col("rmse") - F.col("__b"), "pearson_loss": F.col("__c") - F.col("pearson")})
    return x.withColumn("critical", F.col("change") > most).drop("__a", "__b", "__c")


def compared(a: DataFrame, b: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, each of names as `<name>_a`, `<name>_b`, `<name>_change`) of two systems' metrics by key; a key that one lacks has nulls."""
    sides = [d.select(key, *(F.col(n).alias(f"{n}_{s}") for n in names)) for d, s in ((a, "a"), (b, "b"))]
    return sides[0].join(sides[1], key, "full").withColumns({f"{n}_change": F.col(f"{n}_b") - F.col(f"{n}_a") for n in names})


def ranked(metrics: DataFrame, name: str) -> DataFrame:
    """ranks of methods by each metric, the best first; of equal ones the name decides. One row for each method."""
    w = lambda c: Window.orderBy(c, name)  # noqa: E731  over the few rows of a summary
    return metrics.select("*", F.row_number().over(w(F.col("mae"))).alias("rank_mae"), F.row_number().over(w(F.col("rmse"))).alias("rank_rmse"), F.row_number().over(w(F.col("pearson").desc())).alias("rank_pearson"))


def calibration(df: DataFrame, keys: list[str]) -> DataFrame:
    """errors of accepted rows, median error, selective and expected risk (a rejected row costs |200 - reference|), coverage of the interval.

    The correlation is the plain one (T10). The median is exact without holding a group (exact_quantile).
    """
    e = F.abs(F.col("measured") - F.col("reference"))
    ok = F.col("valid") & ~F.col("rejected")
    on = lambda x: F.when(ok, x)
    inside = F.when(F.col("reference").between(F.col("measured") - F.col("sigma"), F.col("measured") + F.col("sigma")), 1.0).otherwise(0.0)
    median = exact_quantile(df.where(ok).select(*keys, e.alias("e")), keys, "e", 0.5).withColumnRenamed("quantile", "median_error")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("accepted"), F.avg(on(e)).alias("mae"), F.sqrt(F.avg(on(e * e))).alias("rmse"), F.avg(on(F.col("measured") - F.col("reference"))).alias("bias"),
        corr(on(F.col("measured")), on(F.col("reference"))).alias("pearson"), F.avg(F.when(ok, e).otherwise(F.abs(200 - F.col("reference")))).alias("expected_risk"),
        F.avg(on(inside)).alias("coverage"),
    ).join(median, keys, "left")


def reliability(df: DataFrame, keys: list[str], bins: int = 10, least: int = 10) -> DataFrame:
    """mean confidence and accuracy by equal bins of confidence (0..100); confidence 100 is in no bin."""
    ok = df.where((F.col("confidence") >= 0) & (F.col("confidence") < 100))
    e = F.abs(F.col("measured") - F.col("reference"))
    g = ok.groupBy(*keys, F.floor(F.col("confidence") / (100 / bins)).alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), clip(1 - F.avg(e) / 100, 0, 1).alias("accuracy"))
    return g.where(F.col("n") >= least) if least > 1 else g


def calibration_error(df: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """expected calibration error, the bins' |accuracy - confidence| weighted by their rows."""
    g = reliability(df, keys, bins, 1)
    return g.groupBy(*keys).agg(ratio(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence") / 100)), F.sum("n").cast("double")).alias("ece"))


#: Cumulative probabilities of a Poisson count of mean 1, in units of 2^-32, and the finalizer of murmur3 for 32 bits.
POISSON = tuple(int(2**32 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(j + 1))) for j in range(13))
MIX = ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1))
#: Rows of a key that a task sends on as they are; more become sums.
RAW = 512

_SUMS = ("w", "d", "dd", "ad", "m", "r", "mm", "rr", "mr")


def multiplicities(h: np.ndarray, rounds: int) -> np.ndarray:
    """How often each row (two 32-bit hashes, h) occurs in resample 1, 2, ...: Poisson counts of mean 1, (rows, rounds)."""
    low = np.uint64(0xFFFFFFFF)
    z = (h[:, :1] + np.arange(1, rounds + 1, dtype=np.uint64) * (h[:, 1:] | np.uint64(1))) & low
    for shift, factor in MIX:
        z ^= z >> np.uint64(shift)
        z = (z * np.uint64(factor)) & low
    return np.searchsorted(np.array(POISSON, np.uint64), z, side="right")


def _resampled_sums(rows: np.ndarray, rounds: int) -> np.ndarray:
    """(sums, rounds) of rows (h1, h2, measured, reference)."""
    m, r = rows[:, 2], rows[:, 3]
    d = m - r
    return np.stack([np.ones(len(m)), d, d * d, np.abs(d), m, r, m * m, r * r, m * r]) @ multiplicities(rows[:, :2].astype(np.uint64), rounds).astype(float)


def _resampled(df: DataFrame, keys: list[str], row: str, measured: str, reference: str, rounds: int, seed: int, finish: Callable[[np.ndarray], dict[str, float]], names: list[str]) -> DataFrame:
    """keys and the columns `names` that finish() makes of each key's sums, (sums, rounds).

    Each row adds itself to the sums of every resample, as often as hashes of (seed, keys, row) say, so a resample of n rows has
    n rows on average (a Poisson bootstrap), and is the same on every run and engine (T18). A task sends on a key's rows if they
    are few, else their sums, whose size doesn't depend on the number of rows.
    """
    text = F.md5(F.concat_ws("/", F.lit(seed), *(F.col(k).cast("string") for k in keys), F.col(row).cast("string")))
    word = lambda at: F.conv(F.substring(text, at, 8), 16, 10).cast("double")
    rows = df.select(*keys, word(1).alias("__h1"), word(9).alias("__h2"), F.col(measured).cast("double").alias("__m"), F.col(reference).cast("double").alias("__r")).where("__m IS NOT NULL AND __r IS NOT NULL")
    schema = StructType([*(rows.schema[k] for k in keys), StructField("__raw", BinaryType()), StructField("__sums", BinaryType())])
    kinds = to_arrow_schema(schema)
    out = StructType([*(rows.schema[k] for k in keys), *(StructField(n, DoubleType()) for n in names)])

    def combined(batches: Iterator[pa.RecordBatch], parts: Callable[[pa.RecordBatch], Iterator[tuple[tuple, np.ndarray | None, np.ndarray | None]]]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray | None]]:
        """Of each run of equal keys its rows, RAW at most, or else the sums of all of them."""
        now, held, sums = None, [], None
        for batch in batches:
            for key, raw, more in parts(batch):
                if key != now:
                    if now is not None:
                        yield now, np.concatenate(held) if held else np.zeros((0, 4)), sums
                    now, held, sums = key, [], None
                if more is not None:
                    sums = more if sums is None else sums + more
                if raw is not None:
                    held.append(raw)
                    if sums is not None or sum(map(len, held)) > RAW:
                        for i in range(0, len(block := np.concatenate(held)), RAW):
                            own = _resampled_sums(block[i : i + RAW], rounds)
                            sums = own if sums is None else sums + own
                        held = []
        if now is not None:
            yield now, np.concatenate(held) if held else np.zeros((0, 4)), sums

    def by_runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray | None, None]]:
        values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("__h1", "__h2", "__m", "__r")])
        names_ = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
        first = 0
        for i in range(1, len(names_) + 1):
            if i == len(names_) or names_[i] != names_[first]:
                yield names_[first], values[first:i], None
                first = i

    def packed(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray | None, np.ndarray | None]]:
        for *key, raw, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield tuple(key), None if raw is None else np.frombuffer(raw).reshape(-1, 4), None if sums is None else np.frombuffer(sums).reshape(-1, rounds)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, raw, sums in combined(batches, by_runs):
            row = [*key, raw.tobytes() if len(raw) else None, None if sums is None else sums.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, kinds, strict=True)], schema=kinds)

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = to_arrow_schema(out)
        for key, raw, sums in combined(batches, packed):
            if len(raw):
                own = _resampled_sums(raw, rounds)
                sums = own if sums is None else sums + own
            got = finish(sums)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*key, *(got[n] for n in names)], fields, strict=True)], schema=fields)

    parts = rows.sortWithinPartitions(*keys).mapInArrow(add, schema)
    return (parts.repartition(*keys).sortWithinPartitions(*keys) if keys else parts.coalesce(1)).mapInArrow(end, out)


def _ends(values: np.ndarray) -> tuple[float | None, float | None]:
    """The 2.5 and 97.5 percentiles of what is a number."""
    values = values[~np.isnan(values)]
    return (None, None) if not len(values) else tuple(float(q) for q in np.quantile(values, (0.025, 0.975)))


def bootstrap(df: DataFrame, keys: list[str], row: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """percentile interval of the mean absolute error by key from `rounds` resamples. df: keys, row (tells rows of a key apart), e (absolute error)."""

    def finish(s: np.ndarray) -> dict:
        with np.errstate(invalid="ignore", divide="ignore"):
            low, high = _ends(s[4] / s[0])
        return {"low": low, "high": high}

    return _resampled(df.withColumn("__zero", F.lit(0.0)), keys, row, "e", "__zero", rounds, seed, finish, ["low", "high"])


def error_intervals(df: DataFrame, keys: list[str], rounds: int = 1000, seed: int = 42, least: int = 10) -> DataFrame:
    """each metric of errors() by keys with `<metric>_low` and `<metric>_high`, its 95 % interval from `rounds` resamples.

    df: keys, row (tells the rows of a key apart), measured, reference. Groups under `least` pairs have neither. A resample whose
    sides don't vary has no correlation, one of fewer than two rows no limits; they don't count for these intervals.
    """
    names = ["mae", "rmse", "bias", "pearson", "loa_low", "loa_high"]

    def finish(s: np.ndarray) -> dict:
        with np.errstate(invalid="ignore", divide="ignore"):
            n, d, dd, ad, m, r, mm, rr, mr = s
            n = np.where(n > 0, n, np.nan)
            spread = 1.96 * np.sqrt(np.maximum(dd - d * d / n, 0) / np.where(n > 1, n - 1, np.nan))
            vm, vr = mm / n - (m / n) ** 2, rr / n - (r / n) ** 2
            varies = (vm > 1e-9 * (mm / n)) & (vr > 1e-9 * (rr / n))
            pearson = np.where(varies, (mr / n - m * r / n**2) / np.sqrt(np.where(varies, vm * vr, np.nan)), np.nan)
        found = (ad / n, np.sqrt(dd / n), d / n, pearson, d / n - spread, d / n + spread)
        return {f"{name}_{end}": v for name, x in zip(names, found, strict=True) for end, v in zip(("low", "high"), _ends(x), strict=True)}

    drawn = _resampled(df, keys, "row", "measured", "reference", rounds, seed, finish, [f"{name}_{end}" for name in names for end in ("low", "high")])
    return errors(df, keys, least=least).where(F.col("n") >= least).join(drawn, keys)


#: Rows of a group above which its quantile is found by narrowing bounds instead of in one buffer, and marks of each narrowing.
BUFFERED, MARKS = 100_000, 64


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, buffered: int = BUFFERED) -> DataFrame:
    """(keys, quantile) of df's values that are numbers: exact, between two values by linear interpolation, as percentile() gives.

    A group of more than `buffered` rows is never held. Marks from a mergeable sketch cut its values, each mark a bucket of its
    own and what lies between two another; exact counts by bucket say which one has the rank, and that one is cut again until it
    has `buffered` rows or a single value. The sketch only decides where to cut. There are at most two bounds for every `buffered`
    rows of df, so these are broadcast: rows of a group stay where they are and are never dealt by its key.
    """
    if not keys:
        return exact_quantile(df.withColumn("__all", F.lit(0)), ["__all"], value, q, buffered).drop("__all")
    x = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")
    for k in keys:
        x = x.where(F.col(k).isNotNull())
    large = checkpointed(x.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > buffered))
    few = large.limit(1).count() == 0
    small = (x if few else x.join(F.broadcast(large.select(*keys)), keys, "left_anti")).groupBy(*keys).agg(F.percentile("__v", q).alias("quantile"))
    if few:
        return small
    place = (F.col("__n") - 1) * F.lit(q)
    ranks = F.array_distinct(F.array(F.floor(place), F.ceil(place)))
    bounds = large.select(*keys, place.alias("__place"), F.explode(ranks).alias("__r"), F.lit(float("-inf")).alias("__lo"), F.lit(float("inf")).alias("__hi"), F.lit(0).cast("long").alias("__below"), F.col("__n").alias("__in"))
    own = [*keys, "__r"]
    done = (F.col("__lo") == F.col("__hi")) | (F.col("__in") <= buffered)
    while True:
        bounds = checkpointed(bounds)
        wide = bounds.where(~done)
        if not wide.limit(1).count():
            break
        inside = x.join(F.broadcast(wide), keys).where("__v >= __lo AND __v <= __hi")
        marks = inside.groupBy(*own).agg(F.array_distinct(F.percentile_approx("__v", [i / MARKS for i in range(MARKS + 1)], 20 * MARKS)).alias("__marks"))
        under = F.aggregate("__marks", F.lit(0), lambda a, m: a + F.when(m < F.col("__v"), 2).when(m == F.col("__v"), 1).otherwise(0))
        cut = inside.join(F.broadcast(marks), own).withColumn("__bucket", under).groupBy(*own, "__bucket").agg(F.count("*").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), *(F.first(c).alias(c) for c in ("__place", "__below")))
        w = Window.partitionBy(*own).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # 2 MARKS + 3 rows
        cut = cut.withColumn("__below", F.col("__below") + F.coalesce(F.sum("__c").over(w), F.lit(0)))
        cut = cut.where((F.col("__r") >= F.col("__below")) & (F.col("__r") < F.col("__below") + F.col("__c")))
        bounds = bounds.where(done).unionByName(cut.select(*keys, "__place", "__r", "__lo", "__hi", "__below", F.col("__c").alias("__in")))
    held = x.join(F.broadcast(bounds.where("__lo < __hi")), keys).where("__v >= __lo AND __v <= __hi").groupBy(*own, "__place", "__below").agg(F.sort_array(F.collect_list("__v")).alias("__x"))  # `buffered` rows
    found = held.select(*own, "__place", F.element_at("__x", (F.col("__r") - F.col("__below") + 1).cast("int")).alias("__v")).unionByName(bounds.where("__lo = __hi").select(*own, "__place", F.col("__lo").alias("__v")))
    low, high = F.min("__v"), F.max("__v")
    return small.unionByName(found.groupBy(*keys).agg((low + (high - low) * (F.first("__place") - F.floor(F.first("__place")))).alias("quantile")))


def two_sided_p(r: Column, n: Column) -> Column:
    """the p-value of a correlation r of n pairs (Student's t with n - 2 degrees of freedom), null below three pairs."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_beta(1 - min(1.0, x * x), (k - 2) / 2, 0.5) if k > 2 and x == x else None for x, k in zip(r, n, strict=True)], dtype="float64")

    return p(r, n.cast("double"))


def _beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h * math.exp(a * math.log(x) + b * math.log(1 - x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a


def failure_class(error: Column, sqi: Column) -> Column:
    """how an estimate failed."""
    return F.when((error > 30) & (sqi < 30), "low_sqi").when((error > 30) & sqi.isNull(), "invalid_bpm").when(error > 30, "large_error").when(sqi < 20, "low_sqi").otherwise("acceptable")


def rounded_all(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c)) for c in names})
