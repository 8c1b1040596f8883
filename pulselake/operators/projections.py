"""Three-channel streams to one pulse signal (survey B).

What a method needs of its stream is a few moments, so they are aggregated (with a map side) and joined back: a long
stream is never sorted or held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .estimators import independent_pulse

_TINY = 1e-9


def _std(a: dict[str, float], cov: dict[tuple[str, str], Column]) -> Column:
    """Deviation of a linear combination from the channels' covariances."""
    total = F.lit(0.0)
    for x, p in a.items():
        for y, q in a.items():
            total = total + p * q * cov[tuple(sorted((x, y)))]
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def _moments(df: DataFrame, key: str) -> DataFrame:
    c = ("r", "g", "b")
    cov = [F.covar_pop(x, y).alias(f"c_{x}{y}") for i, x in enumerate(c) for y in c[i:]]
    line = [F.regr_slope("g", F.col("seq").cast("double")).alias("slope"), F.regr_intercept("g", F.col("seq").cast("double")).alias("level")]
    return df.join(df.groupBy(key).agg(*(F.avg(x).alias(f"m_{x}") for x in c), *cov, *line), key)


def _covariance(scaled: bool) -> dict[tuple[str, str], Column]:
    """Covariances of the channels, or of the channels over their means."""
    out = {}
    for x, y in (("r", "r"), ("r", "g"), ("r", "b"), ("g", "g"), ("g", "b"), ("b", "b")):
        v = F.col(f"c_{x}{y}")
        out[tuple(sorted((x, y)))] = F.try_divide(v, F.col(f"m_{x}") * F.col(f"m_{y}")) if scaled else v
    return out


def _scaled() -> tuple[Column, Column, Column]:
    return tuple(F.try_divide(F.col(x), F.col(f"m_{x}")) for x in ("r", "g", "b"))


def green(df: DataFrame, key: str = "session") -> DataFrame:
    """B1: the green channel without its linear trend."""
    return _moments(df, key).select(key, "seq", (F.col("g") - F.col("level") - F.col("slope") * F.col("seq")).alias("y"))


def chrom(df: DataFrame, key: str = "session") -> DataFrame:
    """B2: xs - (sd xs / sd ys) ys with xs = 3R - 2G, ys = 1.5R + G - 1.5B of the channels over their means."""
    m, cov = _moments(df, key), _covariance(True)
    r, g, b = _scaled()
    alpha = _std({"r": 3.0, "g": -2.0}, cov) / (_std({"r": 1.5, "g": 1.0, "b": -1.5}, cov) + _TINY)
    return m.select(key, "seq", (3 * r - 2 * g - alpha * (1.5 * r + g - 1.5 * b)).alias("y"))


def pos(df: DataFrame, key: str = "session") -> DataFrame:
    """h = s1 + alpha s2 with s1 = G - B, s2 = G + B - 2R and alpha = sd s1 / sd s2; also m = s1 - s2 / alpha and the parts."""
    m, cov = _moments(df, key), _covariance(True)
    r, g, b = _scaled()
    alpha = _std({"g": 1.0, "b": -1.0}, cov) / (_std({"g": 1.0, "b": 1.0, "r": -2.0}, cov) + _TINY)
    out = m.select(key, "seq", (g - b).alias("s1"), (g + b - 2 * r).alias("s2"), alpha.alias("alpha"))
    return out.select(key, "seq", (F.col("s1") + F.col("alpha") * F.col("s2")).alias("y"), (F.col("s1") - F.try_divide(F.col("s2"), F.col("alpha"))).alias("m"), "alpha", "s1", "s2")


def core_pos(df: DataFrame, key: str = "session") -> DataFrame:
    """The other formula, Pn / sd Pn - (sd Pn / sd S2) (S2 / sd S2) with Pn = G - B, S2 = G + B of scaled channels."""
    m, cov = _moments(df, key), _covariance(True)
    _, g, b = _scaled()
    p, q = _std({"g": 1.0, "b": -1.0}, cov), _std({"g": 1.0, "b": 1.0}, cov)
    return m.select(key, "seq", (F.try_divide(g - b, p) - F.try_divide(p, q) * F.try_divide(g + b, q)).alias("y"))


METHODS = {"GREEN": green, "CHROM": chrom, "POS": pos, "ICA": lambda df, key="session": independent_pulse(df.withColumnRenamed(key, "session")).withColumnRenamed("session", key)}


def project(df: DataFrame, name: str, key: str = "session") -> DataFrame:
    """By name in any case; unknown names are POS."""
    return METHODS.get(name.upper(), pos)(df, key).select(key, "seq", "y")


def moving_means(df: DataFrame, size: int, values: tuple[str, ...]) -> DataFrame:
    """df (session, seq from 1 without gaps, values) with a mean of the last `size` samples for each of values: `<value>_mean`.

    Blocks of `size` samples have sums that grow from either end. The last samples are the end of one block and the beginning of
    the next, so a sample is added twice, however large `size` is, and nothing is subtracted. Null values don't count.
    """
    block = F.floor((F.col("seq") - 1) / size)
    own = Window.partitionBy("session", "__block")
    sums = lambda w: F.struct(*(f(v).over(w).alias(f"{v}_{name}") for v in values for name, f in (("sum", F.sum), ("n", F.count))))
    x = df.withColumn("__block", block).withColumn("__end", sums(own.orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("__begin", sums(own.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    # the end of the block before; a complete block needs none
    x = x.withColumn("__end", F.when(F.col("seq") % size != 0, F.lag("__end", size - 1).over(Window.partitionBy("session").orderBy("__block", "seq"))))
    total = lambda c: F.coalesce(F.col(f"__end.{c}"), F.lit(0)) + F.coalesce(F.col(f"__begin.{c}"), F.lit(0))
    return x.withColumns({f"{v}_mean": F.try_divide(total(f"{v}_sum"), total(f"{v}_n")) for v in values}).drop("__block", "__end", "__begin")


def detrended(df: DataFrame, window: int = 45) -> DataFrame:
    """Df (session, seq from 1, x) with y: the line through x removed, then the mean of the `window` samples around, then scaled.

    Sessions of up to `window` samples have no moving mean. Beyond its ends a session goes on as its mirror image (without the
    end itself): the first and last samples are copied there. Sessions that don't vary aren't scaled.
    """
    half = window // 2
    line = df.groupBy("session").agg(F.regr_slope("x", F.col("seq").cast("double")).alias("slope"), F.regr_intercept("x", F.col("seq").cast("double")).alias("level"), F.count("*").alias("n"))
    d = df.join(line, "session").withColumn("d", F.col("x") - F.coalesce(F.col("level") + F.col("slope") * F.col("seq"), "x"))
    ends = F.array(F.col("seq"), F.when((F.col("n") > window) & F.col("seq").between(2, half + 1), 2 - F.col("seq")), F.when((F.col("n") > window) & F.col("seq").between(F.col("n") - half, F.col("n") - 1), 2 * F.col("n") - F.col("seq")))
    p = d.withColumn("at", F.explode(F.array_compact(ends.cast("array<bigint>"))))
    around = Window.partitionBy("session").orderBy("at").rowsBetween(-half, half)
    y = F.when(F.col("n") > window, F.col("d") - F.avg("d").over(around)).otherwise(F.col("d"))
    p = p.withColumn("y", y).where(F.col("at") == F.col("seq"))
    scale = F.stddev_pop("y").over(Window.partitionBy("session"))
    return p.withColumn("y", F.when(scale > 1e-9, F.col("y") / scale).otherwise(F.col("y"))).drop("slope", "level", "n", "d", "at")
