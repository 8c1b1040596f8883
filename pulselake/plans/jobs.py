"""Whole jobs made of the operators (survey A9-A12, H9, I7, J9, M1, M3, M4)."""

from __future__ import annotations

import inspect
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, ratio, rounded
from ..operators import alignment, folds, fusion, gates, metrics
from ..sources import ground_truth
from .bindings import PAIRS, SIGNAL, pairs, signal
from .registry import SQL, query, r4
from .metric_queries import _ERRORS, _F1_SUMS, _draws
from .stream_queries import greedy_sql
from .temporal_queries import G16, G17


def evaluate(pred: DataFrame, ref: DataFrame, tolerance: float, compat: bool = False, least: int = 10) -> DataFrame:
    """M1, M4: one-to-one alignment of pred to ref (session, id, t, x), then errors by session beside the alignment's summary."""
    m = alignment.greedy(pred, ref, tolerance, compat=compat).withColumnsRenamed({"pred_x": "measured", "ref_x": "reference"})
    return alignment.summary(pred, m).join(metrics.errors(m, ["session"], least=least), "session", "left")


def benchmark(pred: DataFrame, ref: DataFrame, tolerance: float, rounds: int = 1000, least: int = 10) -> DataFrame:
    """M3, M4: (breakdown, name, n, each metric of F1 with its interval) of pred aligned one to one to ref (session, id, t, x): a row for
    each session and one for all of them; groups under `least` pairs have none."""
    m = alignment.greedy(pred, ref, tolerance).select(F.col("session").cast("string").alias("session"), F.col("pred_id").alias("row"), F.col("pred_x").alias("measured"), F.col("ref_x").alias("reference"))
    groups = F.array(F.struct(F.lit("session").alias("breakdown"), F.col("session").alias("name")), F.struct(F.lit("overall").alias("breakdown"), F.lit("all").alias("name")))
    rows = m.withColumn("g", F.explode(groups)).select("g.*", "row", "measured", "reference")
    return metrics.error_intervals(rows, ["breakdown", "name"], rounds, least=least)


def run_benchmark(pred: DataFrame, ref: DataFrame, path: str, tolerance: float, name: str, **more) -> str:
    """M3, M4: benchmark() from two series to what is kept of it under path: `results` (JSON, nulls left out), `alignment` (JSON, a row a
    session), `config` and `report` (Markdown, a line for each group). Returns the report's head and its overall line."""
    spark = pred.sparkSession
    found = benchmark(pred, ref, tolerance, **more)
    ground_truth.save_json(found, f"{path}/results")
    ground_truth.save_json(alignment.summary(pred, alignment.greedy(pred, ref, tolerance)), f"{path}/alignment")
    saved_config({"name": name, "tolerance": tolerance, **more}, f"{path}/config", spark)
    columns = ["breakdown", "name", "n", "mae", "mae_low", "mae_high", "rmse", "bias", "pearson"]
    kept = ground_truth.load_json(spark, f"{path}/results", found.schema)
    lines = kept.orderBy("breakdown", F.col("name")).select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string") if c in ("breakdown", "name", "n") else F.format_string("%.3f", c), F.lit("")) for c in columns)), F.lit(" |")).alias("line"))
    lines.coalesce(1).write.mode("overwrite").text(f"{path}/report")
    total = kept.where("breakdown = 'overall'").first()
    head = [f"# {name}", "", f"Pairs: {total['n']}, mean absolute error {total['mae']:.3f} ({total['mae_low']:.3f} to {total['mae_high']:.3f})" if total else "Too few pairs for any metric", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*head, *(r["line"] for r in lines.where(F.col("line").startswith("| overall")).collect())])  # one line


def configuration() -> dict[str, dict[str, str]]:
    """M5: the defaults of all operators, by module and function, as text (what saved_config() keeps beside a run)."""
    from ..operators import estimators, experiments, filters, frames, grids, splits

    out = {}
    for module in (alignment, estimators, experiments, filters, folds, frames, fusion, gates, grids, metrics, splits):
        for name, f in inspect.getmembers(module, inspect.isfunction):
            defaults = {p.name: repr(p.default) for p in inspect.signature(f).parameters.values() if p.default is not inspect.Parameter.empty}
            if f.__module__ == module.__name__ and not name.startswith("_") and defaults:
                out[f"{module.__name__.rpartition('.')[2]}.{name}"] = defaults
    return out


def reliable(fused: DataFrame) -> DataFrame:
    """H9: fused (series, frame, value, sigma, confidence, direct, cv) with the temporal state, the verdict, the failed checks and the final estimate.

    The final value is 0.7 of the fused and 0.3 of the direct estimate of the same frame. Its confidence is the mean of the fused
    one, of the temporal state's (G16; times 0.8 in warm-up, 0.6 while degrading or uncertain, 0.2 else) and of the plausibility's
    (G17: 95, 60 or 20; jumps are against the frame before, T15; what confidence lacks counts as the spectrum's instability, cv is the estimates' spread).
    """
    rows = fused.withColumn("instability", 1 - F.col("confidence") / 100).withColumn("harmonic_ratio", F.lit(0.0)).withColumnsRenamed({"series": "session", "frame": "seq"})
    state = folds.run(rows.select("session", "seq", F.col("seq").cast("double").alias("t"), F.col("confidence").alias("x")), "reliability").select("session", "seq", "state")
    judged = gates.plausible(rows.withColumn("x", F.col("value"))).join(state, ["session", "seq"], "left").withColumnsRenamed({"session": "series", "seq": "frame"})
    share = F.when(F.col("state") == "STABLE", 1.0).when(F.col("state") == "WARMUP", 0.8).when(F.col("state").isin("DEGRADING", "UNCERTAIN"), 0.6).otherwise(0.2)
    sure = F.when(F.col("verdict") == "PLAUSIBLE", 95.0).when(F.col("verdict") == "UNCERTAIN", 60.0).otherwise(20.0)
    return judged.withColumn("final", 0.7 * F.col("value") + 0.3 * F.col("direct")).withColumn("final_confidence", (F.col("confidence") + share * F.col("confidence") + sure) / 3)


def probabilistic(df: DataFrame, low: float = 40.0, step: float = 0.5, n: int = 321) -> DataFrame:
    """(frame, bpm): the mean of the product of Gaussian likelihoods of a frame's estimates (frame, bpm, sqi), on a grid.

    The product of Gaussians is known from two sums, so the grid is made once for each frame, not for each estimate.
    """
    sigma = 10 * (1 - clip(F.col("sqi") / 100, 0, 1)) + 0.8
    g = df.where("bpm > 0 AND sqi >= 0").groupBy("frame").agg(F.sum(1 / (sigma * sigma)).alias("p"), F.sum(F.col("bpm") / (sigma * sigma)).alias("px"))
    g = g.withColumn("mid", F.least(F.lit(low + step * (n - 1)), F.greatest(F.lit(low), F.col("px") / F.col("p"))))
    g = g.withColumn("mid", low + step * F.round((F.col("mid") - low) / step))  # the likeliest point of the grid: many estimates don't make all weights 0
    grid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + step * i)
    like = lambda x: F.exp(-0.5 * F.col("p") * ((x - F.col("px") / F.col("p")) * (x - F.col("px") / F.col("p")) - (F.col("mid") - F.col("px") / F.col("p")) * (F.col("mid") - F.col("px") / F.col("p"))))
    total = F.aggregate(grid, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("wx")), lambda a, x: F.struct((a.w + like(x)).alias("w"), (a.wx + like(x) * x).alias("wx")))
    return g.select("frame", total.alias("t")).select("frame", ratio(F.col("t.wx"), F.col("t.w")).alias("bpm"))


def report(summary: DataFrame, least: int = 10) -> str:
    """A Markdown report of an experiment's breakdown (a row for each group) with its limitations."""
    rows = summary.orderBy("breakdown", "name").collect()
    total = next((r for r in rows if r["breakdown"] == "overall"), None)
    limits = [x for x in (None if total is None or total["windows"] >= least else f"only {total['windows']} windows", None if total is None or 2 * total["valid"] >= total["windows"] else "fewer than half of the windows are valid") if x]
    lines = ["| breakdown | name | windows | valid | mae | rmse | bias |", "| --- | --- | --- | --- | --- | --- | --- |"]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join(lines + ["", "Limitations: " + ("; ".join(limits) or "none found")])


def manifest(media: DataFrame, series: DataFrame, path: str) -> None:
    """One JSON row for each session: media (session, start, duration) beside its reference's checks, the offset and whether they overlap."""
    c = ground_truth.checks(series, ["session"]).join(series.groupBy("session").agg(F.min("ts").alias("first"), F.max("ts").alias("last")), "session")
    offset = F.col("first") - F.col("start")
    out = media.join(c, "session", "left").withColumn("offset", offset).withColumn("overlaps", (offset <= F.col("duration")) & (F.col("last") - F.col("start") >= 0))
    ground_truth.save_json(out, path)


def capped_log(rows: DataFrame, path: str, most: int = 10_000) -> None:
    """A session's first `most` rows as CSV, a folder for each session."""
    w = Window.partitionBy("session").orderBy("t", "seq")
    rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k").write.mode("append").partitionBy("session").option("header", True).csv(path)


def assert_reproducible(make, runs: int = 3) -> None:
    """The DataFrame that make() gives has the same rows in every run."""
    first = make()
    for _ in range(runs - 1):
        again = make()
        if first.exceptAll(again).limit(1).count() or again.exceptAll(first).limit(1).count():
            raise AssertionError("the runs differ")


def saved_config(config: dict, path: str, spark: SparkSession) -> None:
    """A run's configuration as one JSON row."""
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string").write.mode("overwrite").text(path)


def skin(pixels: DataFrame) -> DataFrame:
    """I8: pixels (frame, r, g, b in 0..255) that are skin by chrominance bounds, neither dark nor burnt out."""
    cr = 0.5 * F.col("r") - 0.4187 * F.col("g") - 0.0813 * F.col("b") + 128
    cb = -0.1687 * F.col("r") - 0.3313 * F.col("g") + 0.5 * F.col("b") + 128
    y = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    return pixels.where(cr.between(133, 173) & cb.between(77, 127) & y.between(30, 235))


@query(f"""WITH {greedy_sql('<= 86400')}, n AS (SELECT session, count(*) AS predictions FROM pred GROUP BY session),
m AS (SELECT session, count(*) AS matches, avg(apart) AS mean_apart, max(apart) AS max_apart, avg(abs(pred_x - ref_x)) AS mae, sqrt(avg((pred_x - ref_x) ** 2)) AS rmse, avg(pred_x - ref_x) AS bias, CASE WHEN stddev_pop(pred_x) > 0 AND stddev_pop(ref_x) > 0 THEN corr(pred_x, ref_x) END AS pearson, stddev_samp(pred_x - ref_x) AS sd FROM matched GROUP BY session)
SELECT session, predictions, coalesce(matches, 0) AS matches, {r4('mean_apart')} AS mean_apart, {r4('max_apart')} AS max_apart, predictions - coalesce(matches, 0) AS unmatched, {r4('coalesce(matches, 0) / predictions::DOUBLE')} AS rate, matches AS n,
  {", ".join(f"CASE WHEN matches >= 5 THEN {r4(e)} END AS {n}" for n, e in (("mae", "mae"), ("rmse", "rmse"), ("bias", "bias"), ("pearson", "pearson"), ("loa_low", "bias - 1.96 * sd"), ("loa_high", "bias + 1.96 * sd")))} FROM n LEFT JOIN m USING (session)""")
def m1_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir).select("session", F.col("event_id").alias("id"), "t", "x", "roi")
    out = evaluate(s.where("roi = 'view'").drop("roi"), s.where("roi = 'click'").drop("roi"), alignment.days(1), least=5)
    return out.select(*(rounded(F.col(c)).alias(c) if t == "double" else c for c, t in out.dtypes))


_M3_ROWS = greedy_sql("<= 86400") + ", rows AS (SELECT 'session/' || session AS session, pred_id AS row, pred_x AS m, ref_x AS r, pred_x - ref_x AS d FROM matched UNION ALL SELECT 'overall/all', pred_id, pred_x, ref_x, pred_x - ref_x FROM matched)"


@query(f"""WITH {_draws(_M3_ROWS)}, {_F1_SUMS}
SELECT split_part(session, '/', 1) AS breakdown, split_part(session, '/', 2) AS name, * EXCLUDE session FROM (SELECT session, {_ERRORS} FROM (SELECT session, m AS measured, r AS reference FROM rows) x GROUP BY session HAVING count(*) >= 10) e JOIN ends USING (session)""")
def m3_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From two series to metrics with intervals, by session and overall; view events stand for predictions, click events for references."""
    s = signal(spark, sf_dir).select("session", F.col("event_id").alias("id"), "t", "x", "roi")
    out = benchmark(s.where("roi = 'view'").drop("roi"), s.where("roi = 'click'").drop("roi"), alignment.days(1))
    return metrics.rounded_all(out, [c for c, t in out.dtypes if t == "double"])


@query(f"""WITH {SIGNAL}, e AS (SELECT session AS frame, x + 30 AS bpm, (event_id % 101)::DOUBLE AS sqi FROM signal), g AS (SELECT frame, sum(1 / s2) AS p, sum(bpm / s2) AS px FROM (SELECT frame, bpm, (10 * (1 - sqi / 100) + 0.8) ** 2 AS s2 FROM e WHERE bpm > 0) GROUP BY frame),
l AS (SELECT frame, 40 + 0.5 * i AS v, -0.5 * p * ((40 + 0.5 * i - px / p) ** 2 - (least(200, greatest(40, px / p)) - px / p) ** 2) AS z FROM g, range(321) r(i)) SELECT frame, {r4('sum(exp(z) * v) / sum(exp(z))')} AS bpm FROM l GROUP BY frame""")
def g5_probabilistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posterior(signal(spark, sf_dir))


@query(SQL["g5_probabilistic"])
def g5_probabilistic_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name that g5_probabilistic had while it stopped after five estimates."""
    return _posterior(signal(spark, sf_dir))


def _posterior(samples: DataFrame) -> DataFrame:
    s = samples.select(F.col("session").alias("frame"), (F.col("x") + 30).alias("bpm"), F.pmod("event_id", F.lit(101)).cast("double").alias("sqi"))
    return probabilistic(s).select("frame", rounded(F.col("bpm")).alias("bpm"))


@query(f"""WITH RECURSIVE {PAIRS}, est AS (SELECT id AS frame, id % 20 AS series, measured AS x, confidence, 1 / (sigma * sigma + 1e-6) AS p FROM pairs),
e AS (SELECT series AS session, frame AS seq, sum(x * p) / sum(p) AS value, max(confidence) AS confidence, arg_max(x, (confidence, x)) AS direct, stddev_pop(x) / avg(x) AS cv FROM est GROUP BY ALL),
i AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY seq) AS seq, value AS x, 1 - confidence / 100 AS instability, 0.0 AS harmonic, cv, seq AS frame, confidence, direct FROM e), {G17.replace("TIMEOUT", "300")},
c AS (SELECT session, seq, confidence AS c FROM i), {G16.replace(" s AS (", " s2 AS (").replace("s AS (SELECT *, CASE WHEN count(*) OVER w >= 3", "s2 AS (SELECT *, CASE WHEN count(*) OVER w >= 3").replace("FROM s UNION", "FROM s2 UNION").replace("JOIN s ON s.session", "JOIN s2 s ON s.session")},
o AS (SELECT i.session AS series, i.frame, x AS value, confidence, direct, state, CASE WHEN invalid THEN 'INVALID' WHEN failures <> '' THEN 'UNCERTAIN' ELSE 'PLAUSIBLE' END AS verdict FROM i JOIN f USING (session, seq) JOIN k USING (session, seq))
SELECT series, frame, {r4('value')} AS value, state, verdict, {r4('0.7 * value + 0.3 * direct')} AS final,
  {r4("(confidence + confidence * CASE WHEN state = 'STABLE' THEN 1.0 WHEN state = 'WARMUP' THEN 0.8 WHEN state IN ('DEGRADING', 'UNCERTAIN') THEN 0.6 ELSE 0.2 END + CASE verdict WHEN 'PLAUSIBLE' THEN 95 WHEN 'UNCERTAIN' THEN 60 ELSE 20 END) / 3")} AS final_confidence FROM o""")
def h9_reliable_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in order stand for frames of a series; the most confident estimate of a part is the direct one."""
    p = pairs(spark, sf_dir).select(F.col("id").alias("frame"), F.col("measured").alias("x"), "sigma", "confidence")
    more = p.groupBy("frame").agg(F.max(F.struct("confidence", "x")).alias("top"), (F.stddev_pop("x") / F.avg("x")).alias("cv")).select("frame", F.col("top.confidence").alias("confidence"), F.col("top.x").alias("direct"), "cv")
    f = fusion.fuse(p, "variance").select("frame", "value", "sigma").join(more, "frame")
    out = reliable(f.withColumn("series", F.col("frame") % 20))
    return out.select("series", "frame", rounded(F.col("value")).alias("value"), "state", "verdict", rounded(F.col("final")).alias("final"), rounded(F.col("final_confidence")).alias("final_confidence"))
