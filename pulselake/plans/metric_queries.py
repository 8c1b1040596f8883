"""Error, agreement and calibration queries (survey F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import corr, rounded
from ..operators import metrics as M
from .bindings import DOMAINS, PAIRS, SIGNAL, domains, pairs, signal, table
from .registry import query, r4

_ERRORS = f"""count(*) AS n, {r4('avg(abs(measured - reference))')} AS mae, {r4('sqrt(avg((measured - reference) ** 2))')} AS rmse, {r4('avg(measured - reference)')} AS bias, {r4('corr(measured, reference)')} AS pearson,
  {r4('avg(measured - reference) - 1.96 * stddev_samp(measured - reference)')} AS loa_low, {r4('avg(measured - reference) + 1.96 * stddev_samp(measured - reference)')} AS loa_high"""
_NAMES = ["mae", "rmse", "bias", "pearson", "loa_low", "loa_high"]


@query(f"WITH {PAIRS} SELECT method, {_ERRORS} FROM pairs GROUP BY method HAVING count(*) >= 10")
def f1_error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded_all(M.errors(pairs(spark, sf_dir), ["method"]).where("n >= 10"), _NAMES)


def _draws(rows: str) -> str:
    """SQL of the resamples of metrics.bootstrap(): each row of (session, row, ...) with its count w in each resample b."""
    steps = ", ".join(f"z{i + 1} AS (SELECT * EXCLUDE z, xor(z, z >> {shift}) * {factor} % 4294967296 AS z FROM z{i})" for i, (shift, factor) in enumerate(M.MIX))
    count = " + ".join(f"(z >= {p})::INT" for p in M.POISSON)
    return f"""{rows}, hashed AS (SELECT *, md5('42/' || session || '/' || row) AS h FROM rows),
z0 AS (SELECT * EXCLUDE h, (('0x' || h[1:8])::UBIGINT + b * (('0x' || h[9:16])::UBIGINT | 1)) % 4294967296 AS z FROM hashed, (SELECT unnest(range(1, 1001))::UBIGINT AS b)), {steps}, drawn AS (SELECT * EXCLUDE z, {count} AS w FROM z{len(M.MIX)})"""


_F1_ROWS = f"{SIGNAL}, rows AS (SELECT session, seq AS row, x AS m, x * 0.5 + event_id % 41 AS r, x - (x * 0.5 + event_id % 41) AS d FROM signal)"
_F1_ENDS = ", ".join(f"{r4(f'quantile_cont({name}, {q})')} AS {name}_{end}" for name in _NAMES for end, q in (("low", 0.025), ("high", 0.975)))


_F1_SUMS = f"""sums AS (SELECT session, b, sum(w)::DOUBLE AS n, sum(w * d) AS d, sum(w * d * d) AS dd, sum(w * abs(d)) AS ad, sum(w * m) AS m, sum(w * r) AS r, sum(w * m * m) AS mm, sum(w * r * r) AS rr, sum(w * m * r) AS mr FROM drawn GROUP BY ALL),
found AS (SELECT session, ad / n AS mae, sqrt(dd / n) AS rmse, d / n AS bias, CASE WHEN mm / n - (m / n) ** 2 > 1e-9 * mm / n AND rr / n - (r / n) ** 2 > 1e-9 * rr / n THEN (mr / n - m * r / n ** 2) / sqrt((mm / n - (m / n) ** 2) * (rr / n - (r / n) ** 2)) END AS pearson,
  d / n - 1.96 * sqrt(greatest(dd - d * d / n, 0) / nullif(n - 1, 0)) AS loa_low, d / n + 1.96 * sqrt(greatest(dd - d * d / n, 0) / nullif(n - 1, 0)) AS loa_high FROM sums WHERE n > 0),
ends AS (SELECT session, {_F1_ENDS} FROM found GROUP BY session)"""


@query(f"""WITH {_draws(_F1_ROWS)}, {_F1_SUMS}
SELECT * FROM (SELECT session, {_ERRORS} FROM (SELECT session, m AS measured, r AS reference FROM rows) x GROUP BY session HAVING count(*) >= 10) e JOIN ends USING (session)""")
def f1_metric_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of all sessions with intervals from 1,000 resamples."""
    x = signal(spark, sf_dir).select("session", F.col("seq").cast("bigint").alias("row"), F.col("x").alias("measured"), (F.col("x") * 0.5 + F.pmod("event_id", F.lit(41))).alias("reference"))
    got = M.error_intervals(x, ["session"])
    return M.rounded_all(got, [c for c in got.columns if c not in ("session", "n")])


_F2 = f"""WITH {_draws(SIGNAL + ", rows AS (SELECT session, seq AS row, abs(x - 50) AS e FROM signal)")}, means AS (SELECT session, b, sum(w * e) / sum(w) AS m FROM drawn WHERE w > 0 GROUP BY ALL)
SELECT session, {r4("quantile_cont(m, 0.025)")} AS low, {r4("quantile_cont(m, 0.975)")} AS high FROM means GROUP BY session"""


@query(_F2)
def f2_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of all sessions from 1,000 resamples, as in the reference."""
    x = signal(spark, sf_dir).select("session", F.col("seq").cast("bigint").alias("row"), F.abs(F.col("x") - 50).alias("e"))
    return M.rounded_all(M.bootstrap(x, ["session"], "row"), ["low", "high"])


@query(_F2)
def f2_bootstrap_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name that f2_bootstrap had while it stopped at a fifth of the sessions."""
    return f2_bootstrap(spark, sf_dir)


@query(f"""
WITH {PAIRS} SELECT domain, {r4('avg(measured - reference)')} AS bias, {r4('stddev_samp(measured - reference)')} AS sigma, {r4('avg(measured - reference) - 1.96 * stddev_samp(measured - reference)')} AS loa_low,
  {r4('avg(measured - reference) + 1.96 * stddev_samp(measured - reference)')} AS loa_high, {r4('corr(measured - reference, (measured + reference) / 2)')} AS proportional FROM pairs GROUP BY domain HAVING count(*) >= 3""")
def f3_bland_altman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded_all(M.bland_altman(pairs(spark, sf_dir), ["domain"]), ["bias", "sigma", "loa_low", "loa_high", "proportional"])


@query(f"""
WITH {PAIRS} SELECT method, {r4('avg(measured - reference)')} AS bias, {r4('stddev_pop(measured - reference)')} AS sigma FROM pairs GROUP BY method HAVING count(*) >= 5""")
def f3_bland_altman_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded_all(M.bland_altman(pairs(spark, sf_dir), ["method"], sample=False, least=5), ["bias", "sigma"]).select("method", "bias", "sigma")


@query(f"WITH {PAIRS} SELECT domain, method, {r4('corr(measured, reference)')} AS pearson FROM pairs GROUP BY ALL HAVING count(*) >= 3")
def f4_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = pairs(spark, sf_dir).groupBy("domain", "method").agg(F.count("*").alias("n"), corr(F.col("measured"), F.col("reference")).alias("pearson"))
    return g.where("n >= 3").select("domain", "method", rounded(F.col("pearson")).alias("pearson"))


@query()
def f4_pearson_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL has no Student's t; the p-value is tested against known values."""
    g = pairs(spark, sf_dir).groupBy("domain", "method").agg(F.count("*").alias("n"), corr(F.col("measured"), F.col("reference")).alias("pearson"))
    return g.where("n >= 3").select("domain", "method", "n", rounded(F.col("pearson")).alias("pearson"), rounded(M.two_sided_p(F.col("pearson"), F.col("n"))).alias("p_value"))


@query(f"WITH {PAIRS} SELECT domain, count(*) AS n, {r4('avg(measured)')} AS mean_measured, {r4('avg(reference)')} AS mean_reference, {r4('stddev_pop(measured)')} AS sd_measured, {r4('stddev_pop(reference)')} AS sd_reference FROM pairs GROUP BY domain")
def f5_light_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n"), rounded(F.avg("measured")).alias("mean_measured"), rounded(F.avg("reference")).alias("mean_reference"),
                                                      rounded(F.stddev_pop("measured")).alias("sd_measured"), rounded(F.stddev_pop("reference")).alias("sd_reference"))


@query(f"""
WITH {PAIRS}, m AS (SELECT method, avg(abs(measured - reference)) AS mae, sqrt(avg((measured - reference) ** 2)) AS rmse, corr(measured, reference) AS pearson FROM pairs GROUP BY method)
SELECT method, row_number() OVER (ORDER BY mae, method) AS rank_mae, row_number() OVER (ORDER BY rmse, method) AS rank_rmse, row_number() OVER (ORDER BY pearson DESC, method) AS rank_pearson FROM m""")
def f6_rank_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ranked(M.errors(pairs(spark, sf_dir), ["method"]), "method").select("method", *(F.col(c).cast("bigint").alias(c) for c in ("rank_mae", "rank_rmse", "rank_pearson")))


@query(f"""WITH {PAIRS}, m AS (SELECT method, avg(abs(measured - reference)) AS mae, sqrt(avg((measured - reference) ** 2)) AS rmse, corr(measured, reference) AS r FROM pairs GROUP BY method), f AS (SELECT * FROM m WHERE method = 'A')
SELECT m.method, {r4('m.mae - f.mae')} AS change, {r4('m.rmse - f.rmse')} AS rmse_change, {r4('f.r - m.r')} AS pearson_loss, m.mae - f.mae > 1.0 AS critical FROM m, f WHERE m.method <> 'A'""")
def f7_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each method loses against the full system, which is method A here."""
    return M.contributions(M.errors(pairs(spark, sf_dir), ["method"]), "method", "A").select("method", *(rounded(F.col(c)).alias(c) for c in ("change", "rmse_change", "pearson_loss")), "critical")


@query(f"""
WITH {PAIRS}, params(param, theta) AS (VALUES ('scale', 1.0), ('offset', 2.0)), m AS (
  SELECT param, theta, avg(abs(measured * CASE WHEN param = 'scale' THEN theta * 1.1 ELSE 1 END + CASE WHEN param = 'offset' THEN theta * 1.1 ELSE 0 END - reference)) AS up,
    avg(abs(measured * CASE WHEN param = 'scale' THEN theta * 0.9 ELSE 1 END + CASE WHEN param = 'offset' THEN theta * 0.9 ELSE 0 END - reference)) AS down,
    avg(abs(measured * CASE WHEN param = 'scale' THEN theta ELSE 1 END + CASE WHEN param = 'offset' THEN theta ELSE 0 END - reference)) AS base FROM pairs, params GROUP BY ALL)
SELECT param, {r4('abs((up - down) / (0.2 * theta)) * abs(theta) / base')} AS sensitivity, CASE WHEN abs((up - down) / (0.2 * theta)) * abs(theta) / base > 0.5 THEN 'critical' WHEN abs((up - down) / (0.2 * theta)) * abs(theta) / base < 0.05 THEN 'insensitive' ELSE 'moderate' END AS verdict FROM m""")
def f8_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Central differences of the mean absolute error, all parameters and directions in one pass."""
    p = pairs(spark, sf_dir)
    m, r = F.col("measured"), F.col("reference")
    changed = {"scale": (1.0, lambda t: F.abs(m * t - r)), "offset": (2.0, lambda t: F.abs(m + t - r))}
    got = p.agg(*(F.avg(f(t * s)).alias(f"{k}_{n}") for k, (t, f) in changed.items() for n, s in (("up", 1.1), ("down", 0.9), ("base", 1.0))))
    rows = F.array(*(F.struct(F.lit(k).alias("param"), (F.abs((F.col(f"{k}_up") - F.col(f"{k}_down")) / (0.2 * t)) * abs(t) / F.col(f"{k}_base")).alias("s")) for k, (t, _) in changed.items()))
    out = got.select(F.explode(rows).alias("x"))
    return out.select("x.param", rounded(F.col("x.s")).alias("sensitivity"), F.when(F.col("x.s") > 0.5, "critical").when(F.col("x.s") < 0.05, "insensitive").otherwise("moderate").alias("verdict"))


#: The reference's stress scenarios.
SCENARIOS = ("low_light", "head_rotation", "speaking", "blinking_burst", "compression", "skin_tone_dark", "fps_drop", "exposure_change")


@query(f"""WITH {PAIRS} SELECT [{", ".join(f"'{s}'" for s in SCENARIOS)}][least(8, 1 + floor((100 - confidence) / 6.5)::INT)] AS scenario, {_ERRORS} FROM pairs GROUP BY 1 HAVING count(*) >= 10""")
def f9_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics by scenario; a pair's scenario is made up from its confidence."""
    at = F.least(F.lit(8), 1 + F.floor((100 - F.col("confidence")) / 6.5)).cast("int")
    named = pairs(spark, sf_dir).withColumn("scenario", F.element_at(F.array(*map(F.lit, SCENARIOS)), at))
    return M.rounded_all(M.errors(named, ["scenario"]).where("n >= 10"), _NAMES)


@query(f"WITH {SIGNAL} SELECT session, count(*) AS frames, {r4('count(*) FILTER (roi = \'error\') / count(*)::DOUBLE')} AS error_rate, {r4('count(*) FILTER (x < 5) / count(*)::DOUBLE')} AS low_rate FROM signal GROUP BY session")
def f10_failure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return signal(spark, sf_dir).groupBy("session").agg(n.alias("frames"), rounded(F.count_if(F.col("roi") == "error") / n).alias("error_rate"), rounded(F.count_if(F.col("x") < 5) / n).alias("low_rate"))


@query(f"""
WITH {PAIRS} SELECT method, count(*) AS frames, count(*) FILTER (valid) AS predictions, count(*) FILTER (valid AND NOT rejected) AS aligned, {r4('count(*) FILTER (valid) / count(*)::DOUBLE')} AS prediction_rate,
  {r4('count(*) FILTER (valid AND NOT rejected) / nullif(count(*) FILTER (valid), 0)::DOUBLE')} AS alignment_rate FROM pairs GROUP BY method""")
def f11_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("valid") & ~F.col("rejected")
    return pairs(spark, sf_dir).groupBy("method").agg(F.count("*").alias("frames"), F.count_if("valid").alias("predictions"), F.count_if(ok).alias("aligned"), rounded(F.count_if("valid") / F.count("*")).alias("prediction_rate"),
                                                      rounded(F.try_divide(F.count_if(ok).cast("double"), F.count_if("valid").cast("double"))).alias("alignment_rate"))


@query(f"""
WITH {PAIRS}, c AS (SELECT CASE WHEN abs(measured - reference) > 30 AND confidence < 60 THEN 'low_sqi' WHEN abs(measured - reference) > 30 AND confidence IS NULL THEN 'invalid_bpm' WHEN abs(measured - reference) > 30 THEN 'large_error'
  WHEN confidence < 55 THEN 'low_sqi' ELSE 'acceptable' END AS failure FROM pairs) SELECT failure, count(*) AS n FROM c GROUP BY failure""")
def f12_failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence 50..100 stands for the quality index, moved to 0..100 by halves."""
    e, sqi = F.abs(F.col("measured") - F.col("reference")), F.when(F.col("confidence") < 55, 10).when(F.col("confidence") < 60, 25).otherwise(50)
    return pairs(spark, sf_dir).groupBy(M.failure_class(e, F.when(F.col("confidence").isNotNull(), sqi)).alias("failure")).agg(F.count("*").alias("n"))


@query(f"""
WITH {PAIRS}, p AS (SELECT *, abs(measured - reference) AS e, valid AND NOT rejected AS ok FROM pairs)
SELECT method, count(*) AS n, count(*) FILTER (ok) AS accepted, {r4('avg(e) FILTER (ok)')} AS mae, {r4('sqrt(avg(e * e) FILTER (ok))')} AS rmse, {r4('avg(measured - reference) FILTER (ok)')} AS bias, {r4('median(e) FILTER (ok)')} AS median_error,
  {r4('corr(measured, reference) FILTER (ok)')} AS pearson, {r4('avg(CASE WHEN ok THEN e ELSE abs(200 - reference) END)')} AS expected_risk,
  {r4('avg(CASE WHEN reference BETWEEN measured - sigma AND measured + sigma THEN 1.0 ELSE 0.0 END) FILTER (ok)')} AS coverage FROM p GROUP BY method""")
def f13_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded_all(M.calibration(pairs(spark, sf_dir), ["method"]), ["mae", "rmse", "bias", "median_error", "pearson", "expected_risk", "coverage"])


_BINS = f"""{PAIRS}, bins AS (SELECT method, floor(confidence / 10)::BIGINT AS bin, count(*) AS n, avg(confidence) AS mean_confidence, greatest(0.0, least(1.0, 1 - avg(abs(measured - reference)) / 100)) AS accuracy
  FROM pairs WHERE confidence >= 0 AND confidence < 100 GROUP BY ALL)"""


@query(f"WITH {_BINS} SELECT method, bin, n, {r4('mean_confidence')} AS mean_confidence, {r4('accuracy')} AS accuracy FROM bins WHERE n >= 10")
def f14_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded_all(M.reliability(pairs(spark, sf_dir), ["method"]), ["mean_confidence", "accuracy"])


@query(f"WITH {_BINS} SELECT method, {r4('sum(n * abs(accuracy - mean_confidence / 100)) / sum(n)')} AS ece FROM bins GROUP BY method")
def f14_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded_all(M.calibration_error(pairs(spark, sf_dir), ["method"]), ["ece"])


@query(f"""
WITH {SIGNAL}, last60 AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS back FROM signal)
SELECT session, {r4('avg(x)')} AS mean, {r4('stddev_pop(x)')} AS sd, {r4('avg(abs(x - 50))')} AS mae, {r4('sqrt(avg((x - 50) ** 2))')} AS rmse FROM last60 WHERE back <= 60 GROUP BY session""")
def f15_paper_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 60 values of each session against a constant of 50."""
    w = Window.partitionBy("session").orderBy(F.col("seq").desc())
    x = signal(spark, sf_dir).withColumn("back", F.row_number().over(w)).where("back <= 60")
    d = F.col("x") - 50
    return x.groupBy("session").agg(rounded(F.avg("x")).alias("mean"), rounded(F.stddev_pop("x")).alias("sd"), rounded(F.avg(F.abs(d))).alias("mae"), rounded(F.sqrt(F.avg(d * d))).alias("rmse"))


@query(f"""
WITH {PAIRS}, d AS (SELECT domain, avg(abs(measured - reference)) AS mae, sqrt(avg((measured - reference) ** 2)) AS rmse FROM pairs GROUP BY domain)
SELECT count(*) AS domains, {r4('avg(mae)')} AS macro_mae, {r4('stddev_pop(mae)')} AS sd_mae, {r4('avg(rmse)')} AS macro_rmse, arg_max(domain, mae) AS worst, {r4('max(mae)')} AS worst_mae FROM d""")
def f20_domain_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro means over domains, and the worst."""
    d = M.errors(pairs(spark, sf_dir), ["domain"], least=1)
    return d.agg(F.count("*").alias("domains"), rounded(F.avg("mae")).alias("macro_mae"), rounded(F.stddev_pop("mae")).alias("sd_mae"), rounded(F.avg("rmse")).alias("macro_rmse"), F.max_by("domain", "mae").alias("worst"), rounded(F.max("mae")).alias("worst_mae"))


@query(f"""
WITH {DOMAINS}, n AS (SELECT domain, count(*) FILTER (value < 3000) AS test, count(*) FILTER (value >= 3000) AS train FROM domains GROUP BY domain),
p AS (SELECT domain, test / sum(test) OVER () AS p_test, train / sum(train) OVER () AS p_train FROM n)
SELECT {r4('sum(CASE WHEN p_test > 0 AND p_train > 0 THEN p_test * ln(p_test / p_train) END)')} AS kl, bool_or(p_train = 0 AND p_test > 0) OR sum(CASE WHEN p_test > 0 AND p_train > 0 THEN p_test * ln(p_test / p_train) END) > 0.1 AS shifted FROM p""")
def f20_domain_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the domains of samples of a low value from those of the rest."""
    n = domains(spark, sf_dir).groupBy("domain").agg(F.count_if(F.col("value") < 3000).alias("test"), F.count_if(F.col("value") >= 3000).alias("train"))
    total = n.agg(F.sum("test").alias("all_test"), F.sum("train").alias("all_train"))
    p = n.crossJoin(F.broadcast(total)).select((F.col("test") / F.col("all_test")).alias("p"), (F.col("train") / F.col("all_train")).alias("q"))  # one row on the right
    kl = F.sum(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("p") * F.log(F.col("p") / F.col("q"))))
    return p.agg(rounded(kl).alias("kl"), (F.bool_or((F.col("q") == 0) & (F.col("p") > 0)) | (kl > 0.1)).alias("shifted"))


@query("""
WITH o AS (SELECT o_custkey AS user, o_totalprice AS v, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders)
SELECT "user", count(*) AS sessions, (floor(avg(CASE WHEN v > 0 THEN v END) * 1e4 + 0.500001) / 1e4 + 0.0) AS mean, count(*) FILTER (v > 300000) AS alerts FROM o WHERE back <= 20 GROUP BY "user" """)
def f21_session_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 sessions of each user (orders here); values of 0 mean none."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.col("o_totalprice").alias("v"), "o_orderdate", "o_orderkey")
    x = o.withColumn("back", F.row_number().over(Window.partitionBy("user").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()))).where("back <= 20")
    return x.groupBy("user").agg(F.count("*").alias("sessions"), rounded(F.avg(F.when(F.col("v") > 0, F.col("v")))).alias("mean"), F.count_if(F.col("v") > 300000).alias("alerts"))


@query(f"""
WITH {PAIRS}, long AS (UNPIVOT (SELECT measured, reference, confidence, sigma FROM pairs) ON measured, reference, confidence, sigma INTO NAME metric VALUE v)
SELECT metric, count(*) AS n, {r4('avg(v)')} AS mean, {r4('stddev_pop(v)')} AS sd, {r4('min(v)')} AS low, {r4('max(v)')} AS high FROM long GROUP BY metric""")
def f22_experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["measured", "reference", "confidence", "sigma"]
    x = pairs(spark, sf_dir).select(*names).unpivot([], names, "metric", "v")
    return x.groupBy("metric").agg(F.count("*").alias("n"), rounded(F.avg("v")).alias("mean"), rounded(F.stddev_pop("v")).alias("sd"), rounded(F.min("v")).alias("low"), rounded(F.max("v")).alias("high"))
