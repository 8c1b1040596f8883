"""Windowed and stateful queries per ordered key (survey G)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quality
from ..functions.numeric import clip, rounded, settled
from ..operators import folds, frames, gates  # noqa: F401  (frames adds folds)
from .bindings import SAMPLES, SIGNAL, WINDOWS, samples, signal, windows
from .registry import query, r4


def _ordered(n: int | None = None, last: int = 0):
    w = Window.partitionBy("session").orderBy("seq")
    return w.rowsBetween(-n, last) if n is not None else w


def _seq(df: DataFrame) -> DataFrame:
    return df.withColumn("seq", F.col("seq").cast("bigint"))


@query(f"""WITH {SIGNAL}, p AS (SELECT session, seq, x FROM signal WHERE x > 0)
SELECT session, seq, CASE WHEN count(*) OVER w < 3 THEN {r4('x')} ELSE {r4('median(x) OVER w')} END AS y FROM p WINDOW w AS (PARTITION BY session ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def g1_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _ordered(9)
    y = F.when(F.count("*").over(w) < 3, F.col("x")).otherwise(F.percentile("x", 0.5).over(w))
    return _seq(signal(spark, sf_dir)).where("x > 0").select("session", "seq", rounded(y).alias("y"))


def _fold(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _seq(signal(spark, sf_dir)).withColumn("sqi", F.pmod("event_id", F.lit(101)).cast("double"))
        return folds.run(s, name)

    return run


@query(f"""
WITH RECURSIVE {SIGNAL}, s AS (SELECT session, seq, x, (event_id % 101)::DOUBLE AS sqi FROM signal),
k AS (
  SELECT session, seq, x AS y, 0.0::DOUBLE AS v, 100.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS c FROM s WHERE seq = 1
  UNION ALL
  SELECT session, seq, least(200.0, greatest(42.0, px + a1 / (a1 + noise) * (x - px))), v + b1 / (a1 + noise) * (x - px), (1 - a1 / (a1 + noise)) * a1, (1 - a1 / (a1 + noise)) * b1, c1 - b1 / (a1 + noise) * b1
  FROM (SELECT s.session, s.seq, s.x, k.y + k.v AS px, k.v, k.a + 2 * k.b + k.c + 1.0 AS a1, k.b + k.c AS b1, k.c + 0.01 AS c1, 4.0 + 21.0 * (1 - CASE WHEN s.sqi = 0 THEN 0.5 ELSE least(1.0, s.sqi / 100) END) AS noise
        FROM k JOIN s ON s.session = k.session AND s.seq = k.seq + 1) n)
SELECT session, seq, {r4('y')} AS y FROM k""")
def g3_kalman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold("kalman")(spark, sf_dir).withColumn("y", rounded(F.col("y")))


_SMOOTH = """
WITH RECURSIVE {SIGNAL}, k AS (
  SELECT DISTINCT session, 0::BIGINT AS seq, NULL::DOUBLE AS last, NULL::DOUBLE AS mean, []::DOUBLE[] AS recent, []::DOUBLE[] AS known, []::DOUBLE[] AS steady, NULL::DOUBLE AS kx, 0::DOUBLE AS kv, 100::DOUBLE AS ka, 0::DOUBLE AS kb, 1::DOUBLE AS kc, false AS locked, 0::DOUBLE AS y FROM signal
  UNION ALL
  SELECT session, seq, CASE WHEN ok THEN x4 ELSE last END, CASE WHEN ok THEN mean2 ELSE mean END, recent2, known2, steady2, CASE WHEN ok THEN f ELSE kx END, CASE WHEN ok AND kx IS NOT NULL THEN kv + b / (a + 12) * miss ELSE kv END,
    CASE WHEN ok AND kx IS NOT NULL THEN (1 - a / (a + 12)) * a ELSE ka END, CASE WHEN ok AND kx IS NOT NULL THEN (1 - a / (a + 12)) * b ELSE kb END, CASE WHEN ok AND kx IS NOT NULL THEN c - b / (a + 12) * b ELSE kc END,
    CASE WHEN ok AND len(steady2) >= 200 AND len(known2) >= 17 THEN list_stddev_pop(steady2) <= 3.5 ELSE locked END, CASE WHEN ok THEN f ELSE coalesce(mean, 0) END
  FROM (SELECT *, CASE WHEN ok THEN list_append(steady, f)[-240:] ELSE steady END AS steady2 FROM (
    SELECT *, CASE WHEN kx IS NULL THEN mean2 ELSE least(200.0, greatest(42.0, kx + kv + a / (a + 12) * miss)) END AS f FROM (
    SELECT *, mean2 - (kx + kv) AS miss, ka + 2 * kb + kc + 0.5 AS a, kb + kc AS b, kc + 0.005 AS c FROM (
    SELECT *, 0.25 * list_median(known2) + 0.75 * coalesce(mean, list_median(known2)) AS mean2 FROM (
    SELECT *, raw > 0 AND NOT dropped AND (last IS NULL OR abs(x4 - last) <= CASE WHEN len(known) >= 17 THEN 12.0 ELSE 30.0 END) AS ok, CASE WHEN raw <= 0 OR dropped THEN known ELSE list_append(known, x4)[-17:] END AS known2 FROM (
    SELECT *, odd AND mean IS NULL AS dropped, CASE WHEN odd AND mean IS NOT NULL THEN 0.2 * x2 + 0.8 * mean ELSE x2 END AS x4,
           CASE WHEN raw <= 0 THEN recent WHEN odd AND mean IS NOT NULL THEN list_append(recent, 0.2 * x2 + 0.8 * mean)[-12:] ELSE list_append(recent, x2)[-12:] END AS recent2 FROM (
    SELECT *, len(recent) >= 2 AND len(list_filter(recent[-2:], lambda r: abs(x2 - r) > 8)) > 0 AS odd FROM (
    SELECT *, CASE WHEN last IS NOT NULL AND abs(x1 - last) > 10 THEN 0.1 * x1 + 0.9 * last ELSE x1 END AS x2 FROM (
    SELECT k.* EXCLUDE (seq, y), s.seq, s.x AS raw, CASE WHEN k.last IS NULL THEN s.x ELSE 0.3 * s.x + 0.7 * k.last END AS x1 FROM k JOIN signal s ON s.session = k.session AND s.seq = k.seq + 1
    ) t1) t2) t3) t4) t5) t6) t7) t8) t9)
SELECT session, seq, {y} AS y, locked FROM k WHERE seq > 0"""


@query(_SMOOTH.format(SIGNAL=SIGNAL, y=r4("y")))
def g2_smoother(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold("smoother")(spark, sf_dir).withColumn("y", rounded(F.col("y")))


@query()
def g4_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold("bayes")(spark, sf_dir)


def _from_zero(first: str, row: str, step: str) -> str:
    """SQL of a fold: k begins at seq 0 with `first`, `row` is each next row's expressions and `step` the next state from them."""
    return f"k AS (SELECT DISTINCT session, 0::BIGINT AS seq, {first} FROM s UNION ALL SELECT session, seq, {step} FROM (SELECT s.session, s.seq, {row} FROM k JOIN s ON s.session = k.session AND s.seq = k.seq + 1) n)"


@query(f"""WITH RECURSIVE {SIGNAL}, s AS (SELECT session, seq, x - 2 AS z, (event_id % 101)::DOUBLE AS sqi, (event_id % 11) / 10.0 AS agree, (4 + 21 * (1 - event_id % 101 / 100.0)) * greatest(1.0, 1 / (event_id % 11 / 10.0 + 0.1)) AS noise FROM signal),
{_from_zero("75.0::DOUBLE AS x, 0.0::DOUBLE AS v, 100.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS c, 0 AS n, 0.0::DOUBLE AS noise, 0.0::DOUBLE AS sqi, 0.0::DOUBLE AS agree",
 "s.z, s.noise AS r, s.sqi AS q, s.agree AS g, k.x, k.v, k.a, k.b, k.c, k.n, CASE WHEN k.n = 0 THEN s.z ELSE k.x END + k.v AS px, k.a + 2 * k.b + k.c + 1.0 AS a1, k.b + k.c AS b1, k.c + 0.01 AS c1",
 """CASE WHEN z > 0 THEN least(200.0, greatest(42.0, px + a1 / (a1 + r) * (z - px))) ELSE x END, CASE WHEN z > 0 THEN v + b1 / (a1 + r) * (z - px) ELSE v END, CASE WHEN z > 0 THEN (1 - a1 / (a1 + r)) * a1 ELSE a END, CASE WHEN z > 0 THEN (1 - a1 / (a1 + r)) * b1 ELSE b END,
 CASE WHEN z > 0 THEN c1 - b1 / (a1 + r) * b1 ELSE c END, CASE WHEN z > 0 THEN n + 1 ELSE n END, r, q, g""")},
o AS (SELECT *, sqrt(noise) AS al, sqrt(greatest(a, 0.01)) AS ep, greatest(42.0, x - 1.96 * sqrt(greatest(a, 0.01))) AS lo, least(200.0, x + 1.96 * sqrt(greatest(a, 0.01))) AS hi FROM k WHERE seq > 0)
SELECT session, seq, {r4("x")} AS y, {r4("al")} AS aleatoric, {r4("ep")} AS epistemic, {r4("lo")} AS low, {r4("hi")} AS high, {r4("sqi / 100 * agree ** 2 * exp(-(hi - lo) / 15) * least(1.0, n / 15.0)")} AS confidence FROM o""")
def g6_uncertain_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of two and less count as frames without a measurement."""
    s = _seq(signal(spark, sf_dir)).withColumns({"x": F.col("x") - 2, "sqi": F.pmod("event_id", F.lit(101)).cast("double"), "agreement": F.pmod("event_id", F.lit(11)) / 10.0})
    return folds.run(s, "uncertain_rate").select("session", "seq", *(rounded(F.col(c)).alias(c) for c in ("y", "aleatoric", "epistemic", "low", "high", "confidence")))


_SQI = "(event_id % 101)::DOUBLE"


@query(f"""WITH RECURSIVE {SIGNAL}, s AS (SELECT session, seq, x / 10 AS x FROM signal),
{_from_zero("0.0::DOUBLE AS fast, 0.0::DOUBLE AS slow, 0.0::DOUBLE AS score, false AS moving, 0 AS spare", "0.5 * s.x + 0.5 * k.fast AS f, 0.04 * s.x + 0.96 * k.slow AS l, round(greatest(0.0, 0.5 * s.x + 0.5 * k.fast - 0.6 * (0.04 * s.x + 0.96 * k.slow)), 3) AS sc, k.moving, k.spare",
 "f, l, sc, CASE WHEN sc > 2.5 THEN true WHEN sc < 1.5 THEN moving AND spare > 0 ELSE moving END, CASE WHEN sc > 2.5 THEN 20 WHEN sc < 1.5 THEN greatest(0, spare - 1) ELSE spare END")}
SELECT session, seq, score, moving FROM k WHERE seq > 0""")
def g9_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.run(_seq(signal(spark, sf_dir)).withColumn("x", F.col("x") / 10), "motion")


@query(f"""WITH RECURSIVE {SIGNAL}, s AS (SELECT session, seq, median(x / 100) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS m FROM signal),
{_from_zero("'RESTING' AS state, 0.0::DOUBLE AS median", "s.m, k.state", "CASE WHEN m > 0.85 THEN 'PANTING' WHEN state = 'RESTING' THEN CASE WHEN m > 0.35 THEN 'ACTIVE' ELSE state END WHEN state = 'ACTIVE' THEN CASE WHEN m < 0.28 THEN 'RESTING' ELSE state END WHEN m >= 0.70 THEN state WHEN m >= 0.28 THEN 'ACTIVE' ELSE 'RESTING' END, m")}
SELECT session, seq, state, {r4("median")} AS median FROM k WHERE seq > 0""")
def g11_physio_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _seq(signal(spark, sf_dir)).withColumn("x", F.col("x") / 100)
    return folds.run(s, "physio_state").withColumn("median", rounded(F.col("median")))


@query()
def g13_sustained_arrhythmia(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _seq(signal(spark, sf_dir)).withColumn("x", 600 + 4 * F.col("x")).withColumn("sqi", F.lit(80.0))
    return folds.run(s, "sustained_arrhythmia")


@query(f"""WITH RECURSIVE {SIGNAL}, s AS (SELECT session, seq, x + 22 AS x, {_SQI} AS sqi FROM signal),
{_from_zero("0 AS n, 72.0::DOUBLE AS mean, 8.0::DOUBLE AS deviation, 0.0::DOUBLE AS x", "s.x AS v, s.x > 0 AND s.sqi >= 35 AS ok, k.n, k.mean, k.deviation, CASE WHEN k.n < 30 THEN 0.12 ELSE 0.04 END::DOUBLE AS a",
 "n + ok::INT, CASE WHEN ok THEN (1 - a) * mean + a * v ELSE mean END, CASE WHEN ok THEN greatest(1.5, (1 - a) * deviation + a * abs(v - mean)) ELSE deviation END, v")},
z AS (SELECT *, CASE WHEN n >= 20 AND x > 0 THEN (x - mean) / deviation END AS z FROM k WHERE seq > 0)
SELECT session, seq, {r4("z")} AS z, CASE WHEN z > 2 THEN 'HIGH' WHEN z < -2 THEN 'LOW' WHEN z > 1 THEN 'ELEVATED' WHEN z < -1 THEN 'SUPPRESSED' WHEN z IS NOT NULL THEN 'NORMAL' END AS label, {r4("mean")} AS mean, {r4("deviation")} AS deviation FROM z""")
def g15_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _seq(signal(spark, sf_dir)).withColumn("x", F.col("x") + 22).withColumn("sqi", F.pmod("event_id", F.lit(101)).cast("double"))
    out = folds.run(s, "baseline")
    return out.select("session", "seq", "label", *(rounded(F.col(c)).alias(c) for c in ("z", "mean", "deviation")))


_DECLINE = "CASE WHEN state = 'STABLE' AND c < 40 THEN low + 1 WHEN state = 'STABLE' THEN 0 ELSE low END"


#: SQL of G16 from c (session, seq, c).
G16 = f"""s AS (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN greatest(-1.0, least(1.0, 10 * regr_slope(c / 100, seq) OVER w)) ELSE 0.0 END AS slope FROM c WINDOW w AS (PARTITION BY session ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
k AS (SELECT DISTINCT session, 0::BIGINT AS seq, 'WARMUP' AS state, 0 AS frames, 0 AS low, 0 AS up, 0.0::DOUBLE AS trend FROM s UNION ALL
SELECT session, seq, after, CASE WHEN after <> state THEN 1 ELSE frames + 1 END, CASE WHEN after <> state THEN 0 WHEN state = 'DEGRADING' THEN low1 + 1 ELSE low1 END,
  CASE WHEN after <> state THEN 0 WHEN state = 'UNCERTAIN' AND c > 60 THEN up + 1 WHEN state = 'RECOVERING' THEN up + 1 ELSE up END, slope
FROM (SELECT *, CASE state WHEN 'WARMUP' THEN CASE WHEN frames >= 15 AND c >= 60 THEN 'STABLE' WHEN frames >= 30 THEN 'UNCERTAIN' ELSE state END WHEN 'STABLE' THEN CASE WHEN low1 >= 5 THEN 'DEGRADING' ELSE state END
   WHEN 'DEGRADING' THEN CASE WHEN c >= 60 THEN 'STABLE' WHEN low1 >= 10 THEN 'UNCERTAIN' ELSE state END WHEN 'UNCERTAIN' THEN CASE WHEN c < 20 THEN 'INVALID' WHEN c >= 60 THEN 'STABLE' WHEN c >= 40 AND up >= 3 THEN 'RECOVERING' ELSE state END
   WHEN 'RECOVERING' THEN CASE WHEN c >= 60 THEN 'STABLE' WHEN c < 40 THEN 'DEGRADING' WHEN up >= 6 THEN 'UNCERTAIN' ELSE state END ELSE CASE WHEN c > 50 THEN 'RECOVERING' WHEN frames >= 30 THEN 'UNCERTAIN' ELSE state END END AS after
  FROM (SELECT s.session, s.seq, s.c, s.slope, k.state, k.frames, k.up, {_DECLINE} AS low1 FROM k JOIN s ON s.session = k.session AND s.seq = k.seq + 1) n) m)"""


@query(f"""WITH RECURSIVE {SIGNAL}, c AS (SELECT session, seq, ((seq // 8) * 37 + event_id % 20) % 101 AS c FROM signal), {G16}
SELECT session, seq, state, {r4("trend")} AS trend FROM k WHERE seq > 0""")
def g16_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confidence holds for eight frames, about."""
    s = _seq(signal(spark, sf_dir))
    c = F.pmod(F.floor(F.col("seq") / 8) * 37 + F.pmod("event_id", F.lit(20)), F.lit(101)).cast("double")
    return folds.run(s.withColumn("x", c), "reliability").withColumn("trend", rounded(F.col("trend")))


@query(f"""WITH RECURSIVE {SIGNAL}, s AS (SELECT session, seq, CASE WHEN event_id % 5 = 0 THEN 10 ELSE (event_id % 32)::DOUBLE END AS sqi FROM signal),
{_from_zero("0 AS bad, 0 AS rest, false AS excluded", "k.bad, k.rest, CASE WHEN s.sqi < 30 THEN k.bad + 1 ELSE greatest(0, k.bad - 2) END AS b", "CASE WHEN rest > 0 THEN bad WHEN b >= 90 THEN 0 ELSE b END, CASE WHEN rest > 0 THEN rest - 1 WHEN b >= 90 THEN 44 ELSE 0 END, rest > 0")}
SELECT session, seq, bad::BIGINT AS bad, excluded FROM k WHERE seq > 0""")
def g23_region_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    sqi = F.when(F.pmod("event_id", F.lit(5)) == 0, 10.0).otherwise(F.pmod("event_id", F.lit(32)).cast("double"))
    return folds.run(_seq(signal(spark, sf_dir)).withColumn("sqi", sqi), "region_state")


@query(f"""WITH RECURSIVE {SIGNAL}, f AS (SELECT session, seq, floor(t / 43200) AS frame, x / 100 AS x FROM signal),
r AS (SELECT *, sum(gap) OVER (PARTITION BY session ORDER BY seq) AS run FROM (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY session ORDER BY seq) <= 1 THEN 0 ELSE 1 END AS gap FROM f)),
s AS (SELECT session, seq, gap = 1 AS first, greatest(0, least(1, avg(x) OVER w * CASE WHEN count(*) OVER w > 1 THEN least(1, 0.3 / (stddev_pop(x) OVER w / (abs(avg(x) OVER w) + 1e-9) + 1e-9)) ELSE 1 END * 0.5)) AS p FROM r WINDOW w AS (PARTITION BY session, run ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
{_from_zero("'' AS life, 0 AS frames, 0.0::DOUBLE AS persistence", "s.first, s.p, k.life, k.frames + 1 AS n",
 """CASE WHEN first THEN CASE WHEN p > 0.5 THEN 'ALIVE' ELSE 'BORN' END WHEN life = 'EXPIRED' THEN CASE WHEN p > 0.25 THEN 'RECOVERED' ELSE life END WHEN life = 'DEGRADING' THEN CASE WHEN p > 0.25 THEN 'ALIVE' WHEN n >= 5 THEN 'EXPIRED' ELSE life END WHEN p < 0.25 THEN 'DEGRADING' ELSE 'ALIVE' END,
 CASE WHEN first OR (life = 'DEGRADING' AND p > 0.25) OR (life NOT IN ('EXPIRED', 'DEGRADING') AND p < 0.25) THEN 0 ELSE n END, p""")}
SELECT session, seq, life, {r4("persistence")} AS persistence FROM k WHERE seq > 0""")
def i5_candidate_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a candidate, half a day a frame."""
    s = _seq(signal(spark, sf_dir)).withColumn("t", F.floor(F.col("t") / 43200).cast("double")).withColumn("x", F.col("x") / 100)
    return folds.run(s, "candidate_life").withColumn("persistence", rounded(F.col("persistence")))


@query(f"""WITH {SAMPLES}, n AS (SELECT session % 15 AS series, event_id % 101 AS sqi, x - 5 AS x, row_number() OVER (PARTITION BY session % 15 ORDER BY t, event_id) AS k FROM samples WHERE event_id % 101 >= 30)
SELECT series, count(*) >= 180 AS done, CASE WHEN count(*) >= 180 THEN {r4('avg(sqi)')} END AS mean_sqi, CASE WHEN count(*) >= 180 THEN coalesce({r4('median(x) FILTER (x > 0)')}, 0) END AS bpm FROM n WHERE k <= 180 GROUP BY series""")
def g8_calibration_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 180 good samples of a series of users; no baseline before all of them are there."""
    s = samples(spark, sf_dir).select((F.col("session") % 15).alias("series"), F.pmod("event_id", F.lit(101)).alias("sqi"), (F.col("x") - 5).alias("x"), "t", "event_id").where("sqi >= 30")
    s = s.withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy("t", "event_id"))).where("k <= 180")
    done = F.count("*") >= 180
    return s.groupBy("series").agg(done.alias("done"), F.when(done, rounded(F.avg("sqi"))).alias("mean_sqi"), F.when(done, F.coalesce(rounded(F.percentile(F.when(F.col("x") > 0, F.col("x")), 0.5)), F.lit(0.0))).alias("bpm"))


@query(f"""WITH {SIGNAL}, t AS (SELECT session, seq, regr_slope(x, seq) OVER w * 30 AS slope, stddev_pop(x) OVER w AS sd, avg(x) OVER w AS m, count(*) OVER w AS n FROM signal WINDOW w AS (PARTITION BY session ORDER BY seq ROWS BETWEEN 599 PRECEDING AND CURRENT ROW))
SELECT session, seq, CASE WHEN slope > 0.5 THEN 'IMPROVING' WHEN slope < -0.5 THEN 'DEGRADING' ELSE 'STABLE' END AS trend, {r4('1 - sd / greatest(m, 1)')} AS stability FROM t WHERE n >= 10""")
def g10_confidence_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _ordered(599)
    t = _seq(signal(spark, sf_dir)).select("session", "seq", settled(F.regr_slope("x", F.col("seq").cast("double")).over(w) * 30).alias("slope"), F.stddev_pop("x").over(w).alias("sd"), F.avg("x").over(w).alias("m"), F.count("*").over(w).alias("n")).where("n >= 10")
    trend = F.when(F.col("slope") > 0.5, "IMPROVING").when(F.col("slope") < -0.5, "DEGRADING").otherwise("STABLE")
    return t.select("session", "seq", trend.alias("trend"), rounded(1 - F.col("sd") / F.greatest("m", F.lit(1.0))).alias("stability"))


_IBI = SIGNAL + """, gaps AS (SELECT session, seq, (t - lag(t) OVER (PARTITION BY session ORDER BY seq)) * 1000 AS ibi FROM signal), mid AS (SELECT session, median(ibi) AS m FROM gaps GROUP BY session),
kept AS (SELECT session, seq, ibi, ibi - lag(ibi) OVER (PARTITION BY session ORDER BY seq) AS d FROM gaps JOIN mid USING (session) WHERE ibi > 0.6 * m AND ibi < 1.6 * m)"""


@query(f"WITH {_IBI} SELECT session, count(*) AS n, {r4('stddev_pop(ibi) / 1000')} AS sdnn, {r4('sqrt(avg(d * d)) / 1000')} AS rmssd, {r4('avg(CASE WHEN abs(d) > 50 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END)')} AS pnn50 FROM kept GROUP BY session")
def g12_hrv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variability of the gaps between events that are near the session's median gap, in seconds."""
    g = signal(spark, sf_dir).withColumn("ibi", (F.col("t") - F.lag("t").over(_ordered())) * 1000)
    kept = g.join(g.groupBy("session").agg(F.percentile("ibi", 0.5).alias("m")), "session").where("ibi > 0.6 * m AND ibi < 1.6 * m")
    kept = kept.withColumn("d", F.col("ibi") - F.lag("ibi").over(_ordered()))
    return kept.groupBy("session").agg(F.count("*").alias("n"), rounded(F.stddev_pop("ibi") / 1000).alias("sdnn"), rounded(F.sqrt(F.avg(F.col("d") * F.col("d"))) / 1000).alias("rmssd"),
                                       rounded(F.avg(F.when(F.abs("d") > 50, 1.0).when(F.col("d").isNotNull(), 0.0))).alias("pnn50"))


@query(f"""WITH {WINDOWS}, s AS (SELECT session, w, 0.30 * CASE WHEN hr_estimate > 100 THEN 1 WHEN hr_estimate > 60 THEN (hr_estimate - 60) / 40 ELSE 0 END + 0.35 * greatest(0, least(1, 1 - luminance_range / 100)) + 0.20 * motion * 4 + 0.15 * (1 - signal_quality) AS s FROM windows)
SELECT session, w, {r4('100 * avg(s) OVER (PARTITION BY session ORDER BY w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} AS stress FROM s""")
def g14_stress_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rate = F.when(c("hr_estimate") > 100, 1.0).when(c("hr_estimate") > 60, (c("hr_estimate") - 60) / 40).otherwise(0.0)
    s = 0.30 * rate + 0.35 * clip(1 - c("luminance_range") / 100, 0, 1) + 0.20 * c("motion") * 4 + 0.15 * (1 - c("signal_quality"))
    w = Window.partitionBy("session").orderBy("w").rowsBetween(-19, 0)
    return windows(spark, sf_dir).withColumn("s", s).select("session", "w", rounded(100 * F.avg("s").over(w)).alias("stress"))


#: SQL of G17 from i (session, seq, x, instability, harmonic, cv), with TIMEOUT.
G17 = """j AS (SELECT *, x NOT BETWEEN 40 AND 200 AS out_of_range, coalesce(lag(x) OVER w > 0 AND (abs(x - lag(x) OVER w) > 20 OR abs(x - lag(x) OVER w) / greatest(lag(x) OVER w, 1) > 0.25), false) AS jumps FROM i WINDOW w AS (PARTITION BY session ORDER BY seq)),
s AS (SELECT *, seq - coalesce(max(CASE WHEN NOT (out_of_range OR jumps) THEN seq END) OVER (PARTITION BY session ORDER BY seq), 0) AS streak FROM j),
t AS (SELECT *, coalesce(max(streak) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= TIMEOUT, false) AS late FROM s),
a AS (SELECT session, seq, stddev_pop(x) OVER v AS sd, count(*) OVER v AS m FROM t WHERE NOT (out_of_range OR jumps OR late) WINDOW v AS (PARTITION BY session ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
f AS (SELECT t.session, t.seq, out_of_range OR jumps OR late AS invalid, concat_ws(',', CASE WHEN out_of_range THEN 'out_of_range' END, CASE WHEN jumps THEN 'jumps' END, CASE WHEN late THEN 'timeout' END, CASE WHEN a.m >= 5 AND a.sd >= 15 THEN 'trajectory' END,
  CASE WHEN instability >= 0.5 THEN 'spectral' END, CASE WHEN harmonic >= 0.5 THEN 'harmonic' END, CASE WHEN cv >= 0.3 THEN 'candidates' END) AS failures FROM t ASOF LEFT JOIN a ON t.session = a.session AND t.seq > a.seq)"""


@query(f"""WITH {SIGNAL}, i AS (SELECT session, seq, 30 + x / 2 AS x, event_id % 11 / 10.0 AS instability, event_id % 13 / 13.0 AS harmonic, event_id % 9 / 20.0 AS cv FROM signal),
{G17.replace("TIMEOUT", "12")}
SELECT session, seq, CASE WHEN invalid THEN 'INVALID' WHEN failures <> '' THEN 'UNCERTAIN' ELSE 'PLAUSIBLE' END AS verdict, failures FROM f""")
def g17_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven checks; spectra, harmonics and candidates from the event's number, timeout after 12 rows."""
    of = lambda n, by: F.pmod("event_id", F.lit(n)) / by
    s = _seq(signal(spark, sf_dir)).withColumns({"x": 30 + F.col("x") / 2, "instability": of(11, 10.0), "harmonic_ratio": of(13, 13.0), "cv": of(9, 20.0)})
    return gates.plausible(s, timeout=12).select("session", "seq", "verdict", F.concat_ws(",", "failures").alias("failures"))


@query(f"""WITH {SIGNAL}, i AS (SELECT session, seq, abs(x - 50) AS error, CASE WHEN seq % 80 < 40 THEN 60.0 ELSE event_id % 101 END::DOUBLE AS c, event_id % 13 AS actual, event_id % 7 AS predicted, (event_id % 21 - 8) / 10.0 AS trend FROM signal),
p AS (SELECT *, count(*) OVER long >= 30 AND stddev_pop(c) OVER long < 1 AS steady, count(*) OVER short >= 10 AND abs(avg(trend) OVER short) > 0.1 AND abs(c - avg(c) OVER short) < 2 AS lagging FROM i
  WINDOW long AS (PARTITION BY session ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), short AS (PARTITION BY session ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT session, seq, concat_ws(',', CASE WHEN c > 80 AND error > 10 THEN 'high_confidence_wrong' END, CASE WHEN c < 30 AND error < 5 THEN 'low_confidence_correct' END, CASE WHEN predicted > 0 AND actual > 2 * predicted THEN 'uncertainty_underestimation' END,
  CASE WHEN predicted > 0 AND predicted > 3 * actual THEN 'uncertainty_overestimation' END, CASE WHEN steady THEN 'confidence_stagnation' END, CASE WHEN lagging THEN 'temporal_confidence_lag' END) AS failures FROM p""")
def g18_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs from the event's number; the confidence rests for 40 frames of 80."""
    of = lambda n: F.pmod("event_id", F.lit(n))
    s = _seq(signal(spark, sf_dir)).withColumns({"c": F.when(F.col("seq") % 80 < 40, 60.0).otherwise(of(101).cast("double")), "trend": (of(21) - 8) / 10.0})
    w30, w10 = _ordered(29), _ordered(9)
    s = s.withColumns({"steady": (F.count("*").over(w30) >= 30) & (F.stddev_pop("c").over(w30) < 1), "lagging": (F.count("*").over(w10) >= 10) & (F.abs(F.avg("trend").over(w10)) > 0.1) & (F.abs(F.col("c") - F.avg("c").over(w10)) < 2)})
    names = quality.confidence_failures(F.abs(F.col("x") - 50), F.col("c"), of(13), of(7), F.col("steady"), F.col("lagging"))
    return s.select("session", "seq", F.concat_ws(",", names).alias("failures"))


_AGREE = """exp(-abs(x - fused) / 12) * CASE WHEN x / fused > 0.45 AND x / fused < 0.55 THEN 0.4 WHEN x / fused > 1.8 AND x / fused < 2.2 THEN 0.3 ELSE 1.0 END * CASE WHEN x > 145 THEN 0.15 WHEN x > 135 THEN 0.3 WHEN x > 130 THEN 0.5 ELSE 1.0 END
  * CASE WHEN x > 130 AND sqi < 80 THEN 0.5 ELSE 1.0 END * CASE WHEN x > 130 AND forehead THEN 0.15 ELSE 1.0 END"""


@query(f"""WITH RECURSIVE {SIGNAL}, s AS (SELECT session, seq, CASE WHEN x > 0 AND sqi > 0 THEN sqi / 100 * {_AGREE} END AS good FROM (SELECT session, seq, 2 * x AS x, {_SQI} AS sqi, 60.0 + event_id % 40 AS fused, roi = 'view' AS forehead FROM signal)),
{_from_zero("0.0::DOUBLE AS up, 0.0::DOUBLE AS down", "k.up, k.down, s.good", "CASE WHEN good IS NULL THEN up ELSE 0.999 * (up + good) END, CASE WHEN good IS NULL THEN down ELSE 0.999 * (down + 1 - good) END")}
SELECT session, seq, {r4("(2 + up) / (4 + up + down)")} AS weight, {r4("sqrt((2 + up) * (2 + down) / ((4 + up + down) ** 2 * (5 + up + down) + 1e-9))")} AS deviation FROM k WHERE seq > 0""")
def g19_learned_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _seq(signal(spark, sf_dir)).withColumns({"x": 2 * F.col("x"), "sqi": F.pmod("event_id", F.lit(101)).cast("double"), "fused": 60.0 + F.pmod("event_id", F.lit(40)), "forehead": F.col("roi") == "view"})
    return folds.run(s, "region_weight").select("session", "seq", rounded(F.col("weight")).alias("weight"), rounded(F.col("deviation")).alias("deviation"))


@query(f"""WITH RECURSIVE {SIGNAL}, e AS (SELECT session, seq, 60 + x AS x, 60 + lag(x) OVER w AS before, event_id % 13 - 1 AS snr, (event_id % 10) / 10.0 AS conc, avg((event_id % 7) / 6.0) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS reg, (event_id % 9) / 3.0 AS motion, event_id % 15 AS drift, 1 + (event_id % 11) / 10.0 AS ratio FROM signal WINDOW w AS (PARTITION BY session ORDER BY seq)),
b AS (SELECT *, CASE WHEN x > 145 THEN -8.0 WHEN x > 135 THEN -5.0 WHEN x > 130 THEN -3.0 WHEN x > 115 AND motion < 1 THEN -2.0 ELSE 0.0 END AS bio, abs(x - coalesce(before, x)) AS jump FROM e),
s AS (SELECT session, seq, bio, 1.5 * (snr - 6) / 4 + 0.8 * (conc - 0.3) / 0.2 + 0.5 * (reg - 0.5) / 0.3 + ln(exp(-motion / 3) + 1e-9) + ln(exp(-greatest(0.0, drift - 8) / 5) + 1e-9) + bio
  + CASE WHEN ratio < 1.3 THEN -5.0 WHEN ratio < 1.8 THEN -1.5 ELSE 0.0 END + CASE WHEN jump > 30 THEN -6.0 WHEN jump > 20 THEN -4.0 WHEN jump > 12 THEN -2.5 ELSE 0.0 END AS odds FROM b),
{_from_zero("-1.0::DOUBLE AS sqi, 0.0::DOUBLE AS odds", "s.odds AS o, s.bio, k.sqi", "round(greatest(0.0, least(100.0, 100 * CASE WHEN sqi >= 0 AND bio >= -4 THEN 0.35 / (1 + exp(-o)) + 0.65 * sqi / 100 ELSE 1 / (1 + exp(-o)) END)), 1), o")}
SELECT session, seq, sqi, {r4("odds")} AS log_odds FROM k WHERE seq > 0""")
def g20_posterior_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda n, by=1.0: F.pmod("event_id", F.lit(n)) / F.lit(by)
    s = _seq(signal(spark, sf_dir)).withColumns({"x": 60 + F.col("x"), "snr_db": of(13) - 1, "concentration": of(10, 10.0), "regularity": of(7, 6.0), "motion": of(9, 3.0), "drift": of(15), "peak_ratio": 1 + of(11, 10.0)})
    return folds.run(s, "posterior_quality").withColumn("log_odds", rounded(F.col("log_odds")))


@query(f"""WITH RECURSIVE {SIGNAL}, s AS (SELECT session, seq, t / 17280 AS t, x - 3 AS x, event_id % 40 = 0 AS moving FROM signal),
{_from_zero("-1::BIGINT AS clear, 0.0::DOUBLE AS good, 0.0::DOUBLE AS since, 0.0::DOUBLE AS shown", "s.t, s.x, s.moving, k.clear, k.good, k.since, k.shown, NOT s.moving AND (k.clear < 0 OR s.seq - k.clear < 20) AS waiting, k.good > 0 AND s.t - k.since <= 5 AS held",
 """CASE WHEN moving THEN -1 WHEN clear < 0 THEN seq ELSE clear END, CASE WHEN NOT moving AND NOT waiting AND x > 0 THEN x ELSE good END, CASE WHEN NOT moving AND NOT waiting AND x > 0 THEN t ELSE since END,
 CASE WHEN moving THEN CASE WHEN held THEN good ELSE shown END WHEN waiting THEN CASE WHEN good > 0 THEN good ELSE shown END WHEN x > 0 THEN x WHEN held THEN good ELSE shown END""")}
SELECT session, seq, {r4("shown")} AS shown FROM k WHERE seq > 0""")
def g22_holdover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day of events stands for five seconds; every fortieth event is in motion."""
    s = _seq(signal(spark, sf_dir)).withColumns({"t": F.col("t") / 17280, "x": F.col("x") - 3, "moving": F.pmod("event_id", F.lit(40)) == 0})
    return folds.run(s, "holdover").withColumn("shown", rounded(F.col("shown")))


_GOOD = "FILTER (WHERE NOT moving AND sqi >= 30"


@query(f"""WITH RECURSIVE {SIGNAL}, f AS (SELECT session, seq, x, {_SQI} AS sqi, roi = 'error' AS moving, 0.5 + (event_id % 11) / 20.0 AS agree, event_id % 3 AS regions, event_id % 17 = 0 AS hard FROM signal),
l AS (SELECT *, list(sqi) {_GOOD}) OVER o AS q, list(x) {_GOOD} AND x > 0) OVER o AS b, list(agree) {_GOOD}) OVER o AS a, avg(moving::INT) OVER (o ROWS BETWEEN 179 PRECEDING AND CURRENT ROW) AS moved FROM f WINDOW o AS (PARTITION BY session ORDER BY seq)),
m AS (SELECT session, seq, hard, regions, moved, len(q) AS n, list_avg(q[-180:]) AS q, list_avg(a[-180:]) AS a, CASE WHEN len(b) >= 5 THEN exp(-list_stddev_pop(b[-180:]) / 10) ELSE 0.5 END AS steady FROM l),
s AS (SELECT session, seq, hard, CASE WHEN n >= 10 THEN greatest(0.0, least(100.0, 100 * (0.4 * q / 100 + 0.3 * a + 0.2 * steady + 0.1 * (1 - moved)) * greatest(0.4, a) * CASE WHEN regions >= 2 THEN 1.0 ELSE 0.85 END)) END AS i FROM m),
{_from_zero("0.0::DOUBLE AS ema, false AS ready", "s.i, s.hard, k.ema", "CASE WHEN i IS NULL THEN ema ELSE CASE WHEN ema = 0 THEN i ELSE 0.25 * i + 0.75 * ema END * CASE WHEN hard THEN 0.85 ELSE 1.0 END END, i IS NOT NULL")}
SELECT session, seq, {r4("CASE WHEN ready THEN ema ELSE 0 END")} AS confidence, CASE WHEN NOT ready THEN 'POOR' WHEN ema >= 75 THEN 'GOOD' WHEN ema >= 45 THEN 'FAIR' ELSE 'POOR' END AS label FROM k WHERE seq > 0""")
def g7_session_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _seq(signal(spark, sf_dir)).withColumns({"sqi": F.pmod("event_id", F.lit(101)).cast("double"), "moving": F.col("roi") == "error", "agreement": 0.5 + F.pmod("event_id", F.lit(11)) / 20.0, "regions": F.pmod("event_id", F.lit(3)), "hard": F.pmod("event_id", F.lit(17)) == 0})
    return folds.run(s, "session_confidence").withColumn("confidence", rounded(F.col("confidence")))


_G21_ST, _G21_CO = "(0.9 * k.steady + 0.1 * s.inst)", "(0.8 * k.consistent + 0.2 * s.consistency)"
_G21_RAW = f"(0.25 * s.snr + 0.30 * s.regular + 0.30 * {_G21_ST} + 0.15 * {_G21_CO} + 0.10 * (1 - s.m) - 0.4 * (s.m + s.l + 0.05) / 3) * (1 - 0.3 * s.m) * (1 - 0.3 * s.l)"
_G21_ROW = f"""s.bio0, k.sqi, {_G21_ST} AS st, {_G21_CO} AS co, s.inst < 0.05 AND {_G21_CO} > 0.9 AS lone, CASE WHEN s.snr > 0.35 AND s.regular > 0.2 THEN greatest({_G21_RAW}, 0.22) ELSE {_G21_RAW} END AS raw,
 s.agree AS agree2"""


@query(f"""WITH RECURSIVE {SIGNAL}, p AS (SELECT session, seq, 1.5 * x AS x, (event_id % 101) / 100.0 AS snr, avg((event_id % 7) / 6.0) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS regular, (event_id % 5) / 4.0 AS consistency, (event_id % 41) / 10.0 AS motion, 30 + (event_id % 200) AS brightness,
  (event_id % 50)::DOUBLE AS drift, (event_id % 11) / 10.0 AS agree, 1 + (event_id % 9) / 4.0 AS ratio, (event_id % 20) / 20.0 AS sine, lag(1.5 * x) OVER w AS before, count(*) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS n,
  stddev_pop(1.5 * x) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS sd, stddev_pop(1.5 * x) OVER (w ROWS BETWEEN 150 PRECEDING AND 1 PRECEDING) AS long_sd FROM signal WINDOW w AS (PARTITION BY session ORDER BY seq)),
s AS (SELECT session, seq, snr, regular, consistency, agree, CASE WHEN n >= 5 THEN greatest(0, (100 - 4 * sd) / 100) ELSE 1.0 END AS inst,
  CASE WHEN motion > 2.5 THEN least(0.5, least(motion / 15, 0.6) + 0.2) WHEN motion > 1.5 THEN greatest(least(motion / 15, 0.6), 0.1) ELSE 0.0 END AS m,
  CASE WHEN drift > 40 THEN 0.9 WHEN drift > 30 THEN 0.7 WHEN drift > 20 THEN 0.5 WHEN drift > 10 THEN 0.3 WHEN brightness < 50 THEN least((50 - brightness) / 50.0, 0.3) WHEN brightness > 210 THEN least((brightness - 210) / 40.0, 0.3) ELSE 0.0 END AS l,
  CASE WHEN x > 160 THEN 0.1 WHEN x > 145 THEN 0.3 WHEN x > 130 THEN 0.5 WHEN x > 115 AND motion < 1.8 THEN 0.55 ELSE 1.0 END * CASE WHEN n >= 5 AND long_sd > 15 THEN 0.7 ELSE 1.0 END * CASE WHEN x >= 110 AND sine > 0.93 THEN 0.55 ELSE 1.0 END
  * CASE WHEN abs(x - before) > 25 THEN CASE WHEN x / 75 BETWEEN 1.8000001 AND 2.1999999 OR x / 75 BETWEEN 0.4500001 AND 0.5499999 THEN 0.2 ELSE 0.4 END ELSE 1.0 END
  * CASE WHEN x / 75 BETWEEN 1.8000001 AND 2.1999999 THEN 0.3 WHEN x / 75 BETWEEN 0.4500001 AND 0.5499999 THEN 0.4 ELSE 1.0 END * CASE WHEN ratio < 1.3 THEN 0.2 ELSE 1.0 END AS bio0 FROM p),
{_from_zero("0.0::DOUBLE AS sqi, 1.0::DOUBLE AS steady, 0.5::DOUBLE AS consistent", _G21_ROW,
 """(floor(least(100, greatest(0, (WITHOUT) * CASE WHEN lone THEN 0.4 * bio0 ELSE bio0 END * CASE WHEN sqi > 0 AND CASE WHEN lone THEN 0.4 * bio0 ELSE bio0 END > 0.5 THEN 0.6 ELSE 1.0 END + CASE WHEN sqi > 0 AND CASE WHEN lone THEN 0.4 * bio0 ELSE bio0 END > 0.5 THEN 0.4 * sqi ELSE 0.0 END)) * 10 + 0.500001) / 10 + 0.0)::DOUBLE, st, co""")}
SELECT session, seq, sqi FROM k WHERE seq > 0""".replace("WITHOUT", "100 * raw * CASE WHEN agree2 < 0.7 THEN 1 - (0.7 - agree2) / 0.7 * 0.3 ELSE 1.0 END"))
def g21_quality_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the index taken from the event's number; 75 is the stable rate."""
    of = lambda n, by=1.0: F.pmod("event_id", F.lit(n)) / F.lit(by)
    s = _seq(signal(spark, sf_dir)).withColumns({"x": 1.5 * F.col("x"), "snr": of(101, 100.0), "regularity": of(7, 6.0), "consistency": of(5, 4.0), "motion": of(41, 10.0), "brightness": 30 + of(200), "drift": of(50), "agreement": of(11, 10.0), "peak_ratio": 1 + of(9, 4.0), "sine": of(20, 20.0), "stable": F.lit(75.0), "spectral_penalty": F.lit(0.05)})
    return folds.run(s, "quality_index").select("session", "seq", "sqi")


def frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a frame of three regions; what they show is taken from the event's number, now and then a doubled rate or one that is off."""
    e = F.col("event_id")
    of = lambda by, n: F.pmod(e * by, F.lit(n))

    def region(name: str, base: float, by: int, bpm: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(base).alias("base"), bpm.cast("double").alias("bpm"), (of(by, 101) / 100.0).alias("snr"), (of(by, 7) / 6.0).alias("regularity"), (of(by, 5) / 4.0).alias("consistency"),
                        F.lit(0.05).alias("spectral_penalty"), (50.0 + of(by, 150)).alias("brightness"), F.when(of(by, 6) == 0, 0.5).otherwise(1.0).alias("penalty"))

    slow = F.least(F.floor(F.col("x") / 8), F.lit(25))
    regions = F.array(region("forehead", 0.15, 3, 70 + of(1, 9) + slow), region("cheek_left", 0.25, 5, F.when(of(1, 13) == 0, 136 + of(1, 3)).when(of(1, 19) == 0, 100).otherwise(68 + of(1, 7) + slow)), region("cheek_right", 0.60, 7, F.when(of(1, 37) == 0, 0).otherwise(69 + of(1, 5) + slow)))
    s = _seq(signal(spark, sf_dir))
    return s.withColumns({"regions": regions, "moving": of(1, 11) == 0, "drift": of(1, 45).cast("double"), "x": of(1, 41) / 10.0}).select("session", "seq", "t", "x", "moving", "drift", "regions")


@query()
def h3_frame_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.run(frame_rows(spark, sf_dir), "frame_pipeline")


@query()
def h3_session_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the frame pipeline showed at a session's end, its confidence, and how many frames it froze."""
    f = folds.run(frame_rows(spark, sf_dir), "frame_pipeline")
    shown = F.when(~F.col("frozen") & (F.col("bpm") > 0), F.struct("seq", "bpm"))
    return f.groupBy("session").agg(F.max(shown)["bpm"].alias("bpm"), F.max_by("confidence", "seq").alias("confidence"), F.count("*").alias("frames"), F.count_if("frozen").alias("frozen"), F.avg("accepted").alias("accepted"))
