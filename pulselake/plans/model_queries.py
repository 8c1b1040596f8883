"""Fusion, grid, split, augmentation and loss queries (survey A, H, I, K, L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import augment as A
from ..functions import losses as L
from ..functions import spectral as S
from ..functions.numeric import mean_of, rounded, std_of, sum_of
from ..operators import fusion as H
from ..operators import gates
from ..operators import grids as G
from ..operators import splits as K
from .bindings import ARRAYS, DOMAINS, PAIRS, PIXELS, SAMPLES, SIGNAL, arrays, domains, pairs, pixels, samples, signal, table
from .registry import query, r4


_STEADY = SAMPLES + """, rois AS (SELECT *, exp(-abs(bpm - avg(bpm) OVER (PARTITION BY frame)) / 6) AS agreement FROM (
  SELECT session AS frame, roi, avg(x) AS bpm, least(100.0, count(*) * 5.0) AS sqi, CASE WHEN count(*) >= 5 THEN greatest(0.1, 1 - stddev_pop(x) / 20) ELSE 1.0 END AS temporal FROM samples GROUP BY ALL) r)"""
_W = """w AS (SELECT *, CASE WHEN suspect THEN 0.0 ELSE greatest(0.05, least(3.0, 0.33 * (0.4 * greatest(0.1, sqi / 100) + 0.4 * temporal + 0.2 * CASE WHEN sqi > 0 THEN least((sqi / 100) ** 1.5, 1.0) ELSE 0.1 END)
  * CASE WHEN bpm < 45 OR bpm > 150 THEN 0.1 WHEN bpm < 55 OR bpm > 130 THEN 0.5 ELSE 1.0 END * CASE WHEN abs(bpm - 75) > 25 THEN 0.6 ELSE 1.0 END * CASE WHEN bpm < 65 THEN greatest(0.08, (bpm / 65) ** 2) WHEN bpm < 85 THEN greatest(0.35, bpm / 85) ELSE 1.0 END
  * CASE WHEN bpm < 45 OR bpm > 130 THEN 0.15 ELSE 1.0 END * CASE WHEN bpm / 20 > 2.5 THEN 0.2 ELSE 1.0 END * CASE WHEN bpm / 20 > 3.5 THEN 0.5 ELSE 1.0 END * CASE WHEN agreement < 0.55 THEN 0.15 ELSE 1.0 END
  * CASE WHEN 4 * abs(bpm - 50) > 40 THEN 0.1 WHEN 4 * abs(bpm - 50) > 20 THEN 0.45 ELSE 1.0 END)) END AS weight
  FROM (SELECT *, bpm > 70 AS suspect FROM rois) r)"""


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions of a user's events with weights; rates also stand for brightness, motion and drift, 75 for the stable rate."""
    g = samples(spark, sf_dir).groupBy(F.col("session").alias("frame"), "roi").agg(F.avg("x").alias("bpm"), F.least(F.lit(100.0), F.count("*") * 5.0).alias("sqi"), H.steadiness(F.stddev_pop("x"), F.count("*")).alias("temporal"))
    g = g.withColumn("agreement", F.exp(-F.abs(F.col("bpm") - F.avg("bpm").over(Window.partitionBy("frame"))) / 6)).withColumn("suspect", F.col("bpm") > 70)
    b, s = F.col("bpm"), F.col("sqi")
    return g.withColumn("weight", H.region_weight(F.lit(0.33), s, F.col("temporal"), s, b, b, b / 20, 4 * F.abs(b - 50), F.col("suspect"), F.col("agreement"), F.lit(75.0)))


@query(f"WITH {_STEADY}, {_W} SELECT frame, roi, {r4('weight')} AS weight FROM w")
def h1_region_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted(spark, sf_dir).select("frame", "roi", rounded(F.col("weight")).alias("weight"))


@query(f"""WITH {_STEADY}, {_W}, clean AS (SELECT *, max((NOT suspect)::INT) OVER (PARTITION BY frame) AS any_clean FROM w WHERE weight > 0), held AS (SELECT frame, roi, bpm, greatest(0.01, least(3.0, weight)) AS w FROM clean WHERE any_clean = 0 OR NOT suspect),
capped AS (SELECT frame, roi, bpm, least(w, 0.75 * sum(w) OVER (PARTITION BY frame)) AS w, CASE WHEN bpm - lag(bpm) OVER (PARTITION BY frame ORDER BY bpm, roi) > 8 THEN 1 ELSE 0 END AS far FROM held),
grouped AS (SELECT *, sum(far) OVER (PARTITION BY frame ORDER BY bpm, roi) AS cluster FROM capped), c AS (SELECT frame, cluster, sum(w) AS w, count(*) AS n, sum(bpm * w) / (sum(w) + 1e-9) AS bpm FROM grouped GROUP BY ALL),
t AS (SELECT *, sum(w) OVER (PARTITION BY frame) AS total, max(n) OVER (PARTITION BY frame) AS top FROM c) SELECT frame, {r4('sum(bpm * w) / (sum(w) + 1e-9)')} AS fused FROM t WHERE w / total >= 0.2 OR n = top GROUP BY frame""")
def h2_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.hierarchical(_weighted(spark, sf_dir)).select("frame", rounded(F.col("fused")).alias("fused"))


@query(f"""WITH {_STEADY}, {_W}, c AS (SELECT frame, bpm, sum(weight) OVER (PARTITION BY frame ORDER BY bpm, roi) AS cum, sum(weight) OVER (PARTITION BY frame) / 2 AS half FROM w WHERE weight > 0) SELECT frame, {r4('min(bpm)')} AS median FROM c WHERE cum >= half GROUP BY frame""")
def h4_weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.weighted_median(_weighted(spark, sf_dir).where("weight > 0")).select("frame", rounded(F.col("median")).alias("median"))


_EST = f"{PAIRS}, est AS (SELECT id AS frame, measured AS x, sigma, confidence, 1 / (sigma * sigma + 1e-6) AS p FROM pairs)"
_AGREE = "greatest(0.0, least(1.0, 1 - 5 * stddev_pop(x) / avg(x)))"


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select(F.col("id").alias("frame"), F.col("measured").alias("x"), "sigma", "confidence")


def _fused(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return H.fuse(_estimates(spark, sf_dir), method).select("frame", *(rounded(F.col(c)).alias(c) for c in ("value", "sigma", "agreement")), "n")


@query(f"WITH {_EST} SELECT frame, {r4('avg(x)')} AS value, {r4('1 / sqrt(sum(p))')} AS sigma, {r4(_AGREE)} AS agreement, count(*) AS n FROM est GROUP BY frame")
def h5_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "mean")


@query(f"WITH {_EST} SELECT frame, {r4('sum(x * confidence) / nullif(sum(confidence), 0)')} AS value, {r4('1 / sqrt(sum(p))')} AS sigma, {r4(_AGREE)} AS agreement, count(*) AS n FROM est GROUP BY frame")
def h5_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "weighted")


@query(f"WITH {_EST} SELECT frame, {r4('sum(x * p) / sum(p)')} AS value, {r4('1 / sqrt(sum(p))')} AS sigma, {r4(_AGREE)} AS agreement, count(*) AS n FROM est GROUP BY frame")
def h5_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "variance")


@query(f"WITH {_EST}, m AS (SELECT frame, median(x) AS mid FROM est GROUP BY frame) SELECT frame, {r4('sum(x * p) / sum(p)')} AS value, {r4('1 / sqrt(sum(p))')} AS sigma, {r4(_AGREE)} AS agreement, count(*) AS n FROM est JOIN m USING (frame) WHERE abs(x - mid) <= greatest(2 * sigma, 5.0) GROUP BY frame")
def h5_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "robust")


@query(f"WITH {_EST} SELECT frame, {r4('(sum(x * p) + 0.001 * avg(x)) / (sum(p) + 0.001)')} AS value, {r4('1 / sqrt(sum(p) + 0.001)')} AS sigma, {r4(_AGREE)} AS agreement, count(*) AS n FROM est GROUP BY frame")
def h5_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "bayes")


@query(f"WITH {PAIRS} SELECT id, {r4('1 / sum(1 / (sigma * sigma))')} AS variance FROM pairs GROUP BY id")
def h6_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = pairs(spark, sf_dir).groupBy("id").agg(F.sum(1 / (F.col("sigma") * F.col("sigma"))).alias("p"))
    return g.select("id", rounded(F.try_divide(F.lit(1.0), F.col("p"))).alias("variance"))


@query(f"""WITH {SAMPLES}, e AS (SELECT session AS frame, CASE WHEN roi = 'error' THEN 1 - x / 100 ELSE x / 100 END * ((event_id % 10) / 10.0) AS e, x, 1 + event_id % 3 AS weight FROM samples)
SELECT frame, {r4('sum(weight * e) / sum(weight)')} AS weighted, {r4('min(e)')} AS least, {r4('avg(e)')} AS mean, {r4('avg(CASE WHEN x <> 0 THEN 1.0 ELSE 0.0 END)')} AS coverage FROM e GROUP BY frame""")
def h7_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = samples(spark, sf_dir).select(F.col("session").alias("frame"), F.when(F.col("roi") == "error", "harmonic_risk").otherwise(F.col("roi")).alias("source"), (F.col("x") / 100).alias("value"),
                                      (F.pmod("event_id", F.lit(10)) / 10.0).alias("confidence"), (1 + F.pmod("event_id", F.lit(3))).alias("weight"))
    return H.evidence(e).select("frame", *(rounded(F.col(c)).alias(c) for c in ("weighted", "least", "mean", "coverage")))


@query(f"""WITH {PAIRS}, u AS (SELECT id, method, sqrt(sigma * sigma + (1 - confidence / 100) ** 2) AS a, sqrt((measured - reference) ** 2 + 4) AS b FROM pairs)
SELECT id, method, {r4('max(a)')} AS aleatoric, {r4('max(b)')} AS epistemic, {r4('max(sqrt(a * a + b * b))')} AS total, count(*) FILTER (sqrt(a * a + b * b) > 10) AS uncertain FROM u GROUP BY ALL""")
def h8_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"noise": F.col("sigma"), "confidence": 1 - F.col("confidence") / 100, "model": F.col("measured") - F.col("reference"), "method": F.lit(2.0)}
    a, b, t = H.uncertainty(parts, {"noise", "confidence"})
    x = pairs(spark, sf_dir).select("id", "method", a.alias("a"), b.alias("b"), t.alias("t"))
    return x.groupBy("id", "method").agg(rounded(F.max("a")).alias("aleatoric"), rounded(F.max("b")).alias("epistemic"), rounded(F.max("t")).alias("total"), F.count_if(F.col("t") > 10).alias("uncertain"))


_KINDS = {"aleatoric": ("aleatoric", "both"), "epistemic": ("epistemic", "both"), "total": ("aleatoric", "epistemic", "both")}
_ROOTS = ", ".join(f"sqrt({' + '.join(f'u_{k} * u_{k}' for k, (_, kind) in H.COMPONENTS.items() if kind in kinds)}) AS {name}" for name, kinds in _KINDS.items())


@query(f"""WITH {SIGNAL}, p AS (SELECT session, seq, 1 + event_id % 6 AS noise, (event_id % 101)::DOUBLE AS sqi, (event_id % 11) / 10.0 AS spatial, (event_id % 13) / 12.0 AS motion, (event_id % 7) / 6.0 AS temporal, (event_id % 17) / 16.0 AS coverage, event_id % 61 - 30 AS snr_db, x AS model_variance FROM signal),
u AS (SELECT *, noise * (1 - 0.5 * sqi / 100) AS u_measurement, (1 - sqi / 100) * 10 AS u_signal, (1 - spatial) * 8 AS u_spatial, (1 - motion) * 6 AS u_motion, (1 - temporal) * 5 AS u_temporal, (1 - greatest(0, least(1, (snr_db + 20) / 40.0))) * 8 AS u_spectral, 0.0 AS u_harmonic, sqrt(greatest(model_variance, 0.01)) AS u_model, (1 - coverage) * 10 AS u_coverage FROM p),
t AS (SELECT *, {_ROOTS} FROM u)
SELECT session, seq, {r4('u_measurement')} AS measurement, {r4('u_spectral')} AS spectral, {r4('u_model')} AS model, {r4('aleatoric')} AS aleatoric, {r4('epistemic')} AS epistemic, {r4('total')} AS total, CASE WHEN coverage < 0.3 THEN 'INVALID' WHEN total > 15 OR epistemic > 10 THEN 'UNCERTAIN' ELSE 'VALID' END AS validity FROM t""")
def h8_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine components; inputs from the event's number, the value as the model's variance."""
    of = lambda n, by=1.0: F.pmod("event_id", F.lit(n)) / F.lit(by)
    s = signal(spark, sf_dir).withColumns({"noise": 1 + of(6), "sqi": of(101), "spatial": of(11, 10.0), "motion": of(13, 12.0), "temporal": of(7, 6.0), "coverage": of(17, 16.0), "snr_db": of(61) - 30, "model_variance": F.col("x")})
    out = H.decomposed(s)
    return out.select("session", F.col("seq").cast("bigint").alias("seq"), *(rounded(F.col(f"u_{c}")).alias(c) for c in ("measurement", "spectral", "model")), *(rounded(F.col(c)).alias(c) for c in _KINDS), "validity")


_CELLS = PIXELS + ", cells AS (SELECT frame, y // 2 AS cy, x // 2 AS cx, avg(v) AS v FROM pixels GROUP BY ALL)"


@query(f"WITH {_CELLS} SELECT frame, {r4('avg(v)')} AS mean, {r4('max(v)')} AS high, {r4('min(v)')} AS low, {r4('stddev_pop(v)')} AS sd, {r4('quantile_cont(v, 0.25)')} AS p25, {r4('quantile_cont(v, 0.75)')} AS p75 FROM cells GROUP BY frame")
def i1_cell_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.cells(pixels(spark, sf_dir), 2)
    return c.groupBy("frame").agg(*(rounded(f).alias(n) for n, f in (("mean", F.avg("v")), ("high", F.max("v")), ("low", F.min("v")), ("sd", F.stddev_pop("v")), ("p25", F.percentile("v", 0.25)), ("p75", F.percentile("v", 0.75)))))


_MOVES = PIXELS + """, moves AS (SELECT a.frame, a.y // 2 AS cy, a.x // 2 AS cx, avg(abs(a.v - b.v)) AS v FROM pixels a JOIN pixels b ON b.frame = a.frame - 1 AND a.y = b.y AND a.x = b.x GROUP BY ALL)"""


@query(f"""WITH {_MOVES.replace("a.frame, a.y // 2", "a.frame // 50 AS stream, a.frame, a.y // 2").replace("b.frame = a.frame - 1", "b.frame = a.frame - 1 AND b.frame // 50 = a.frame // 50")} SELECT stream, frame, cy, cx, {r4('v')} AS motion, {r4('exp(-v / 2)')} AS confidence, CASE WHEN v < 0.5 THEN 'low' WHEN v < 1.0 THEN 'moderate' WHEN v < 2.0 THEN 'high' ELSE 'extreme' END AS level,
  {r4('exp(-5 * stddev_pop(v) OVER (PARTITION BY stream, cy, cx ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))')} AS stability FROM moves""")
def i2_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty frames are a stream."""
    p = pixels(spark, sf_dir).withColumn("stream", F.floor(F.col("frame") / 50))
    m = G.stability(G.motion(p, 2, "stream"), stream="stream")
    return m.select("stream", "frame", F.col("cy").cast("bigint").alias("cy"), F.col("cx").cast("bigint").alias("cx"), rounded(F.col("v")).alias("motion"), rounded(F.col("confidence")).alias("confidence"), "level", rounded(F.col("stability")).alias("stability"))


@query(f"""WITH {_MOVES}, cells AS (SELECT frame, y // 2 AS cy, x // 2 AS cx, avg(v) AS v FROM pixels GROUP BY ALL), q AS (SELECT c.frame, greatest(0, least(1, (c.v * 20 + 20) / 40)) AS q, exp(-m.v / 2) AS k FROM cells c JOIN moves m USING (frame, cy, cx))
SELECT frame, {r4('avg(q)')} AS plain, {r4('avg(greatest(0, least(1, q * k)))')} AS by_confidence, {r4('avg(greatest(0, least(1, q * least(k, 0.9))))')} AS by_least, {r4('avg(CASE WHEN q * k >= 0.3 THEN 1.0 ELSE 0.0 END)')} AS usable FROM q GROUP BY frame""")
def i3_motion_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    x = G.cells(p, 2).withColumnRenamed("v", "q").join(G.motion(p, 2).select("frame", "cy", "cx", "confidence"), ["frame", "cy", "cx"])
    of = lambda mode: G.aware_quality(F.col("q") * 20, F.col("confidence"), F.lit(0.9), mode)
    return x.groupBy("frame").agg(rounded(F.avg(of("none"))).alias("plain"), rounded(F.avg(of("confidence"))).alias("by_confidence"), rounded(F.avg(of("least"))).alias("by_least"), rounded(F.avg(F.when(of("confidence") >= 0.3, 1.0).otherwise(0.0))).alias("usable"))


@query(f"""WITH RECURSIVE {PIXELS}, mask AS (SELECT frame, (y * 8 + x)::BIGINT AS cell, y, x FROM pixels WHERE v > 0), e AS (SELECT a.frame, a.cell, b.cell AS other FROM mask a JOIN mask b ON a.frame = b.frame AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
reach AS (SELECT frame, cell, cell AS root FROM mask UNION SELECT r.frame, e.other, r.root FROM reach r JOIN e ON e.frame = r.frame AND e.cell = r.cell), l AS (SELECT frame, cell, min(root) AS region FROM reach GROUP BY ALL), s AS (SELECT frame, region, count(*) AS size FROM l GROUP BY ALL)
SELECT frame, region, size FROM s WHERE size >= 2""")
def i4_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of two or more cells above 0."""
    return G.regions(pixels(spark, sf_dir).where("v > 0"), 8).groupBy("frame", "region").agg(F.count("*").alias("size")).where("size >= 2")


_REACH = PIXELS + """, mask AS (SELECT frame, (y * 8 + x)::BIGINT AS cell, y, x, v FROM pixels WHERE v > 0), e AS (SELECT a.frame, a.cell, b.cell AS other FROM mask a JOIN mask b ON a.frame = b.frame AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
reach AS (SELECT frame, cell, cell AS root FROM mask UNION SELECT r.frame, e.other, r.root FROM reach r JOIN e ON e.frame = r.frame AND e.cell = r.cell), l AS (SELECT frame, cell, min(root) AS region FROM reach GROUP BY ALL),
c AS (SELECT frame, region, count(*) AS cells, avg(y) AS y, avg(x) AS x, avg(0.5 + 2 * v) * avg(1 - v) * avg(1 - v / 2) / (1 + 0.1 * abs(count(*) - 5)) AS score FROM l JOIN mask USING (frame, cell) GROUP BY ALL HAVING count(*) >= 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, region) AS rank FROM c WHERE score >= 0.2) WHERE rank <= 10)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    maps = pixels(spark, sf_dir).where("v > 0").select("frame", "y", "x", (0.5 + 2 * v).alias("quality"), (1 - v).alias("confidence"), (1 - v / 2).alias("stability"))
    return G.candidates(maps, 8, 0.5)


@query(f"WITH RECURSIVE {_REACH} SELECT frame, region, cells, {r4('score')} AS score, rank FROM best")
def i4_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("frame", "region", "cells", rounded(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH RECURSIVE {_REACH} SELECT a.frame, a.region, min(b.region) AS candidate FROM best a LEFT JOIN best b ON b.frame = a.frame - 1 AND sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) < 2 GROUP BY ALL")
def e8_candidate_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's candidates against those of the frame before."""
    c = _candidates(spark, sf_dir)
    known = c.select((F.col("frame") + 1).alias("stream"), F.col("region").alias("candidate"), "y", "x")
    return G.matched(c.select(F.col("frame").alias("stream"), "region", "y", "x"), known, 2.0).select(F.col("stream").alias("frame"), "region", "candidate")


_SCORES = "list_transform(list_filter(x, lambda v: abs(v) > 0.22), lambda v: abs(v) - 0.2)"


@query(f"""WITH {ARRAYS}, f AS (SELECT label AS stream, id AS frame, 1.4 * list_max(list_transform(x, lambda v: abs(v))) AS motion, {_SCORES} AS scores, 1 - 7 * list_avg(list_transform(x, lambda v: abs(v))) AS stability, 2.5 * x[1] + 0.7 AS quality, 25 * abs(x[2]) AS landmarks FROM arrays),
many AS (SELECT frame, count(*) OVER w >= 10 AND 10 * sum(len(scores) ** 2) OVER w - (sum(len(scores)) OVER w) ** 2 > 200 AS thrashing FROM f WHERE len(scores) >= 3 WINDOW w AS (PARTITION BY stream ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
q AS (SELECT *, avg(quality) OVER w AS m, stddev_pop(quality) OVER w AS sd, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY stream ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
g AS (SELECT frame, CASE WHEN motion > 0.8 THEN 2 WHEN motion > 0.4 THEN 1 END AS a, CASE WHEN len(scores) < 1 THEN 2 WHEN len(scores) < 2 THEN 1 END AS b, CASE WHEN thrashing THEN 1 END AS c,
  CASE WHEN len(scores) >= 2 AND list_stddev_pop(scores) > 0.4 * list_avg(scores) THEN 1 END AS d, CASE WHEN stability < 0.3 OR (n >= 5 AND m > 0 AND sd > 0.5 * m AND sd > 0.3) THEN 1 END AS e, CASE WHEN landmarks > 5 THEN 2 WHEN landmarks > 2 THEN 1 END AS h FROM q LEFT JOIN many USING (frame))
SELECT frame, concat_ws(',', CASE WHEN a > 0 THEN 'local_motion' END, CASE WHEN b > 0 THEN 'insufficient_candidates' END, CASE WHEN c > 0 THEN 'candidate_thrashing' END, CASE WHEN d > 0 THEN 'spatial_disagreement' END, CASE WHEN e > 0 THEN 'temporal_instability' END,
  CASE WHEN h > 0 THEN 'landmark_instability' END) AS failures, CASE greatest(0, a, b, c, d, e, h) WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, CASE greatest(0, a, b, c, d, e, h) WHEN 2 THEN 'reject' WHEN 1 THEN 'downweight' ELSE 'none' END AS action FROM g""")
def i6_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors; a label's vectors are a stream of frames, with inputs from their values."""
    x, size = F.col("x"), lambda v: F.abs(v)
    f = arrays(spark, sf_dir).select(
        F.col("label").alias("stream"), F.col("id").alias("frame"), (1.4 * F.array_max(F.transform(x, size))).alias("motion"), F.transform(F.filter(x, lambda v: F.abs(v) > 0.22), lambda v: F.abs(v) - 0.2).alias("scores"),
        (1 - 7 * mean_of(F.transform(x, size))).alias("stability"), (2.5 * F.get(x, F.lit(0)) + 0.7).alias("quality"), (25 * F.abs(F.get(x, F.lit(1)))).alias("landmark_variance"),
    )
    return gates.spatial_failures(f.withColumn("candidates", F.size("scores"))).select("frame", F.concat_ws(",", "failures").alias("failures"), "severity", "action")


@query(f"""WITH {SIGNAL}, p AS (SELECT session, seq, median(x - 50) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS yaw FROM signal) SELECT session, seq, {r4('yaw')} AS yaw, abs(yaw) <= 25 AS facing FROM p""")
def i10_pose_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(-7, 0)
    x = signal(spark, sf_dir).select("session", F.col("seq").cast("bigint").alias("seq"), F.percentile(F.col("x") - 50, 0.5).over(w).alias("yaw"))
    return x.select("session", "seq", rounded(F.col("yaw")).alias("yaw"), (F.abs("yaw") <= 25).alias("facing"))


_SPLIT = DOMAINS + """, placed AS (SELECT *, row_number() OVER (ORDER BY md5('42/' || sample), sample) - 1 AS place, count(*) OVER () AS n FROM domains),
split AS (SELECT sample, subject, domain, value, CASE WHEN place < floor(n * 0.7) THEN 'train' WHEN place < floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM placed)"""


@query(f"WITH {_SPLIT} SELECT sample, split FROM split")
def k1_random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.random_split(domains(spark, sf_dir)).select("sample", "split")


@query(f"""WITH {DOMAINS}, g AS (SELECT DISTINCT subject::VARCHAR AS g FROM domains), p AS (SELECT g, row_number() OVER (ORDER BY md5('42/' || g), g) - 1 AS place, count(*) OVER () AS n FROM g),
s AS (SELECT g, CASE WHEN place < floor(n * 0.7) THEN 'train' WHEN place < floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM p) SELECT sample, subject, split FROM domains JOIN s ON subject::VARCHAR = g""")
def k2_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.group_split(domains(spark, sf_dir), "subject").select("sample", "subject", "split")


@query(f"""WITH {DOMAINS}, folds AS (SELECT DISTINCT domain AS fold FROM domains), r AS (SELECT fold, d.sample, d.domain, row_number() OVER (PARTITION BY fold, d.domain = fold ORDER BY md5('42/' || d.sample), d.sample) AS k, count(*) OVER (PARTITION BY fold, d.domain = fold) AS n FROM domains d, folds)
SELECT fold, CASE WHEN domain = fold THEN 'test' WHEN k <= greatest(1, floor(n * 0.8)) THEN 'train' ELSE 'validation' END AS split, count(*) AS n, min(sample) AS least FROM r GROUP BY ALL""")
def k3_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.leave_one_out(domains(spark, sf_dir)).groupBy("fold", "split").agg(F.count("*").alias("n"), F.min("sample").alias("least"))


@query(f"WITH {_SPLIT} SELECT subject, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM split GROUP BY subject HAVING count(DISTINCT split) > 1")
def k4_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.leakage(K.random_split(domains(spark, sf_dir))).select("subject", F.concat_ws(",", "splits").alias("splits"))


@query(f"WITH {DOMAINS} SELECT sample, row_number() OVER (PARTITION BY domain ORDER BY md5('42/' || sample), sample) AS round FROM domains")
def k5_balanced_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.balanced_order(domains(spark, sf_dir)).select("sample", F.col("round").cast("bigint").alias("round"))


@query(f"WITH {DOMAINS}, n AS (SELECT domain, count(*) AS n FROM domains GROUP BY domain) SELECT domain, {r4('sum(n) OVER () / (count(*) OVER () * n)::DOUBLE')} AS weight, {r4('sqrt(sum(n) OVER () / n::DOUBLE)')} AS root_weight FROM n")
def k6_domain_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = domains(spark, sf_dir)
    x = K.domain_weights(d).join(K.domain_weights(d, root=True).withColumnRenamed("weight", "root_weight"), "domain")
    return x.select("domain", rounded(F.col("weight")).alias("weight"), rounded(F.col("root_weight")).alias("root_weight"))


@query(f"WITH {DOMAINS}, g AS (SELECT domain, avg(abs(value)) / 1000 AS loss FROM domains GROUP BY domain), w AS (SELECT domain, loss, exp(0.01 * loss) / sum(exp(0.01 * loss)) OVER () AS weight FROM g) SELECT domain, {r4('weight')} AS weight, {r4('sum(weight * loss) OVER ()')} AS weighted FROM w")
def k7_group_dro(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = K.group_dro(domains(spark, sf_dir).withColumn("loss", F.abs("value") / 1000))
    return x.select("domain", rounded(F.col("weight")).alias("weight"), rounded(F.col("weighted")).alias("weighted"))


@query(f"WITH {ARRAYS}, w AS (SELECT id, s AS start, x[s + 1 : s + 32] AS y FROM arrays, range(0, 33, 16) r(s)) SELECT id, start, {r4('list_avg(y)')} AS mean, {r4('list_stddev_pop(y)')} AS sd FROM w")
def k9_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = K.sliding(arrays(spark, sf_dir), "x", 32, 16)
    return w.select("id", F.col("start").cast("bigint").alias("start"), rounded(mean_of(F.col("window"))).alias("mean"), rounded(std_of(F.col("window"))).alias("sd"))


@query(f"""WITH {ARRAYS}, a AS (SELECT id, list_transform(x, lambda v: v * 1.1) AS scaled, list_concat(list_transform(range(4), lambda i: x[1]), x[1:60]) AS shifted, list_concat(x[1:20], list_transform(range(8), lambda i: 0.0), x[29:64]) AS masked FROM arrays)
SELECT id, {r4('list_sum(scaled)')} AS scaled, {r4('list_sum(shifted)')} AS shifted, {r4('list_sum(masked)')} AS masked FROM a""")
def k10_augmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale by 1.1, shift by 4 repeating the edge, steps 20..27 masked."""
    x = F.col("x")
    return arrays(spark, sf_dir).select("id", *(rounded(sum_of(y)).alias(n) for n, y in (("scaled", A.scaled(x, 1.1)), ("shifted", A.shifted(x, 4)), ("masked", A.masked(x, 20, 8)))))


@query(f"""WITH {ARRAYS}, h AS (SELECT id, x, ('0x' || substr(md5('crop/' || id), 1, 8))::BIGINT / 2.0 ** 32 AS place FROM arrays), p AS (SELECT id, unnest(x) AS v, unnest(range(64)) AS i FROM arrays)
SELECT h.id, {r4('max(list_sum(x[floor(place * 17)::INT + 1 : floor(place * 17)::INT + 48]))')} AS cropped, {r4("sum(CASE WHEN ('0x' || substr(md5('drop/' || p.id || '/' || i), 1, 8))::BIGINT / 2.0 ** 32 < 0.2 THEN 0.0 ELSE v END)")} AS dropped FROM h JOIN p USING (id) GROUP BY h.id""")
def k10_random_augmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quarters of a row from a place of its own; a fifth of the samples dropped."""
    x, key = F.col("x"), F.col("id")
    return arrays(spark, sf_dir).select("id", rounded(sum_of(A.cropped(x, F.lit(0.75), A.chance(key, "crop")))).alias("cropped"), rounded(sum_of(A.dropped(x, key, 0.2))).alias("dropped"))


_TWO = ARRAYS + ", two AS (SELECT a.id, a.x AS p, b.x AS y FROM arrays a JOIN arrays b ON b.id = a.id + 1), pts AS (SELECT id, unnest(p) AS p, unnest(y) AS y FROM two)"


@query(f"WITH {_TWO} SELECT id, {r4('avg((p - y) ** 2)')} AS mse, {r4('1 - corr(p, y)')} AS correlation_loss, {r4('sqrt(avg((p - y) ** 2))')} AS rmse, {r4('avg(abs(p - y) / (abs(y) + 1e-8)) * 100 / 1000')} AS mape FROM pts GROUP BY id")
def l2_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal against the next as its target (mape in tens of percent)."""
    a = arrays(spark, sf_dir)
    x = a.select("id", F.col("x").alias("p")).join(a.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id")
    p, y = F.col("p"), F.col("y")
    mape = mean_of(F.zip_with(p, y, lambda u, v: F.abs(u - v) / (F.abs(v) + 1e-8))) * 100 / 1000
    return x.select("id", rounded(L.mse(p, y)).alias("mse"), rounded(1 - L.correlation(p, y)).alias("correlation_loss"), rounded(F.sqrt(L.mse(p, y))).alias("rmse"), rounded(mape).alias("mape"))


_MAGNITUDES = ARRAYS + """, pts AS (SELECT a.id, unnest(a.x) AS p, unnest(b.x) AS y, unnest(range(64)) AS i FROM arrays a JOIN arrays b ON b.id = a.id + 1),
m AS (SELECT id, k, sqrt(sum(p * cos(2 * pi() * k * i / 64)) ** 2 + sum(p * sin(2 * pi() * k * i / 64)) ** 2) AS mp, sqrt(sum(y * cos(2 * pi() * k * i / 64)) ** 2 + sum(y * sin(2 * pi() * k * i / 64)) ** 2) AS my FROM pts, range(0, 33) r(k) GROUP BY ALL),
s AS (SELECT id, avg(abs(mp - my)) FILTER (k * 30 / 64.0 BETWEEN 0.833 AND 3.0) + 0.1 * avg(abs(mp - my)) FILTER (k * 30 / 64.0 NOT BETWEEN 0.833 AND 3.0) AS frequency FROM m GROUP BY id),
n AS (SELECT id, avg(abs(mp / (hp + 1e-9) - my / (hy + 1e-9))) AS spectral FROM (SELECT *, max(mp) OVER w AS hp, max(my) OVER w AS hy FROM m WINDOW w AS (PARTITION BY id)) GROUP BY id),
t AS (SELECT id, avg((p - y) ** 2) AS mse, 1 - corr(p, y) AS correlation FROM pts GROUP BY id)"""


@query(f"""WITH {_MAGNITUDES} SELECT id, {r4('spectral')} AS spectral, {r4('frequency')} AS frequency, {r4('mse + 0.5 * correlation + 0.3 * spectral')} AS waveform FROM t JOIN n USING (id) JOIN s USING (id)""")
def l2_waveform_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal against the next as its target, by their spectra."""
    a = arrays(spark, sf_dir)
    x = a.select("id", F.col("x").alias("p")).join(a.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id")
    x = x.select("id", "p", "y", *(S.spectrum(F.col(c), 64, 30.0, 0, 32).alias(f"{c}_bins") for c in ("p", "y")))
    p, y = F.col("p_bins"), F.col("y_bins")
    return x.select("id", rounded(L.spectral_loss(p, y)).alias("spectral"), rounded(L.frequency_loss(p, y)).alias("frequency"), rounded(L.waveform_loss(F.col("p"), F.col("y"), p, y)).alias("waveform"))


@query(f"WITH {PAIRS}, b AS (SELECT method, greatest(1e-7, least(1 - 1e-7, confidence / 100)) AS p, CASE WHEN abs(measured - reference) <= 10 THEN 1.0 ELSE 0.0 END AS y FROM pairs WHERE valid) SELECT method, {r4('avg(-(y * ln(p) + (1 - y) * ln(1 - p)))')} AS bce FROM b GROUP BY method")
def l2_confidence_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.when(F.abs(F.col("measured") - F.col("reference")) <= 10, 1.0).otherwise(0.0)
    return pairs(spark, sf_dir).where("valid").groupBy("method").agg(rounded(F.avg(L.bce(F.col("confidence") / 100, y))).alias("bce"))


@query(f"""WITH {_TWO}, s AS (SELECT id, id // 16 AS batch, p, y FROM two), c AS (SELECT a.batch, a.id, b.id AS other, list_cosine_similarity(a.p, b.y) / 0.5 AS z FROM s a JOIN s b ON a.batch = b.batch)
SELECT batch, {r4('avg(lse - own)')} AS loss FROM (SELECT batch, id, ln(sum(exp(z))) AS lse, max(z) FILTER (id = other) AS own FROM c GROUP BY ALL) GROUP BY batch""")
def l3_contrastive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NT-Xent within batches of 16 consecutive pairs (T26); a batch is a fixed number of rows, so the pairs within it are bounded."""
    a = arrays(spark, sf_dir)
    s = a.select("id", F.col("x").alias("p")).join(a.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id").withColumn("batch", F.floor(F.col("id") / 16))
    c = s.select("batch", "id", "p").join(s.select("batch", F.col("id").alias("other"), "y"), "batch").withColumn("z", L.cosine(F.col("p"), F.col("y")) / 0.5)
    g = c.groupBy("batch", "id").agg(F.log(F.sum(F.exp("z"))).alias("lse"), F.max(F.when(F.col("id") == F.col("other"), F.col("z"))).alias("own"))
    return g.groupBy("batch").agg(rounded(F.avg(F.col("lse") - F.col("own"))).alias("loss"))


_PAD = f"{ARRAYS}, kept AS (SELECT id, v, i FROM points WHERE i < 20 + id % 44)"


_BCE = "-({y} * ln(greatest(1e-7, least(1 - 1e-7, {p}))) + (1 - {y}) * ln(1 - greatest(1e-7, least(1 - 1e-7, {p}))))"


@query(f"""WITH {ARRAYS}, r AS (SELECT a.label AS batch, a.id, a.x AS p, b.x AS y, 70 + 20 * a.x[1] AS hr_p, 70 + a.id % 9 AS hr_y, a.id % 3 > 0 AS hr_ok, 0.5 + a.x[2] AS sqi_p, 0.5 + 3 * a.x[3] AS sqi_y, a.id % 4 > 0 AS sqi_ok, 0.5 + a.x[4] AS conf, a.id % 2 = 0 OR a.label = 3 AS bvp_ok FROM arrays a JOIN arrays b ON b.id = a.id + 1 WHERE a.label <> 4 OR a.id % 3 = 0),
e AS (SELECT *, list_avg(list_transform(list_zip(p, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS mse, (list_avg(list_transform(list_zip(p, y), lambda z: z[1] * z[2])) - list_avg(p) * list_avg(y)) / (list_stddev_pop(p) * list_stddev_pop(y)) AS r, greatest(0, least(1, sqi_y)) AS sqi_t, abs(hr_p - hr_y) < 5 AS good, min(CASE WHEN hr_ok THEN hr_y END) OVER b AS lo, max(CASE WHEN hr_ok THEN hr_y END) OVER b AS hi FROM r WINDOW b AS (PARTITION BY batch)),
g AS (SELECT batch, coalesce(avg(mse + 0.5 * (1 - r)) FILTER (bvp_ok), 0) AS bvp, coalesce(avg((hr_p - hr_y) ** 2) FILTER (hr_ok), 0) AS hr, coalesce(avg(CASE WHEN hi > lo THEN (1 - (hr_y - lo) / (hi - lo)::DOUBLE) ** 2 ELSE 0 END * (hr_p - hr_y) ** 2) FILTER (hr_ok), 0) AS focal, coalesce(avg({_BCE.format(p='sqi_p', y='sqi_t')}) FILTER (sqi_ok), 0) AS sqi,
  coalesce(avg({_BCE.format(p='conf', y='good::INT')}) FILTER (hr_ok), 0) + 0.1 * coalesce(var_samp(conf) FILTER (hr_ok), 0) AS confidence FROM e GROUP BY batch)
SELECT batch, {", ".join(f"{r4(c)} AS {c}" for c in ("bvp", "hr", "focal", "sqi", "confidence"))}, {r4('bvp + 0.01 * hr + 0.001 * focal + 0.5 * sqi + 0.1 * confidence')} AS total FROM g""")
def l2_multitask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of four tasks by batch (label), each over the rows whose label is available, and their weighted sum."""
    a = arrays(spark, sf_dir)
    r = a.join(a.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id").where("label <> 4 OR id % 3 = 0")
    x, at = F.col("x"), lambda i: F.get("x", F.lit(i))
    r = r.select(F.col("label").alias("batch"), (L.mse(x, F.col("y")) + 0.5 * (1 - L.correlation(x, F.col("y")))).alias("bvp"), ((F.col("id") % 2 == 0) | (F.col("label") == 3)).alias("bvp_ok"), (70 + 20 * at(0)).alias("hr_p"), (70 + F.col("id") % 9).cast("double").alias("hr_y"), (F.col("id") % 3 > 0).alias("hr_ok"),
                 (0.5 + at(1)).alias("sqi_p"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 3 * at(2))).alias("sqi_y"), (F.col("id") % 4 > 0).alias("sqi_ok"), (0.5 + at(3)).alias("conf"))
    known = F.when(F.col("hr_ok"), F.col("hr_y"))
    r = r.join(r.groupBy("batch").agg(F.min(known).alias("lo"), F.max(known).alias("hi")), "batch")
    p, y, ok = F.col("hr_p"), F.col("hr_y"), F.col("hr_ok")
    g = r.groupBy("batch").agg(L.mean_of_available(F.col("bvp"), F.col("bvp_ok")).alias("bvp"), L.mean_of_available((p - y) * (p - y), ok).alias("hr"), L.focal_loss(p, y, F.col("lo"), F.col("hi"), ok).alias("focal"),
                               L.mean_of_available(L.bce(F.col("sqi_p"), F.col("sqi_y")), F.col("sqi_ok")).alias("sqi"), L.confidence_loss(F.col("conf"), F.abs(p - y), ok, exact=5.0).alias("confidence"))
    total = F.col("bvp") + 0.01 * F.col("hr") + 0.001 * F.col("focal") + 0.5 * F.col("sqi") + 0.1 * F.col("confidence")
    return g.select("batch", *(rounded(F.col(c)).alias(c) for c in ("bvp", "hr", "focal", "sqi", "confidence")), rounded(total).alias("total"))


@query(f"""WITH {ARRAYS}, r AS (SELECT a.label AS batch, a.id, a.x AS p, b.x AS y, list_transform(range(64), lambda i: (i + a.id) % 3 = 0) AS m FROM arrays a JOIN arrays b ON b.id = a.id + 1),
e AS (SELECT *, list_sum(list_transform(list_zip(p, y, m), lambda z: CASE WHEN z[3] THEN (z[1] - z[2]) ** 2 ELSE 0 END)) AS err, len(list_filter(m, lambda v: v)) AS n, list_stddev_samp(p) AS sd, list_cosine_similarity(p, y) AS c FROM r),
g AS (SELECT batch, sum(err) / (sum(n) + 1e-9) AS predictive, -0.1 * avg(sd) AS consistency, 2 - 2 * avg(c) AS agreement FROM e GROUP BY batch)
SELECT batch, {r4('predictive')} AS predictive, {r4('consistency')} AS consistency, {r4('agreement')} AS agreement, {r4('0.5 * consistency + 0.3 * predictive + 0.1 * agreement')} AS total FROM g""")
def l3_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked reconstruction, consistency and agreement of views by batch (label), and their weighted sum."""
    a = arrays(spark, sf_dir)
    r = a.join(a.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id").withColumn("m", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i + F.col("id")) % 3 == 0))
    x, y = F.col("x"), F.col("y")
    g = r.groupBy(F.col("label").alias("batch")).agg(L.masked_mse(x, y, F.col("m")).alias("predictive"), L.spread_loss(x).alias("consistency"), L.agreement_loss(x, y).alias("agreement"))
    total = 0.5 * F.col("consistency") + 0.3 * F.col("predictive") + 0.1 * F.col("agreement")
    return g.select("batch", *(rounded(F.col(c)).alias(c) for c in ("predictive", "consistency", "agreement")), rounded(total).alias("total"))


@query(f"WITH {_PAD} SELECT id, {r4('avg(v)')} AS mean, {r4('max(v)')} AS high, {r4('arg_max(v, i)')} AS last, {r4('sum(exp(v) * v) / sum(exp(v))')} AS attention, {r4('40 + 160 / (1 + exp(-avg(v)))')} AS rate FROM kept GROUP BY id")
def l5_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled over the first 20 + id mod 44 steps, the rest being padding."""
    a = arrays(spark, sf_dir).withColumn("pad", F.transform("x", lambda v, i: i >= 20 + F.pmod("id", F.lit(44))))
    of = lambda kind: L.pooled(F.col("x"), F.col("pad"), kind)
    return a.select("id", rounded(of("mean")).alias("mean"), rounded(of("max")).alias("high"), rounded(of("last")).alias("last"), rounded(of("attention")).alias("attention"), rounded(L.to_rate(of("mean"))).alias("rate"))


@query(f"WITH {ARRAYS} SELECT id, 64 - (20 + id % 44) AS padded, {r4('list_sum(x[1 : (20 + id % 44)::INT])')} AS total FROM arrays")
def a15_pad_and_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of unequal length padded with zeros to 64; the mask is true at padding."""
    n = (20 + F.pmod("id", F.lit(44))).cast("int")
    a = arrays(spark, sf_dir).withColumn("y", F.slice("x", 1, n)).withColumn("z", F.concat("y", F.array_repeat(F.lit(0.0), 64 - F.size("y")))).withColumn("mask", F.transform("z", lambda v, i: i >= F.size("y")))
    return a.select("id", F.size(F.filter("mask", lambda m: m)).cast("bigint").alias("padded"), rounded(sum_of(F.col("z"))).alias("total"))


@query(f"WITH {SIGNAL}, d AS (SELECT session, t, x, t - lag(t) OVER (PARTITION BY session ORDER BY seq) AS step FROM signal) SELECT session, count(*) AS n, min(step) > 0 AS monotonic, {r4('avg(step)')} AS mean_step, {r4('min(x)')} AS low, {r4('max(x)')} AS high, {r4('avg(x)')} AS mean, min(x) >= 0 AND max(x) <= 200 AS plausible FROM d GROUP BY session")
def a5_validate_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir).withColumn("step", F.col("t") - F.lag("t").over(Window.partitionBy("session").orderBy("seq")))
    return s.groupBy("session").agg(F.count("*").alias("n"), (F.min("step") > 0).alias("monotonic"), rounded(F.avg("step")).alias("mean_step"), rounded(F.min("x")).alias("low"), rounded(F.max("x")).alias("high"), rounded(F.avg("x")).alias("mean"), ((F.min("x") >= 0) & (F.max("x") <= 200)).alias("plausible"))


@query("SELECT o_orderkey AS id, o_custkey AS session, o_totalprice AS value FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def a8_session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 50 sessions: the limit is the operator's own."""
    o = table(spark, sf_dir, "orders").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(50)
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session"), F.col("o_totalprice").alias("value"))


@query(f"WITH {SIGNAL} SELECT session, CASE WHEN x < 20 OR x > 95 THEN 'warning' ELSE 'valid' END AS verdict, count(*) AS n FROM signal GROUP BY ALL")
def a1_plausible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows out of range stay, with a warning."""
    x = F.col("x")
    return samples(spark, sf_dir).groupBy("session", F.when((x < 20) | (x > 95), "warning").otherwise("valid").alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""WITH {SAMPLES}, s AS (SELECT session, avg(x) AS m, count(*) FILTER (roi = 'error') AS e FROM samples GROUP BY session) SELECT session, concat_ws('; ', CASE WHEN m > 55 THEN 'rate is high' END, CASE WHEN m < 45 THEN 'rate is low' END, CASE WHEN e > 15 THEN 'signal is poor' END) AS advice FROM s""")
def j7_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three messages of a session."""
    s = samples(spark, sf_dir).groupBy("session").agg(F.avg("x").alias("m"), F.count_if(F.col("roi") == "error").alias("e"))
    texts = F.array_compact(F.array(F.when(F.col("m") > 55, "rate is high"), F.when(F.col("m") < 45, "rate is low"), F.when(F.col("e") > 15, "signal is poor")))
    return s.select("session", F.concat_ws("; ", F.slice(texts, 1, 3)).alias("advice"))


@query(f"""WITH {PAIRS}, m AS (SELECT id, avg(abs(measured - reference)) FILTER (method = 'A') AS base, avg(abs(measured - reference)) FILTER (method = 'R') AS evolved FROM pairs GROUP BY id)
SELECT CASE WHEN base IS NULL OR evolved IS NULL THEN 'INCONCLUSIVE' WHEN evolved < base THEN 'KEEP' ELSE 'REJECT' END AS verdict, count(*) AS n FROM m GROUP BY 1""")
def j10_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a changed method is nearer the reference than the baseline, by series."""
    e = F.abs(F.col("measured") - F.col("reference"))
    m = pairs(spark, sf_dir).groupBy("id").agg(F.avg(F.when(F.col("method") == "A", e)).alias("base"), F.avg(F.when(F.col("method") == "R", e)).alias("evolved"))
    verdict = F.when(F.col("base").isNull() | F.col("evolved").isNull(), "INCONCLUSIVE").when(F.col("evolved") < F.col("base"), "KEEP").otherwise("REJECT")
    return m.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))
