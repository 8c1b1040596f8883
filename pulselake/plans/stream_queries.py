"""Alignment, projection and conditioning queries (survey B, C, E)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import spectral as S
from ..functions.numeric import dot, rounded, settled, std_of, sum_of
from ..operators import alignment as A
from ..operators import projections as P
from .bindings import ARRAYS, DOMAINS, RGB, SAMPLES, SIGNAL, arrays, domains, rgb, samples, signal
from .registry import SQL, query, r4


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = samples(spark, sf_dir).select("session", F.col("event_id").alias("id"), "t", "x", "roi")
    return s.where("roi = 'view'").drop("roi"), s.where("roi = 'click'").drop("roi")


_SIDES = SAMPLES + ", pred AS (SELECT session, event_id AS id, t, x FROM samples WHERE roi = 'view'), ref AS (SELECT session, event_id AS id, t, x FROM samples WHERE roi = 'click')"
_NEAREST = _SIDES + """, near AS (SELECT p.session, p.id AS pred_id, r.id AS ref_id, p.x AS pred_x, r.x AS ref_x, abs(p.t - r.t) AS apart,
  row_number() OVER (PARTITION BY p.id ORDER BY abs(p.t - r.t), r.t, r.id) AS k FROM pred p JOIN ref r ON p.session = r.session AND abs(p.t - r.t) <= 86400)"""


@query(f"WITH {_NEAREST} SELECT session, pred_id, ref_id, {r4('apart')} AS apart, {r4('pred_x - ref_x')} AS error FROM near WHERE k = 1")
def e2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.nearest(*_sides(spark, sf_dir), A.days(1))
    return m.select("session", "pred_id", "ref_id", rounded(F.col("apart")).alias("apart"), rounded(F.col("pred_x") - F.col("ref_x")).alias("error"))


@query(f"""WITH {_NEAREST}, n AS (SELECT session, count(*) AS predictions FROM pred GROUP BY session), m AS (SELECT session, count(*) AS matches, max(apart) AS max_apart FROM near WHERE k = 1 GROUP BY session)
SELECT session, predictions, coalesce(matches, 0) AS matches, predictions - coalesce(matches, 0) AS unmatched, {r4('coalesce(matches, 0) / predictions::DOUBLE')} AS rate, {r4('max_apart')} AS max_apart FROM n LEFT JOIN m USING (session)""")
def e2_alignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, ref = _sides(spark, sf_dir)
    out = A.summary(pred, A.nearest(pred, ref, A.days(1)))
    return out.select("session", "predictions", "matches", "unmatched", rounded(F.col("rate")).alias("rate"), rounded(F.col("max_apart")).alias("max_apart"))


def greedy_sql(within: str) -> str:
    """The pairs of E1 as a recursion over each session's predictions, which remembers the references taken."""
    return f"""RECURSIVE {_SIDES}, c AS (SELECT p.id, list({{'apart': abs(p.t - r.t), 't': r.t, 'id': r.id}} ORDER BY abs(p.t - r.t), r.t, r.id) AS near FROM pred p JOIN ref r ON p.session = r.session AND abs(p.t - r.t) {within} GROUP BY p.id),
p AS (SELECT session, id, near, row_number() OVER (PARTITION BY session ORDER BY t, id) AS n FROM pred LEFT JOIN c USING (id)),
k AS (SELECT DISTINCT session, 0::BIGINT AS n, NULL::BIGINT AS pred_id, NULL::BIGINT AS ref_id, []::BIGINT[] AS taken FROM p UNION ALL
SELECT session, n, id, ref_id, CASE WHEN ref_id IS NULL THEN taken ELSE list_append(taken, ref_id) END FROM (SELECT p.session, p.n, p.id, k.taken, list_filter(p.near, lambda r: NOT list_contains(k.taken, r.id))[1].id AS ref_id FROM k JOIN p ON p.session = k.session AND p.n = k.n + 1) j),
matched AS (SELECT k.session, k.pred_id, k.ref_id, p.t AS pred_t, r.t AS ref_t, p.x AS pred_x, r.x AS ref_x, abs(p.t - r.t) AS apart FROM k JOIN pred p ON p.id = k.pred_id JOIN ref r ON r.id = k.ref_id)"""


@query(f"WITH {greedy_sql('<= 86400')} SELECT * FROM matched")
def e1_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one in prediction order; view events stand for predictions, click events for references."""
    return A.greedy(*_sides(spark, sf_dir), A.days(1))


@query(f"WITH {greedy_sql('< 86401')} SELECT * FROM matched")
def e3_greedy_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anything less than the tolerance and one second."""
    return A.greedy(*_sides(spark, sf_dir), A.days(1), compat=True)


@query(f"""WITH {_SIDES}, a AS (SELECT session, x AS pred_x, row_number() OVER (PARTITION BY session ORDER BY t DESC, id DESC) AS back FROM pred), b AS (SELECT session, x AS ref_x, row_number() OVER (PARTITION BY session ORDER BY t DESC, id DESC) AS back FROM ref)
SELECT session, back, pred_x, ref_x FROM a JOIN b USING (session, back)""")
def e4_index_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.by_index(*_sides(spark, sf_dir)).select("session", F.col("back").cast("bigint").alias("back"), "pred_x", "ref_x")


_ROIS = SAMPLES + ", rois AS (SELECT session AS frame, roi, avg(x) AS bpm, least(100.0, count(*) * 5.0) AS sqi FROM samples GROUP BY ALL)"


def rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy(F.col("session").alias("frame"), "roi").agg(F.avg("x").alias("bpm"), F.least(F.lit(100.0), F.count("*") * 5.0).alias("sqi"))


@query(f"""WITH {_ROIS} SELECT a.frame, a.roi, bool_or(a.bpm / b.bpm > 1.85 AND a.bpm / b.bpm < 2.15 AND b.sqi > 30) AS doubled, bool_or(abs(a.bpm - 2 * b.bpm) < 8 AND b.sqi > 25) AS suspect
FROM rois a JOIN rois b ON a.frame = b.frame AND a.roi <> b.roi GROUP BY ALL""")
def e6_harmonic_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of one frame whose rate is about twice that of another good one: an equi join on the frame."""
    a = rois(spark, sf_dir)
    b = a.toDF("frame", "roi_b", "bpm_b", "sqi_b")
    x = a.join(b, "frame").where("roi <> roi_b")
    q = F.try_divide(F.col("bpm"), F.col("bpm_b"))
    return x.groupBy("frame", "roi").agg(F.bool_or((q > 1.85) & (q < 2.15) & (F.col("sqi_b") > 30)).alias("doubled"), F.bool_or((F.abs(F.col("bpm") - 2 * F.col("bpm_b")) < 8) & (F.col("sqi_b") > 25)).alias("suspect"))


@query(f"WITH {SIGNAL}, {DOMAINS} SELECT coalesce(domain, 'unknown') AS domain, count(*) AS n FROM signal LEFT JOIN domains ON session = 3 * sample GROUP BY 1")
def e7_domain_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's samples stand for every third session, so that some sessions are unknown."""
    d = domains(spark, sf_dir).select((3 * F.col("sample")).alias("session"), "domain")
    return samples(spark, sf_dir).join(d, "session", "left").groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count("*").alias("n"))


@query(f"WITH {RGB}, l AS (SELECT session, regr_slope(g, seq) AS s, regr_intercept(g, seq) AS i FROM rgb GROUP BY session) SELECT session, seq, {r4('g - i - s * seq')} AS y FROM rgb JOIN l USING (session)")
def b1_green(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.green(rgb(spark, sf_dir)).select("session", F.col("seq").cast("bigint").alias("seq"), rounded(F.col("y")).alias("y"))


_SCALED = RGB + ", scaled AS (SELECT session, seq, r / avg(r) OVER w AS r, g / avg(g) OVER w AS g, b / avg(b) OVER w AS b FROM rgb WINDOW w AS (PARTITION BY session))"


@query(f"""WITH {_SCALED}, p AS (SELECT session, seq, 3 * r - 2 * g AS xs, 1.5 * r + g - 1.5 * b AS ys FROM scaled)
SELECT session, seq, {r4('xs - stddev_pop(xs) OVER (PARTITION BY session) / (stddev_pop(ys) OVER (PARTITION BY session) + 1e-9) * ys')} AS y FROM p""")
def b2_chrom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chrom(rgb(spark, sf_dir)).select("session", F.col("seq").cast("bigint").alias("seq"), rounded(F.col("y")).alias("y"))


_POS = _SCALED + """, s AS (SELECT session, seq, g - b AS s1, g + b - 2 * r AS s2 FROM scaled), pos AS (SELECT *, stddev_pop(s1) OVER (PARTITION BY session) / (stddev_pop(s2) OVER (PARTITION BY session) + 1e-9) AS alpha FROM s)"""


@query(f"WITH {_POS} SELECT session, seq, {r4('s1 + alpha * s2')} AS y FROM pos")
def b3_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pos(rgb(spark, sf_dir)).select("session", F.col("seq").cast("bigint").alias("seq"), rounded(F.col("y")).alias("y"))


@query(f"""WITH {_SCALED}, s AS (SELECT session, seq, g - b AS p, g + b AS q FROM scaled), d AS (SELECT *, stddev_pop(p) OVER (PARTITION BY session) AS sp, stddev_pop(q) OVER (PARTITION BY session) AS sq FROM s)
SELECT session, seq, {r4('p / sp - sp / sq * (q / sq)')} AS y FROM d""")
def b4_core_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.core_pos(rgb(spark, sf_dir)).select("session", F.col("seq").cast("bigint").alias("seq"), rounded(F.col("y")).alias("y"))


@query(f"WITH {_POS} SELECT session, seq, {r4('s1 + alpha * s2')} AS h, {r4('s1 - s2 / alpha')} AS m, {r4('alpha')} AS alpha, {r4('s1')} AS s1, {r4('s2')} AS s2 FROM pos")
def b5_pos_with_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = P.pos(rgb(spark, sf_dir))
    return x.select("session", F.col("seq").cast("bigint").alias("seq"), rounded(F.col("y")).alias("h"), *(rounded(F.col(c)).alias(c) for c in ("m", "alpha", "s1", "s2")))


@query(f"""WITH {SIGNAL}, l AS (SELECT session, regr_slope(x, seq) AS s, regr_intercept(x, seq) AS i, count(*) AS n FROM signal GROUP BY session), d AS (SELECT session, seq, n, x - coalesce(i + s * seq, x) AS d FROM signal JOIN l USING (session)),
p AS (SELECT *, seq AS pos FROM d UNION ALL SELECT *, 2 - seq FROM d WHERE n > 45 AND seq BETWEEN 2 AND 23 UNION ALL SELECT *, 2 * n - seq FROM d WHERE n > 45 AND seq BETWEEN n - 22 AND n - 1),
a AS (SELECT session, seq, pos, CASE WHEN n > 45 THEN d - avg(d) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN 22 PRECEDING AND 22 FOLLOWING) ELSE d END AS y FROM p),
z AS (SELECT session, seq, y, stddev_pop(y) OVER (PARTITION BY session) AS sd FROM a WHERE pos = seq)
SELECT session, seq, {r4('CASE WHEN sd > 1e-9 THEN y / sd ELSE y END')} AS y FROM z""")
def c1_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.detrended(signal(spark, sf_dir)).select("session", F.col("seq").cast("bigint").alias("seq"), rounded(F.col("y")).alias("y"))


_HANN = f"{ARRAYS}, hann AS (SELECT id, i, v * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS v FROM points)"


@query(f"WITH {_HANN} SELECT id, {r4('sum(v)')} AS total, {r4('sum(v * v)')} AS energy FROM hann GROUP BY id")
def c3_windowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = arrays(spark, sf_dir).withColumn("h", S.windowed(F.col("x"), 64))
    return x.select("id", rounded(sum_of(F.col("h"))).alias("total"), rounded(dot(F.col("h"), F.col("h"))).alias("energy"))


@query(f"""WITH {SIGNAL}, e AS (SELECT session, seq, x, abs(avg(x) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) - avg(x) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 89 PRECEDING AND 10 PRECEDING)) AS drift FROM signal)
SELECT session, seq, {r4('drift')} AS drift, drift > 20 AS flagged FROM e WHERE drift IS NOT NULL""")
def c4_exposure_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the last 10 samples are from those before, of 90."""
    w = Window.partitionBy("session").orderBy("seq")
    drift = F.abs(F.avg("x").over(w.rowsBetween(-9, 0)) - F.avg("x").over(w.rowsBetween(-89, -10)))
    return signal(spark, sf_dir).select("session", F.col("seq").cast("bigint").alias("seq"), drift.alias("drift")).where("drift IS NOT NULL").select("session", "seq", rounded(F.col("drift")).alias("drift"), (settled(F.col("drift")) > 20).alias("flagged"))


@query(f"WITH {ARRAYS}, m AS (SELECT id, avg(v) AS m, stddev_pop(v) AS s FROM points GROUP BY id) SELECT id, i, {r4('(v - m) / s')} AS z FROM points JOIN m USING (id)")
def c5_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = arrays(spark, sf_dir).withColumn("s", std_of(F.col("x"))).withColumn("c", S.centred(F.col("x")))
    return a.select("id", "s", F.posexplode("c").alias("i", "v")).select("id", F.col("i").cast("bigint").alias("i"), rounded(F.try_divide(F.col("v"), F.col("s"))).alias("z"))


@query(f"""WITH {SIGNAL}, span AS (SELECT session, min(t) AS t0, max(t) AS t1, floor((max(t) - min(t)) / 43200)::BIGINT AS n FROM signal GROUP BY session HAVING count(*) >= 10 AND max(t) - min(t) >= 1 AND floor((max(t) - min(t)) / 43200) >= 10),
grid AS (SELECT session, n, t1, unnest(range(0, n)) AS k, t0, n / (t1 - t0) AS rate FROM span), points AS (SELECT session, k, rate, CASE WHEN k = n - 1 THEN t1 ELSE t0 + (t1 - t0) * k / (n - 1) END AS g FROM grid),
seg AS (SELECT session, t, x, lead(t) OVER w AS t2, lead(x) OVER w AS x2 FROM signal WINDOW w AS (PARTITION BY session ORDER BY t, event_id))
SELECT session, k, {r4('CASE WHEN x2 IS NULL THEN x ELSE x + (x2 - x) * (g - t) / (t2 - t) END')} AS y, {r4('rate * 86400')} AS rate FROM points JOIN seg USING (session) WHERE g >= t AND (t2 IS NULL OR g < t2)""")
def c6_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear interpolation on int(duration * rate) even points, both ends included, two a day; sessions of fewer than ten samples or
    points have none. Samples and grid points are one ordered stream, each point looks back and ahead."""
    s = signal(spark, sf_dir)
    span = s.groupBy("session").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("m")).where("m >= 10 AND t1 - t0 >= 1").withColumn("n", F.floor((F.col("t1") - F.col("t0")) / 43200)).where("n >= 10")
    at = F.when(F.col("k") == F.col("n") - 1, F.col("t1")).otherwise(F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("k") / (F.col("n") - 1))
    grid = span.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("session", at.alias("t"), "k", (F.col("n") / (F.col("t1") - F.col("t0"))).alias("rate"))
    both = s.select("session", "t", F.lit(None).cast("bigint").alias("k"), F.struct("t", "x").alias("p"), "event_id").unionByName(grid.withColumn("p", F.lit(None)).withColumn("event_id", F.lit(None)), allowMissingColumns=True)
    w = Window.partitionBy("session").orderBy("t", F.col("event_id").asc_nulls_last())
    down = Window.partitionBy("session").orderBy(F.col("t").desc(), F.col("event_id").desc_nulls_first())  # what follows, looked back at
    x = both.withColumn("a", F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("b", F.last("p", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))).where("k IS NOT NULL")
    y = F.coalesce(F.col("a.x") + (F.col("b.x") - F.col("a.x")) * F.try_divide(F.col("t") - F.col("a.t"), F.col("b.t") - F.col("a.t")), F.col("a.x"))
    return x.select("session", "k", rounded(y).alias("y"), rounded(F.col("rate") * 86400).alias("rate"))


@query(f"""WITH {RGB} SELECT session, seq, {r4('avg(g) OVER w / avg(r) OVER w')} AS nf_r, {r4('avg(g) OVER w / avg(b) OVER w')} AS nf_b FROM rgb WINDOW w AS (PARTITION BY session ORDER BY seq ROWS BETWEEN 149 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w >= 30""")
def c8_skin_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = P.moving_means(rgb(spark, sf_dir).withColumn("seq", F.col("seq").cast("bigint")), 150, ("r", "g", "b")).where("seq >= 30")
    return x.select("session", "seq", rounded(F.col("g_mean") / F.col("r_mean")).alias("nf_r"), rounded(F.col("g_mean") / F.col("b_mean")).alias("nf_b"))


_DFT = f"""{_HANN}, centre AS (SELECT id, i, v - avg(v) OVER (PARTITION BY id) AS c FROM points), shaped AS (SELECT id, i, c * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS v FROM centre),
bins AS (SELECT id, k, k * 30.0 / 64 AS hz, sum(v * cos(2 * pi() * k * i / 64)) AS re, -sum(v * sin(2 * pi() * k * i / 64)) AS im FROM shaped, range(1, 33) r(k) GROUP BY ALL), power AS (SELECT *, re * re + im * im AS p FROM bins)"""


_DFT0 = _DFT.replace("range(1, 33)", "range(0, 33)")


def bins(spark: SparkSession, sf_dir: str, first: int = 1, last: int = 32) -> DataFrame:
    """(id, bins): the mean removed, Hann, bins first..last of 64 samples at 30 frames a second. All: 0 or 1 to 32."""
    return arrays(spark, sf_dir).select("id", "label", S.spectrum(S.windowed(S.centred(F.col("x")), 64), 64, 30.0, first, last).alias("bins"))


@query(f"WITH {_DFT} SELECT id, k, {r4('p')} AS power FROM power")
def d1_spectrum(spark: SparkSession, sf_dir: str, first: int = 1, last: int = 32) -> DataFrame:
    return bins(spark, sf_dir, first, last).select("id", F.explode("bins").alias("b")).select("id", F.col("b.k").cast("bigint").alias("k"), rounded(F.col("b.power")).alias("power"))


@query(f"""WITH {_DFT}, m AS (SELECT *, lag(p) OVER (PARTITION BY id ORDER BY k) AS a, lead(p) OVER (PARTITION BY id ORDER BY k) AS b FROM power), t AS (SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY p DESC, k) AS rank FROM m WHERE p > a AND p > b)
SELECT id, k, rank FROM t WHERE rank <= 3""")
def d2_top_peaks(spark: SparkSession, sf_dir: str, first: int = 1, last: int = 32) -> DataFrame:
    """The three highest local maxima, inside each row's array."""
    b = F.col("bins")
    near = F.filter(F.transform(F.sequence(F.lit(1), F.size(b) - 2), lambda i: F.struct((-F.get(b, i).power).alias("p"), F.get(b, i).k.alias("k"), ((F.get(b, i).power > F.get(b, i - 1).power) & (F.get(b, i).power > F.get(b, i + 1).power)).alias("top"))), lambda x: x.top)
    x = bins(spark, sf_dir, first, last).select("id", F.posexplode(F.slice(F.array_sort(near), 1, 3)).alias("rank", "m"))
    return x.select("id", F.col("m.k").cast("bigint").alias("k"), (F.col("rank") + 1).cast("bigint").alias("rank"))


@query(f"""WITH {_DFT}, top AS (SELECT id, arg_max(hz, (p, -k)) AS hz FROM power WHERE hz BETWEEN 0.8 AND 3.0 GROUP BY id)
SELECT id, {r4('hz * 60')} AS bpm FROM top""")
def d3_peak_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bins(spark, sf_dir).withColumn("band", F.filter("bins", lambda b: (b.hz >= 0.8) & (b.hz <= 3.0)))
    return x.select("id", rounded(S.peak(F.col("band")).hz * 60).alias("bpm"))


@query(f"""WITH {ARRAYS}, w AS (SELECT id, s, x[s + 1 : s + 32] AS y FROM arrays, range(0, 33, 8) r(s)), v AS (SELECT id, s, unnest(y) AS v, unnest(range(32)) AS i FROM w), c AS (SELECT id, s, i, v - avg(v) OVER (PARTITION BY id, s) AS v FROM v),
b AS (SELECT id, s, k, sum(v * cos(2 * pi() * k * i / 32)) ** 2 + sum(v * sin(2 * pi() * k * i / 32)) ** 2 AS p FROM c, range(1, 9) r(k) GROUP BY ALL) SELECT id, s AS start, arg_max(k, (p, -k)) AS k FROM b GROUP BY id, s""")
def d4_window_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of windows of 32 samples every 8, stamped by their start."""
    w = arrays(spark, sf_dir).withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(32), F.lit(8)))).withColumn("y", F.slice("x", F.col("start") + 1, 32))
    top = S.peak(S.spectrum(S.centred(F.col("y")), 32, 30.0, 1, 8))
    return w.select("id", F.col("start").cast("bigint").alias("start"), (-top.lower).cast("bigint").alias("k"))


@query(f"""WITH {_DFT}, f AS (SELECT id, CASE WHEN id % 3 > 0 THEN 60.0 + id % 3 * 30 END AS before, arg_max(hz, (p, -k)) FILTER (hz BETWEEN 0.6 AND 3.0) AS f, max(hz) FILTER (hz <= 3.0) AS highest FROM power GROUP BY id),
e AS (SELECT f.*, {", ".join(f"coalesce(sum(sqrt(p)) FILTER (hz BETWEEN {c} - 0.12 AND {c} + 0.12 AND hz BETWEEN 0.6 AND 3.0), 0) AS {n}" for c, n in (("f", "own"), ("f / 2", "half"), ("2 * f", "twice")))} FROM power JOIN f USING (id) GROUP BY ALL)
SELECT id, {r4('f * 60')} AS bpm, {r4("60 * CASE WHEN f / 2 >= 0.6 AND half >= own * CASE WHEN before < 90 AND f * 60 > 130 THEN 0.15 ELSE 0.30 END THEN f / 2 WHEN f < 1.25 AND 2 * f <= highest AND twice >= own * CASE WHEN before > 80 AND f * 60 < 60 THEN 0.25 ELSE 0.40 END THEN 2 * f ELSE f END")} AS resolved FROM e""")
def d5_subharmonic(spark: SparkSession, sf_dir: str, first: int = 1, last: int = 32) -> DataFrame:
    """Peaks from 0.6 Hz up, as these bins are 0.47 Hz apart; a third of the rows has no rate before."""
    f = S.peak(F.filter("bins", lambda b: b.hz.between(0.6, 3.0))).hz
    before = F.when(F.col("id") % 3 > 0, 60.0 + F.col("id") % 3 * 30)
    x = bins(spark, sf_dir, first, last).select("id", "bins", f.alias("f"), before.alias("before"))
    return x.select("id", rounded(F.col("f") * 60).alias("bpm"), rounded(60 * S.resolved(F.col("bins"), F.col("f"), F.col("before"), low=0.6)).alias("resolved"))


@query(f"""WITH {_DFT0}, t AS (SELECT id, arg_max(hz, (p, -k)) AS f FROM power WHERE hz BETWEEN 0.8 AND 3.0 GROUP BY id), e AS (SELECT power.id, f, {', '.join(f"max(p) FILTER (hz BETWEEN {c} - 0.1 AND {c} + 0.1) AS {n}" for n, c in (('main', 'f'), ('half', 'f / 2'), ('third', 'f / 3'), ('twice', '2 * f'), ('thrice', '3 * f')))} FROM power JOIN t USING (id) GROUP BY ALL)
SELECT id, {r4('f * 60')} AS bpm, coalesce(f / 2 >= 0.7 AND half > CASE WHEN f * 60 > 140 THEN 0.4 ELSE 0.6 END * main, false) OR coalesce(f / 3 >= 0.7 AND third > CASE WHEN f * 60 > 140 THEN 0.4 ELSE 0.6 END * main, false)
  OR coalesce(twice > 0.15 * main, false) OR coalesce(thrice > 0.15 * main, false) AS harmonic FROM e""")
def d6_harmonic_rejection(spark: SparkSession, sf_dir: str, first: int = 0, last: int = 32) -> DataFrame:
    x = bins(spark, sf_dir, first, last).withColumn("f", S.peak(F.filter("bins", lambda b: (b.hz >= 0.8) & (b.hz <= 3.0))).hz)
    return x.select("id", rounded(F.col("f") * 60).alias("bpm"), S.is_harmonic(F.col("bins"), F.col("f")).alias("harmonic"))


@query(f"WITH {_DFT} SELECT id, {r4('sum(p) FILTER (hz <= 1.5) / sum(p) FILTER (hz BETWEEN 0.83 AND 3.0)')} AS interference, {r4('arg_max(hz, (p, -k)) FILTER (hz <= 1.5)')} AS resp_hz FROM power GROUP BY id")
def d7_respiration(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("bins")
    return bins(spark, sf_dir).select("id", rounded(F.try_divide(S.band_power(b, 0.1, 1.5), S.band_power(b, 0.83, 3.0))).alias("interference"), rounded(S.peak(F.filter(b, lambda x: x.hz <= 1.5)).hz).alias("resp_hz"))


@query(f"""WITH {_DFT}, two AS (SELECT a.id, a.k, a.hz, a.re * b.re + a.im * b.im AS cr, a.im * b.re - a.re * b.im AS ci FROM power a JOIN power b ON b.id = a.id + 1 AND a.k = b.k),
w AS (SELECT id, sqrt(cr * cr + ci * ci) AS weight, cos(atan2(ci, cr) - 2 * pi() * hz * 0.05) AS near FROM two) SELECT id, {r4('greatest(0.0, least(1.0, (1 + sum(weight * near) / sum(weight)) / 2))')} AS fraction FROM w GROUP BY id""")
def d8_phase_coherence(spark: SparkSession, sf_dir: str, first: int = 1, last: int = 32) -> DataFrame:
    """How well the phase between two neighbouring signals fits a transit of 50 ms, weighted by cross power."""
    a = bins(spark, sf_dir, first, last).select("id", "bins")
    b = a.select((F.col("id") - 1).alias("id"), F.col("bins").alias("other"))
    two = F.zip_with("bins", "other", lambda x, y: F.struct(x.hz.alias("hz"), (x.re * y.re + x.im * y.im).alias("cr"), (x.im * y.re - x.re * y.im).alias("ci")))
    w = F.transform(two, lambda t: F.struct(F.sqrt(t.cr * t.cr + t.ci * t.ci).alias("weight"), F.cos(F.atan2(t.ci, t.cr) - 2 * math.pi * 0.05 * t.hz).alias("near")))
    x = a.join(b, "id").withColumn("w", w)
    near = F.try_divide(sum_of(F.transform("w", lambda t: t.weight * t.near)), sum_of(F.transform("w", lambda t: t.weight)))
    return x.select("id", rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 + near) / 2))).alias("fraction"))


@query(f"WITH {_DFT0}, s AS (SELECT id, sum(p) FILTER (hz BETWEEN 0.83 AND 3.0) AS inside, sum(p) FILTER (hz > 3.0 OR hz < 0.83) AS outside FROM power GROUP BY id) SELECT id, {r4('greatest(-20.0, least(20.0, 10 * log10(inside / outside)))')} AS snr FROM s")
def d9_snr(spark: SparkSession, sf_dir: str, first: int = 0, last: int = 32) -> DataFrame:
    x = bins(spark, sf_dir, first, last).select("id", S.band_power(F.col("bins"), 0.83, 3.0).alias("inside"), sum_of(F.transform("bins", lambda b: b.power)).alias("total"))
    return x.select("id", rounded(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), 10 * F.log10(F.try_divide(F.col("inside"), F.col("total") - F.col("inside")))))).alias("snr"))


def _whole(f, first: int = 1):
    """f as a query of all bins up to half the frame rate, under the name it had while f itself stopped at bin 16."""

    def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(spark, sf_dir, first, 32)

    whole.__name__ = f"{f.__name__}_whole"
    return query(SQL[f.__name__])(whole)


for _f in (d1_spectrum, d2_top_peaks, d5_subharmonic, d8_phase_coherence):
    _whole(_f)
for _f in (d6_harmonic_rejection, d9_snr):  # with bin 0
    _whole(_f, 0)


@query(f"WITH {_DFT}, r AS (SELECT *, first(hz) OVER (PARTITION BY id ORDER BY CASE WHEN hz <= 1.5 THEN p ELSE -1 END DESC, k) AS resp FROM power) SELECT id, k, {r4('p * CASE WHEN abs(hz - resp) <= 0.15 THEN 0.35 WHEN abs(hz - 2 * resp) <= 0.15 THEN 0.5 ELSE 1 END')} AS power FROM r")
def d10_panting_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power damped around the respiration peak and its double."""
    x = bins(spark, sf_dir).withColumn("resp", S.peak(F.filter("bins", lambda b: b.hz <= 1.5)).hz).select("id", "resp", F.explode("bins").alias("b"))
    damp = F.when(F.abs(F.col("b.hz") - F.col("resp")) <= 0.15, 0.35).when(F.abs(F.col("b.hz") - 2 * F.col("resp")) <= 0.15, 0.5).otherwise(1.0)
    return x.select("id", F.col("b.k").cast("bigint").alias("k"), rounded(F.col("b.power") * damp).alias("power"))
