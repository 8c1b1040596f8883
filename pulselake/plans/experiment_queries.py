"""Experiments, records and samplers as queries (survey A1, A5, A8, A10, C9, I7, K4, K6, K7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import experiments as X
from ..operators import splits as K
from ..sources import experiment_tree as tree
from ..sources import ground_truth
from ..sources.shared import new_path
from .bindings import DOMAINS, PIXELS, SAMPLES, WINDOWS, domains, pixels, samples, windows
from .registry import query, r4
from .window_queries import FPS, _channels

_MEASURES = ("quality_mean", "motion_mean", "aware_mean", "usable", "n_candidates", "best_score", "persistence")
_STAGE_OF = {"quality_mean": "quality", "motion_mean": "motion", "aware_mean": "aware", "usable": "aware", "n_candidates": "candidates", "best_score": "candidates", "persistence": "temporal"}


def _dealt(measure: str) -> str:
    having = ", ".join(f"'{e}'" for e, has in X.EXPERIMENTS.items() if _STAGE_OF[measure] in has)
    value = measure if measure == "n_candidates" else r4(measure)
    return f"CASE WHEN experiment IN ({having}) THEN {value} END AS {measure}"


@query(f"""WITH RECURSIVE {PIXELS}, m AS (SELECT frame, (y * 8 + x)::BIGINT AS cell, y, x, 80 * v AS db, least(1.0, greatest(0.0, least(1.0, greatest(0.0, (80 * v + 20) / 40)) * (0.8::DOUBLE * 0.9::DOUBLE))) AS q FROM pixels), mask AS (SELECT * FROM m WHERE q >= 0.3),
e AS (SELECT a.frame, a.cell, b.cell AS other FROM mask a JOIN mask b ON a.frame = b.frame AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
reach AS (SELECT frame, cell, cell AS root FROM mask UNION SELECT r.frame, e.other, r.root FROM reach r JOIN e ON e.frame = r.frame AND e.cell = r.cell), l AS (SELECT frame, cell, min(root) AS region FROM reach GROUP BY ALL),
c AS (SELECT frame, region, avg(q) * 0.8 * 0.9 / (1 + 0.1 * abs(count(*) - 5)) AS score FROM l JOIN mask USING (frame, cell) GROUP BY ALL HAVING count(*) >= 2),
best AS (SELECT frame, region, score FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, region) AS rank FROM c WHERE score >= 0.2) WHERE rank <= 10),
t AS (SELECT *, frame - row_number() OVER (PARTITION BY region ORDER BY frame) AS run FROM best),
p AS (SELECT frame, greatest(0, least(1, avg(score) OVER w * CASE WHEN count(*) OVER w > 1 THEN least(1, 0.3 / (stddev_pop(score) OVER w / (abs(avg(score) OVER w) + 1e-9) + 1e-9)) ELSE 1 END * 0.9)) AS p FROM t WINDOW w AS (PARTITION BY region, run ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
moved AS (SELECT frame, avg(v) AS motion_mean FROM (SELECT a.frame, a.y // 2 AS cy, a.x // 2 AS cx, avg(abs(a.v - b.v)) AS v FROM pixels a JOIN pixels b ON b.frame = a.frame - 1 AND a.y = b.y AND a.x = b.x GROUP BY ALL) GROUP BY frame),
f AS (SELECT frame, avg(db) AS quality_mean, avg(q) AS aware_mean, avg((q >= 0.3)::INT) AS usable FROM m GROUP BY frame), n AS (SELECT frame, count(*) AS n_candidates, max(score) AS best_score FROM best GROUP BY frame), s AS (SELECT frame, max(p) AS persistence FROM p GROUP BY frame)
SELECT experiment, frame, {", ".join(map(_dealt, _MEASURES))} FROM f LEFT JOIN moved USING (frame) LEFT JOIN n USING (frame) LEFT JOIN s USING (frame), (SELECT unnest([{", ".join(f"'{e}'" for e in X.EXPERIMENTS)}]) AS experiment)""")
def i7_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All experiments in one pass: each stage is built once."""
    out = X.run(pixels(spark, sf_dir), scale=80.0)
    return out.select("experiment", "frame", *(F.col(m) if m == "n_candidates" else rounded(F.col(m)).alias(m) for m in _MEASURES))


@query()
def c9_bandpass_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates with and without the band-pass, of each window."""
    return X.bandpass_ablation(_channels(spark, sf_dir), FPS)


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w = windows(spark, sf_dir)
    name = F.concat_ws("/", "session", "w")
    flat = w.select(F.col("session").alias("session_id"), F.col("subject").alias("subject_id"), name.alias("window_id"), F.col("w").alias("number"), (F.col("w") * 432000.0).alias("start_time"), ((F.col("w") + 1) * 432000.0).alias("end_time"),
                    "hr_estimate", "hr_reference", "hr_confidence", "signal_quality", "is_valid", F.array("luminance", "luminance_range").alias("rgb_mean"))
    found = F.array_compact(F.array(
        F.when(F.col("motion") > 0.05, F.struct(F.lit("motion").alias("type"), (4 * F.col("motion")).alias("severity"), F.create_map(F.lit("motion"), F.col("motion")).alias("evidence"), F.lit(True).alias("is_actionable"), F.lit(None).cast("string").alias("description"))),
        F.when(F.col("luminance_range") > 90, F.struct(F.lit("illumination").alias("type"), (F.col("luminance_range") / 500).alias("severity"), F.create_map(F.lit("range"), F.col("luminance_range")).alias("evidence"), F.lit(False).alias("is_actionable"), F.lit("wide").alias("description"))),
    ))
    return flat, w.select(name.alias("window_id"), F.explode(found).alias("c")).select("window_id", "c.*")


def _back(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Windows and conditions after the way into nested sessions, JSON and back."""
    nested = tree.tree(*_records(spark, sf_dir), "e1")
    text = nested.select(F.to_json(F.struct(*nested.columns)).alias("json"))
    return tree.flat(text.select(F.from_json("json", tree.SESSION).alias("s")).select("s.*"))


@query(f"""WITH {WINDOWS} SELECT 'e1' AS experiment_id, session::VARCHAR AS session_id, subject::VARCHAR AS subject_id, session || '/' || w AS window_id, w * 432000.0::DOUBLE AS start_time, {r4('hr_estimate')} AS hr_estimate, {r4('hr_reference')} AS hr_reference, {r4('hr_confidence')} AS hr_confidence, {r4('signal_quality')} AS signal_quality, is_valid,
  {r4('luminance')} AS mean, {r4('luminance_range')} AS range FROM windows""")
def a10_window_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _back(spark, sf_dir)[0]
    return w.select("experiment_id", "session_id", "subject_id", "window_id", "start_time", *(rounded(F.col(c)).alias(c) for c in ("hr_estimate", "hr_reference", "hr_confidence", "signal_quality")), "is_valid", rounded(F.col("rgb_mean")[0]).alias("mean"), rounded(F.col("rgb_mean")[1]).alias("range"))


@query(f"""WITH {WINDOWS} SELECT session || '/' || w AS window_id, 'motion' AS type, {r4('4 * motion')} AS severity, {r4('motion')} AS evidence, true AS is_actionable, NULL::VARCHAR AS description FROM windows WHERE motion > 0.05
UNION ALL SELECT session || '/' || w, 'illumination', {r4('luminance_range / 500')}, {r4('luminance_range')}, false, 'wide' FROM windows WHERE luminance_range > 90""")
def a10_condition_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _back(spark, sf_dir)[1]
    return c.select("window_id", "type", rounded(F.col("severity")).alias("severity"), rounded(F.map_values("evidence")[0]).alias("evidence"), "is_actionable", "description")


@query(f"""WITH {SAMPLES} SELECT session AS id, {r4('min(t)')} AS timestamp, {r4('max(t) - min(t)')} AS duration_sec, {r4('avg(x - 5) FILTER (x > 5)')} AS avg_bpm, {r4('avg(event_id % 30)')} AS avg_resp, {r4('avg(event_id % 101)')} AS avg_sqi FROM samples GROUP BY session""")
def a8_session_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session history that the readings give."""
    of = lambda n: F.pmod("event_id", F.lit(n)).cast("double")
    r = samples(spark, sf_dir).select(F.col("session").alias("session_id"), F.col("t").alias("timestamp"), (F.col("x") - 5).alias("bpm"), of(30).alias("resp"), F.lit(None).cast("double").alias("hrv_sdnn"), F.lit(None).cast("double").alias("stress"), of(101).alias("sqi"))
    return tree.summaries(r).select("id", *(rounded(F.col(c)).alias(c) for c in ("timestamp", "duration_sec", "avg_bpm", "avg_resp", "avg_sqi")))


def _csv(spark: SparkSession, sf_dir: str) -> str:
    """The events as a reference file with faults: numbers missing, unreadable, not finite or out of range."""
    e = F.col("event_id")
    odd = F.when(e % 50 == 1, "").when(e % 50 == 2, "x").when(e % 50 == 3, "NaN").when(e % 50 == 4, "-inf").when(e % 50 == 5, "999.5").otherwise((F.col("x").cast("decimal(10,2)")).cast("string"))
    path = new_path(spark, "series")
    samples(spark, sf_dir).select(F.when(e % 70 == 6, "then").otherwise(e.cast("string")).alias("Timestamp "), odd.alias(" BPM"), F.lit("more").alias("note")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


_CSV = f"""{SAMPLES}, f AS (SELECT CASE WHEN event_id % 70 = 6 THEN 'then' ELSE event_id::VARCHAR END AS timestamp, CASE event_id % 50 WHEN 1 THEN NULL WHEN 2 THEN 'x' WHEN 3 THEN 'NaN' WHEN 4 THEN '-inf' WHEN 5 THEN '999.5' ELSE x::DECIMAL(10, 2)::VARCHAR END AS bpm FROM samples),
n AS (SELECT *, TRY_CAST(timestamp AS DOUBLE) AS ts, TRY_CAST(bpm AS DOUBLE) AS v FROM f)"""


@query(f"WITH {_CSV} SELECT ts, v AS bpm, CASE WHEN v < 20 OR v > 250 THEN 'out of range' END AS warning FROM n WHERE ts IS NOT NULL AND isfinite(v)")
def a1_loaded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a reference file; values out of range stay with a warning."""
    return ground_truth.load(spark, _csv(spark, sf_dir))[0]


@query(f"WITH {_CSV} SELECT timestamp, bpm, CASE WHEN ts IS NULL THEN 'bad timestamp' WHEN v IS NULL THEN 'bad bpm' ELSE 'not finite' END AS reason FROM n WHERE NOT coalesce(ts IS NOT NULL AND isfinite(v), false)")
def a1_rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground_truth.load(spark, _csv(spark, sf_dir))[1]


@query(f"WITH {_CSV} SELECT count(*) AS n, 0 AS duplicates, {r4('max(ts) - min(ts)')} AS span, {r4('(max(ts) - min(ts)) / (count(*) - 1)')} AS mean_step, {r4('min(v)')} AS low, {r4('max(v)')} AS high, {r4('avg(v)')} AS mean, min(v) >= 40 AND max(v) <= 200 AS plausible FROM n WHERE ts IS NOT NULL AND isfinite(v)")
def a5_file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of the file's rows."""
    c = ground_truth.checks(ground_truth.load(spark, _csv(spark, sf_dir))[0])
    return c.select("n", "duplicates", *(rounded(F.col(k)).alias(k) for k in ("span", "mean_step", "low", "high", "mean")), "plausible")


_CHANCE = "(('0x' || md5({})[1:8])::UBIGINT + 0.5) / 4294967296"
_COUNTED = f"{DOMAINS}, counted AS (SELECT domain, count(*) AS m FROM domains GROUP BY domain), weights AS (SELECT domain, m, sum(m) OVER () / (count(*) OVER () * m)::DOUBLE AS weight, sqrt(sum(m) OVER () / m) AS root FROM counted)"


@query(f"""WITH {_COUNTED}, keyed AS (SELECT sample, domain, -ln({_CHANCE.format("'42/' || sample")}) / root AS key FROM domains JOIN weights USING (domain)) SELECT sample, domain, {r4('key')} AS key FROM keyed ORDER BY keyed.key LIMIT 700""")
def k6_weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """700 samples without replacement, rare domains more often."""
    d = domains(spark, sf_dir).select("sample", "domain")
    return K.weighted_sample(d, K.domain_weights(d, root=True), 700).select("sample", "domain", rounded(F.col("key")).alias("key"))


@query(f"""WITH {_COUNTED}, shares AS (SELECT domain, m, sum(weight * m) OVER (ORDER BY domain) AS upto, sum(weight * m) OVER () AS all_ FROM weights),
draws AS (SELECT i AS draw, {_CHANCE.format("'42/' || i || '/d'")} AS d, {_CHANCE.format("'42/' || i || '/s'")} AS s FROM range(2000) r(i)),
picked AS (SELECT draw, arg_min(domain, upto) AS domain, arg_min(floor(s * m), upto) AS place FROM draws JOIN shares ON upto > d * all_ GROUP BY draw), placed AS (SELECT sample, domain, row_number() OVER (PARTITION BY domain ORDER BY md5('42/' || sample), sample) - 1 AS place FROM domains)
SELECT draw, domain, sample FROM picked JOIN placed USING (domain, place)""")
def k6_weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2,000 draws with replacement, all domains alike."""
    d = domains(spark, sf_dir).select("sample", "domain")
    return K.weighted_draws(d, K.domain_weights(d), 2000)


@query(f"""WITH {DOMAINS}, g AS (SELECT sample % 6 AS round, domain, avg(abs(value)) / 100 AS loss FROM domains WHERE sample % 7 > 0 OR domain > 'C' GROUP BY ALL),
grid AS (SELECT r.round, n.domain, coalesce(loss, 0) AS loss FROM (SELECT DISTINCT round FROM g) r CROSS JOIN (SELECT DISTINCT domain FROM g) n LEFT JOIN g ON g.round = r.round AND g.domain = n.domain),
t AS (SELECT *, 0.01 * sum(loss) OVER (PARTITION BY domain ORDER BY round) AS t FROM grid), e AS (SELECT *, exp(t) AS e, exp(t - 0.01 * loss) AS b FROM t)
SELECT round, domain, {r4('e / sum(e) OVER (PARTITION BY round)')} AS weight, {r4('sum(b * loss) OVER (PARTITION BY round) / sum(b) OVER (PARTITION BY round)')} AS weighted FROM e""")
def k7_dro_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = domains(spark, sf_dir).where("sample % 7 > 0 OR domain > 'C'")  # not every domain has a loss in every round
    g = d.groupBy((F.col("sample") % 6).alias("round"), "domain").agg((F.avg(F.abs("value")) / 100).alias("loss"))
    return K.dro_rounds(g).select("round", "domain", rounded(F.col("weight")).alias("weight"), rounded(F.col("weighted")).alias("weighted"))


_SPLIT = f"{DOMAINS}, s AS (SELECT sample, subject, CASE WHEN sample % 10 < 7 THEN 'train' WHEN sample % 10 < 9 THEN 'validation' ELSE 'test' END AS split FROM domains WHERE sample % 50 > 0 UNION ALL SELECT sample, subject, 'test' FROM domains WHERE sample % 40 = 1 UNION ALL SELECT -sample, -1, 'test' FROM domains WHERE sample % 60 = 7)"


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split with faults: samples without one, with two, and unknown ones."""
    d = domains(spark, sf_dir).select("sample", "subject")
    where = F.when(F.col("sample") % 10 < 7, "train").when(F.col("sample") % 10 < 9, "validation").otherwise("test")
    test = F.lit("test").alias("split")
    return d.where("sample % 50 > 0").withColumn("split", where).union(d.where("sample % 40 = 1").select("sample", "subject", test)).union(d.where("sample % 60 = 7").select(-F.col("sample"), F.lit(-1), test))


@query(f"""WITH {_SPLIT}, g AS (SELECT subject, bool_or(split = 'train') AS a, bool_or(split = 'validation') AS b, bool_or(split = 'test') AS c FROM s GROUP BY subject)
SELECT (SELECT count(*) FROM (SELECT sample FROM s GROUP BY sample HAVING count(DISTINCT split) > 1)) AS overlapping, (SELECT count(*) FROM domains WHERE sample NOT IN (SELECT sample FROM s)) AS missing, (SELECT count(DISTINCT sample) FROM s WHERE sample NOT IN (SELECT sample FROM domains)) AS unknown,
  count(*) FILTER (a AND b) AS train_validation, count(*) FILTER (a AND c) AS train_test, count(*) FILTER (b AND c) AS validation_test FROM g""")
def k4_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.validated(_split(spark, sf_dir), domains(spark, sf_dir))


@query(f"""WITH {_SPLIT}, n AS (SELECT split, count(*) AS n, list(sample ORDER BY sample)[1:10] AS l FROM s GROUP BY split), o AS (SELECT any_value(n) FILTER (split = 'train') AS a, any_value(n) FILTER (split = 'validation') AS b, any_value(n) FILTER (split = 'test') AS c, any_value(l) FILTER (split = 'train') AS x, any_value(l) FILTER (split = 'test') AS y FROM n)
SELECT md5(concat_ws('|', 'random', 'domain', '42', a, b, c, '[' || array_to_string(x, ', ') || ']', '[' || array_to_string(y, ', ') || ']'))[1:16] AS hash FROM o""")
def k4_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.split_hash(_split(spark, sf_dir), "random", "domain", 42)
