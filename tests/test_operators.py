"""Known answers of the operators."""

import hashlib
import math
import random

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulselake import plans
from pulselake.functions import augment as A
from pulselake.functions import conditions as C
from pulselake.functions import losses as L
from pulselake.functions import spectral as S
from pulselake.operators import alignment, filters, folds, fusion, gates, grids, metrics, splits
from pulselake.plans import jobs
from pulselake.plans.bindings import arrays, signal
from pulselake.sources import ground_truth, synthetic


def series(spark, times, value=70.0):
    return spark.createDataFrame([(1, i, float(t), value) for i, t in enumerate(times)], "session int, id int, t double, x double")


@pytest.mark.parametrize(("pred", "ref", "tolerance", "n"), [
    ((1, 2, 3), (1, 2, 3), 0.1, 3), ((1, 2), (1.1, 2.1), 0.5, 2), ((1.0,), (1.5,), 0.5, 1), ((1.0,), (1.51,), 0.5, 0), ((1, 2), (1, 2.001), 0.0, 1), ((1.0, 1.1, 1.2), (1.0,), 0.5, 1), ((0.1, 1.1, 2.0), (0, 1, 5), 1.0, 2),
])
def test_greedy_alignment(spark, pred, ref, tolerance, n):
    assert alignment.greedy(series(spark, pred), series(spark, ref), tolerance).count() == n


def test_compat_alignment_reaches_further(spark):
    pred, ref = series(spark, (0.1, 1.1, 2.1, 5.2, 6.1, 10.0)), series(spark, (0, 1, 2, 5, 6, 7))
    assert alignment.greedy(pred, ref, 2.0, compat=True).count() == 5  # 10.0 and 7.0 are exactly 3.0 apart


def test_nearest_alignment_reuses_references_and_takes_the_earlier(spark):
    got = alignment.nearest(series(spark, (1.0, 1.1, 2.5)), series(spark, (1.0, 2.0, 3.0)), 0.5).orderBy("pred_t").collect()
    assert [(r.pred_t, r.ref_t) for r in got] == [(1.0, 1.0), (1.1, 1.0), (2.5, 2.0)]
    assert alignment.nearest(series(spark, (float("nan"), 1.0)), series(spark, (1.0,)), 0.5).count() == 1


def test_error_metrics(spark):
    df = spark.createDataFrame([(1, 75.0, 70.0)] * 10 + [(2, 75.0, 70.0)] * 9 + [(1, None, 70.0)], "k int, measured double, reference double")
    got = {r.k: r for r in metrics.errors(df, ["k"]).collect()}
    assert (got[1].mae, got[1].rmse, got[1].bias, got[1].n) == (5.0, 5.0, 5.0, 10)
    assert got[2].mae is None  # fewer than ten pairs


def test_overall_rmse_is_over_windows(spark):
    df = spark.createDataFrame([(1, 71.0, 70.0), (1, 75.0, 70.0), (2, 72.0, 70.0), (2, 74.0, 70.0)], "session int, measured double, reference double")
    assert metrics.errors(df, [], least=1).first().rmse == pytest.approx(math.sqrt(11.5))


def poisson_draws(key, row, rounds):
    """The counts of a row in each resample, by plain integers."""
    h = hashlib.md5(f"42/{key}/{row}".encode()).hexdigest()
    h1, h2 = int(h[:8], 16), int(h[8:16], 16) | 1
    out = []
    for b in range(1, rounds + 1):
        z = (h1 + b * h2) % 2**32
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            z = (z ^ (z >> shift)) * factor % 2**32
        u, k, p = z / 2**32, 0, math.exp(-1)
        while u >= p:
            k, p = k + 1, p + math.exp(-1) / math.factorial(k + 1)
        out.append(k)
    return np.array(out)


@pytest.mark.parametrize("parts", [1, 5])
def test_bootstrap_by_force(spark, parts):
    """Few rows a key and many (which go as sums), on one task and on several; a null takes no part."""
    e = {1: [1.0, 4.0, 2.5, 9.0], 2: [3.0, 0.5, 7.0, None], 3: [float(i % 17) for i in range(1500)]}
    df = spark.createDataFrame([(s, i, v) for s, x in e.items() for i, v in enumerate(x, 1)], "s int, row bigint, e double").repartition(parts)
    got = {r.s: r for r in metrics.bootstrap(df, ["s"], "row", rounds=200).collect()}
    for s, x in e.items():
        w = np.array([poisson_draws(s, i, 200) for i, v in enumerate(x, 1) if v is not None])
        assert 0.9 < w.mean() < 1.1 or len(x) < 10
        v = np.array([v for v in x if v is not None])
        means = [(w[:, b] @ v) / w[:, b].sum() for b in range(200) if w[:, b].sum()]
        assert (got[s].low, got[s].high) == pytest.approx(tuple(np.quantile(means, (0.025, 0.975))))
    assert metrics.bootstrap(df.limit(0), ["s"], "row").count() == 0


def test_bootstrap_sends_sums_of_large_groups(spark):
    """What is shuffled for a key doesn't grow with its rows."""
    df = spark.range(40_000).select((F.col("id") % 2).alias("s"), F.col("id").alias("row"), (F.col("id") % 7).cast("double").alias("e"))
    sizes = []
    for n in (4_000, 40_000):
        plan = metrics.bootstrap(df.where(F.col("row") < n).coalesce(1), ["s"], "row", rounds=50)
        plan.collect()
        sizes.append(plan._jdf.queryExecution().executedPlan().toString())
    assert all("Exchange hashpartitioning(s" in x for x in sizes)
    got = metrics.bootstrap(df.coalesce(1), ["s"], "row", rounds=300).collect()
    assert all(r.low < 3.0 < r.high and r.high - r.low < 0.1 for r in got)


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.975, 1.0])
def test_exact_quantiles_of_large_groups(spark, q):
    """Bounds are narrowed from 10 rows on: ties that fill a group, two values that share the middle, infinite and tiny ones."""
    r = np.random.default_rng(3)
    groups = {"one": [5.0] * 3000, "two": [1.0] * 500 + [2.0] * 500, "mixed": [7.0] * 1000 + r.normal(size=1500).tolist() + [1e300, -1e300, 1e-300], "few": [3.0, 1.0, 2.0], "none": [float("nan")] * 20, "wide": (10 ** r.uniform(-200, 200, 2000)).tolist()}
    df = spark.createDataFrame([(k, v) for k, x in groups.items() for v in [*x, None]], "k string, v double").repartition(3)
    got = {x.k: x.quantile for x in metrics.exact_quantile(df, ["k"], "v", q, buffered=10).collect()}
    want = {k: float(np.quantile(x, q)) for k, x in groups.items() if k != "none"}
    assert got == pytest.approx(want, rel=1e-9)
    assert metrics.exact_quantile(df.where("k = 'wide'"), [], "v", q, buffered=100).first().quantile == pytest.approx(want["wide"], rel=1e-9)


@pytest.mark.parametrize("compat", [False, True])
def test_greedy_sweep_equals_the_plain_rule(spark, compat):
    """Dense and sparse sessions, ties in time and distance, values that take no part, against a scan of all references."""
    rng = random.Random(4)
    rows = {side: [(s, 1000 * s + i, float(rng.choice([rng.randint(0, 40) / 2, rng.random() * 60])), float(i)) for s in (1, 2, 3) for i in range(n)] for side, n in (("p", 90), ("r", 70))}
    rows["p"] += [(1, 9001, float("nan"), 1.0), (1, 9002, 5.0, float("inf")), (1, 9003, None, 1.0), (4, 9004, 1.0, 1.0)]
    rows["r"] += [(1, 9001, float("nan"), 1.0), (5, 9005, 1.0, 1.0)]
    frames = [spark.createDataFrame(rows[k], "session int, id int, t double, x double").repartition(4) for k in ("p", "r")]
    got = {(r.session, r.pred_id): r.ref_id for r in alignment.greedy(*frames, 1.5, compat=compat).collect()}
    want, taken = {}, set()
    finite = lambda v: v is not None and math.isfinite(v)
    for s, i, t, _ in sorted((p for p in rows["p"] if finite(p[2]) and finite(p[3])), key=lambda p: (p[0], p[2], p[1])):
        free = [(abs(t - r[2]), r[2], r[1]) for r in rows["r"] if r[0] == s and finite(r[2]) and r[1] not in taken]
        best = min(free, default=None)
        if best and (best[0] < 2.5 if compat else best[0] <= 1.5):
            want[s, i] = best[2]
            taken.add(best[2])
    assert got == want and len(want) > 100
    by_order = alignment.greedy(frames[0].withColumn("o2", F.col("t")), frames[1], 1.5, order="o2", compat=compat)
    assert len(want) == by_order.count()


def test_greedy_holds_what_is_within_reach():
    from pulselake.operators.alignment import nearest_free

    assert nearest_free([], 1.0) is None and nearest_free([1.0, 1.0, 2.0], 1.4) == 0 and nearest_free([1.0, 2.0], 1.5) == 0 and nearest_free([1.0, 2.0, 2.0], 1.6) == 1 and nearest_free([3.0], 9.0) == 0


def test_whole_queries_use_all_rows(spark):
    s = signal(spark, SF).select("session", "x", F.pmod("event_id", F.lit(101)).alias("sqi")).collect()
    sessions = {r.session for r in s}
    got = {r.session: r for r in plans.QUERIES["f2_bootstrap_whole"](spark, SF).collect()}
    assert set(got) == sessions and all(r.low <= r.high for r in got.values())
    grid = 40 + 0.5 * np.arange(321)
    want = {}
    for k in sessions:
        z = sum(-0.5 * ((grid - r.x - 30) / (10 * (1 - r.sqi / 100) + 0.8)) ** 2 for r in s if r.session == k and r.x + 30 > 0)
        want[k] = np.average(grid, weights=np.exp(z - z.max()))
    assert {r.frame: r.bpm for r in plans.QUERIES["g5_probabilistic_whole"](spark, SF).collect()} == pytest.approx(want, abs=1e-4)


def test_posterior_of_many_estimates(spark):
    df = spark.range(20000).select(F.lit(1).alias("frame"), F.lit(70.2).alias("bpm"), F.lit(100.0).alias("sqi"))
    assert jobs.probabilistic(df).first().bpm == pytest.approx(70.0)


def test_whole_spectra_equal_numpy(spark):
    x = {r.id: np.array(r.x) for r in arrays(spark, SF).select("id", "x").limit(300).collect()}
    power = {k: np.abs(np.fft.rfft((v - v.mean()) * np.hanning(64))) ** 2 for k, v in x.items()}
    hz = np.fft.rfftfreq(64, 1 / 30)
    inside = (hz >= 0.83) & (hz <= 3.0)
    ids = F.col("id").isin(list(x))
    for r in plans.QUERIES["d9_snr_whole"](spark, SF).where(ids).collect():
        assert r.snr == pytest.approx(np.clip(10 * np.log10(power[r.id][inside].sum() / power[r.id][~inside].sum()), -20, 20), abs=1e-3)
    band = np.flatnonzero((hz >= 0.8) & (hz <= 3.0))
    for r in plans.QUERIES["d6_harmonic_rejection_whole"](spark, SF).where(ids).collect():
        p, f = power[r.id], hz[band[power[r.id][band].argmax()]]
        top = lambda g: max(p[np.abs(hz - g) <= 0.1], default=0.0)  # noqa: B023, E731
        below = any(g >= 0.7 and top(g) > (0.4 if 60 * f > 140 else 0.6) * top(f) for g in (f / 2, f / 3))
        assert r.harmonic == (below or any(top(g) > 0.15 * top(f) for g in (2 * f, 3 * f)))
    assert {r.k for r in plans.QUERIES["d1_spectrum_whole"](spark, SF).select("k").distinct().collect()} == set(range(1, 33))


def test_full_confidence_is_in_no_bin(spark):
    df = spark.createDataFrame([(1, 72.0, 72.0, 100.0), (1, 72.0, 72.0, 95.0)], "k int, measured double, reference double, confidence double")
    assert metrics.reliability(df, ["k"], least=1).collect()[0].n == 1


@pytest.mark.parametrize(("sqi", "conf", "kind", "score"), [(0.9, None, "sqi_high", 0.9), (0.6, None, "sqi_medium", 0.6), (0.25, None, "sqi_failed", 0.25), (None, None, "sqi_failed", 0.0), (float("nan"), None, "sqi_failed", 0.0), (0.9, 0.4, "sqi_low", 0.4)])
def test_quality(spark, sqi, conf, kind, score):
    df = spark.createDataFrame([(sqi, conf)], "s double, c double")
    got = df.select(C.quality(F.col("s"), F.col("c"), F.lit(None).cast("double")).alias("q")).first().q
    assert (got.type, got.score) == (kind, score)


def test_conditions(spark):
    df = spark.createDataFrame([(125.0, 5.0, 0.25, 0.85), (20.0, 5.0, 0.0, 1.0), (None, None, None, None)], "m double, v double, level double, cover double")
    got = df.select(C.lighting(F.col("m"), F.col("v")).alias("l"), C.motion(F.col("level"), F.lit(0.0)).alias("o"), C.roi_stability(F.col("cover")).alias("r")).collect()
    assert [r.l.type for r in got] == ["lighting_normal", "lighting_low", "unknown"]
    assert got[1].l.severity > 0.5 and got[0].o.type == "motion_severe" and got[0].o.severity > 0.7 and got[2].o.type == "motion_none"
    assert [r.r.type for r in got] == ["roi_partial_loss", "roi_stable", "roi_stable"]


def test_spectrum_equals_numpy(spark):
    x = np.random.default_rng(1).normal(size=64)
    got = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(S.spectrum(F.col("x"), 64, 30.0, 1, 16).alias("b")).first().b
    assert np.allclose([b.power for b in got], np.abs(np.fft.rfft(x)[1:17]) ** 2)


def test_bandpass_gain():
    sections = filters.butterworth(4, 0.833, 3.0, 30.0)
    gain = lambda f: abs(np.prod([np.polyval(b, z) / np.polyval(a, z) for b, a in sections for z in [np.exp(2j * math.pi * f / 30.0)]]))
    assert gain(0.833) == pytest.approx(math.sqrt(0.5), rel=0.02) and gain(3.0) == pytest.approx(math.sqrt(0.5), rel=0.02)
    assert gain(1.6) == pytest.approx(1.0, abs=0.02) and gain(0.1) < 1e-3 and gain(10.0) < 1e-2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(30, 220), st.floats(0, 100)), min_size=2, max_size=60))
def test_kalman_covariance_stays_positive(rows):
    state = {}
    for x, sqi in rows:
        state, out = folds.kalman(state, {"x": x, "sqi": sqi})
        assert state["a"] > 0 and state["c"] > 0 and state["a"] * state["c"] - state["b"] ** 2 >= -1e-9
    assert 30 <= out["y"] <= 220


def traced(step, rows):
    state, out = {}, []
    for row in rows:
        state, got = step(state, row)
        out.append(got)
    return out


def test_smoother_trace():
    """Worked by hand: pull to the value before, a cut of large moves, the slow mean, values without a rate."""
    got = traced(folds.smoother, [{"x": 0.0}, {"x": 70.0}, {"x": 80.0}, {"x": -1.0}, {"x": 170.0}])
    assert [g["y"] for g in got[:2]] == [0.0, 70.0] and not any(g["locked"] for g in got)
    # 80 is pulled to 73; the median of 70 and 73 is 71.5, the slow mean 70.375; the filter starts at 70 and has quality 50
    state = {}
    for x in (70.0, 70.375):
        state, out = folds.kalman(state, {"x": x}, (0.5, 0.005), 20.0)
    assert got[2]["y"] == pytest.approx(out["y"]) and got[3]["y"] == pytest.approx(70.375)
    # 170 is pulled to 102.1, cut to 75.91, which is within 8 of the last three: the median of 70, 73, 75.91 moves the mean to 71.03
    assert folds.kalman(state, {"x": 0.25 * 73 + 0.75 * 70.375}, (0.5, 0.005), 20.0)[1]["y"] == pytest.approx(got[4]["y"])
    steady = traced(folds.smoother, [{"x": 72.0}] * 230)
    assert [g["locked"] for g in steady].index(True) == 199


def test_motion_trace():
    moving = [g["moving"] for g in traced(folds.motion, [{"x": 5.0}] * 2 + [{"x": 0.0}] * 40)]
    # 2.4 isn't over 2.5, the second score (3.75 - 0.6 * 0.392) is; the next is 1.65 (holds), then 20 frames of grace and the one that ends it
    assert moving == [False, True] + [True] * 21 + [False] * 19


def test_reliability_trace():
    states = [g["state"] for g in traced(folds.reliability, [{"x": 80.0}] * 20 + [{"x": 50.0}] * 3 + [{"x": 30.0}] * 20 + [{"x": 10.0}] * 2 + [{"x": 55.0}] * 2 + [{"x": 80.0}])]
    assert states[:15] == ["WARMUP"] * 15 and states[15:27] == ["STABLE"] * 12 and states[27] == "DEGRADING"
    assert states[38] == "UNCERTAIN" and states[43:45] == ["INVALID"] * 2 and states[45:47] == ["RECOVERING"] * 2 and states[47] == "STABLE"
    assert [g["state"] for g in traced(folds.reliability, [{"x": 50.0}] * 31)][29:] == ["WARMUP", "UNCERTAIN"]


def test_arrhythmia_trace():
    """Two kinds of oddity raise the alarm after three votes; it rests for 45 s, and extreme rates raise it alone."""
    odd = [{"x": 500.0 + 600.0 * (i % 2), "t": float(i), "sqi": 90.0, "bpm": 75.0} for i in range(80)]
    alarms = [(i, g["kinds"]) for i, g in enumerate(traced(folds.sustained_arrhythmia, odd)) if g["alarm"]]
    assert alarms == [(11, "HRV_HIGH|RR_JUMP"), (56, "HRV_HIGH|RR_JUMP")]
    assert not any(g["alarm"] for g in traced(folds.sustained_arrhythmia, [r | {"sqi": 60.0} for r in odd]))
    assert not any(g["alarm"] for g in traced(folds.sustained_arrhythmia, [r | {"x": 800.0} for r in odd]))


def test_candidate_life_trace():
    row = lambda t, x: {"t": float(t), "x": x, "stability": 1.0}
    got = traced(folds.candidate_life, [row(0, 0.9), row(1, 0.9), *(row(2 + i, 0.01) for i in range(20)), *(row(22 + i, 0.9) for i in range(10)), row(60, 0.1)])
    lives = [g["life"] for g in got]
    faded = lives.index("DEGRADING")
    assert lives[:2] == ["ALIVE", "ALIVE"] and lives[faded : faded + 5] == ["DEGRADING"] * 5 and lives[faded + 5] == "EXPIRED"
    assert "RECOVERED" in lives and lives[lives.index("RECOVERED") + 1] == "ALIVE" and lives[-1] == "BORN"


@pytest.mark.parametrize("name", ["kalman", "uncertain_rate", "baseline", "reliability", "motion", "session_confidence"])
def test_stream_equals_batch(spark, tmp_path, name):
    from pulselake.streaming import stateful

    rows = synthetic.pulse(spark, 3, 40).select(F.col("session").cast("long").alias("session"), "seq", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("ts"), ((F.col("g") - 100) * 2).alias("x"), F.when(F.col("seq") % 3 > 0, F.col("seq") * 2.5).alias("sqi"), F.when(F.col("seq") % 4 > 0, F.lit(0.5)).alias("agreement")).cache()
    for i in range(2):
        rows.where(f"seq div 20 = {i}").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stateful.run(stream, name).writeStream.format("memory").queryName(f"out_{name}").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table(f"out_{name}").collect()))
    want = sorted(map(tuple, folds.run(rows.withColumn("t", F.unix_micros("ts") / 1e6), name).collect()))
    assert len(got) == 120 and got == want


def test_correlation_p_values(spark):
    """Known values of Student's t: r 0.5 of 10 pairs, r 0.9 of 5, r 0.02 of 1,000, none of 2."""
    df = spark.createDataFrame([(0.5, 10), (-0.9, 5), (0.02, 1000), (0.0, 8), (0.7, 2)], "r double, n long")
    got = [r[0] for r in df.select(metrics.two_sided_p(F.col("r"), F.col("n"))).collect()]
    assert got[:4] == pytest.approx([0.14111, 0.03739, 0.52752, 1.0], abs=2e-4) and got[4] is None


def test_lenient_csv(spark, tmp_path):
    p = tmp_path / "gt.csv"
    p.write_text("Time,Rate,More\n0.0,71.5,x\n\n5\nabc,70\n1.0 , 72\n")
    assert [tuple(r) for r in ground_truth.load_lenient(spark, str(p)).orderBy("ts").collect()] == [(0.0, 71.5), (1.0, 72.0)]


def test_csv_rows_and_rejects(spark, tmp_path):
    p = tmp_path / "gt.csv"
    p.write_text(" Timestamp , BPM\n0.0,71.5\n0.5,999.0\n1.0,\n1.5,abc\nnan,70\n")
    rows, rejects = ground_truth.load(spark, str(p))
    assert [(r.ts, r.warning) for r in rows.orderBy("ts").collect()] == [(0.0, None), (0.5, "out of range")]
    assert rejects.count() == 3
    with pytest.raises(Exception, match="rejected"):
        ground_truth.load_strict(spark, str(p), "x").collect()
    bad = tmp_path / "bad.csv"
    bad.write_text("timestamp,heartrate\n0,1\n")
    with pytest.raises(ValueError, match="bpm"):
        ground_truth.load(spark, str(bad))


def test_sensor_import_and_history(spark, tmp_path):
    p = tmp_path / "sensor.csv"
    p.write_text("# made by a sensor\n0.0,70\n0.5,71\n\nx,y\n1.0,72\n")
    s = ground_truth.import_sensor(spark, str(p), str(tmp_path / "out")).first()
    assert (s.n, s.mean, s.mean_step, s.duplicates) == (3, 71.0, 0.5, 0)
    rows = spark.createDataFrame([(i, f"2024-01-0{i}", 1.0, 70.0, None) for i in range(1, 6)], ground_truth.SESSION)
    ground_truth.save_sessions(rows, str(tmp_path / "h"))
    assert [r.id for r in ground_truth.history(spark, str(tmp_path / "h"), 2).collect()] == [5, 4]
    ground_truth.save_json(rows, str(tmp_path / "j"))
    assert ground_truth.load_json(spark, str(tmp_path / "j"), ground_truth.SESSION).exceptAll(rows).count() == 0


def test_splits_are_disjoint_complete_and_repeatable(spark):
    df = spark.createDataFrame([(i * 7 + 1000, i % 5, f"d{i % 3}") for i in range(100)], "sample long, subject int, domain string")
    one = splits.random_split(df)
    assert sorted(r["count"] for r in one.groupBy("split").count().collect()) == [15, 15, 70]
    assert one.exceptAll(splits.random_split(df)).count() == 0 and one.select("sample").exceptAll(df.select("sample")).count() == 0
    assert splits.leakage(splits.split(df, "SUBJECT_HELD_OUT")).count() == 0
    assert splits.leave_one_out(df).where("split = 'test' AND domain <> fold").count() == 0


def test_fusion_and_regions(spark):
    df = spark.createDataFrame([(1, "a", 70.0, 1.0, False), (1, "b", 72.0, 1.0, False), (1, "c", 140.0, 0.1, False), (2, "a", 60.0, 1.0, True)], "frame int, roi string, bpm double, weight double, suspect boolean")
    got = {r.frame: r.fused for r in fusion.hierarchical(df).collect()}
    assert got[1] == pytest.approx(71.0, abs=1e-6) and got[2] == pytest.approx(60.0, abs=1e-6)
    snake = [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (3, 3)]
    mask = spark.createDataFrame([(1, y, x) for y, x in snake], "frame int, y int, x int")
    assert {r.region: r["count"] for r in grids.regions(mask, 4).groupBy("region").count().collect()} == {0: 7, 15: 1}


def test_pooling_skips_padding(spark):
    df = spark.createDataFrame([([1.0, 3.0, 99.0], [False, False, True])], "x array<double>, p array<boolean>")
    got = df.select(*(L.pooled(F.col("x"), F.col("p"), k).alias(k) for k in ("mean", "max", "last"))).first()
    assert tuple(got) == (2.0, 3.0, 3.0)


def test_jobs(spark, tmp_path):
    from pulselake.plans import jobs

    t = synthetic.pulse(spark, 2, 600)
    jobs.assert_reproducible(lambda: synthetic.pulse(spark, 1, 50))
    same = spark.createDataFrame([(1, 70.0, 100.0), (1, 74.0, 100.0), (1, -1.0, 100.0)], "frame int, bpm double, sqi double")
    assert jobs.probabilistic(same).first().bpm == pytest.approx(72.0, abs=0.01)
    jobs.capped_log(t.select("session", "seq", "t", "g"), str(tmp_path / "log"), most=10)
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 20
    series_ = spark.createDataFrame([(1, float(i), 70.0) for i in range(5)], "session int, ts double, bpm double")
    jobs.manifest(spark.createDataFrame([(1, 0.5, 3.0)], "session int, start double, duration double"), series_, str(tmp_path / "m"))
    m = spark.read.json(str(tmp_path / "m")).first()
    assert (m.offset, m.overlaps, m.n) == (-0.5, True, 5)
    summary = spark.createDataFrame([("overall", "all", 4, 1, 1.0, 1.0, 0.0)], "breakdown string, name string, windows long, valid long, mae double, rmse double, bias double")
    assert "only 4 windows; fewer than half" in jobs.report(summary)
    skin = jobs.skin(spark.createDataFrame([(1, 200.0, 140.0, 120.0), (1, 20.0, 200.0, 20.0)], "frame int, r double, g double, b double"))
    assert skin.count() == 1


def test_plausibility_trace(spark):
    rates = [70.0] * 6 + [95.0, 95.0, None, float("nan"), 300.0, 70.0, 70.0]
    df = spark.createDataFrame([(1, i, x, 0.0, 0.0, 0.0) for i, x in enumerate(rates)] + [(2, 0, 70.0, 0.5, None, 0.3)], "session int, seq int, x double, instability double, harmonic_ratio double, cv double")
    got = {(r.session, r.seq): (r.verdict, r.failures) for r in gates.plausible(df).collect()}
    assert got[2, 0] == ("UNCERTAIN", ["spectral", "candidates"])
    assert [got[1, i][0] for i in range(13)] == ["PLAUSIBLE"] * 6 + ["INVALID", "PLAUSIBLE", "INVALID", "INVALID", "INVALID", "INVALID", "PLAUSIBLE"]
    assert got[1, 6][1] == ["jumps"] and got[1, 8][1] == got[1, 9][1] == ["out_of_range"] and got[1, 11][1] == ["jumps"]
    late = {r.seq: r.failures for r in gates.plausible(df.where("session = 1"), timeout=4).collect()}
    assert late[11] == ["jumps"] and late[12] == ["timeout"]  # four rows in a row were invalid: the session stays so
    wild = spark.createDataFrame([(1, i, x, 0.0, 0.0, 0.0) for i, x in enumerate([100.0, 119.0, 100.0, 119.0, 138.0, 157.0, 157.0])], df.schema)
    assert [r.failures for r in gates.plausible(wild, unsteady=13).orderBy("seq").collect()] == [[]] * 5 + [["trajectory"]] * 2
    assert gates.plausible(df.limit(0)).count() == 0


def test_spatial_failures(spark):
    kind = "stream int, frame int, motion double, candidates int, scores array<double>, stability double, quality double, landmark_variance double"
    calm = (0.1, 5, [1.0, 1.1], 0.9, 1.0, 0.5)
    rows = [(1, 1, *calm), (1, 2, 0.5, 1, [1.0, 9.0], 0.2, 1.0, 3.0), (1, 3, 0.9, 0, [], 0.9, 1.0, 6.0), (1, 4, None, 5, None, None, None, None)]
    rows += [(2, i, 0.1, 3 if i % 2 else 9, [], 0.9, 1.0, 0.5) for i in range(11)] + [(3, i, 0.1, 5, [], 0.9, 2.0 * (i % 2), 0.5) for i in range(5)]
    got = {(r.stream, r.frame): (r.failures, r.severity, r.action) for r in gates.spatial_failures(spark.createDataFrame(rows, kind)).collect()}
    assert got[1, 1] == got[1, 4] == ([], "info", "none")
    assert got[1, 2] == (["local_motion", "insufficient_candidates", "spatial_disagreement", "temporal_instability", "landmark_instability"], "warning", "downweight")
    assert got[1, 3] == (["local_motion", "insufficient_candidates", "landmark_instability"], "error", "reject")
    assert [got[2, i][0] for i in range(11)] == [[]] * 9 + [["candidate_thrashing"]] * 2
    assert [got[3, i][0] for i in range(5)] == [[]] * 4 + [["temporal_instability"]]


def test_metric_intervals_by_force(spark):
    rng = np.random.default_rng(5)
    x, e = rng.normal(70, 10, 12), rng.normal(1, 3, 12)
    df = spark.createDataFrame([(7, i + 1, float(a + b), float(a)) for i, (a, b) in enumerate(zip(x, e, strict=True))] + [(8, 1, 1.0, 2.0)], "session int, row long, measured double, reference double")
    got = metrics.error_intervals(df, ["session"], rounds=40).collect()
    assert [r.session for r in got] == [7]
    d, r = x + e, x
    of = {"mae": lambda m, t: np.abs(m - t).mean(), "rmse": lambda m, t: np.sqrt(((m - t) ** 2).mean()), "bias": lambda m, t: (m - t).mean(), "pearson": lambda m, t: np.corrcoef(m, t)[0, 1],
          "loa_low": lambda m, t: (m - t).mean() - 1.96 * (m - t).std(ddof=1), "loa_high": lambda m, t: (m - t).mean() + 1.96 * (m - t).std(ddof=1)}
    counts = np.array([poisson_draws(7, i, 40) for i in range(1, 13)])
    draws = [np.repeat(np.arange(12), counts[:, b]) for b in range(40)]
    for name, f in of.items():
        drawn = [f(d[at], r[at]) for at in draws]
        assert got[0][name] == pytest.approx(f(d, r)) and got[0][f"{name}_low"] == pytest.approx(np.percentile(drawn, 2.5)) and got[0][f"{name}_high"] == pytest.approx(np.percentile(drawn, 97.5))


def test_waveform_losses_equal_numpy(spark):
    rng = np.random.default_rng(2)
    p, y = rng.normal(size=64), rng.normal(size=64)
    df = spark.createDataFrame([(p.tolist(), y.tolist())], "p array<double>, y array<double>")
    bins = [S.spectrum(F.col(c), 64, 30.0, 0, 32) for c in "py"]
    got = df.select(L.spectral_loss(*bins).alias("s"), L.frequency_loss(*bins).alias("f"), L.waveform_loss(F.col("p"), F.col("y"), *bins).alias("w")).first()
    a, b = np.abs(np.fft.rfft(p)), np.abs(np.fft.rfft(y))
    hz = np.fft.rfftfreq(64, 1 / 30)
    band = (hz >= 0.833) & (hz <= 3.0)
    s = np.abs(a / a.max() - b / b.max()).mean()
    assert got.s == pytest.approx(s) and got.f == pytest.approx(np.abs(a - b)[band].mean() + 0.1 * np.abs(a - b)[~band].mean())
    assert got.w == pytest.approx(((p - y) ** 2).mean() + 0.5 * (1 - np.corrcoef(p, y)[0, 1]) + 0.3 * s)


def test_subharmonic_rules(spark):
    def run(energy, hz, before):
        df = spark.createDataFrame([([(k, k * 0.1, 0.0, 0.0, energy.get(k, 0.0) ** 2) for k in range(41)], hz, before)], "bins array<struct<k:int,hz:double,re:double,im:double,power:double>>, f double, b double")
        return df.select(S.resolved(F.col("bins"), F.col("f"), F.col("b"))).first()[0]

    assert run({24: 1.0, 12: 0.31}, 2.4, None) == pytest.approx(1.2)
    assert run({24: 1.0, 12: 0.2}, 2.4, None) == 2.4 and run({24: 1.0, 12: 0.2}, 2.4, 80.0) == pytest.approx(1.2)
    assert run({9: 1.0, 18: 0.45}, 0.9, None) == pytest.approx(1.8) and run({9: 1.0, 18: 0.3}, 0.9, 85.0) == pytest.approx(1.8)
    assert run({9: 1.0, 18: 0.3}, 0.9, None) == 0.9 and run({}, 2.4, None) == 2.4


def test_candidates_and_matching(spark):
    ok = (0.9, 1.0, 1.0)
    rows = [(1, y, x, *ok) for y, x in [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]] + [(1, 5, 5, *ok)] + [(1, 7, x, 0.6, 0.5, 0.5) for x in (0, 1)] + [(1, 4, 0, 0.1, 1.0, 1.0), (2, 0, 0, *ok), (2, 1, 0, *ok)]
    got = grids.candidates(spark.createDataFrame(rows, "frame int, y int, x int, quality double, confidence double, stability double"), 8, 0.3).collect()
    assert {(r.frame, r.region, r.cells, r.rank): round(r.score, 6) for r in got} == {(1, 0, 5, 1): 0.9, (2, 0, 2, 1): round(0.9 / 1.3, 6)}
    new = spark.createDataFrame([(1, 1, 0.4, 0.4), (1, 2, 9.0, -9.0), (2, 1, 0.0, 0.0)], "stream int, region int, y double, x double")
    known = spark.createDataFrame([(1, 5, -1.0, 0.0), (1, 3, 2.3, 0.4), (1, 2, 2.5, 0.4), (1, 9, 9.0, -9.5)], "stream int, candidate int, y double, x double")
    assert {(r.stream, r.region): r.candidate for r in grids.matched(new, known, 2.0).collect()} == {(1, 1): 3, (1, 2): 9, (2, 1): None}


def test_augmentations(spark):
    df = spark.range(300).select("id", F.array(*(F.lit(float(i)) for i in range(10))).alias("x"))
    x, key = F.col("x"), F.col("id")
    one = df.limit(1).select(A.shifted(x, 2).alias("a"), A.shifted(x, -2).alias("b"), A.composed(x, [lambda c: A.scaled(c, 2.0), lambda c: A.masked(c, 1, 8)]).alias("c"), A.shifted(F.slice(x, 1, 0), 2).alias("d")).first()
    assert one.a == [0, 0, 0, 1, 2, 3, 4, 5, 6, 7] and one.b == [2, 3, 4, 5, 6, 7, 8, 9, 9, 9] and one.c == [0] * 9 + [18] and one.d == []
    got = df.select(A.cropped(x, F.lit(0.5), A.chance(key, "crop")).alias("part"), A.noisy(x, key, 0.5).alias("noisy"), A.dropped(x, key, 0.2).alias("dropped"), A.views(x, key, 2, 4, lambda c, own: A.noisy(c, own, 0.0)).alias("views")).collect()
    assert {tuple(r.part) for r in got} == {tuple(float(i) for i in range(s, s + 5)) for s in range(6)}
    noise = np.array([r.noisy for r in got]) - np.arange(10)
    assert abs(noise.mean()) < 0.05 and abs(noise.std() - 0.5) < 0.05
    assert 0.15 < np.mean([[v == 0 for v in r.dropped[1:]] for r in got]) < 0.25
    assert all(len(v) == 4 and np.diff(v).tolist() == [1, 1, 1] for r in got for v in r.views) and any(r.views[0] != r.views[1] for r in got)
