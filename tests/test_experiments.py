"""Experiments, records, samplers and the rate on show against plain versions."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.operators import estimators, experiments, folds, grids, splits
from pulselake.sources import experiment_tree as tree


def pulse(n, fps=30.0, seed=42):
    """The reference's ablation signal: a pulse of 1.2 Hz and a drift of 0.15 Hz in three channels, with noise."""
    t = np.arange(n) / fps
    noise = np.random.default_rng(seed).normal(0, 0.1, n)
    return [128 + c * np.sin(2 * np.pi * 1.2 * t) + d * np.sin(2 * np.pi * 0.15 * t) + noise for c, d in ((0.5, 0.3), (0.75, 0.24), (0.25, 0.09))]


def test_the_bandpass_flag_changes_the_signal(spark):
    rows = [(1, i + 1, *map(float, x)) for i, x in enumerate(zip(*pulse(600), strict=True))] + [(2, i + 1, 1.0, 1.0, 1.0) for i in range(40)] + [(3, 1, 1.0, 2.0, None)]
    wins = estimators.windows(spark.createDataFrame(rows, "session int, seq bigint, r double, g double, b double"), 600, 300, ("r", "g", "b"))
    got = {r.session: r for r in experiments.bandpass_ablation(wins, 30.0).collect()}
    assert abs(got[1].with_bandpass - 72) <= 15 and abs(got[1].without_bandpass - 72) <= 30 and got[1].apart > 1e-4
    assert got[2].apart == pytest.approx(0, abs=1e-9) and got[3].with_bandpass == 0.0


def test_each_experiment_has_its_stages(spark):
    r = np.random.default_rng(5)
    frames = [(f, y, x, float(v) if (y, x) in ((1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (6, 5), (6, 6), (7, 5 + f % 2)) else -1.0) for f in range(4) for (y, x), v in np.ndenumerate(r.uniform(0.5, 1, (8, 8)))]
    df = spark.createDataFrame(frames, "frame bigint, y bigint, x bigint, v double")
    got = {(x.experiment, x.frame): x.asDict() for x in experiments.run(df, scale=20.0).collect()}
    measures = {"quality": {"quality_mean"}, "motion": {"motion_mean"}, "aware": {"aware_mean", "usable"}, "candidates": {"n_candidates", "best_score"}, "temporal": {"persistence"}}
    assert len(got) == 7 * 4
    for (e, f), row in got.items():
        want = set().union(*(measures[s] for s in experiments.EXPERIMENTS[e])) - ({"motion_mean"} if f == 0 else set())
        assert {k for k, v in row.items() if v is not None} - {"experiment", "frame"} == want, (e, f)
        full = got["e6_full", f]
        assert all(row[k] == full[k] for k in want)
    few = experiments.run(df, ("e0_baseline", "e2_motion_only"))
    assert few.columns == ["experiment", "frame", "motion_mean"] and few.count() == 8
    with pytest.raises(KeyError):
        experiments.run(df, ("e9",))
    cells = grids.candidates(df.select("frame", "y", "x", (F.lit(0.72) * (F.col("v") + 1) / 2).alias("quality"), F.lit(0.8).alias("confidence"), F.lit(0.9).alias("stability")), 8, 0.3)
    assert {x.frame: x["count"] for x in cells.groupBy("frame").count().collect()} == {f: got["e6_full", f]["n_candidates"] for f in range(4)}


def test_records_survive_the_way_there_and_back(spark, tmp_path):
    rows = [("s1", "p", f"w{i}", i, float(i), 70.0 + i if i % 3 else None, [1.0, 2.0] if i % 2 else None, i != 4) for i in range(7)] + [("s2", None, "x0", 0, 0.0, None, [], None)]
    windows = spark.createDataFrame(rows, "session_id string, subject_id string, window_id string, number int, start_time double, hr_estimate double, bvp_signal array<double>, is_valid boolean")
    conditions = spark.createDataFrame([("w1", "motion", 0.5, {"a": 1.0, "b": 2.0}, True, None), ("w1", "light", 0.1, {}, False, "dim"), ("w3", "motion", None, None, None, "x"), ("gone", "motion", 1.0, None, None, None)], "window_id string, type string, severity double, evidence map<string,double>, is_actionable boolean, description string")
    nested = tree.tree(windows.repartition(4), conditions, "e1", part=3)
    assert sorted((r.session_id, r.part, [w.window_id for w in r.windows]) for r in nested.collect()) == [("s1", 0, ["w0", "w1", "w2"]), ("s1", 1, ["w3", "w4", "w5"]), ("s1", 2, ["w6"]), ("s2", 0, ["x0"])]
    tree.save(nested.where("session_id = 's1'"), str(tmp_path / "t"))
    tree.save(nested.where("session_id = 's2'"), str(tmp_path / "t"))  # appends
    w, c = tree.flat(tree.load(spark, str(tmp_path / "t")))
    got = {x.window_id: x for x in w.collect()}
    assert len(got) == 8
    for session, subject, name, _, start, estimate, bvp, valid in rows:
        x = got[name]
        assert (x.experiment_id, x.session_id, x.subject_id, x.start_time, x.hr_estimate, x.bvp_signal, x.is_valid, x.rgb_mean) == ("e1", session, subject, start, estimate, bvp, valid, None)
    assert sorted(((x.window_id, x.type, x.severity, x.evidence, x.description) for x in c.collect()), key=str) == [("w1", "light", 0.1, {}, "dim"), ("w1", "motion", 0.5, {"a": 1.0, "b": 2.0}, None), ("w3", "motion", None, None, "x")]
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "a.json").write_text('{"session_id": "s", "colour": 3, "windows": [{"window_id": "w", "what": {}}]}\n')
    assert tree.flat(tree.load(spark, str(tmp_path / "old")))[0].first().window_id == "w"
    assert tree.flat(nested.limit(0))[0].count() == 0


def test_readings_append_and_sum_up(spark, tmp_path):
    path = str(tmp_path / "readings")
    for i in range(2):
        tree.save_readings(spark.createDataFrame([(7, 10.0 * i, 60.0 + 20 * i), (8, 1.0, 0.0)], "session_id int, timestamp double, bpm double"), path)
    got = {r.id: r for r in tree.summaries(spark.read.parquet(path)).collect()}
    assert (got[7].duration_sec, got[7].avg_bpm, got[7].avg_sqi) == (10.0, 70.0, None) and got[8].avg_bpm is None


def chance(*text):
    return (int(hashlib.md5("/".join(map(str, text)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def test_weighted_samples_and_draws_by_force(spark):
    rows = [(i, "abbcccc"[i % 7]) for i in range(210)]
    df = spark.createDataFrame(rows, "sample int, domain string").withColumn("key", F.lit(1)).drop("key").repartition(3)
    weights = splits.domain_weights(df)
    w = {r.domain: r.weight for r in weights.collect()}
    assert w == pytest.approx({"a": 210 / (3 * 30), "b": 210 / (3 * 60), "c": 210 / (3 * 120)})
    order = sorted(rows, key=lambda r: -math.log(chance(42, r[0])) / w[r[1]])
    for n in (0, 1, 50, 209, 210, 500):
        got = {(r.sample, r.domain) for r in splits.weighted_sample(df, weights, n).collect()}
        assert got == set(order[:n]), n
    draws = splits.weighted_draws(df, weights, 600).collect()
    by_digest = {d: sorted((r[0] for r in rows if r[1] == d), key=lambda s: (hashlib.md5(f"42/{s}".encode()).hexdigest(), s)) for d in "abc"}
    for r in draws:
        u, d = chance(42, r.draw, "d") * 210, "a"
        for d in "abc":
            u -= w[d] * len(by_digest[d])
            if u < 0:
                break
        assert r.domain == d and r["sample"] == by_digest[d][int(chance(42, r.draw, "s") * len(by_digest[d]))]
    assert len(draws) == 600 and all(150 < n < 250 for n in Counter(r.domain for r in draws).values())  # all domains alike
    assert splits.weighted_draws(df, weights, 0).count() == 0


def test_dro_rounds_by_force(spark):
    losses = {(1, "a"): 2.0, (1, "b"): 0.5, (2, "a"): 1.0, (3, "b"): 4.0, (5, "a"): 0.0}
    got = {(r.round, r.domain): r for r in splits.dro_rounds(spark.createDataFrame([(*k, v) for k, v in losses.items()], "round int, domain string, loss double"), eta=0.5).collect()}
    w = {"a": 0.5, "b": 0.5}
    for t in (1, 2, 3, 5):
        loss = {d: losses.get((t, d), 0.0) for d in w}
        assert got[t, "a"].weighted == pytest.approx(sum(w[d] * loss[d] for d in w))
        w = {d: w[d] * math.exp(0.5 * loss[d]) for d in w}
        w = {d: v / sum(w.values()) for d, v in w.items()}
        assert {d: got[t, d].weight for d in w} == pytest.approx(w)
    far = splits.dro_rounds(spark.createDataFrame([(i, d, 1000.0) for i in range(5) for d in "ab"], "round int, domain string, loss double"), eta=1.0)
    assert all(r.weight == 0.5 for r in far.collect())  # exp(5000) isn't taken


def test_splits_are_checked(spark):
    df = spark.createDataFrame([(1, "p", "train"), (2, "p", "test"), (2, "q", "train"), (3, "q", "validation"), (9, "r", "test")], "sample int, subject string, split string")
    known = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "sample int")
    assert splits.validated(df, known).first().asDict() == {"overlapping": 1, "missing": 2, "unknown": 1, "train_validation": 1, "train_test": 1, "validation_test": 0}
    want = hashlib.md5(b"random|domain|7|2|1|2|[1, 2]|[2, 9]").hexdigest()[:16]
    assert splits.split_hash(df, "random", "domain", 7).first().hash == want


def test_holdover_trace():
    state, shown = {}, []
    for i in range(60):
        row = {"t": i / 10, "x": 0.0 if i in (25, 26) else 70.0 + i, "moving": 30 <= i < 33}
        state, out = folds.holdover(state, row)
        shown.append(out["shown"])
    assert shown[:20] == [0.0] * 20 and shown[20] == 90.0  # the grace of the first twenty frames
    assert shown[24] == 94.0 and shown[25] == shown[26] == 94.0 and shown[29] == 99.0
    assert shown[30:53] == [99.0] * 23 and shown[53] == 123.0  # in motion, then twenty frames of grace
    state = {"n": 5, "clear": 1, "good": 80.0, "at": 0.0, "shown": 80.0}
    assert folds.holdover({**state, "n": 50}, {"t": 5.0, "x": 0.0})[1]["shown"] == 80.0
    assert folds.holdover({**state, "n": 50, "shown": 70.0}, {"t": 5.1, "x": -1.0})[1]["shown"] == 70.0  # too old to be shown anew


def test_a_candidate_that_is_not_seen_ends():
    row = lambda t: {"t": t, "x": 0.9}
    state, _ = folds.candidate_life({}, row(10))
    for t in (11, 12):
        state, _ = folds.candidate_life(state, row(t))
    assert len(state["scores"]) == 3
    assert len(folds.candidate_life(state, row(13))[0]["scores"]) == 4 and len(folds.candidate_life(state, row(14))[0]["scores"]) == 1
    state, _ = folds.candidate_life({}, row(1))
    assert len(folds.candidate_life(state, row(4))[0]["scores"]) == 2  # frames before the fifth end nothing


def test_a_benchmark_from_series_to_report(spark, tmp_path):
    from pulselake.plans import jobs

    pred = spark.createDataFrame([(s, i, float(i), 70.0 + i % 5) for s in (1, 2) for i in range(12)] + [(3, 0, 0.0, 70.0)], "session int, id int, t double, x double")
    ref = spark.createDataFrame([(s, i, i + 0.1, 71.0) for s in (1, 2, 3) for i in range(12 if s < 3 else 1)], "session int, id int, t double, x double")
    text = jobs.run_benchmark(pred, ref, str(tmp_path / "b"), 0.5, "trial", rounds=50)
    assert text.startswith("# trial") and "Pairs: 25" in text and text.splitlines()[-1].startswith("| overall | all | 25 | ")
    got = {(r.breakdown, r["name"]): r for r in spark.read.json(str(tmp_path / "b" / "results")).collect()}
    assert set(got) == {("overall", "all"), ("session", "1"), ("session", "2")}  # the third has one pair
    assert all(r.mae_low <= r.mae <= r.mae_high for r in got.values())
    assert spark.read.json(str(tmp_path / "b" / "alignment")).count() == 3 and '"tolerance": 0.5' in spark.read.text(str(tmp_path / "b" / "config")).first()[0]
    assert jobs.configuration()["alignment.greedy"] == {"order": "'t'", "compat": "False"} and len(jobs.configuration()) > 40
    few = jobs.run_benchmark(pred.where("session = 3"), ref, str(tmp_path / "c"), 0.5, "few")
    assert "Too few pairs" in few
