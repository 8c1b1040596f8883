"""The frame pipeline (H3) and its parts by hand."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.operators import folds, frames
from pulselake.plans import temporal_queries


def region(name, bpm, snr=0.8, brightness=120.0, base=0.3, penalty=1.0):
    return {"name": name, "base": base, "bpm": bpm, "snr": snr, "regularity": 0.9, "consistency": 0.9, "spectral_penalty": 0.05, "brightness": brightness, "penalty": penalty}


def frame(*regions, motion=0.0, moving=False, drift=0.0):
    return {"x": motion, "moving": moving, "drift": drift, "regions": list(regions)}


def run(rows):
    state, out = {}, []
    for r in rows:
        state, got = frames.frame_pipeline(state, r)
        json.dumps(state)  # what a stream keeps
        out.append(got)
    return state, out


def test_the_first_frame_by_hand():
    state, (got,) = run([frame(region("a", 70.0), region("b", 76.0, 0.5), region("c", 95.0, 0.4))])
    # steadiness 1, consistency 0.58 after one frame; the lower SNR alone makes b and c worse
    quality = lambda snr: math.floor(10 * 100 * (0.25 * snr + 0.3 * 0.9 + 0.3 + 0.15 * 0.58 + 0.1 - 0.4 * 0.05 / 3) + 0.500001) / 10
    assert [state["regions"][k]["sqi"] for k in "abc"] == [quality(0.8), quality(0.5), quality(0.4)]
    # c is 25 from the best, so it is left out; b agrees by exp(-1)
    assert got["accepted"] == 2 and state["regions"]["b"]["agreement"] == pytest.approx(math.exp(-1)) and got["agreement"] == pytest.approx(math.exp(-3 / 7))
    grid = np.arange(40, 200.5, 0.5)
    like = np.exp(sum(-0.5 * ((grid - b) / (10 * (1 - q / 100) + 0.8)) ** 2 for b, q in ((70, quality(0.8)), (76, quality(0.5)))))
    joint = (like / like.sum()) @ grid
    weight = {"a": 0.3 * (0.4 * quality(0.8) / 100 + 0.4 + 0.2 * 0.8**1.5), "b": max(0.05, 0.15 * 0.3 * (0.4 * quality(0.5) / 100 + 0.4 + 0.2 * 0.5**1.5))}
    w = {k: v / 2 for k, v in weight.items()}  # the mean of the belief in a region is a half at first
    total = sum(w.values())
    w = {k: min(v, 0.75 * total) for k, v in w.items()}
    mean = (70 * w["a"] + 76 * w["b"]) / sum(w.values())
    assert got["bpm"] == pytest.approx(0.7 * joint + 0.3 * mean, rel=1e-6)
    assert got["sqi"] == pytest.approx((weight["a"] * quality(0.8) + weight["b"] * quality(0.5)) / sum(weight.values()))  # agreement is over a half
    assert got["confidence"] == 0.0 and got["calibrating"] and not got["frozen"] and not got["locked"]


def test_freeze_inertia_and_jumps():
    calm = [frame(region("a", 70.0), region("b", 71.0))] * 12
    state, out = run([*calm, frame(region("a", 70.0), drift=40.0), frame(), frame(region("a", 20.0))])
    held = out[11]["bpm"]
    assert 69 < held < 72 and out[11]["confidence"] > 0
    assert out[12]["frozen"] and out[12]["bpm"] == held and out[13]["bpm"] == 0.0 and out[13]["accepted"] == 0
    assert out[14]["bpm"] == 0.0 and state["held"] == held  # 20 isn't usable
    # three frames at 125 move the belief, but a fused rate more than 30 away isn't shown
    _, out = run([*calm, *[frame(region("a", 125.0), region("b", 125.0))] * 3])
    assert any(o["locked"] and o["bpm"] == held for o in out[12:])
    assert all(abs(b["bpm"] - a["bpm"]) < 15 for a, b in zip(out[11:], out[12:], strict=False))


def test_rates_that_were_implausible_stay_out():
    state, out = run([frame(region("a", 135.0), region("b", 70.0)), frame(region("a", 72.0), region("b", 70.0))])
    assert out[1]["accepted"] == 1 and state["regions"]["a"]["bpm"] == 135.0
    _, out = run([frame(region("a", 140.0), region("b", 70.0), region("c", 71.0, brightness=30.0)), frame(region("a", 71.0), region("b", 70.0))])
    assert out[0]["accepted"] == 1 and out[1]["accepted"] == 1  # 140 / 105 isn't twice the median
    state, _ = run([frame(region("a", 126.0), region("b", 60.0), region("c", 62.0))])
    assert state["regions"]["a"]["bpm"] == 63.0  # twice the median of 62


def test_doubled_rates_count_frames():
    a, b = {"bpm": 100.0, "sqi": 80.0, "agreement": 1.0}, {"bpm": 50.0, "sqi": 80.0, "agreement": 1.0}
    seen = []
    for _ in range(5):
        a["sqi"] = b["sqi"] = 80.0
        frames.doubled_rates([a, b])
        seen.append((a["streak"], round(a["sqi"], 2), a["suspect"]))
    assert seen == [(1, 48.0, True), (2, 28.0, True), (3, 9.6, True), (4, 9.6, True), (5, 6.4, True)] and not b["suspect"] and frames.region_weight(a, 1.0, 0, 0) == 0.0
    a["bpm"] = 54.0
    for _ in range(5):
        frames.doubled_rates([a, b])
    assert not a["suspect"] and a["streak"] == 0


def test_grouped_mean():
    assert frames.grouped_mean([]) == 0.0 and frames.grouped_mean([(70.0, 0.0, False)]) == 0.0
    assert frames.grouped_mean([(70.0, 1.0, False), (74.0, 1.0, False), (120.0, 1.0, True)]) == pytest.approx(72.0, abs=1e-6)
    assert frames.grouped_mean([(70.0, 1.0, True), (90.0, 1.0, True)]) == pytest.approx(80.0, abs=1e-6)
    # the pair of 70 and 72 has a tenth of the weight, but more members than the heavy one
    assert frames.grouped_mean([(70.0, 0.05, False), (72.0, 0.05, False), (100.0, 0.9, False)]) == pytest.approx((71 * 0.1 + 100 * 0.75) / 0.85, abs=1e-6)


def test_calibration_waits_for_all_frames():
    state = {}
    for i in range(200):
        state, out = frames.calibration(state, {"x": float(i % 3), "sqi": 29.0 if i % 10 == 0 else 40.0})
        assert out["calibrating"] and (state.get("done", False) == (i == 199))
    assert state["base_sqi"] == 40.0 and state["base_bpm"] == 1.5
    assert frames.calibration(state, {"x": 1.0, "sqi": 90.0}) == (state, {"calibrating": False})


def test_smoother_passes_all_until_three_are_known():
    state, _ = folds.smoother({}, {"x": 60.0})
    state, _ = folds.smoother(state, {"x": 90.0})
    assert state["mean"] == pytest.approx(0.25 * 64.5 + 0.75 * 60)


def test_frames_in_batch_do_not_depend_on_order(spark):
    from conftest import SF

    df = temporal_queries.frame_rows(spark, SF)
    got = [sorted(map(tuple, folds.run(d, "frame_pipeline").collect())) for d in (df, df.orderBy(F.rand(1)).repartition(7))]
    assert got[0] == got[1] and len(got[0]) == df.count()
    one = df.where("session = (SELECT 1)").orderBy("t", "seq").collect()
    state, want = {}, []
    for r in one:
        state, out = frames.frame_pipeline(state, r.asDict(recursive=True))
        want.append((r.seq, out["bpm"], out["confidence"]))
    assert [(r[1], r[2], r[6]) for r in got[0] if r[0] == 1] == sorted(want)


def test_frames_as_a_stream(spark, tmp_path):
    """Frames of two micro-batches give what the batch gives."""
    from conftest import SF

    from pulselake.streaming import stateful

    rows = temporal_queries.frame_rows(spark, SF).where("session < 3").withColumn("ts", F.timestamp_seconds("t")).cache()
    for i in range(2):
        rows.where(f"(seq > 20) = {bool(i)}").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stateful.run(stream, "frame_pipeline", lateness="60 days").writeStream.format("memory").queryName("frames_out").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(180)
    got = sorted(map(tuple, spark.table("frames_out").collect()))
    want = sorted(map(tuple, folds.run(rows, "frame_pipeline").collect()))
    assert len(got) == rows.count() and got == want
