"""What grows faster than the input, or costs more of it than it must."""

import math

import pyarrow as pa
from conftest import SF

from pulselake import plans
from pulselake.operators import estimators as E
from pulselake.operators import folds, frames, metrics
from pulselake.operators import projections as P


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_moving_means(spark):
    values = [[None if (i + s) % 5 == 0 else float((i * 7 + s) % 11) for i in range(n)] for s, n in enumerate((1, 6, 7, 8, 30, 3))] + [[None] * 9, [1.0, math.nan] + [2.0] * 9]
    rows = [(s, i + 1, v) for s, x in enumerate(values) for i, v in enumerate(x)]
    got = {(r.session, r.seq): r.x_mean for r in P.moving_means(spark.createDataFrame(rows, "session long, seq long, x double").repartition(3), 7, ("x",)).collect()}
    assert len(got) == len(rows)
    for s, x in enumerate(values):
        for i in range(len(x)):
            last = [v for v in x[max(0, i - 6) : i + 1] if v is not None]
            want = sum(last) / len(last) if last else None
            assert got[s, i + 1] == want or math.isclose(got[s, i + 1], want) or (math.isnan(got[s, i + 1]) and math.isnan(want))


def test_skin_tone_adds_no_sample_150_times_and_deals_once(spark):
    p = plan(plans.QUERIES["c8_skin_tone"](spark, SF))
    assert p.count("Exchange hashpartitioning") == 1
    assert "149, currentrow" not in p


def test_rows_of_a_batch():
    region = pa.struct([("name", pa.string()), ("bpm", pa.float64())])
    kinds = pa.schema([("session", pa.int64()), ("x", pa.float64()), ("moving", pa.bool_()), ("regions", pa.list_(region))])
    rows = [
        {"session": 1, "x": 0.5, "moving": True, "regions": [{"name": "a", "bpm": 1.0}, {"name": None, "bpm": None}]}, {"session": 2, "x": None, "moving": None, "regions": None},
        {"session": None, "x": -0.0, "moving": False, "regions": []}, {"session": 4, "x": 2.0, "moving": True, "regions": [None, {"name": "b", "bpm": 2.0}]},
    ]
    batch = pa.RecordBatch.from_pylist(rows, schema=kinds)
    for part in (batch, batch.slice(1), batch.slice(3, 1), batch.slice(0, 1), batch.slice(2, 0)):
        assert folds.rows_of(part) == part.to_pylist()


def test_a_frame_weighs_each_region_once(monkeypatch):
    calls = []
    weigh = frames.region_weight
    monkeypatch.setattr(frames, "region_weight", lambda *a: calls.append(a) or weigh(*a))
    region = lambda n, bpm: {"name": n, "base": 0.3, "bpm": bpm, "snr": 0.8, "regularity": 0.9, "consistency": 0.9, "spectral_penalty": 0.0, "brightness": 120.0, "penalty": 1.0}
    _, out = frames.frame_pipeline({}, {"x": 0.1, "moving": False, "drift": 0.0, "regions": [region("a", 70.0), region("b", 72.0)]})
    assert out["accepted"] == 2 and len(calls) == 2


def test_windows_deal_samples_once(spark):
    p = plan(plans.QUERIES["d4_benchmark_windows"](spark, SF))
    assert "explode" not in p.lower() and p.count("Exchange hashpartitioning") == 1 and "Join" not in p


def test_windows_of_any_size_and_hop(spark):
    lengths = (1, 5, 6, 7, 12, 25)
    df = spark.createDataFrame([(s, i + 1, None if i == 3 else float(i)) for s, n in enumerate(lengths) for i in range(n)], "session long, seq long, x double").repartition(3)
    for size, hop in ((6, 2), (6, 6), (6, 4), (5, 3), (2, 4)):
        for complete in (True, False):
            got = {(r.session, r.w): (r.x, r.end) for r in E.windows(df, size, hop, complete=complete, ends=True).collect()}
            want = {}
            for s, n in enumerate(lengths):
                x = [0.0 if i == 3 else float(i) for i in range(n)]
                want |= {(s, w): (x[w * hop : w * hop + size], n) for w in range(-(-n // hop)) if not complete or w == 0 or w * hop + size <= n}
            assert got == want


def test_no_group_of_a_quantile_is_dealt_by_its_key(spark, monkeypatch):
    from pyspark.sql import functions as F

    plans_of_large = []
    cut = metrics.checkpointed
    monkeypatch.setattr(metrics, "checkpointed", lambda df: plans_of_large.append(plan(df)) or cut(df))
    df = spark.range(4000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") * 1.0).alias("v")).unionByName(spark.createDataFrame([(2, 1.0), (2, 4.0), (None, 5.0)], "k long, v double"))
    out = metrics.exact_quantile(df, ["k"], "v", 0.5, buffered=100)
    want = {k: sorted(7.0 if i % 3 == 0 else float(i) for i in range(k, 4000, 2)) for k in (0, 1)}
    assert {r.k: r.quantile for r in out.collect()} == {**{k: (v[999] + v[1000]) / 2 for k, v in want.items()}, 2: 2.5}
    assert len(plans_of_large) > 2 and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in [*plans_of_large, plan(out)])
