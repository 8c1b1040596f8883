"""Filters, spectra and intervals of windows against plain versions and signals whose rates are known."""

import math

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulselake import plans
from pulselake.operators import estimators as E
from pulselake.operators import filters, projections
from pulselake.sources import synthetic


def wave(hz, n, fps, phase=0.0, height=1.0):
    return height * np.sin(2 * np.pi * hz * np.arange(n) / fps + phase)


def plain_filter(x, b, a):
    """The difference equation, from rest."""
    y = []
    for i in range(len(x)):
        y.append(sum(b[k] * x[i - k] for k in range(len(b)) if i >= k) - sum(a[k] * y[i - k] for k in range(1, len(a)) if i >= k))
    return np.array(y)


def series(spark, sessions):
    return spark.createDataFrame([(s, i, float(v)) for s, x in sessions.items() for i, v in enumerate(x, 1)], "session int, seq bigint, x double")


def test_polynomials_are_the_sections():
    x = np.random.default_rng(1).normal(size=120)
    sections = filters.butterworth(4, 0.833, 3.0, 30.0)
    b, a = filters.butterworth_tf(4, 0.833, 3.0, 30.0)
    assert len(a) == 9 and a[0] == 1.0
    assert filters.run_sections(x, sections) == pytest.approx(plain_filter(x, b, a), abs=1e-9)


def test_both_ways_keeps_phases_and_starts_steady():
    x = wave(1.5, 300, 30.0) + 5.0
    y = filters.both_ways(x[None], *filters.butterworth_tf(4, 0.7, 3.0, 30.0))[0]
    assert np.abs(y - wave(1.5, 300, 30.0))[60:-60].max() < 0.02
    flat = filters.both_ways(np.full((1, 100), 3.0), *filters.notch_tf(1.0, 30.0, 12.0))[0]
    assert flat == pytest.approx(np.full(100, 3.0))  # a level that has always been there stays
    assert filters.both_ways(np.zeros((2, 27)), *filters.butterworth_tf(4, 0.7, 3.0, 30.0)) is None
    b, a = filters.notch_tf(1.2, 30.0, 12.0)
    gain = lambda f: abs(np.polyval(b, z := np.exp(2j * math.pi * f / 30)) / np.polyval(a, z))
    assert gain(1.2) < 1e-9 and gain(0) == pytest.approx(1) and gain(1.15) == pytest.approx(math.sqrt(0.5), rel=0.05)


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_scan_equals_the_sequential_filter(spark, block):
    """Sessions over many blocks, one not full; a null counts as 0."""
    r = np.random.default_rng(2)
    sessions = {1: r.normal(size=300), 2: r.normal(size=64) + 10, 3: r.normal(size=1)}
    df = series(spark, sessions).withColumn("x", F.when((F.col("session") != 1) | (F.col("seq") != 5), F.col("x"))).repartition(5)
    sessions[1][4] = 0.0
    got = filters.bandpass(df, 30.0, block=block).orderBy("session", "seq").collect()
    want = np.concatenate([filters.run_sections(x, filters.butterworth(4, 0.833, 3.0, 30.0)) for x in sessions.values()])
    assert [r.y for r in got] == pytest.approx(want, abs=1e-9) and len(got) == 365
    assert filters.bandpass(df.limit(0), 30.0).count() == 0


def plain_peaks(x, distance, prominence):
    """By the definitions, one after the other."""
    tops = []
    for i in range(1, len(x) - 1):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            tops.append((i + j) // 2)
    alive = set(tops)
    for k in sorted(tops, key=lambda k: (x[k], k), reverse=True):
        if k in alive:
            alive -= {o for o in alive if o != k and abs(o - k) < distance}
    out = []
    for k in sorted(alive):
        left, low = k, x[k]
        while left >= 0 and x[left] <= x[k]:
            low = min(low, x[left])
            left -= 1
        right, other = k, x[k]
        while right < len(x) and x[right] <= x[k]:
            other = min(other, x[right])
            right += 1
        if prominence is None or x[k] - max(low, other) >= prominence:
            out.append(k)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 6), st.sampled_from([None, 0, 1, 3]))
def test_peaks_by_definition(x, distance, prominence):
    assert E.peaks(np.array(x, float), distance, prominence).tolist() == plain_peaks(x, distance, prominence)


def test_one_peak_rules():
    at = lambda **m: np.array([m.get(f"k{i}", 0.0) for i in range(40)])  # noqa: E731  bins of 0.1 Hz
    pick = lambda before=None, **m: E.one_peak(at(**m), 0.1, before)
    assert pick(k12=1.0, k16=0.9) == pytest.approx(1.2)
    assert pick(k24=3.0, k12=1.0) == pytest.approx(1.2)  # 144 is outside 45..130, so it weighs a tenth
    assert pick(k20=3.0, k10=1.0) == pytest.approx(1.0)  # over 110, and half of it stands out
    assert pick(k20=3.0, k10=0.3) == pytest.approx(2.0)  # by less than 0.12
    assert pick(72.0, k11=1.0, k24=9.0) == pytest.approx(1.1)  # double of the rate before, and far from it
    assert pick(90.0, k12=1.0, k15=0.9) == pytest.approx(1.5)  # nearer to the rate before
    assert E.one_peak(np.ones(40), 0.1) == pytest.approx(0.9)  # nothing stands out: the band's first bin
    assert E.one_peak(np.ones(5), 0.1) is None
    assert pick(104.0, k9=20.0, k17=0.5) == pytest.approx(1.7)  # 54 is half of the rate before
    assert pick(120.0, k10=1.0, k20=0.5) == pytest.approx(1.0)  # nearest to the rate before, but half of it stands out


def test_votes_and_history():
    fps = 30.0
    got = E.segment_vote(np.concatenate([wave(1.2, 900, fps), wave(2.0, 300, fps)]), fps)
    assert len(got["votes"]) == 7 and got["x"] == pytest.approx(1.2)
    assert E.segment_vote(np.zeros(29), fps) == {"x": 0.0, "votes": [], "hz": [], "band": []}
    assert E.segment_vote(wave(1.5, 200, fps), fps)["x"] == pytest.approx(1.5) and E.segment_vote(np.full(200, 7.0), fps)["x"] == pytest.approx(0.9)
    state = {}
    row = lambda x, votes: {"x": x, "votes": votes, "hz": [1.0, 1.2, 1.5, 2.0], "band": [0.0, 1.0, 0.0, 0.5]}
    for _ in range(5):
        state, out = E.rate_history(state, row(1.2, [1.2, 1.2]))
        assert out["bpm"] == pytest.approx(72) and out["consistency"] == 1.0 and out["sharp"] and out["dominance"] == pytest.approx(1 / 1.5)
    # a new rate with fewer votes than the history is taken back; with more it stays, at a loss of consistency
    _, out = E.rate_history(state, row(2.0, [2.0, 1.2, 1.2]))
    assert out["bpm"] == pytest.approx(72) and out["jump"] == 0.0 and out["consistency"] == pytest.approx(math.exp(-4))
    _, out = E.rate_history(state, row(2.0, [2.0, 2.0, 1.2]))
    assert out["bpm"] == pytest.approx(120) and out["jump"] == pytest.approx(48) and out["consistency"] == pytest.approx(math.exp(-4) / 2)
    # the double of 60 holds half of its energy
    state, out = E.rate_history({}, row(1.0, []) | {"band": [1.0, 0.0, 0.0, 0.5]})
    assert out["corrected"] and out["bpm"] == pytest.approx(120) and state["known"] == [1.0, 2.0]
    assert E.rate_history({}, row(0.0, []))[1]["bpm"] == 0.0


def test_estimates_of_sessions(spark):
    df = series(spark, {1: np.concatenate([wave(1.2, 600, 30), wave(1.6, 150, 30)]), 2: wave(1.0, 40, 30), 3: np.zeros(5)})
    got = {(r.session, r.seq): r for r in E.estimates(E.windows(df.repartition(3), 300, 150), 30.0).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (3, 0)]
    assert [round(got[1, w].bpm) for w in range(3)] == [72, 72, 72] and got[3, 0].bpm == 0.0


@pytest.mark.parametrize("n, size", [(300, 128), (129, 64), (40, 64), (65, 65)])
def test_welch_by_definition(n, size):
    x = np.random.default_rng(n).normal(size=n)
    hz, p = E.welch(x, 4.0, size)
    size = min(size, n)
    shape = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    total, parts = 0.0, 0
    for i in range(0, n - size + 1, size - size // 2):
        part = (x[i : i + size] - x[i : i + size].mean()) * shape
        total, parts = total + np.array([abs(sum(part * np.exp(-2j * np.pi * k * np.arange(size) / size))) ** 2 for k in range(size // 2 + 1)]), parts + 1
    want = total / parts / (4.0 * (shape**2).sum())
    want[1 : -1 if size % 2 == 0 else None] *= 2
    assert p == pytest.approx(want) and hz == pytest.approx(4.0 * np.arange(size // 2 + 1) / size)


def test_notch_follows_the_sessions_own_rate(spark):
    fps = 10.0
    x = wave(0.25, 900, fps) + wave(1.2, 900, fps)
    df = series(spark, {1: x, 2: wave(0.4, 9, fps)})
    rated = E.respiration(E.windows(df, 300, 150), fps)
    got = {(r.session, r.w): r for r in E.without_respiration(rated, fps).collect()}
    assert len(got) == 6 and got[2, 0].hz == 0.25 and got[2, 0].y == wave(0.4, 9, fps).tolist()  # too short for the filter
    for w in range(5):
        assert got[1, w].hz == pytest.approx(0.25, abs=0.08)
    # the median of the last rates is what counts
    steps = {1: np.concatenate([wave(0.15625, 600, fps), wave(0.3125, 300, fps)])}
    hz = [r.hz for r in E.respiration(E.windows(series(spark, steps), 300, 300), fps, last=3).orderBy("w").collect()]
    assert hz == pytest.approx([0.15625, 0.15625, 0.15625], abs=0.02)
    # what is left of breathing once its rate is known well
    y = filters.both_ways((wave(0.25, 600, fps) + wave(1.2, 600, fps))[None], *filters.notch_tf(0.25, fps, 12.0))[0]
    power = np.abs(np.fft.rfft(y[100:500])) ** 2
    assert power[10] < 0.05 * power[48]


def test_intervals_and_their_variability():
    fps = 30.0
    even = wave(1.0, 3000, fps, 0.1)
    got = E.variability(even, fps)
    assert got["n"] == 98 or got["n"] == 99
    assert got["sdnn"] == pytest.approx(0, abs=1e-9) and got["pnn50"] == 0.0 and got["lf_hf"] == 0.0
    beats = np.cumsum([0.8, 1.0] * 20)  # every second interval is longer by 200 ms
    x = np.sum([np.exp(-0.5 * ((np.arange(1200) / fps - t) / 0.08) ** 2) for t in beats], axis=0)
    got = E.variability(x, fps)
    assert got["sdnn"] == pytest.approx(100, rel=0.05) and got["rmssd"] == pytest.approx(200, rel=0.05) and got["pnn50"] == 100.0
    assert E.variability(np.zeros(100), fps) == {"n": 0, "sdnn": None, "rmssd": None, "pnn50": None, "lf_hf": None} and E.beats(np.zeros(0), fps).size == 0
    slow, fast = ([800 + 100 * math.sin(2 * math.pi * f * 0.8 * i) for i in range(150)] for f in (0.1, 0.3))
    assert E.lf_hf(np.array(slow)) > 5 > 0.5 > E.lf_hf(np.array(fast)) and E.lf_hf(np.array(slow[:19])) == 0.0


def test_blending_prefers_the_clear_signal():
    fps, r = 30.0, np.random.default_rng(1)
    clear = wave(1.2, 300, fps)[None]
    got = E.contrast(np.concatenate([clear, r.normal(size=(1, 300))]), fps)
    assert got[0] > 2 * got[1] and E.contrast(clear[:, :20], fps).tolist() == [0.0]
    g = 100 + wave(1.2, 300, fps)[None]
    signals = E.pulses(np.full((1, 300), 90.0), g, np.full((1, 300), 80.0))
    assert all(np.abs(np.corrcoef(s[0], wave(1.2, 300, fps))[0, 1]) > 0.99 for s in (signals["chrom"], signals["green"]))


def test_classical_rates_of_a_synthetic_pulse(spark):
    wins = E.windows(synthetic.pulse(spark, 2, 600), 300, 300, ("r", "g", "b"))
    for r in E.classical(wins, 30.0).collect():
        assert all(abs(x - 72) <= 15 for x in (r.green, r.chrom, r.pos, r.ica)), r
    assert all(abs(r.green - 72) <= 30 for r in E.classical(wins, 30.0, filtered=False).collect())  # C9: without the band-pass
    y = {m: {(r.session, r.seq): r.y for r in projections.project(synthetic.pulse(spark, 1, 310), m).collect()} for m in ("ICA", "ica", "GREEN")}
    assert len(y["ICA"]) == 310 and y["ICA"] == y["ica"] and y["ICA"] != y["GREEN"]


def test_ica_separates_mixed_sources():
    t = np.arange(600) / 30
    sources = np.stack([np.sin(2 * np.pi * 1.2 * t), np.sign(np.sin(2 * np.pi * 0.37 * t)), (t * 0.7) % 1 - 0.5])
    mixed = np.array([[0.6, 0.3, 0.5], [0.9, 0.4, 0.2], [0.2, 0.8, 0.5]]) @ sources
    found = filters.fast_ica(mixed.T)
    match = np.abs(np.corrcoef(found.T, sources)[:3, 3:])
    assert match.max(0) == pytest.approx(np.ones(3), abs=0.03)
    (y,) = E.independent(*(m[None] for m in mixed))
    assert abs(np.corrcoef(y, sources[0])[0, 1]) > 0.95  # the one whose spectrum has the highest peak
    assert E.independent(np.ones((1, 40)), np.arange(40.0)[None], np.ones((1, 40)))[0] == pytest.approx(np.arange(40) - 19.5)


def test_window_queries_use_all_windows(spark):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_suppkey").count().selectExpr("sum(if(count < 300, 1, (count - 300) div 150 + 1)) n").first().n
    for name in ("b8_arbitrated", "b9_classical_rates", "b6_independent_pulse", "c7_respiratory_notch", "g12_lf_hf"):
        got = plans.QUERIES[name](spark, SF)
        assert got.count() == n, name


def test_windows_are_worked_on_in_slices(spark):
    """A batch of many windows reaches the step a few at a time, in order and whole."""
    n = 2 * E.AT_ONCE + 3
    wins = spark.range(n, numPartitions=1).selectExpr("id AS session", "0L AS w", "array(double(id), 1.0D) AS x")
    got = E.by_window(wins, lambda x: [{"sum": float(r.sum()), "rows": len(x)} for r in x], "sum double, rows long").collect()
    assert [(r["session"], r["sum"]) for r in got] == [(i, i + 1.0) for i in range(n)]
    assert max(r["rows"] for r in got) <= E.AT_ONCE
