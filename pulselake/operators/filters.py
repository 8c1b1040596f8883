"""Recursive filters (survey C2, C7, B8): as a scan over blocks for sessions of any length, both ways on windows; ICA."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def butterworth(order: int, low: float, high: float, fps: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of a Butterworth band-pass, from its analog poles by the bilinear transform."""
    warp = lambda f: 2 * fps * math.tan(math.pi * f / fps)
    a, b = warp(low), warp(high)
    width, centre = b - a, math.sqrt(a * b)
    poles = []
    for k in range(order):
        p = np.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) * width / 2
        root = np.sqrt(p * p - centre * centre)
        poles += [p + root, p - root]
    z = [(2 * fps + p) / (2 * fps - p) for p in poles]
    gain = np.prod([width for _ in range(order)]) * (2 * fps) ** order / np.prod([2 * fps - p for p in poles]).real
    upper = sorted((p for p in z if p.imag > 1e-12), key=lambda p: abs(p))
    real = sorted(p.real for p in z if abs(p.imag) <= 1e-12)
    quads = [np.array([1.0, -2 * p.real, abs(p) ** 2]) for p in upper] + [np.array([1.0, -(x + y), x * y]) for x, y in zip(real[::2], real[1::2], strict=True)]
    each = abs(gain) ** (1 / len(quads))
    return [(each * np.array([1.0, 0.0, -1.0]), q) for q in quads]


def butterworth_tf(order: int, low: float, high: float, fps: float) -> tuple[np.ndarray, np.ndarray]:
    """The same filter as one pair of polynomials (b, a)."""
    b, a = np.ones(1), np.ones(1)
    for x, y in butterworth(order, low, high, fps):
        b, a = np.convolve(b, x), np.convolve(a, y)
    return b, a


def notch_tf(hz: float, fps: float, q: float) -> tuple[np.ndarray, np.ndarray]:
    """A second-order notch at hz, hz / q wide at half power."""
    w = 2 * math.pi * hz / fps
    beta = math.tan(w / q / 2)
    gain = 1 / (1 + beta)
    return gain * np.array([1, -2 * math.cos(w), 1]), np.array([1, -2 * gain * math.cos(w), 2 * gain - 1])


def _filtered(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The causal filter of each row of x, begun as if it had had its first value for ever."""
    level = b.sum() / a.sum()
    state, out = np.cumsum((b[1:] - a[1:] * level)[::-1])[::-1] * x[:, :1], np.empty_like(x)
    for i in range(x.shape[1]):
        v = x[:, i]
        out[:, i] = y = b[0] * v + state[:, 0]
        state[:, :-1] = state[:, 1:] + v[:, None] * b[1:-1] - y[:, None] * a[1:-1]
        state[:, -1] = b[-1] * v - a[-1] * y
    return out


def both_ways(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray | None:
    """The filter of each row of x forwards and backwards, so that phases stay; rows are continued at both ends by their mirror image
    through the end point (three times the filter's length). None where they are too short for that."""
    n = 3 * len(a)
    if x.shape[1] <= n:
        return None
    wide = np.concatenate((2 * x[:, :1] - x[:, n:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -n - 2 : -1]), axis=1)
    return _filtered(_filtered(wide, b, a)[:, ::-1], b, a)[:, ::-1][:, n:-n]


def run_sections(x: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]], state: np.ndarray | None = None) -> np.ndarray:
    """The causal filter, section after section, from a state of two numbers a section (0 if none), which is left as it is after x."""
    y = np.asarray(x, float)
    for k, (b, a) in enumerate(sections):
        s, t = (0.0, 0.0) if state is None else state[2 * k : 2 * k + 2]
        out = np.empty_like(y)
        for i, v in enumerate(y):
            o = b[0] * v + s
            s, t = b[1] * v - a[1] * o + t, b[2] * v - a[2] * o
            out[i] = o
        if state is not None:
            state[2 * k : 2 * k + 2] = s, t
        y = out
    return y


#: Samples of a block; a session spans as many tasks as it has blocks.
BLOCK = 4096


def one_step(sections: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The matrix that takes the cascade's state to that after one sample of 0."""
    n = 2 * len(sections)
    out = np.eye(n)
    for column in range(n):
        state = out[:, column].copy()
        run_sections(np.zeros(1), sections, state)
        out[:, column] = state
    return out


def bandpass(df: DataFrame, fps: float, low: float = 0.833, high: float = 3.0, order: int = 4, block: int = BLOCK) -> DataFrame:
    """(session, seq, y) of df (session, seq from 1, x), sessions of any length.

    The filter is linear, so a block's end is its end from rest plus a power of one matrix times its beginning. Blocks are run from
    rest side by side; a fold over each session's blocks, a few numbers each, gives their beginnings; blocks are then run from these.
    A null x counts as 0.
    """
    sections = butterworth(order, low, high, fps)
    step = one_step(sections)
    types = dict(df.dtypes)
    rows = df.select("session", F.floor((F.col("seq") - 1) / block).cast("bigint").alias("block"), F.struct("seq", F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x")).alias("row"))
    blocks = rows.groupBy("session", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"))  # `block` samples at most
    blocks = blocks.select("session", "block", F.col("rows.seq").alias("seq"), F.col("rows.x").alias("x"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("x").to_pylist():
                run_sections(np.array(x), sections, state := np.zeros(len(step)))
                out.append(state.tolist())
            yield pa.RecordBatch.from_arrays([b.column("session"), b.column("block"), pc.list_value_length(b.column("x")).cast(pa.int64()), pa.array(out, pa.list_(pa.float64()))], ["session", "block", "n", "gain"])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, state = object(), np.zeros(len(step))
        for b in batches:
            out = []
            for s, n, gain in zip(*(b.column(c).to_pylist() for c in ("session", "n", "gain")), strict=True):
                if s != session:
                    session, state = s, np.zeros(len(step))
                out.append(state.tolist())
                state = np.linalg.matrix_power(step, n) @ state + np.array(gain)
            yield pa.RecordBatch.from_arrays([b.column("session"), b.column("block"), pa.array(out, pa.list_(pa.float64()))], ["session", "block", "state"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [run_sections(np.array(x), sections, np.array(s)).tolist() for x, s in zip(b.column("x").to_pylist(), b.column("state").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("session"), b.column("seq"), pa.array(out, pa.list_(pa.float64()))], ["session", "seq", "y"])

    key = f"session {types['session']}, block bigint"
    ended = blocks.select("session", "block", "x").mapInArrow(ends, f"{key}, n bigint, gain array<double>")
    begun = ended.repartition("session").sortWithinPartitions("session", "block").mapInArrow(begin, f"{key}, state array<double>")
    filled = blocks.join(begun, ["session", "block"]).select("session", "seq", "x", "state").mapInArrow(fill, f"session {types['session']}, seq array<{types['seq']}>, y array<double>")
    return filled.select("session", F.explode(F.arrays_zip("seq", "y")).alias("p")).select("session", F.col("p.seq").alias("seq"), F.col("p.y").alias("y"))


def fast_ica(x: np.ndarray, rounds: int = 200, seed: int = 42) -> np.ndarray:
    """Independent components of (samples, channels) by symmetric FastICA with tanh, from a fixed start."""
    x = x - x.mean(0)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    white = x @ (vectors / np.sqrt(np.maximum(values, 1e-12)))
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1],) * 2))[0]
    for _ in range(rounds):
        g = np.tanh(white @ w.T)
        new = g.T @ white / len(x) - np.diag((1 - g * g).mean(0)) @ w
        u, _, v = np.linalg.svd(new)
        new = u @ v
        done = np.max(np.abs(np.abs((new * w).sum(1)) - 1)) < 1e-6
        w = new
        if done:
            break
    return white @ w.T
