"""Rates from windows of a series (survey C7, D1, D2, D7, G12): peaks, segment votes, Welch spectra, intervals between beats.

windows() cuts series into overlapping windows of bounded length, one row with an array each, so no step holds a session;
what a session remembers from window to window (history of rates) is a fold over its windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import median

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import folds
from .filters import both_ways, butterworth, butterworth_tf, fast_ica, notch_tf, run_sections

#: The pulse band in Hz, the plausible rates a minute and the usable ones.
BAND, PLAUSIBLE, USABLE = (50 / 60, 3.0), (45.0, 130.0), (50.0, 180.0)
#: Windows that a task works on at once: a batch of Spark's has up to 10,000, whose arrays and lists of numbers would be several 100 MB.
AT_ONCE = 256


def parts(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `most` rows."""
    most = most or AT_ONCE
    for b in batches:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)


def windows(df: DataFrame, size: int, hop: int, values: tuple[str, ...] = ("x",), complete: bool = True, ends: bool = False) -> DataFrame:
    """(session, w, an array for each of values) of df (session, seq from 1 without gaps, values): windows of `size` samples every `hop`,
    if asked only complete ones and each session's first, however short it is; with `ends` also the session's last seq. A null value counts as 0.

    Samples are gathered once, in pieces of the greatest common divisor of size and hop; a window is a row of pieces.
    """
    step = math.gcd(size, hop)
    rows = df.select("session", F.struct("seq", *(F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values)).alias("row"), F.floor((F.col("seq") - 1) / step).alias("piece"))
    made = rows.groupBy("session", "piece").agg(F.sort_array(F.collect_list("row")).alias("rows"))  # `step` samples at most
    made = made.select("session", "piece", F.element_at("rows.seq", -1).alias("end"), *(F.col(f"rows.{v}").alias(v) for v in values))
    if size > step:
        over = Window.partitionBy("session").orderBy("piece").rangeBetween(0, size // step - 1)
        made = made.withColumns({v: F.flatten(F.collect_list(v).over(over)) for v in values})
    if ends:
        made = made.withColumn("end", F.max("end").over(Window.partitionBy("session")))
    made = made.where(F.col("piece") % (hop // step) == 0).withColumn("w", F.floor(F.col("piece") / (hop // step)))
    if complete:
        made = made.where((F.size(values[0]) == size) | (F.col("w") == 0))
    return made.select("session", "w", *values, *(["end"] if ends else []))


def by_window(wins: DataFrame, made: Callable[..., list[dict]], columns: str, values: tuple[str, ...] = ("x",)) -> DataFrame:
    """wins without its arrays `values`, with the columns that made() gives: it is called with a (windows, samples) array for each
    of values, of windows of one length, and returns a dict for each window."""
    more = StructType.fromDDL(columns)
    schema = StructType([*(f for f in wins.schema if f.name not in values), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for b in parts(batches):
            arrays = [b.column(v) for v in values]
            length = pc.list_value_length(arrays[0]).to_numpy(zero_copy_only=False)
            rows: list[dict] = [{}] * b.num_rows
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                stacks = [a.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), n) for a in arrays]
                for i, row in zip(own, made(*stacks), strict=True):
                    rows[i] = row
            kept = [b.column(n) for n in b.schema.names if n not in values]
            yield pa.RecordBatch.from_arrays([c.cast(kinds.field(i).type) for i, c in enumerate(kept)] + [pa.array([r[f.name] for r in rows], kinds.field(f.name).type) for f in more], schema=kinds)

    return wins.mapInArrow(run, schema)


def each(f: Callable[[np.ndarray], dict]) -> Callable[[np.ndarray], list[dict]]:
    """f, which takes one window, for by_window()."""
    return lambda x: [f(row) for row in x]


def peaks(x: np.ndarray, distance: int = 1, prominence: float | None = None) -> np.ndarray:
    """Places of local maxima (of a plateau its middle), none within less than `distance` of a higher one that stays (of equal ones
    the later), and rising by `prominence` at least over the higher of the lowest points towards the next higher value on each side."""
    found, i = [], 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
            found.append((i + j) // 2)
        i = j + 1
    kept: list[int] = []
    for k in sorted(found, key=lambda k: (x[k], k), reverse=True):
        if all(abs(k - other) >= distance for other in kept):
            kept.append(k)
    kept.sort()
    if prominence is not None:

        def rise(k: int) -> float:
            higher = np.flatnonzero(x > x[k])
            left, right = higher[higher < k], higher[higher > k]
            return x[k] - max(x[left[-1] if len(left) else 0 : k + 1].min(), x[k : (right[0] if len(right) else len(x)) + 1].min())

        kept = [k for k in kept if rise(k) >= prominence]
    return np.array(kept, int)


def one_peak(magnitude: np.ndarray, step: float, before: float | None = None) -> float | None:
    """The rate in Hz that a spectrum (bins of `step` Hz from 0) shows in the band, 0 if none is usable, None without a bin in it.

    Of the five highest peaks the one that scores best: magnitude, less outside 45..130 a minute, and with a rate before less
    when double of it, by distance, and beyond 25. A second peak of nearly the same magnitude that is clearly nearer to the rate
    before is taken, and peaks at its double or half give way to one near it; over 110 a peak at about half the rate is.
    """
    hz = np.arange(len(magnitude)) * step
    band = (hz >= BAND[0]) & (hz <= BAND[1])
    if not band.any():
        return None
    usable = lambda bpm: USABLE[0] <= bpm <= USABLE[1]
    top = sorted((k for k in peaks(magnitude, 3) if band[k]), key=lambda k: -magnitude[k])[:5]
    if not top:
        raw = float(hz[band][magnitude[band].argmax()])
        return raw if usable(raw * 60) else 0.0
    past = before is not None and before > 0
    scored = []
    for k in top:
        bpm = 60 * k * step  # in this order: whole rates are whole numbers, which limits on them need
        score = magnitude[k] * (1.0 if PLAUSIBLE[0] <= bpm <= PLAUSIBLE[1] else 0.1)
        if past:
            away = abs(bpm - before)
            score *= (0.2 if abs(bpm - 2 * before) < 5 else 1.0) * (0.4 + 0.6 * math.exp(-(away**2) / 450)) * (0.2 if away > 25 else 1.0)
        scored.append((score, magnitude[k], bpm, float(hz[k])))
    scored.sort(key=lambda s: -s[0])
    best, others = scored[0], scored[1:]
    near = lambda x, room: next((s for s in others if abs(s[2] - x) < room), None)
    if past:
        if others and others[0][1] > 0.85 * best[1] and abs(others[0][2] - before) < abs(best[2] - before) - 5:
            best = others[0]
        if best[2] > 110 and abs(best[2] - 2 * before) < 10:
            best = near(before, 10) or best
        elif best[2] < 75 and abs(best[2] - before / 2) < 8:
            best = near(before, 12) or best
    if best[2] > 110:
        best = next((s for s in others if abs(s[2] - best[2] / 2) < 8 and s[1] > 0.12 * best[1]), best)
    return next((s[3] for s in (best, *others) if usable(s[2])), 0.0)


def spectrum(x: np.ndarray) -> np.ndarray:
    """Magnitudes of a series shaped by a symmetric Hann window."""
    return np.abs(np.fft.rfft(x * np.hanning(len(x))))


def segment_vote(x: np.ndarray, fps: float, seconds: float = 10.0, room: float = 0.08) -> dict:
    """D1, the part without memory: a window's rate and the rates of its segments.

    Segments of 10 s (30 samples at least) overlap by half; each one's rate is a vote. Of two votes or more the median of the
    largest group within `room` Hz of one of them wins (of equal groups that of the earliest), else the whole window's peak.
    Under 30 samples there is no rate. `band` has the window's magnitudes in the pulse band, at `hz`.
    """
    n = len(x)
    if n < 30:
        return {"x": 0.0, "votes": [], "hz": [], "band": []}
    size = max(int(fps * seconds), 30)
    votes = [one_peak(spectrum(x[i : i + size]), fps / size) for i in range(0, n - size + 1, size // 2)] if n >= size else []
    votes = [v for v in votes if v is not None]
    whole = spectrum(x)
    if len(votes) >= 2:
        groups = [[v for v in votes if abs(v - hz) < room] for hz in votes]
        rate = median(max(groups, key=len))
    else:
        rate = one_peak(whole, fps / n) or 0.0
    hz = np.arange(len(whole)) * fps / n
    inside = (hz >= BAND[0]) & (hz <= BAND[1])
    return {"x": float(rate), "votes": votes, "hz": hz[inside].tolist(), "band": whole[inside].tolist()}


def rate_history(state: dict, row: dict) -> tuple[dict, dict]:
    """D1, the part with memory: the last twelve rates of a series (in Hz, x the new one).

    Consistency falls with the distance to their median, and by half beyond 15 a minute. A rate that leaves a steady history is
    taken back unless more segments vote for it than for the history. Then the half or double of the rate may be the right one
    (energy within 0.12 Hz); such a correction is remembered too. dominance is the highest magnitude within 0.1 Hz by the
    band's sum, sharp says that this peak is at most five bins wide at half its height.
    """
    rate, votes, known = row["x"], row["votes"], list(state.get("known", ()))
    consistency = 1.0
    if len(known) >= 5:
        mid = median(known)
        consistency = math.exp(-abs(rate - mid) / 0.20)
        if folds.pstdev(known) < 0.08 and abs(rate - mid) > 0.18 and len(votes) >= 2:
            for_it = lambda hz: sum(abs(v - hz) < 0.08 for v in votes)
            rate = mid if for_it(mid) >= for_it(rate) else rate
    jump = abs(rate - median(known)) * 60 if len(known) >= 3 else 0.0
    consistency *= 0.5 if jump > 15 else 1.0
    known = (known + [rate])[-12:]
    hz = row["hz"]
    energy = lambda f: sum(m for m, h in zip(row["band"], hz, strict=True) if f - 0.12 <= h <= f + 0.12)
    own, fixed = energy(rate) if rate > 0 else 0.0, rate
    if own >= 1e-12:
        if rate / 2 >= BAND[0] and energy(rate / 2) >= 0.30 * own:
            fixed = rate / 2
        elif rate < 1.25 and 2 * rate <= hz[-1] and energy(2 * rate) >= 0.40 * own:
            fixed = 2 * rate
    corrected = fixed != rate
    if corrected:
        known = (known + [fixed])[-12:]
    near = [i for i, h in enumerate(hz) if fixed - 0.10 <= h <= fixed + 0.10]
    dominance, sharp = 0.0, True
    if near:
        at = max(near, key=lambda i: (row["band"][i], -i))
        dominance = row["band"][at] / (sum(row["band"]) + 1e-9)
        over = lambda i: 0 <= i < len(hz) and row["band"][i] > row["band"][at] / 2
        low = high = at
        while over(low):
            low -= 1
        while over(high):
            high += 1
        sharp = high - low <= 5
    return {"known": known}, {"bpm": 60 * fixed, "consistency": consistency, "jump": jump, "corrected": corrected, "dominance": dominance, "sharp": sharp}


folds.FOLDS["rate_history"] = (rate_history, "bpm double, consistency double, jump double, corrected boolean, dominance double, sharp boolean")


def estimates(wins: DataFrame, fps: float) -> DataFrame:
    """(session, seq, bpm, consistency, jump, corrected, dominance, sharp) of windows(): seq is the window's number.

    A window under 30 samples has rate 0, one of a single value the band's first bin (no bin stands out).
    """
    voted = by_window(wins, each(lambda x: segment_vote(x, fps)), "x double, votes array<double>, hz array<double>, band array<double>")
    return folds.run(voted.withColumn("seq", F.col("w")).withColumn("t", F.col("w").cast("double")), "rate_history")


def welch(x: np.ndarray, fps: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hz and power density: the mean of segments of `size` samples that overlap by half, each without its mean, in a periodic Hann window."""
    size = min(size, len(x))
    shape = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size) if size > 1 else np.ones(1)
    parts = np.stack([x[i : i + size] for i in range(0, len(x) - size + 1, size - size // 2)])
    power = (np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * shape, axis=1)) ** 2).mean(0) / (fps * (shape**2).sum())
    power[1 : (len(power) - 1 if size % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(size, 1 / fps), power


def strongest(hz: np.ndarray, power: np.ndarray, low: float, high: float) -> float | None:
    band = np.flatnonzero((hz >= low) & (hz <= high))
    return float(hz[band[power[band].argmax()]]) if len(band) else None


def breathing(x: np.ndarray, fps: float) -> dict:
    """Power of 0.1 to 1.5 Hz by that of 0.83 to 3.0 (0 below 20 samples), and the strongest rate of the former in Hz (0 below 3 s or 30 samples)."""
    share = rate = 0.0
    if len(x) >= 20:
        hz, p = welch(x, fps, max(int(8 * fps), 64))
        low, high = (hz >= 0.10) & (hz <= 1.50), (hz >= 0.83) & (hz <= 3.00)
        share = float(p[low].sum() / (p[high].sum() + 1e-9)) if low.any() and high.any() else 0.0
    if len(x) >= max(30, int(3 * fps)):
        rate = strongest(*welch(x, fps, max(int(10 * fps), 64)), 0.10, 1.50) or 0.0
    return {"interference": share, "resp_hz": rate}


def respiration(wins: DataFrame, fps: float, last: int = 30) -> DataFrame:
    """(session, w, x, hz): each window's respiration rate, the median of its session's last `last` ones.

    A window's own rate is the strongest of a Welch spectrum (128 samples) between 0.1 and 0.5 Hz after a band-pass both ways. A
    window too short for the filter has none; before a session's first rate hz is 0.25.
    """

    def rate(x: np.ndarray) -> list[dict]:
        low, high = max(0.1, 1e-6), min(0.5, fps / 2 * (1 - 1e-6))
        y = both_ways(x, *butterworth_tf(3, low, high, fps)) if low < high else None
        return [{"own": None if y is None else strongest(*welch(y[i], fps, 128), 0.1, 0.5), "samples": row.tolist()} for i, row in enumerate(x)]

    w = Window.partitionBy("session").orderBy("w").rowsBetween(-(last - 1), 0)
    # of a window without a rate the median is that of the rates before, so rates alone are counted
    own = by_window(wins, rate, "own double, samples array<double>")
    rated = own.where("own IS NOT NULL").select("session", "w", F.percentile("own", 0.5).over(w).alias("known"))
    back = Window.partitionBy("session").orderBy("w")
    joined = own.join(rated, ["session", "w"], "left").withColumn("hz", F.coalesce(F.last("known", ignorenulls=True).over(back), F.lit(0.25)))
    return joined.select("session", "w", F.col("samples").alias("x"), "hz")


def without_respiration(rated: DataFrame, fps: float) -> DataFrame:
    """(session, w, hz, y array) of respiration(): the window without its session's respiration rate (Q 12) and, where that is in the pulse band, its double (Q 9.6), phases kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            out = []
            for x, hz in zip(b.column("x").to_pylist(), b.column("hz").to_pylist(), strict=True):
                y = np.asarray(x, float)
                for f, q in ((hz, 12.0), (2 * hz, 9.6)):
                    if (f == hz or BAND[0] <= f <= BAND[1]) and 0.01 < f / (fps / 2) < 0.99:
                        z = both_ways(y[None], *notch_tf(f, fps, q))
                        y = y if z is None else z[0]
                out.append(y.tolist())
            yield pa.RecordBatch.from_arrays([b.column("session"), b.column("w"), b.column("hz"), pa.array(out, pa.list_(pa.float64()))], ["session", "w", "hz", "y"])

    return rated.select("session", "w", "x", "hz").mapInArrow(run, f"session {dict(rated.dtypes)['session']}, w bigint, hz double, y array<double>")


def beats(x: np.ndarray, fps: float) -> np.ndarray:
    """Intervals in ms between peaks (0.35 s apart at least, rising by 0.25 deviations), those of 0.6 to 1.6 medians; none below three peaks."""
    if not len(x):
        return np.zeros(0)
    found = peaks((x - x.mean()) / (x.std() + 1e-9), max(1, int(0.35 * fps)), 0.25)
    if len(found) < 3:
        return np.zeros(0)
    ibi = np.diff(found) / fps * 1000.0
    mid = np.median(ibi)
    return ibi[(ibi > 0.6 * mid) & (ibi < 1.6 * mid)]


def lf_hf(ibi: np.ndarray, fps: float = 4.0) -> float:
    """Power of 0.04 to 0.15 Hz by that of 0.15 to 0.4 (sums by the trapezoid, bins one apart, T22) of the intervals at 4 a second; 0 below 20 intervals."""
    if len(ibi) < 20:
        return 0.0
    at = np.cumsum(ibi) / 1000.0
    even = np.interp(np.arange(at[0], at[-1], 1 / fps), at, ibi)
    hz, p = welch(even, fps, 64)
    area = lambda y: float(((y[1:] + y[:-1]) / 2).sum())
    low, high = area(p[(hz >= 0.04) & (hz < 0.15)]), area(p[(hz >= 0.15) & (hz < 0.4)])
    return 0.0 if high < 1e-9 else round(low / high, 3)


def variability(x: np.ndarray, fps: float) -> dict:
    """A window's number of intervals, their deviation (SDNN), that of steps (RMSSD), the share of steps over 50 ms in percent, and LF/HF; null below five intervals."""
    ibi = beats(x, fps)
    out = {"n": len(ibi), "sdnn": None, "rmssd": None, "pnn50": None, "lf_hf": None}
    if len(ibi) >= 5:
        step = np.diff(ibi)
        out |= {"sdnn": float(ibi.std()), "rmssd": float(np.sqrt((step**2).mean())), "pnn50": float((np.abs(step) > 50).mean() * 100), "lf_hf": lf_hf(ibi, 4.0)}
    return out


def pulses(r: np.ndarray, g: np.ndarray, b: np.ndarray, eps: float = 1e-6) -> dict[str, np.ndarray]:
    """CHROM, POS and green of windows, each channel by its window's mean."""
    mean, std = (lambda x: x.mean(1, keepdims=True)), (lambda x: x.std(1, keepdims=True) + eps)
    rn, gn, bn = (c / (mean(c) + eps) for c in (r, g, b))
    x, y, p, s = 3 * rn - 2 * gn, 1.5 * rn + gn - 1.5 * bn, gn - bn, gn + bn
    return {"chrom": x - std(x) / std(y) * y, "pos": p / std(p) - std(p) / std(s) * s / std(s), "green": gn - 1}


def contrast(x: np.ndarray, fps: float, low: float = 0.7, high: float = 3.0) -> np.ndarray:
    """Of windows, power within 0.08 Hz of the strongest rate in the band over that of its sidebands (0.09 to 0.4 Hz away), of the
    series without trend, band-passed both ways; 0 for windows too short for that."""
    n = x.shape[1]
    high = min(high, fps / 2 * (1 - 1e-6))
    t = np.arange(n) - (n - 1) / 2
    x = x - x.mean(1, keepdims=True)
    y = both_ways(x - (x @ t / max((t * t).sum(), 1e-12))[:, None] * t, *butterworth_tf(4, low, high, fps)) if low < high else x
    if y is None:
        return np.zeros(len(x))
    power, hz = np.abs(np.fft.rfft(y * np.hanning(n), axis=1)) ** 2, np.fft.rfftfreq(n, 1 / fps)
    band = np.flatnonzero((hz >= 0.7) & (hz <= 3.0))
    if not len(band):
        return np.zeros(len(x))
    apart = hz[None] - hz[band[power[:, band].argmax(1)]][:, None]
    near, side = (apart >= -0.08) & (apart <= 0.08), ((apart >= -0.4) & (apart < -0.09)) | ((apart > 0.09) & (apart <= 0.4))
    return (power * near).sum(1) / ((power * side).sum(1) + 1e-9)


def arbitrated(wins: DataFrame, fps: float) -> DataFrame:
    """(session, w, winner, y array) of windows() of (r, g, b): the signals of CHROM, POS and green by rank of their contrast,
    0.6, 0.3 and 0.1 of them (of equal ones the first named first)."""

    def blend(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> list[dict]:
        signals = pulses(r, g, b)
        names = list(signals)
        score = np.stack([contrast(signals[n], fps) for n in names])
        order = np.argsort(-score, axis=0, kind="stable")
        stack = np.stack([signals[n] for n in names])
        at = np.arange(len(r))
        y = sum(w * stack[order[k], at] for k, w in enumerate((0.6, 0.3, 0.1)))
        return [{"winner": names[order[0, i]], "y": y[i].tolist()} for i in at]

    return by_window(wins, blend, "winner string, y array<double>", ("r", "g", "b"))


def independent(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Of each window the independent component with the highest spectral peak; green less its mean for windows under 30
    samples or without three independent channels."""
    out = []
    for rows in np.stack([r, g, b], axis=2):
        y = rows[:, 1] - rows[:, 1].mean()
        if len(rows) >= 30 and np.linalg.matrix_rank(rows - rows.mean(0)) == 3:
            found = fast_ica(rows)
            y = found[:, (np.abs(np.fft.rfft(found, axis=0)[1:]) ** 2).max(0).argmax()]
        out.append(y)
    return out


def independent_pulse(df: DataFrame, size: int = 300) -> DataFrame:
    """(session, seq, y) of df (session, seq from 1 without gaps, r, g, b), found anew for every `size` samples."""
    channels = ("r", "g", "b")
    found = by_window(windows(df, size, size, channels, complete=False), lambda *x: [{"y": y.tolist()} for y in independent(*x)], "y array<double>", channels)
    return found.select("session", "w", F.posexplode("y").alias("i", "y")).select("session", (F.col("w") * size + F.col("i") + 1).cast(dict(df.dtypes)["seq"]).alias("seq"), "y")


def filtered_rate(y: np.ndarray, fps: float, filtered: bool = True) -> float:
    """The rate a minute of a series less its mean, with or without the band-pass; 0 below 30 samples."""
    if len(y) < 30:
        return 0.0
    y = y - y.mean()
    return 60 * (one_peak(spectrum(run_sections(y, butterworth(4, *BAND, fps)) if filtered else y), fps / len(y)) or 0.0)


def classical(wins: DataFrame, fps: float, filtered: bool = True) -> DataFrame:
    """(session, w, green, chrom, pos, ica) of windows() of (r, g, b): the rate a minute that each method's signal shows,
    with or without the band-pass (C2)."""
    rate = lambda y: filtered_rate(y, fps, filtered)

    def made(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> list[dict]:
        signals = pulses(r, g, b)
        return [{**{k: rate(signals[k][i]) for k in ("green", "chrom", "pos")}, "ica": rate(y)} for i, y in enumerate(independent(r, g, b))]

    return by_window(wins, made, "green double, chrom double, pos double, ica double", ("r", "g", "b"))


def window_rates(df: DataFrame, fps: float, seconds: float = 10.0, hop: float = 1.0, band: tuple[float, float] = (0.5, 4.0), keep: tuple[float, float] = (40.0, 180.0), last: bool = False, centre: bool = True) -> DataFrame:
    """(session, t, bpm) of df (session, seq from 1, x): the strongest rate in the band of each complete window, of those kept.

    t is the window's centre or start in seconds. Without `last` the window that ends with the session's last sample is left
    out, as in the reference's benchmark mode; its laboratory mode is hop 5, last, start.
    """
    size, step = int(fps * seconds), int(fps * hop)
    wins = windows(df, size, step, ends=True).where(F.size("x") == size)
    if not last:
        wins = wins.where(F.col("w") * step + size < F.col("end"))

    def rate(x: np.ndarray) -> list[dict]:
        hz = np.arange(size // 2 + 1) * fps / size
        inside = np.flatnonzero((hz >= band[0]) & (hz <= band[1]))
        power = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * np.hanning(size), axis=1))
        return [{"bpm": 60 * float(hz[inside[i]])} for i in power[:, inside].argmax(1)] if len(inside) else [{"bpm": None}] * len(x)

    t = (F.col("w") * step + (size // 2 if centre else 0)) / F.lit(fps)
    return by_window(wins.drop("end"), rate, "bpm double").where(F.col("bpm").between(*keep)).select("session", t.alias("t"), "bpm")
