"""State machines over ordered samples: one step function each, driven in batch (mapInArrow over sorted rows) and in streams.

A step takes (state, row) and returns (state, output); inputs that a row doesn't have are None. Batch and stream agree because
they run the same steps. A key's rows are read in order and only its state is kept, so memory doesn't grow with their number.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from statistics import median
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

Step = Callable[[dict[str, Any], dict[str, Any]], tuple[dict[str, Any], dict[str, Any]]]


def pstdev(values: list[float]) -> float:
    mean = sum(values) / len(values)
    return math.sqrt(sum([(v - mean) ** 2 for v in values]) / len(values))


def kalman(state: dict, row: dict, q: tuple[float, float] = (1.0, 0.01), r: float = 25.0, floor: float = 4.0) -> tuple[dict, dict]:
    """Constant velocity; the measurement's variance falls from r to floor with quality 0..100 (null or 0: 50); clipped to 42..200."""
    z = row["x"]
    if "x" not in state:
        return {"x": z, "v": 0.0, "a": 100.0, "b": 0.0, "c": 1.0}, {"y": z}
    trust = min(1.0, max(0.0, (row.get("sqi") or 50.0) / 100.0))
    noise = floor + (r - floor) * (1 - trust)
    x, v = state["x"] + state["v"], state["v"]
    a, b, c = state["a"] + 2 * state["b"] + state["c"] + q[0], state["b"] + state["c"], state["c"] + q[1]
    gain, lead = a / (a + noise), b / (a + noise)
    miss = z - x
    x = min(200.0, max(42.0, x + gain * miss))
    return {"x": x, "v": v + lead * miss, "a": (1 - gain) * a, "b": (1 - gain) * b, "c": c - lead * b}, {"y": x}


def uncertain_rate(state: dict, row: dict, q: tuple[float, float] = (1.0, 0.01), r: float = 25.0, floor: float = 4.0, warm_up: int = 15) -> tuple[dict, dict]:
    """The filter with a variance that disagreement raises; measurement and model deviation, interval, confidence.

    Frames without a measurement (x <= 0) leave the state. Confidence is quality times agreement squared, less with a
    wider interval, and grows over the first frames.
    """
    sqi, agree = row.get("sqi") or 0.0, 1.0 if row.get("agreement") is None else row["agreement"]
    s = dict(state) or {"x": 75.0, "v": 0.0, "a": 100.0, "b": 0.0, "c": 1.0, "n": 0}
    noise = (floor + (r - floor) * (1 - min(1.0, max(0.0, sqi / 100)))) * max(1.0, 1 / (agree + 0.1))
    if row["x"] > 0:
        x = (row["x"] if not s["n"] else s["x"]) + s["v"]
        a, b, c = s["a"] + 2 * s["b"] + s["c"] + q[0], s["b"] + s["c"], s["c"] + q[1]
        gain, lead = a / (a + noise), b / (a + noise)
        miss = row["x"] - x
        s = {"x": min(200.0, max(42.0, x + gain * miss)), "v": s["v"] + lead * miss, "a": (1 - gain) * a, "b": (1 - gain) * b, "c": c - lead * b, "n": s["n"] + 1}
    epistemic, aleatoric = math.sqrt(max(s["a"], 0.01)), math.sqrt(noise)
    low, high = max(42.0, s["x"] - 1.96 * epistemic), min(200.0, s["x"] + 1.96 * epistemic)
    confidence = sqi / 100 * agree**2 * math.exp(-(high - low) / 15) * min(1.0, s["n"] / warm_up)
    return s, {"y": s["x"], "aleatoric": aleatoric, "epistemic": epistemic, "low": low, "high": high, "confidence": confidence}


def smoother(state: dict, row: dict, jump: float = 12.0, window: int = 17, lock: tuple[int, int, float] = (200, 240, 3.5)) -> tuple[dict, dict]:
    """Inertia, plausibility, jump test, median, slow mean, the filter of G3, and a lock on steady output.

    A value is pulled to the one before (0.3 of the new), and a move of more than 10 that is left is cut to a tenth. If it is
    more than 8 from one of the last three (itself included; none before there are three) it is pulled to the slow mean. One that still moves by more than
    `jump` (2.5 times that until `window` values are known) counts for the median only. Values of 0 or less change nothing.
    """
    x, last, mean = row["x"], state.get("last"), state.get("mean")
    (known, recent, steady), locked = (list(state.get(k, ())) for k in ("known", "recent", "steady")), state.get("locked", False)
    held = {"y": mean or 0.0, "locked": locked}
    if x <= 0:
        return state, held
    if last is not None:
        x = 0.3 * x + 0.7 * last
        if abs(x - last) > 10:
            x = 0.1 * x + 0.9 * last
    recent = (recent + [x])[-12:]
    state = {**state, "recent": recent}
    if len(recent) >= 3 and any(abs(x - r) > 8 for r in recent[-3:]):
        if not mean:
            return state, held
        recent[-1] = x = 0.2 * x + 0.8 * mean
    room = jump if len(known) >= window else 2.5 * jump
    state["known"] = known = (known + [x])[-window:]
    if last is not None and abs(x - last) > room:
        return state, held
    middle = median(known)
    mean = middle if mean is None else 0.25 * middle + 0.75 * mean
    inner, out = kalman(state.get("inner", {}), {"x": mean}, (0.5, 0.005), 20.0)
    steady = (steady + [out["y"]])[-lock[1] :]
    if len(steady) >= lock[0] and len(known) >= window:
        locked = pstdev(steady) <= lock[2]
    return {**state, "last": x, "mean": mean, "inner": inner, "steady": steady, "locked": locked}, {"y": out["y"], "locked": locked}


_GRID = np.arange(40, 200.5, 0.5)
_SPREAD = np.exp(-0.5 * (0.5 * np.arange(-20, 21)) ** 2)


def bayes(state: dict, row: dict) -> tuple[dict, dict]:
    """A belief over 40..200 in steps of 0.5; each frame multiplies a Gaussian likelihood and then spreads by one unit."""
    prior = np.array(state["p"]) if "p" in state else np.full(len(_GRID), 1 / len(_GRID))
    post = prior
    if row["x"] > 0:
        sigma = 10 * (1 - min(1.0, max(0.0, (row.get("sqi") or 0.0) / 100))) + 1.5
        off = -0.5 * ((_GRID - row["x"]) / sigma) ** 2
        post = (prior + 1e-30) * np.exp(off - off.max())  # so that a measurement beyond the grid doesn't vanish
        post /= post.sum()
    wide = np.convolve(post, _SPREAD, "same")
    mean = float(post @ _GRID)
    return {"p": (wide / wide.sum()).tolist()}, {"y": mean, "sd": float(np.sqrt(max(0.0, post @ (_GRID - mean) ** 2))), "top": float(_GRID[post.argmax()])}


def motion(state: dict, row: dict, enter: float = 2.5, leave: float = 1.5, grace: int = 20) -> tuple[dict, dict]:
    """Fast mean less 0.6 of the slow one, both from 0. Above `enter` movement begins; below `leave` it uses up its frames of grace, then ends."""
    fast, slow = 0.5 * row["x"] + 0.5 * state.get("fast", 0.0), 0.04 * row["x"] + 0.96 * state.get("slow", 0.0)
    score = round(max(0.0, fast - 0.6 * slow), 3)
    on, left = state.get("on", False), state.get("left", 0)
    if score > enter:
        on, left = True, grace
    elif score < leave:
        on, left = on and left > 0, max(0, left - 1)
    return {"fast": fast, "slow": slow, "on": on, "left": left}, {"score": score, "moving": on}


def physio_state(state: dict, row: dict) -> tuple[dict, dict]:
    """Resting, active, panting by the median of 15 respiration rates in Hz, with hysteresis."""
    recent = (list(state.get("recent", ())) + [row["x"]])[-15:]
    m, now = median(recent), state.get("now", "RESTING")
    if now == "RESTING":
        now = "PANTING" if m > 0.85 else "ACTIVE" if m > 0.35 else now
    elif now == "ACTIVE":
        now = "PANTING" if m > 0.85 else "RESTING" if m < 0.28 else now
    else:
        now = now if m >= 0.70 else "ACTIVE" if m >= 0.28 else "RESTING"
    return {"recent": recent, "now": now}, {"state": now, "median": m}


def sustained_arrhythmia(state: dict, row: dict, beats: int = 30, pause: float = 45.0, short_pause: float = 30.0) -> tuple[dict, dict]:
    """X is an interval in ms; the last `beats` intervals are looked at, with the rate bpm (without it, that of their median).

    Nothing is looked at below a quality of 70, with under ten intervals, or while an alarm rests (event time). The share of odd
    runs of five is a vote; where three of the last five votes pass 0.4, two kinds of oddity raise the alarm, or an extreme rate does.
    """
    ibi = (list(state.get("ibi", ())) + [row["x"]])[-beats:]
    state = {**state, "ibi": ibi}
    calm = {"alarm": False, "kinds": ""}
    sqi = row.get("sqi")
    if (sqi is not None and sqi < 70) or len(ibi) < 10 or row["t"] < state.get("until", -math.inf):
        return state, calm
    spread = lambda v: pstdev(v) / (sum(v) / len(v) + 1e-9)
    steps = lambda v: [abs(p - q) for p, q in zip(v, v[1:], strict=False)]
    runs = [ibi[i : i + 5] for i in range(len(ibi) - 4)]
    state["votes"] = votes = (list(state.get("votes", ())) + [sum(spread(r) > 0.28 or max(steps(r)) > 180 for r in runs) / len(runs)])[-10:]
    if sum(v > 0.4 for v in votes[-5:]) < 3:
        return state, calm
    beat = 60000 / (median(ibi) + 1e-9)
    bpm = beat if row.get("bpm") is None else row["bpm"]
    kinds = ["HRV_HIGH"] * (spread(ibi) > 0.3) + ["RR_JUMP"] * (sum(d > 180 for d in steps(ibi)) >= 3)
    kinds += ["BRADY"] if bpm < 45 and beat < 48 else ["TACHY"] if bpm > 150 and beat > 148 else []
    if len(kinds) >= 2:
        return {**state, "until": row["t"] + pause}, {"alarm": True, "kinds": "|".join(kinds)}
    if bpm < 38 or bpm > 175:
        return {**state, "until": row["t"] + short_pause}, {"alarm": True, "kinds": "|".join(kinds) or "EXTREME"}
    return state, calm


def baseline(state: dict, row: dict, gate: float = 35.0) -> tuple[dict, dict]:
    """A slow mean (from 72) and mean deviation (from 8, at least 1.5) of the rate, learned at 0.12 for 30 values, then 0.04.

    Values of a quality below `gate` or of 0 or less aren't learned. Labels after 20 learned values, by the value's distance.
    """
    x, n, mean, off = row["x"], state.get("n", 0), state.get("mean", 72.0), state.get("off", 8.0)
    if x > 0 and (row.get("sqi") is None or row["sqi"] >= gate):
        a = 0.12 if n < 30 else 0.04
        off = max(1.5, (1 - a) * off + a * abs(x - mean))
        mean, n = (1 - a) * mean + a * x, n + 1
    z = (x - mean) / off if n >= 20 and x > 0 else None
    label = None if z is None else "HIGH" if z > 2 else "LOW" if z < -2 else "ELEVATED" if z > 1 else "SUPPRESSED" if z < -1 else "NORMAL"
    return {"n": n, "mean": mean, "off": off}, {"z": z, "label": label, "mean": mean, "deviation": off}


def reliability(state: dict, row: dict, warm_up: int = 15, patience: int = 5, recovery: int = 3, timeout: int = 30) -> tuple[dict, dict]:
    """WARMUP, STABLE, DEGRADING, UNCERTAIN, RECOVERING, INVALID by confidence x (0..100) and evidence (0..1, by default x / 100).

    Counters begin anew with each change of state: frames in it, frames of decline, frames of recovery.
    """
    c = row["x"]
    evidence = c / 100 if row.get("evidence") is None else row["evidence"]
    now, frames, low, up = (state.get(k, d) for k, d in (("now", "WARMUP"), ("frames", 0), ("low", 0), ("up", 0)))
    recent = (list(state.get("recent", ())) + [evidence])[-10:]
    after = now
    if now == "WARMUP":
        after = "STABLE" if frames >= warm_up and c >= 60 else "UNCERTAIN" if frames >= 2 * warm_up else now
    elif now == "STABLE":
        low = low + 1 if c < 40 else 0
        after = "DEGRADING" if low >= patience else now
    elif now == "DEGRADING":
        after = "STABLE" if c >= 60 else "UNCERTAIN" if low >= 2 * patience else now
        low += after == now
    elif now == "UNCERTAIN":
        after = "INVALID" if c < 20 else "STABLE" if c >= 60 else "RECOVERING" if c >= 40 and up >= recovery else now
        up += after == now and evidence > 0.6 and c > 40
    elif now == "RECOVERING":
        after = "STABLE" if c >= 60 else "DEGRADING" if c < 40 else "UNCERTAIN" if up >= 2 * recovery else now
        up += after == now
    else:
        after = "RECOVERING" if evidence > 0.5 and c > 40 else "UNCERTAIN" if frames >= timeout else now
    if after != now:
        frames = low = up = 0
    tail = recent[-5:]
    mid, avg = (len(tail) - 1) / 2, sum(tail) / len(tail)
    slope = sum((i - mid) * (v - avg) for i, v in enumerate(tail)) / sum((i - mid) ** 2 for i in range(len(tail))) if len(tail) >= 3 else 0.0
    return {"now": after, "frames": frames + 1, "low": low, "up": up, "recent": recent}, {"state": after, "trend": max(-1.0, min(1.0, 10 * slope))}


def candidate_life(state: dict, row: dict, window: int = 10, born: float = 0.5, fade: float = 0.25, patience: int = 5, lost_after: int = 5) -> tuple[dict, dict]:
    """A candidate's life by the frames (t) that show it: BORN, ALIVE, DEGRADING, EXPIRED, RECOVERED.

    Persistence: the mean score x times its evenness (0.3 over its variation, at most 1) times the mean stability (by default
    0.5), in 0..1. DEGRADING for `patience` frames expires, an expired one that persists again has recovered. A frame from number
    `lost_after` on that doesn't show the candidate ends it, as in the reference: the next one begins anew.
    """
    frame = row["t"]
    if "frame" in state and frame - state["frame"] > 1 and frame > lost_after:
        state = {}
    scores, steady = ((list(state.get(k, ())) + [v])[-window:] for k, v in (("scores", row["x"]), ("steady", 0.5 if row.get("stability") is None else row["stability"])))
    mean = sum(scores) / len(scores)
    even = min(1.0, 0.3 / (pstdev(scores) / (abs(mean) + 1e-9) + 1e-9)) if len(scores) > 1 else 1.0
    persistence = max(0.0, min(1.0, mean * even * sum(steady) / len(steady)))
    now, frames = state.get("now"), state.get("frames", 0) + 1
    if now is None:
        now, frames = "ALIVE" if persistence > born else "BORN", 0
    elif now == "EXPIRED":
        now = "RECOVERED" if persistence > fade else now
    elif now == "DEGRADING":
        if persistence > fade:
            now, frames = "ALIVE", 0
        elif frames >= patience:
            now = "EXPIRED"
    elif persistence < fade:
        now, frames = "DEGRADING", 0
    else:
        now = "ALIVE"
    return {"frame": frame, "scores": scores, "steady": steady, "now": now, "frames": frames}, {"life": now, "persistence": persistence}


def session_confidence(state: dict, row: dict, window: int = 180) -> tuple[dict, dict]:
    """A session's confidence (0..100) from quality, agreement, steadiness and stillness of the last `window` frames, slowly followed.

    Frames in motion count as motion only; the others add their quality (30 and more), rate x (above 0) and agreement. A single
    region costs 0.15; a hard reject lowers the confidence by 0.15. Under ten frames of quality it is 0.
    """
    moving = bool(row.get("moving"))
    s = {k: list(state.get(k, ())) for k in ("sqi", "bpm", "agree", "moved")} | {"ema": state.get("ema", 0.0)}
    s["moved"] = (s["moved"] + [float(moving)])[-window:]
    if not moving and (row.get("sqi") or 0.0) >= 30:
        s["sqi"] = (s["sqi"] + [row["sqi"]])[-window:]
        s["bpm"] = (s["bpm"] + [row["x"]] * (row["x"] > 0))[-window:]
        s["agree"] = (s["agree"] + [1.0 if row.get("agreement") is None else row["agreement"]])[-window:]
    if len(s["sqi"]) < 10:
        return s, {"confidence": 0.0, "label": "POOR"}
    mean = lambda v: sum(v) / len(v)
    agree = mean(s["agree"])
    steady = math.exp(-pstdev(s["bpm"]) / 10) if len(s["bpm"]) >= 5 else 0.5
    whole = 0.4 * mean(s["sqi"]) / 100 + 0.3 * agree + 0.2 * steady + 0.1 * (1 - mean(s["moved"]))
    whole = max(0.0, min(100.0, 100 * whole * max(0.4, agree) * (1.0 if row.get("regions") is None or row["regions"] >= 2 else 0.85)))
    s["ema"] = (0.25 * whole + 0.75 * s["ema"] if s["ema"] else whole) * (0.85 if row.get("hard") else 1.0)
    return s, {"confidence": s["ema"], "label": "GOOD" if s["ema"] >= 75 else "FAIR" if s["ema"] >= 45 else "POOR"}


def region_trust(state: dict, prior: float = 2.0) -> float:
    """The weight of G19 before the next frame."""
    a, b = prior + state.get("up", 0.0), prior + state.get("down", 0.0)
    return a / (a + b)


def region_weight(state: dict, row: dict, prior: float = 2.0, keep: float = 0.999) -> tuple[dict, dict]:
    """A region's weight: the mean of a Beta belief that it succeeds, which fades towards its prior, and its deviation.

    A frame's success is quality times agreement of its rate x with the fused rate (exp(-distance / 12), less for half or double
    rates and for rates over 130) times plausibility. Frames without rate or quality change nothing.
    """
    up, down = state.get("up", 0.0), state.get("down", 0.0)
    x, sqi, fused = row["x"], row.get("sqi") or 0.0, row.get("fused") or 0.0
    if x > 0 and sqi > 0:
        agree = math.exp(-abs(x - fused) / 12)
        if fused > 0:
            agree *= 0.4 if 0.45 < x / fused < 0.55 else 0.3 if 1.8 < x / fused < 2.2 else 1.0
        agree *= 0.15 if x > 145 else 0.3 if x > 135 else 0.5 if x > 130 else 1.0
        if x > 130:
            agree *= (0.5 if sqi < 80 else 1.0) * (0.15 if row.get("forehead") else 1.0)
        good = sqi / 100 * agree
        up, down = keep * (up + good), keep * (down + 1 - good)
    a, b = prior + up, prior + down
    return {"up": up, "down": down}, {"weight": a / (a + b), "deviation": math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1) + 1e-9))}


def posterior_quality(state: dict, row: dict) -> tuple[dict, dict]:
    """Quality (0..100) from a sum of log odds: SNR in dB, concentration, regularity (mean of the last eight), and priors.

    Priors: motion, exposure drift, the rate x, the peak's ratio to the next, and the move from the frame before. The result is
    blended with the one before (0.35 of the new) unless the rate's prior is below -4.
    """
    x, of = row["x"], lambda k, d: d if row.get(k) is None else row[k]
    regular = (list(state.get("regular", ())) + [of("regularity", 0.5)])[-8:]
    moved = of("motion", 0.0)
    bio = -8.0 if x > 145 else -5.0 if x > 135 else -3.0 if x > 130 else -2.0 if x > 115 and moved < 1 else 0.0
    ratio = of("peak_ratio", 2.0)
    jump = abs(x - state["x"]) if "x" in state else 0.0
    odds = 1.5 * (of("snr_db", 6.0) - 6) / 4 + 0.8 * (of("concentration", 0.3) - 0.3) / 0.2 + 0.5 * (sum(regular) / len(regular) - 0.5) / 0.3
    odds += math.log(math.exp(-moved / 3) + 1e-9) + math.log(math.exp(-max(0.0, of("drift", 0.0) - 8) / 5) + 1e-9) + bio
    odds += (-5.0 if ratio < 1.3 else -1.5 if ratio < 1.8 else 0.0) + (-6.0 if jump > 30 else -4.0 if jump > 20 else -2.5 if jump > 12 else 0.0)
    p = 1 / (1 + math.exp(-odds))
    if "sqi" in state and bio >= -4:
        p = 0.35 * p + 0.65 * state["sqi"] / 100
    sqi = max(0.0, min(100.0, 100 * p))
    return {"x": x, "regular": regular, "sqi": round(sqi, 1)}, {"sqi": round(sqi, 1), "log_odds": odds}


def region_state(state: dict, row: dict, floor: float = 30.0, streak: int = 90, rest: int = 45) -> tuple[dict, dict]:
    """Frames of a quality below `floor` count up by one, others down by two; at `streak` the region is left out until `rest` frames later."""
    bad, out = state.get("bad", 0), state.get("out", 0)
    if out > 0:
        return {"bad": bad, "out": out - 1}, {"bad": bad, "excluded": True}
    bad = bad + 1 if (row.get("sqi") or 0.0) < floor else max(0, bad - 2)
    if bad >= streak:
        return {"bad": 0, "out": rest - 1}, {"bad": 0, "excluded": False}
    return {"bad": bad, "out": 0}, {"bad": bad, "excluded": False}


def holdover(state: dict, row: dict, seconds: float = 5.0, grace: int = 20) -> tuple[dict, dict]:
    """The rate on show. In motion the last good one for `seconds`, then what is shown; from the end of motion on it stays for
    `grace` frames; then each rate x above 0 is shown and good, and without one the last good one for `seconds`."""
    n, clear, good, at, shown = state.get("n", 0) + 1, state.get("clear", -1), state.get("good", 0.0), state.get("at", 0.0), state.get("shown", 0.0)
    held = good > 0 and row["t"] - at <= seconds
    if row.get("moving"):
        clear, shown = -1, good if held else shown
    elif clear < 0 or n - clear < grace:
        clear, shown = n if clear < 0 else clear, good if good > 0 else shown
    elif row["x"] > 0:
        shown = good = row["x"]
        at = row["t"]
    elif held:
        shown = good
    return {"n": n, "clear": clear, "good": good, "at": at, "shown": shown}, {"shown": shown}


#: Step, output columns.
FOLDS: dict[str, tuple[Step, str]] = {
    "kalman": (kalman, "y double"),
    "uncertain_rate": (uncertain_rate, "y double, aleatoric double, epistemic double, low double, high double, confidence double"),
    "smoother": (smoother, "y double, locked boolean"),
    "bayes": (bayes, "y double, sd double, top double"),
    "motion": (motion, "score double, moving boolean"),
    "physio_state": (physio_state, "state string, median double"),
    "sustained_arrhythmia": (sustained_arrhythmia, "alarm boolean, kinds string"),
    "baseline": (baseline, "z double, label string, mean double, deviation double"),
    "reliability": (reliability, "state string, trend double"),
    "candidate_life": (candidate_life, "life string, persistence double"),
    "session_confidence": (session_confidence, "confidence double, label string"),
    "region_weight": (region_weight, "weight double, deviation double"),
    "posterior_quality": (posterior_quality, "sqi double, log_odds double"),
    "holdover": (holdover, "shown double"),
    "region_state": (region_state, "bad long, excluded boolean"),
}


#: Rows that a task has as Python objects at once.
AT_ONCE = 1000

ARROW = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def plain(row: dict) -> dict:
    """The row as steps expect it: NaN, which pandas makes of null, is None."""
    return {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in row.items()}


def rows_of(batch: pa.RecordBatch) -> list[dict]:
    """batch.to_pylist(), column by column, which is several times as fast for nested columns."""

    def values(c: pa.Array) -> list:
        if pa.types.is_struct(c.type):
            names = [f.name for f in c.type]
            made = [dict(zip(names, v, strict=True)) for v in zip(*map(values, c.flatten()), strict=True)]
            return made if not c.null_count else [v if ok else None for v, ok in zip(made, c.is_valid().to_pylist(), strict=True)]
        if pa.types.is_list(c.type):
            flat, ends = values(c.flatten()), itertools.accumulate(n or 0 for n in pc.list_value_length(c).to_pylist())
            made = [flat[i:j] for i, j in itertools.pairwise(itertools.chain((0,), ends))]
            return made if not c.null_count else [v if ok else None for v, ok in zip(made, c.is_valid().to_pylist(), strict=True)]
        if not c.null_count and (pa.types.is_integer(c.type) or pa.types.is_floating(c.type) or pa.types.is_boolean(c.type)):
            return c.to_numpy(zero_copy_only=False).tolist()
        return c.to_pylist()

    names = batch.schema.names
    return [dict(zip(names, v, strict=True)) for v in zip(*map(values, batch.columns), strict=True)]


def run(df: DataFrame, name: str) -> DataFrame:
    """df (session, seq, t, x, more inputs of the step) with the fold's outputs for each row, in order of (t, seq); null x are left out.

    Sessions are dealt by hash and sorted by Spark; a task reads them batch by batch and keeps one session's state at a time.
    """
    step, outputs = FOLDS[name]
    types = dict(df.dtypes)
    schema = f"session {types['session']}, seq {types['seq']}, {outputs}"
    names = [c.split()[0] for c in outputs.split(", ")]
    arrow = {c.split()[0]: ARROW[c.split()[1]] for c in schema.split(", ")}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, state = object(), {}
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            out = []
            for row in rows_of(batch):
                if row["session"] != session:
                    session, state = row["session"], {}
                state, got = step(state, plain(row))
                out.append((session, row["seq"], *[got[n] for n in names]))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), arrow.values(), strict=True)], list(arrow))

    return df.where("x IS NOT NULL").repartition("session").sortWithinPartitions("session", "t", "seq").mapInArrow(fold, schema)
