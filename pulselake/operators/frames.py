"""The frame pipeline (survey H3): one fold over frames, each with an array of regions, that nests every region's state.

A frame's row has motion score x, moving, drift and `regions`: an array of (name, base, bpm, snr, regularity, consistency,
spectral_penalty, brightness, penalty). A session's regions are few (three in the reference), so a frame is a small row and the
state a few numbers for each of them; sessions are independent keys.
"""

from __future__ import annotations

import math
from statistics import median
from typing import Any

import numpy as np

from . import folds
from .folds import pstdev

#: Limits of a usable rate and of a plausible one, least quality, brightness.
USABLE, PLAUSIBLE, LEAST_SQI, BRIGHTNESS = (50.0, 180.0), (45.0, 130.0), 20.0, (60.0, 205.0)
#: A rate farther than OUTLIER from the best region's is left out; a fused rate that moves by more than FREEZE is not shown.
OUTLIER, FREEZE, SOFT = 18.0, 30.0, 15.0
DRIFT_FREEZE, DRIFT_WARN = 40.0, 20.0


def within(x: float, limits: tuple[float, float]) -> bool:
    return limits[0] <= x <= limits[1]


def doubted(bpm: float, motion: float) -> float:
    """How likely a rate is at rest."""
    for limit, factor in ((160, 0.1), (145, 0.3), (130, 0.5)):
        if bpm > limit:
            return factor
    return 0.55 if bpm > 115 and motion < 1.8 else 1.0


#: What quality_index() takes for a part that a row doesn't have.
PARTS = {"motion": 0.0, "drift": 0.0, "brightness": 128.0, "stable": 0.0, "sine": 0.0, "peak_ratio": 2.0, "regularity": 0.1, "consistency": 0.5, "snr": 0.0, "spectral_penalty": 0.0}


def recent_spread(region: dict) -> float:
    """The deviation of a region's last ten rates, which quality_index() keeps with them."""
    return region["spread"] if "spread" in region else pstdev(region["rates"][-10:])


def quality_index(state: dict, row: dict) -> tuple[dict, dict]:
    """A region's quality (0..100, one decimal) from its parts, less penalties and doubts, blended with its own last one.

    Steadiness (of the last ten rates) and the peak's consistency follow slowly, regularity is the mean of the last eight. The
    doubts (of the rate at rest, of unsteady rates, of jumps of more than 25, of rates half or double the `stable` one, of a
    nearly equal second peak, of a pure sine) act at once: where they halve the index it isn't blended. A rate of 0 counts like any
    other; region_index() is for rows that may have none.
    """
    of = {**PARTS, "agreement": state.get("agreement", 1.0), **row}
    if None in of.values():
        of = {k: (PARTS.get(k, state.get("agreement", 1.0)) if v is None else v) for k, v in of.items()}
    x, rates = row["x"], state.get("rates", [])
    moved, drift, bright, stable, agree = of["motion"], of["drift"], of["brightness"], of["stable"], of["agreement"]
    relation = x / stable if stable > 0 else 0.0
    doubled, halved = 1.8 < relation < 2.2, 0.45 < relation < 0.55
    late = recent_spread(state) if len(rates) >= 5 else 0.0
    bio = doubted(x, moved) * (0.7 if len(rates) >= 5 and (pstdev(rates) if len(rates) > 10 else late) > 15 else 1.0) * (0.55 if x >= 110 and of["sine"] > 0.93 else 1.0)
    if rates and abs(x - rates[-1]) > 25:
        bio *= 0.2 if doubled or halved else 0.4
    bio *= (0.3 if doubled else 0.4 if halved else 1.0) * (0.2 if of["peak_ratio"] < 1.3 else 1.0)
    regular = [*state.get("regular", ())[-7:], of["regularity"]]
    now_steady = max(0.0, (100 - 4 * late) / 100) if len(rates) >= 5 else 1.0
    steady = 0.9 * state.get("steady", 1.0) + 0.1 * now_steady
    consistent = 0.8 * state.get("consistent", 0.5) + 0.2 * of["consistency"]
    m = min(moved / 15, 0.6)
    m = min(0.5, m + 0.2) if moved > 2.5 else max(m, 0.1) if moved > 1.5 else 0.0
    light = 0.9 if drift > 40 else 0.7 if drift > 30 else 0.5 if drift > 20 else 0.3 if drift > 10 else min((50 - bright) / 50, 0.3) if bright < 50 else min((bright - 210) / 40, 0.3) if bright > 210 else 0.0
    snr, regularity = of["snr"], sum(regular) / len(regular)
    raw = 0.25 * snr + 0.30 * regularity + 0.30 * steady + 0.15 * consistent + 0.10 * (1 - m)
    raw = (raw - 0.4 * (m + light + of["spectral_penalty"]) / 3) * (1 - 0.3 * m) * (1 - 0.3 * light)
    if snr > 0.35 and regularity > 0.20:
        raw = max(raw, 0.22)
    if agree < 0.7:
        raw *= 1 - (0.7 - agree) / 0.7 * 0.3
    if now_steady < 0.05 and consistent > 0.9:  # a lone spike
        bio, agree = 0.4 * bio, 0.5 * agree
    whole = 100 * raw * bio
    before = state.get("sqi", 0.0)
    if before > 0 and bio > 0.5:
        whole = 0.4 * before + 0.6 * whole
    sqi = math.floor(min(100.0, max(0.0, whole)) * 10 + 0.500001) / 10
    now = {**state, "bpm": x, "sqi": sqi, "agreement": agree, "rates": [*rates[-149:], x], "regular": regular, "steady": steady, "consistent": consistent}
    if len(rates) >= 4:
        now["spread"] = pstdev(now["rates"][-10:])
    return now, {"sqi": sqi}


def region_index(state: dict, row: dict) -> tuple[dict, dict]:
    """quality_index() of a region's frame: without a rate (null, 0 or less) it is 0, and what is known of the region stays."""
    if not row["x"] or row["x"] <= 0:
        return {**state, "sqi": 0.0, "bpm": row["x"] or 0.0}, {"sqi": 0.0}
    return quality_index(state, row)


def calibration(state: dict, row: dict, frames: int = 180, least: float = 30.0) -> tuple[dict, dict]:
    """The first `frames` samples of a quality of at least `least`; their mean quality and median rate (above 0) once they are complete."""
    if not state.get("done"):
        sqi, bpm = list(state.get("sqi", ())), list(state.get("bpm", ()))
        if (row.get("sqi") or 0.0) >= least:
            sqi, bpm = [*sqi, row["sqi"]], bpm + [row["x"]] * (row["x"] > 0)
        done = len(sqi) >= frames
        return {"done": done, **({"base_sqi": sum(sqi) / len(sqi), "base_bpm": median(bpm) if bpm else 0.0} if done else {"sqi": sqi, "bpm": bpm})}, {"calibrating": True}
    return state, {"calibrating": False}


def doubled_rates(regions: list[dict]) -> None:
    """Regions whose rate is twice another's: a streak costs quality and agreement, and from the fifth frame nearly all of it."""
    for a in regions:
        for b in regions:
            if a is b or a["bpm"] <= 0 or b["bpm"] <= 0:
                continue
            streak = a.get("streak", 0)
            if not 1.85 < a["bpm"] / b["bpm"] < 2.15:
                a["streak"] = max(0, streak - 1)
                a["suspect"] = a.get("suspect", False) and a["streak"] > 0
            elif b["sqi"] <= 30:
                a["streak"] = max(0, streak - 1)
            else:
                a["streak"], a["suspect"] = streak + 1, True
                lasting = streak + 1 >= 5
                a["sqi"] *= 0.08 if lasting else max(0.12, 0.85 - 0.25 * (streak + 1))
                a["agreement"] *= 0.05 if lasting else 0.25
    for a in regions:
        for b in regions:
            if a is not b and a["bpm"] > 0 and b["bpm"] > 0 and abs(a["bpm"] - 2 * b["bpm"]) < 8 and b["sqi"] > 25:
                a["suspect"] = True
                a["agreement"] *= 0.25
    best = max(regions, key=lambda r: r["sqi"])
    for a in regions:
        if a is not best and a["bpm"] > 0:
            ratio, ref = a["bpm"] / (best["bpm"] + 1e-6), best["bpm"]
            found = min(abs(ratio - h) for h in (2.0, 3.0, 0.5, 0.333)) < 0.08 or abs(a["bpm"] - 2 * ref) < 0.15 * ref or abs(a["bpm"] - 0.5 * ref) < 0.08 * ref
            a["suspect"] = (found and abs(a["bpm"] - ref) >= 6) or a.get("suspect", False)


def region_weight(region: dict, base: float, motion: float, drift: float, stable: float = 0.0) -> float:
    """H1: a region's weight in this frame, 0 for a suspect, else 0.05..3."""
    if region.get("suspect") or region.get("streak", 0) >= 5:
        return 0.0
    bpm, snr, bright, rates = region["bpm"], region.get("snr", 0.0), region.get("brightness", 128.0), region.get("rates", ())
    body = 1.0 if bpm <= 0 else 0.1 if not within(bpm, (45, 150)) else 0.5 if not within(bpm, (55, 130)) else 1.0
    if stable > 0 and abs(bpm - stable) > 25:
        body *= 0.6
    steady = max(0.1, 1 - recent_spread(region) / 20) if len(rates) >= 5 else 1.0
    w = base * body * (0.4 * max(0.1, region["sqi"] / 100) + 0.4 * steady + 0.2 * (min((snr / 100) ** 1.5, 1.0) if snr > 0 else 0.1))
    w *= 1.0 if within(bpm, PLAUSIBLE) else 0.15
    w *= max(0.08, (bright / 65) ** 2) if bright < 65 else max(0.35, bright / 85) if bright < 85 else 1.0
    w *= (0.2 if motion > 2.5 else 1.0) * (0.5 if motion > 3.5 else 1.0) * (0.15 if region.get("agreement", 1.0) < 0.55 else 1.0)
    w *= 0.1 if drift > DRIFT_FREEZE else 0.45 if drift > DRIFT_WARN else 1.0
    return min(3.0, max(0.05, w))


def grouped_mean(regions: list[tuple[float, float, bool]], gap: float = 8.0, keep: float = 0.2, share: float = 0.75) -> float:
    """H2: of (rate, weight, suspect): suspects only if there are no others; groups of rates at most `gap` apart; a group counts
    if it has `keep` of the weight or as many members as any."""
    left = [(b, min(3.0, max(0.01, w)), s) for b, w, s in regions if w > 0]
    left = [x for x in left if not x[2]] or left
    if not left:
        return 0.0
    most = share * sum([w for _, w, _ in left])
    left = sorted((b, min(w, most)) for b, w, _ in left)
    groups: list[list[tuple[float, float]]] = []
    for b, w in left:
        if groups and b - groups[-1][-1][0] <= gap:
            groups[-1].append((b, w))
        else:
            groups.append([(b, w)])
    total, members = sum([w for _, w in left]), max(map(len, groups))
    rows = [(sum([b * w for b, w in g]), sum([w for _, w in g]) + 1e-9, len(g)) for g in groups]
    rows = [(b / w, w) for b, w, n in rows if w / (total + 1e-9) >= keep or n == members]
    return sum([b * w for b, w in rows]) / sum([w for _, w in rows])


#: The even belief, and the spread of one from frame to frame.
_EVEN, _SPREAD = np.full(len(folds._GRID), 1 / len(folds._GRID)), folds._SPREAD / folds._SPREAD.sum()


def joint_belief(prior: list[float] | None, estimates: list[tuple[float, float]]) -> tuple[list[float], float]:
    """G5 with a memory: the belief over 40..200 times the Gaussian likelihoods of all estimates (rate, quality); spread, and its mean."""
    grid = folds._GRID
    off = np.zeros(len(grid))
    for bpm, sqi in estimates:
        if bpm > 0 and sqi >= 0:
            d = grid - bpm
            d /= 10 * (1 - min(1.0, sqi / 100)) + 0.8
            d *= d
            d *= 0.5
            off += d
    like = np.exp(off.min() - off)
    post = like * (_EVEN if prior is None else np.array(prior))
    post /= np.add.reduce(like) + 1e-12
    post /= np.add.reduce(post) + 1e-12
    wide = np.convolve(post, _SPREAD, "same")
    wide /= np.add.reduce(wide) + 1e-12
    return wide.tolist(), float(post @ grid)


def frame_pipeline(state: dict[str, Any], row: dict[str, Any]) -> tuple[dict, dict]:
    """H3: quality of each region (G21), corrections, agreement, weights (E6, H1, G19), fusion (G5, H2), inertia, smoothing (G2, G1), confidence.

    Regions count whose brightness is usable and whose own last rate was plausible (one that wasn't stays out, as in the
    reference). Rates two or three times the median are halved or thirded; of those usable, the ones within 18 of the best stay,
    and agree by exp(-distance / 6), at least 0.2. A fused rate more than 30 from the one shown isn't shown, one more than 15 away
    only in part. A frame of strong drift, or without a usable region, changes nothing that is shown.
    """
    s = {**state, "regions": {k: dict(v) for k, v in state.get("regions", {}).items()}}
    held = s.get("held", 0.0)
    out = {"bpm": held, "sqi": 0.0, "agreement": None, "accepted": 0, "confidence": s.get("score", {}).get("ema", 0.0), "frozen": False, "locked": False, "calibrating": None}
    motion, moving, drift = row["x"], bool(row.get("moving")), row.get("drift") or 0.0
    if drift >= DRIFT_FREEZE:
        return state, {**out, "frozen": True}
    out["bpm"] = 0.0
    names, base, damp = [], {}, {}
    for r in row["regions"] if row.get("regions") is not None else ():
        name, was = r["name"], s["regions"].get(r["name"], {})
        if not within(r["brightness"], BRIGHTNESS) or (was.get("bpm", 0.0) > 0 and not within(was["bpm"], PLAUSIBLE)):
            continue
        parts = {"x": r["bpm"], "motion": motion, "drift": drift, "snr": r["snr"], "regularity": r["regularity"], "consistency": r["consistency"], "spectral_penalty": r["spectral_penalty"], "brightness": r["brightness"]}
        now, _ = region_index(was, parts)
        s["regions"][name] = {**now, "snr": 100 * r["snr"], "brightness": r["brightness"]}
        names.append(name)
        base[name], damp[name] = r["base"], r["penalty"]
    regions = {n: s["regions"][n] for n in names}
    if not regions:
        return s, out
    usable = lambda r: within(r["bpm"], USABLE) and r["sqi"] >= LEAST_SQI
    s["calibration"], told = calibration(s.get("calibration", {}), {"sqi": max(r["sqi"] for r in regions.values()), "x": max((r["bpm"] for r in regions.values() if within(r["bpm"], USABLE)), default=0.0)})
    out["calibrating"] = told["calibrating"]
    good = [r for r in regions.values() if usable(r)]
    if len(good) >= 2:
        mid = median(r["bpm"] for r in good)
        for r in good:
            by = 2 if 1.85 <= r["bpm"] / (mid + 1e-6) <= 2.15 else 3 if 2.8 <= r["bpm"] / (mid + 1e-6) <= 3.2 else 1
            if mid >= USABLE[0] and within(r["bpm"] / by, USABLE):
                r["bpm"] /= by
    taken = {n: r for n, r in regions.items() if usable(r)}
    if not taken:
        return s, out
    best = max(taken.values(), key=lambda r: r["sqi"])["bpm"]
    taken = {n: r for n, r in taken.items() if abs(r["bpm"] - best) <= OUTLIER}
    for r in taken.values():
        r["agreement"] = math.exp(-abs(r["bpm"] - best) / 6)
    taken = {n: r for n, r in taken.items() if r["agreement"] >= 0.2}
    agree = math.exp(-pstdev([r["bpm"] for r in taken.values()]) / 7) if len(taken) >= 2 else 0.8
    doubled_rates(list(taken.values()))
    own = {n: region_weight(r, base[n], motion, drift) for n, r in taken.items()}
    weight = {n: own[n] * damp[n] for n in taken}
    learned = {n: folds.region_trust(r.get("trust", {})) for n, r in taken.items()}
    s["belief"], joint = joint_belief(s.get("belief"), [(r["bpm"], r["sqi"]) for r in taken.values()])
    fused = 0.7 * joint + 0.3 * grouped_mean([(r["bpm"], weight[n] * learned[n], r.get("suspect", False)) for n, r in taken.items()])
    for n, r in taken.items():
        r["trust"], _ = folds.region_weight(r.get("trust", {}), {"x": r["bpm"], "sqi": r["sqi"], "fused": fused, "forehead": n == "forehead"})
    out |= {"agreement": agree, "accepted": len(taken)}
    far = abs(fused - held)
    if fused > 0 and held > 0 and far > FREEZE:
        out |= {"bpm": held, "locked": True}
    elif fused > 0:
        if held > 0 and far > SOFT:
            trust = math.exp(-(far - SOFT) / 10)
            fused = trust * fused + (1 - trust) * held
        s["smoother"], smooth = folds.smoother(s.get("smoother", {}), {"x": fused})
        s["shown"] = (list(s.get("shown", ())) + [smooth["y"]] * (smooth["y"] > 0))[-10:]
        out["bpm"] = s["held"] = median(s["shown"]) if len(s["shown"]) >= 3 else smooth["y"]
        strong = [(own[n], r["sqi"]) for n, r in taken.items() if r["sqi"] >= LEAST_SQI]
        total = sum(w for w, _ in strong)
        out["sqi"] = (sum(w * q for w, q in strong) / total if total > 0 else 0.0) * max(0.0, 1 - 0.5 * max(0.0, 0.5 - agree))
    s["score"], scored = folds.session_confidence(s.get("score", {}), {"sqi": out["sqi"], "x": out["bpm"], "moving": moving, "agreement": agree, "regions": 1})
    out["confidence"] = scored["confidence"]
    return s, out


folds.FOLDS["quality_index"] = (quality_index, "sqi double")
folds.FOLDS["calibration"] = (calibration, "calibrating boolean")
folds.FOLDS["frame_pipeline"] = (frame_pipeline, "bpm double, sqi double, agreement double, accepted long, confidence double, frozen boolean, locked boolean, calibrating boolean")
