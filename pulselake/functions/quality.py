"""The signal quality index of a region's frame as a column (survey G21), and its parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clip, rounded

#: Weights of the parts (they sum to 1.1) and of the penalties, and the penalties' limits.
WEIGHTS = {"snr": 0.25, "regularity": 0.30, "temporal": 0.30, "consistency": 0.15, "stillness": 0.10}
PENALTY_WEIGHT, MOST_MOTION, MOST_LIGHT = 0.40, 0.60, 0.30


def plausibility(bpm: Column, motion: Column) -> Column:
    """How likely a rate is at rest; fast ones are doubted, moderately fast ones only without motion."""
    still = motion < 1.8
    return F.when(bpm > 160, 0.1).when(bpm > 145, 0.3).when(bpm > 130, 0.5).when((bpm > 115) & still, 0.55).otherwise(1.0)


def motion_penalty(motion: Column, leave: float = 1.5, enter: float = 2.5) -> Column:
    base = F.least(motion / 15, F.lit(MOST_MOTION))
    return F.when(motion > enter, F.least(F.lit(0.5), base + 0.2)).when(motion > leave, F.greatest(base, F.lit(0.1))).otherwise(0.0)


def lighting_penalty(brightness: Column, drift: Column) -> Column:
    """A drift of the exposure decides before the brightness does."""
    dark, burnt = F.least((50 - brightness) / 50, F.lit(MOST_LIGHT)), F.least((brightness - 210) / 40, F.lit(MOST_LIGHT))
    return F.when(drift > 40, 0.9).when(drift > 30, 0.7).when(drift > 20, 0.5).when(drift > 10, 0.3).when(brightness < 50, dark).when(brightness > 210, burnt).otherwise(0.0)


def index(snr: Column, regularity: Column, temporal: Column, consistency: Column, motion: Column, brightness: Column, drift: Column, bpm: Column, agreement: Column, before: Column, spectral_penalty: Column) -> Column:
    """0..100, one decimal. A weak second peak only lowers the plausibility (T12); doubtful frames aren't blended with the one before."""
    m, light, bio = motion_penalty(motion), lighting_penalty(brightness, drift), plausibility(bpm, motion)
    w = WEIGHTS
    raw = w["snr"] * snr + w["regularity"] * regularity + w["temporal"] * temporal + w["consistency"] * consistency + w["stillness"] * (1 - m)
    raw = (raw - PENALTY_WEIGHT * (m + light + spectral_penalty) / 3) * (1 - 0.3 * m) * (1 - 0.3 * light)
    raw = F.when((snr > 0.35) & (regularity > 0.2), F.greatest(raw, F.lit(0.22))).otherwise(raw)
    raw = raw * F.when(agreement < 0.7, 1 - (0.7 - agreement) / 0.7 * 0.3).otherwise(1.0)
    whole = raw * 100 * bio
    return rounded(clip(F.when((before > 0) & (bio > 0.5), 0.4 * before + 0.6 * whole).otherwise(whole), 0, 100), 1)


def confidence_failures(error: Column, confidence: Column, actual: Column, predicted: Column, steady: Column, lagging: Column) -> Column:
    """Names of what is wrong with an estimate's confidence (0..100) and predicted uncertainty, given its error and actual one.

    steady: the confidence hardly varied over the last 30 frames; lagging: evidence moved over the last 10, the confidence didn't.
    """
    found = {
        "high_confidence_wrong": (confidence > 80) & (error > 10), "low_confidence_correct": (confidence < 30) & (error < 5),
        "uncertainty_underestimation": (predicted > 0) & (actual > 2 * predicted), "uncertainty_overestimation": (predicted > 0) & (predicted > 3 * actual),
        "confidence_stagnation": steady, "temporal_confidence_lag": lagging,
    }
    return F.array_compact(F.array(*(F.when(c, name) for name, c in found.items())))
