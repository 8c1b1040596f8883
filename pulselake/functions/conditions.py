"""Stress conditions of a window as columns: (type, severity) structs and the quality of its signal (survey J1-J5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import finite


def condition(kind: str, severity: Column | float) -> Column:
    """A condition with its severity within 0..1."""
    s = severity if isinstance(severity, Column) else F.lit(float(severity))
    return F.struct(F.lit(kind).alias("type"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), s.cast("double"))).alias("severity"))


def lighting(mean: Column, spread: Column, low: float = 50.0, variable: float = 30.0) -> Column:
    """J1. No mean: unknown. A spread that is null is not looked at."""
    return (
        F.when(mean.isNull(), condition("unknown", 1.0))
        .when(mean < low, condition("lighting_low", F.greatest(F.lit(0.5), 1 - mean / low)))
        .when(spread > variable, condition("lighting_variable", spread / (2 * variable)))
        .otherwise(condition("lighting_normal", 0.0))
    )


def motion(level: Column, tracking_loss: Column, mild: float = 0.01, moderate: float = 0.05, severe: float = 0.1) -> Column:
    """J2. level: the larger of mean |motion| and mean |displacement|; null: tracking loss stands in. Mild and moderate
    severities are multiples of their threshold, so they reach 1 (T7)."""
    return (
        F.when(level.isNull() & (tracking_loss > 0.5), condition("motion_severe", tracking_loss))
        .when(level.isNull() & (tracking_loss > 0), condition("motion_moderate", tracking_loss))
        .when(level.isNull() | (level < mild), condition("motion_none", 0.0))
        .when(level >= severe, condition("motion_severe", F.greatest(F.lit(0.7), level / (2 * severe))))
        .when(level >= moderate, condition("motion_moderate", F.greatest(F.lit(0.4), level / moderate)))
        .otherwise(condition("motion_mild", F.greatest(F.lit(0.1), level / mild)))
    )


def roi_stability(coverage: Column, mild: float = 0.1, severe: float = 0.3) -> Column:
    """J3. By the share of the region that is lost."""
    loss = F.coalesce(1 - coverage, F.lit(0.0))
    return (
        F.when(loss >= severe, condition("roi_severe_loss", F.greatest(F.lit(0.7), loss)))
        .when(loss >= mild, condition("roi_partial_loss", F.greatest(F.lit(0.3), 2 * loss)))
        .otherwise(condition("roi_stable", 0.0))
    )


def quality(sqi: Column, confidence: Column, hr_confidence: Column) -> Column:
    """J4. (type, score) of a window's signal: the first of the indicators that isn't null; a good index with a low
    confidence counts as the lower one; null or NaN: failed, 0 (T21)."""
    sqi, confidence, hr_confidence = finite(sqi), finite(confidence), finite(hr_confidence)
    first = F.coalesce(sqi, confidence, hr_confidence)
    score = F.when((sqi > 0.3) & (confidence < 0.5), F.least(sqi, confidence)).otherwise(first)
    kind = F.when(score >= 0.8, "sqi_high").when(score >= 0.5, "sqi_medium").when(score >= 0.3, "sqi_low").otherwise("sqi_failed")
    return F.struct(kind.alias("type"), F.coalesce(score, F.lit(0.0)).alias("score"))


def quality_level(kind: Column) -> Column:
    """Failed signals are of poor quality."""
    return F.when(kind == "sqi_high", "excellent").when(kind == "sqi_medium", "good").when(kind == "sqi_low", "fair").otherwise("poor")


def all_conditions(mean: Column, spread: Column, level: Column, loss: Column, coverage: Column, quality_struct: Column) -> Column:
    """J5. The window's conditions: lighting, motion, region, signal (severity 1 - score), the unknown left out."""
    signal = F.struct(quality_struct.type.alias("type"), (1 - quality_struct.score).alias("severity"))
    return F.filter(F.array(lighting(mean, spread), motion(level, loss), roi_stability(coverage), signal), lambda c: c.type != "unknown")
