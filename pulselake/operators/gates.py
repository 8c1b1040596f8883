"""Checks of estimates and frames over their stream (survey G17, I6): window functions, no state in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import mean_of, std_of


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def plausible(df: DataFrame, low: float = 40, high: float = 200, most_jump: float = 20, most_share: float = 0.25, unsteady: float = 15, spectral: float = 0.5, harmonic: float = 0.5, spread: float = 0.3, timeout: int = 300) -> DataFrame:
    """Df (session, seq, x, instability, harmonic_ratio, cv) with failures, the names of failed checks, and verdict.

    Range, jump against the row before (T15) and timeout make a row INVALID; trajectory, spectrum, harmonics and candidates
    UNCERTAIN. The trajectory is that of the last ten rows which weren't INVALID, from five on. After `timeout` INVALID rows in
    a row a session stays INVALID. A null or NaN rate is out of range; other null inputs pass.
    """
    w = Window.partitionBy("session").orderBy("seq")
    x, before = F.col("x"), F.lag("x").over(w)
    jump = F.abs(x - before)
    df = df.withColumns({"out_of_range": ~_known(x.between(low, high)), "jumps": _known((before > 0) & ((jump > most_jump) | (jump / F.greatest(before, F.lit(1.0)) > most_share))), "_n": F.row_number().over(w)})
    df = df.withColumn("_streak", F.col("_n") - F.coalesce(F.max(F.when(~(F.col("out_of_range") | F.col("jumps")), F.col("_n"))).over(w), F.lit(0)))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("timeout", _known(F.max("_streak").over(past) >= timeout))
    df = df.withColumn("_kept", ~(F.col("out_of_range") | F.col("jumps") | F.col("timeout")))
    ten = Window.partitionBy("session", "_kept").orderBy("seq").rowsBetween(-9, 0)
    df = df.withColumn("_recent", F.when(F.col("_kept"), F.struct(F.stddev_pop("x").over(ten).alias("sd"), F.count("*").over(ten).alias("n"))))
    df = df.withColumn("_recent", F.last("_recent", ignorenulls=True).over(past))
    errors = {name: F.col(name) for name in ("out_of_range", "jumps", "timeout")}
    warnings = {
        "trajectory": _known((F.col("_recent.n") >= 5) & (F.col("_recent.sd") >= unsteady)), "spectral": _known(F.col("instability") >= spectral),
        "harmonic": _known(F.col("harmonic_ratio") >= harmonic), "candidates": _known(F.col("cv") >= spread),
    }
    df = df.withColumn("failures", F.array_compact(F.array(*(F.when(c, name) for name, c in (errors | warnings).items()))))
    verdict = F.when(~F.col("_kept"), "INVALID").when(F.size("failures") > 0, "UNCERTAIN").otherwise("PLAUSIBLE")
    return df.withColumn("verdict", verdict).drop(*errors, "_n", "_streak", "_kept", "_recent")


def spatial_failures(df: DataFrame, motion: float = 0.8, least_stability: float = 0.3, agreement: float = 0.4, thrashing: float = 0.5) -> DataFrame:
    """Df (stream, frame, motion, candidates long, scores array, stability, quality, landmark_variance) with failures,
    severity (info, warning, error) and action (none, downweight, reject).

    Thrashing is a variance (in whole numbers, so that a tie is one) over the last ten frames with three candidates or more, instability looks at the last ten known qualities, from
    five on. Null inputs have no failure, but a null number of candidates counts as none.
    """
    n = F.coalesce(F.col("candidates"), F.lit(0))
    many = Window.partitionBy("stream", n >= 3).orderBy("frame").rowsBetween(-9, 0)
    known = Window.partitionBy("stream", F.col("quality").isNull()).orderBy("frame").rowsBetween(-9, 0)
    df = df.withColumns({
        "_thrashing": (n >= 3) & (F.count("*").over(many) >= 10) & (10 * F.sum(n * n).over(many) - F.pow(F.sum(n).over(many), F.lit(2)) > 100 * 4 * thrashing),
        "_mean": F.avg("quality").over(known), "_sd": F.stddev_pop("quality").over(known), "_frames": F.count("quality").over(known),
    })
    graded = lambda value, warning, error: F.when(value > error, 2).when(value > warning, 1)
    warned = lambda c: F.when(c, 1)
    mean, sd, scores = F.col("_mean"), F.col("_sd"), F.col("scores")
    found = {
        "local_motion": graded(F.col("motion"), motion / 2, motion), "insufficient_candidates": F.when(n < 1, 2).when(n < 2, 1), "candidate_thrashing": warned(F.col("_thrashing")),
        "spatial_disagreement": warned((F.size(scores) >= 2) & (mean_of(scores) > 0) & (std_of(scores) > agreement * mean_of(scores))),
        "temporal_instability": warned((F.col("stability") < least_stability) | _known((F.col("_frames") >= 5) & (mean > 0) & (sd > 0.5 * mean) & (sd > 0.3))),
        "landmark_instability": graded(F.col("landmark_variance"), 2.0, 5.0),
    }
    level = F.greatest(F.lit(0), *found.values())
    names = F.array_compact(F.array(*(F.when(c.isNotNull(), name) for name, c in found.items())))
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), F.col("_level") + 1)
    return df.withColumns({"failures": names, "_level": level}).withColumns({"severity": pick("info", "warning", "error"), "action": pick("none", "downweight", "reject")}).drop("_thrashing", "_mean", "_sd", "_frames", "_level")
