"""Many estimates to one (survey H): weights, gap clusters, precision-weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, ratio


def region_weight(base: Column, sqi: Column, temporal: Column, snr: Column, bpm: Column, brightness: Column, motion: Column, drift: Column, suspect: Column, agreement: Column, stable: Column) -> Column:
    """H1: base weight times quality, plausibility, brightness, motion, agreement and exposure factors; suspects 0, else 0.05..3.

    temporal is the steadiness of the region's rates (see steadiness()), stable the rate that was last fused (0 if none).
    """
    plausible = F.when((bpm > 0) & ((bpm < 45) | (bpm > 150)), 0.1).when((bpm > 0) & ((bpm < 55) | (bpm > 130)), 0.5).otherwise(1.0)
    plausible = plausible * F.when((stable > 0) & (F.abs(bpm - stable) > 25), 0.6).otherwise(1.0)
    snr_score = F.when(snr > 0, F.least(F.pow(snr / 100, F.lit(1.5)), F.lit(1.0))).otherwise(0.1)
    light = F.when(brightness < 65, F.greatest(F.lit(0.08), F.pow(brightness / 65, F.lit(2.0)))).when(brightness < 85, F.greatest(F.lit(0.35), brightness / 85)).otherwise(1.0)
    w = base * (0.4 * F.greatest(F.lit(0.1), sqi / 100) + 0.4 * temporal + 0.2 * snr_score) * plausible * light * F.when((bpm < 45) | (bpm > 130), 0.15).otherwise(1.0)
    w = w * F.when(motion > 2.5, 0.2).otherwise(1.0) * F.when(motion > 3.5, 0.5).otherwise(1.0) * F.when(agreement < 0.55, 0.15).otherwise(1.0) * F.when(drift > 40, 0.1).when(drift > 20, 0.45).otherwise(1.0)
    return F.when(suspect, 0.0).otherwise(clip(w, 0.05, 3.0))


def steadiness(deviation: Column, n: Column) -> Column:
    """H1: 1 less a twentieth of the deviation of a region's last rates, at least 0.1; 1 with fewer than five."""
    return F.when(n >= 5, F.greatest(F.lit(0.1), 1 - deviation / 20)).otherwise(1.0)


def clusters(df: DataFrame, frame: str = "frame", value: str = "bpm", gap: float = 8.0) -> DataFrame:
    """H2: cluster numbers of a frame's estimates: a gap of more than `gap` to the one before begins a new cluster."""
    w = Window.partitionBy(frame).orderBy(value, "roi")
    far = F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)
    return df.withColumn("__far", far).withColumn("cluster", F.sum("__far").over(w)).drop("__far")


def hierarchical(df: DataFrame, keep: float = 0.2, share: float = 0.75) -> DataFrame:
    """H2: (frame, fused) from df (frame, roi, bpm, weight, suspect).

    Suspects count only in frames without others; weights are held to 0.01..3 and to `share` of the frame's; clusters of
    less than `keep` of the weight count only if no cluster has more members.
    """
    w = Window.partitionBy("frame")
    d = df.where("weight > 0").withColumn("clean", F.max((~F.col("suspect")).cast("int")).over(w)).where("clean = 0 OR NOT suspect").withColumn("w", clip(F.col("weight"), 0.01, 3.0))
    d = d.withColumn("w", F.least("w", share * F.sum("w").over(w)))
    c = clusters(d).groupBy("frame", "cluster").agg(F.sum("w").alias("w"), F.count("*").alias("n"), (F.sum(F.col("bpm") * F.col("w")) / (F.sum("w") + 1e-9)).alias("bpm"))
    c = c.withColumn("total", F.sum("w").over(w)).withColumn("top", F.max("n").over(w))
    c = c.where((F.col("w") / F.col("total") >= keep) | (F.col("n") == F.col("top")))
    return c.groupBy("frame").agg((F.sum(F.col("bpm") * F.col("w")) / (F.sum("w") + 1e-9)).alias("fused"))


def weighted_median(df: DataFrame, frame: str = "frame", value: str = "bpm", weight: str = "weight") -> DataFrame:
    """H4: the first value at which half of the frame's weight is reached."""
    w = Window.partitionBy(frame).orderBy(value, "roi")
    d = df.withColumn("cum", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("half", F.sum(weight).over(Window.partitionBy(frame)) / 2)
    return d.where("cum >= half").groupBy(frame).agg(F.min(value).alias("median"))


def fuse(df: DataFrame, method: str = "variance", frame: str = "frame") -> DataFrame:
    """H5: (frame, value, sigma, agreement, n) of df (frame, x, sigma, confidence); values not finite or of sigma <= 0 are left out.

    mean, weighted (by confidence), variance (by precision), robust (precision, within max(2 sigma, 5) of the median), or
    bayes (precision, with a wide prior at the mean).
    """
    ok = df.where(~F.isnan("x") & (F.abs("x") < float("inf")) & (F.col("sigma") > 0)).withColumn("p", 1 / (F.col("sigma") * F.col("sigma") + 1e-6))
    if method == "robust":
        mid = ok.groupBy(frame).agg(F.percentile("x", 0.5).alias("mid"))
        ok = ok.join(mid, frame).where(F.abs(F.col("x") - F.col("mid")) <= F.greatest(2 * F.col("sigma"), F.lit(5.0)))
    w = {"mean": F.lit(1.0), "weighted": F.col("confidence")}.get(method, F.col("p"))
    g = ok.groupBy(frame).agg(F.count("*").alias("n"), F.sum(w * F.col("x")).alias("wx"), F.sum(w).alias("w"), F.sum("p").alias("p"), F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    prior = 0.001 if method == "bayes" else 0.0
    value = ratio(F.col("wx") + prior * F.col("m"), F.col("w") + prior)
    return g.select(frame, value.alias("value"), (1 / F.sqrt(F.col("p") + prior)).alias("sigma"), clip(1 - 5 * ratio(F.col("sd"), F.col("m")), 0, 1).alias("agreement"), "n")


def inverse_variance(values: Column) -> Column:
    """H6: the variance of the precision-weighted mean of variances in an array."""
    return ratio(F.lit(1.0), F.aggregate(values, F.lit(0.0), lambda a, v: a + 1 / v))


def evidence(df: DataFrame, frame: str = "frame") -> DataFrame:
    """H7: (frame, weighted, least, mean, coverage) of long evidence (frame, source, value, confidence, weight).

    Effective evidence is value times confidence, a harmonic risk counts as its complement, once (T16).
    """
    v = F.when(F.col("source") == "harmonic_risk", 1 - F.col("value")).otherwise(F.col("value")) * F.col("confidence")
    e = df.withColumn("e", v)
    return e.groupBy(frame).agg(ratio(F.sum(F.col("weight") * F.col("e")), F.sum("weight")).alias("weighted"), F.min("e").alias("least"), F.avg("e").alias("mean"), F.avg(F.when(F.col("value") != 0, 1.0).otherwise(0.0)).alias("coverage"))


def uncertainty(parts: dict[str, Column], aleatoric: set[str]) -> tuple[Column, Column, Column]:
    """H8: root sums of squares of component deviations: aleatoric, epistemic, total."""
    root = lambda names: F.sqrt(sum((parts[n] * parts[n] for n in names), F.lit(0.0)))
    return root(sorted(aleatoric)), root(sorted(set(parts) - aleatoric)), root(sorted(parts))


#: Of each component the greatest deviation (a minute), and whether it is of the data, of the model, or of both.
COMPONENTS = {
    "measurement": (None, "aleatoric"), "signal": (10.0, "both"), "spatial": (8.0, "epistemic"), "motion": (6.0, "epistemic"), "temporal": (5.0, "epistemic"),
    "spectral": (8.0, "both"), "harmonic": (None, "both"), "model": (None, "epistemic"), "coverage": (10.0, "epistemic"),
}


def decomposed(df: DataFrame, least_coverage: float = 0.3, most: float = 15.0, most_epistemic: float = 10.0) -> DataFrame:
    """H8: df (noise, sqi 0..100, spatial, motion, temporal, coverage in 0..1, snr_db, model_variance) with the nine components as
    `u_<name>` (deviations a minute), aleatoric, epistemic, total, and validity.

    A component that is of both kinds counts for both; harmonics have their own check and are 0 here. INVALID below the least
    coverage, else UNCERTAIN beyond either limit, else VALID.
    """
    sqi = clip(F.col("sqi") / 100, 0, 1)
    snr = clip((F.col("snr_db") + 20) / 40, 0, 1)
    short = {"signal": sqi, "spatial": F.col("spatial"), "motion": F.col("motion"), "temporal": F.col("temporal"), "spectral": snr, "coverage": F.col("coverage")}
    parts = {k: (1 - v) * COMPONENTS[k][0] for k, v in short.items()} | {"measurement": F.col("noise") * (1 - 0.5 * sqi), "harmonic": F.lit(0.0), "model": F.sqrt(F.greatest(F.col("model_variance"), F.lit(0.01)))}
    df = df.withColumns({f"u_{k}": parts[k] for k in COMPONENTS})
    root = lambda kinds: F.sqrt(sum((F.col(f"u_{k}") * F.col(f"u_{k}") for k, (_, kind) in COMPONENTS.items() if kind in kinds), F.lit(0.0)))
    df = df.withColumns({"aleatoric": root(("aleatoric", "both")), "epistemic": root(("epistemic", "both")), "total": root(("aleatoric", "epistemic", "both"))})
    return df.withColumn("validity", F.when(F.col("coverage") < least_coverage, "INVALID").when((F.col("total") > most) | (F.col("epistemic") > most_epistemic), "UNCERTAIN").otherwise("VALID"))
