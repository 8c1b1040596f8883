"""Ablation experiments (survey I7, C9): stages that need earlier ones, built once for all experiments that have them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grids
from .estimators import BAND, by_window, one_peak, spectrum
from .filters import butterworth, run_sections

#: The experiments and their stages.
EXPERIMENTS = {
    "e0_baseline": (),
    "e1_quality_only": ("quality",),
    "e2_motion_only": ("motion",),
    "e3_quality_motion": ("quality", "motion", "aware"),
    "e4_candidates": ("quality", "motion", "aware", "candidates"),
    "e5_temporal": ("quality", "motion", "aware", "candidates", "temporal"),
    "e6_full": ("quality", "motion", "aware", "candidates", "temporal"),
}
#: What stands for motion confidence and stability where buffers are processed.
CONFIDENCE, STABILITY = 0.8, 0.9


def quality(maps: dict[str, DataFrame]) -> DataFrame:
    """Mean quality (dB) of a frame's cells."""
    return maps["cells"].groupBy("frame").agg(F.avg("db").alias("quality_mean"))


def moved(maps: dict[str, DataFrame]) -> DataFrame:
    """Mean motion of a frame's cells against the frame before, null for a frame without one."""
    return grids.motion(maps["pixels"], 2).groupBy("frame").agg(F.avg("v").alias("motion_mean"))


def aware(maps: dict[str, DataFrame]) -> DataFrame:
    """Quality in 0..1 weighed by motion; also leaves the cells for later stages."""
    maps["aware"] = maps["cells"].withColumn("quality", grids.aware_quality(F.col("db"), F.lit(CONFIDENCE), F.lit(STABILITY), "product"))
    return maps["aware"].groupBy("frame").agg(F.avg("quality").alias("aware_mean"), F.avg(F.when(F.col("quality") >= 0.3, 1.0).otherwise(0.0)).alias("usable"))


def chosen(maps: dict[str, DataFrame]) -> DataFrame:
    """Number and best score of a frame's candidate regions (I4)."""
    cells = maps["aware"].select("frame", "y", "x", "quality", F.lit(CONFIDENCE).alias("confidence"), F.lit(STABILITY).alias("stability"))
    maps["candidates"] = grids.candidates(cells, 8, 0.3)
    return maps["candidates"].groupBy("frame").agg(F.count("*").alias("n_candidates"), F.max("score").alias("best_score"))


def temporal(maps: dict[str, DataFrame]) -> DataFrame:
    """The best persistence of a frame's candidates: of the scores of a region in its last ten frames without a gap, their mean
    times their evenness times the stability (I5)."""
    c = maps["candidates"].select("frame", "region", "score")
    run = F.col("frame") - F.row_number().over(Window.partitionBy("region").orderBy("frame"))
    w = Window.partitionBy("region", "run").orderBy("frame").rowsBetween(-9, 0)
    mean, even = F.avg("score").over(w), F.least(F.lit(1.0), 0.3 / (F.stddev_pop("score").over(w) / (F.abs(F.avg("score").over(w)) + 1e-9) + 1e-9))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean * F.when(F.count("*").over(w) > 1, even).otherwise(1.0) * STABILITY))
    return c.withColumn("run", run).withColumn("p", p).groupBy("frame").agg(F.max("p").alias("persistence"))


STAGES: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {"quality": quality, "motion": moved, "aware": aware, "candidates": chosen, "temporal": temporal}


def run(pixels: DataFrame, experiments: tuple[str, ...] = tuple(EXPERIMENTS), scale: float = 20.0) -> DataFrame:
    """(experiment, frame, the stages' measures) of pixels (frame, y, x, v; `scale` of it is the quality in dB): null what an experiment doesn't have.

    Each stage that any of the experiments has is built once; its measures are joined by frame, and each frame's row is dealt to the
    experiments. An unknown experiment raises KeyError.
    """
    wanted = {e: EXPERIMENTS[e] for e in experiments}
    maps = {"pixels": pixels, "cells": pixels.select("frame", "y", "x", (scale * F.col("v")).alias("db"))}
    rows, measures = pixels.select("frame").distinct(), {}
    for name, stage in STAGES.items():
        if any(name in has for has in wanted.values()):
            found = stage(maps)
            measures[name] = [c for c in found.columns if c != "frame"]
            rows = rows.join(found, "frame", "left")
    experiment = F.explode(F.array(*(F.lit(e) for e in wanted))).alias("experiment")
    having = lambda name: F.col("experiment").isin([e for e, has in wanted.items() if name in has])
    return rows.select(experiment, "*").select("experiment", "frame", *(F.when(having(name), F.col(c)).alias(c) for name, cs in measures.items() for c in cs))


def bandpass_ablation(wins: DataFrame, fps: float) -> DataFrame:
    """(session, w, with_bandpass, without_bandpass, apart) of windows (r, g, b): the rate a minute of the CHROM signal without
    its line, with and without the band-pass, and the deviation of the two signals from each other. The reference's other flags change nothing."""
    sections = butterworth(4, *BAND, fps) if fps > 2 * BAND[1] else []

    def made(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> list[dict]:
        scaled = [c / (c.mean(1, keepdims=True) + 1e-9) for c in (r, g, b)]
        x, y = 3 * scaled[0] - 2 * scaled[1], 1.5 * scaled[0] + scaled[1] - 1.5 * scaled[2]
        chrom = x - x.std(1, keepdims=True) / (y.std(1, keepdims=True) + 1e-9) * y
        t = np.arange(chrom.shape[1]) - (chrom.shape[1] - 1) / 2
        plain = chrom - chrom.mean(1, keepdims=True)
        plain = plain - (plain @ t / max((t * t).sum(), 1e-12))[:, None] * t
        rate = lambda s: 60 * (one_peak(spectrum(s), fps / len(s)) or 0.0) if len(s) >= 30 else 0.0
        out = []
        for row in plain:
            passed = run_sections(row, sections)
            out.append({"with_bandpass": rate(passed), "without_bandpass": rate(row), "apart": float(np.std(passed - row))})
        return out

    return by_window(wins, made, "with_bandpass double, without_bandpass double, apart double", ("r", "g", "b"))
