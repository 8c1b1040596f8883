"""Pixel and cell grids (survey I) as long tables (frame, y, x, v)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip


def cells(pixels: DataFrame, size: int) -> DataFrame:
    """Mean of each size x size cell of each frame."""
    return pixels.groupBy("frame", F.floor(F.col("y") / size).alias("cy"), F.floor(F.col("x") / size).alias("cx")).agg(F.avg("v").alias("v"))


def motion(pixels: DataFrame, size: int, stream: str | None = None) -> DataFrame:
    """Mean |difference to the frame before| by cell, confidence exp(-m / 2) and level; pixels meet their predecessor by an
    equi join. With `stream` frames are those of a stream each, else of one."""
    keys = [stream] if stream else []
    before = pixels.select(*keys, (F.col("frame") + 1).alias("frame"), "y", "x", F.col("v").alias("old"))
    d = pixels.join(before, [*keys, "frame", "y", "x"]).withColumn("v", F.abs(F.col("v") - F.col("old")))
    of = d.groupBy(*keys, "frame", F.floor(F.col("y") / size).alias("cy"), F.floor(F.col("x") / size).alias("cx")).agg(F.avg("v").alias("v"))
    return of.withColumn("confidence", F.exp(-F.col("v") / 2)).withColumn("level", level(F.col("v")))


def level(m: Column, low: float = 0.5, moderate: float = 1.0, high: float = 2.0) -> Column:
    return F.when(m < low, "low").when(m < moderate, "moderate").when(m < high, "high").otherwise("extreme")


def stability(motion_cells: DataFrame, frames: int = 5, stream: str | None = None) -> DataFrame:
    """exp(-5 sd) of a cell's motion over the last frames of its stream."""
    w = Window.partitionBy(*([stream] if stream else []), "cy", "cx").orderBy("frame").rowsBetween(1 - frames, 0)
    return motion_cells.withColumn("stability", F.exp(-5 * F.stddev_pop("v").over(w)))


def aware_quality(quality_db: Column, confidence: Column, stable: Column, mode: str) -> Column:
    """Quality in 0..1 weighed by motion confidence, stability, both, their least, or not at all."""
    q = clip((quality_db + 20) / 40, 0, 1)
    by = {"confidence": confidence, "stability": stable, "product": confidence * stable, "least": F.least(confidence, stable)}
    return clip(q * by.get(mode, F.lit(1.0)), 0, 1)


def regions(mask: DataFrame, side: int) -> DataFrame:
    """I4: (frame, cell, region) of the 4-connected cells of mask (frame, y, x): the region is its smallest cell y * side + x.

    A frame's cells, at most side x side, are one row for the flood fill, so frames spread over all tasks.
    """
    frames = mask.groupBy("frame").agg(F.array_sort(F.collect_set((F.col("y") * side + F.col("x")).cast("long"))).alias("cells"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for frame, cells in zip(b["frame"], b["cells"], strict=True):
                left = {int(c) for c in cells}
                for start in cells:
                    todo = [int(start)] if start in left else []
                    left.discard(int(start))
                    while todo:
                        cell = todo.pop()
                        out.append((frame, cell, int(start)))
                        for near in (cell - side, cell + side, *([cell - 1] if cell % side else []), *([cell + 1] if cell % side < side - 1 else [])):
                            if near in left:
                                left.remove(near)
                                todo.append(near)
            yield pd.DataFrame(out, columns=["frame", "cell", "region"])

    return frames.mapInPandas(fill, f"frame {dict(mask.dtypes)['frame']}, cell long, region long")


def candidates(cells: DataFrame, side: int, least: float, area: int = 2, least_score: float = 0.2, most: int = 10) -> DataFrame:
    """I4: cells (frame, y, x, quality, confidence, stability) to a frame's `most` best regions: (frame, region, cells, y, x, score, rank).

    Regions join cells with quality >= least that share an edge. The score is the product of their means, less the further their
    size is from five; regions under `area` cells or `least_score` go. Of equal scores the smaller region comes first.
    """
    kept = cells.where(F.col("quality") >= least)
    at = regions(kept, side).join(kept.withColumn("cell", (F.col("y") * side + F.col("x")).cast("long")), ["frame", "cell"])
    n = F.count("*")
    score = F.avg("quality") * F.avg("confidence") * F.avg("stability") / (1 + 0.1 * F.abs(n - 5))
    g = at.groupBy("frame", "region").agg(n.alias("cells"), F.avg("y").alias("y"), F.avg("x").alias("x"), score.alias("score")).where((F.col("cells") >= area) & (F.col("score") >= least_score))
    rank = F.row_number().over(Window.partitionBy("frame").orderBy(F.col("score").desc(), "region"))
    return g.withColumn("rank", rank).where(F.col("rank") <= most)


def matched(new: DataFrame, known: DataFrame, reach: float) -> DataFrame:
    """New (stream, region, y, x) with candidate: the first id of known (stream, candidate, y, x) whose centre is nearer than
    reach, null where there is none. Centres of known are those before the frame. An equi join by squares of side reach."""
    square = lambda c: F.floor(F.col(c) / reach)
    near = F.sequence(F.lit(-1), F.lit(1))
    left = new.withColumns({"_y": F.col("y"), "_x": F.col("x")}).withColumn("_i", F.explode(F.transform(near, lambda d: square("y") + d))).withColumn("_j", F.explode(F.transform(near, lambda d: square("x") + d)))
    right = known.select("stream", "candidate", square("y").alias("_i"), square("x").alias("_j"), F.col("y").alias("_ky"), F.col("x").alias("_kx"))
    close = F.sqrt(F.pow(F.col("_y") - F.col("_ky"), F.lit(2)) + F.pow(F.col("_x") - F.col("_kx"), F.lit(2))) < reach
    found = left.join(right, ["stream", "_i", "_j"]).where(close).groupBy("stream", "region").agg(F.min("candidate").alias("candidate"))
    return new.join(found, ["stream", "region"], "left")
