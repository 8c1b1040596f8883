"""Generated signals for tests and demonstrations (survey A14); noise comes from a hash of the row, so it repeats everywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def noise(seed: int, *columns: str) -> Column:
    """About standard normal: twelve hashed uniform numbers, less six."""
    u = [F.pmod(F.xxhash64(F.lit(seed), F.lit(i), *(F.col(c) for c in columns)), F.lit(1_000_003)) / 1_000_003.0 for i in range(12)]
    return sum(u[1:], u[0]) - 6.0


def pulse(spark: SparkSession, sessions: int, n: int, fps: float = 30.0, hz: float = 1.2, sigma: float = 0.1, seed: int = 42) -> DataFrame:
    """(session, seq, t, r, g, b): a cardiac wave, drift and noise on 128 in each channel."""
    rows = spark.range(sessions * n).select(F.floor(F.col("id") / n).alias("session"), (F.col("id") % n).alias("seq"))
    t = F.col("seq") / fps
    wave, drift = F.sin(2 * math.pi * hz * t), F.sin(2 * math.pi * 0.15 * t)
    e = sigma * noise(seed, "session", "seq")
    return rows.select("session", "seq", t.alias("t"), *((128 + a * wave + d * drift + e).alias(c) for c, a, d in (("r", 0.5, 0.3), ("g", 0.75, 0.24), ("b", 0.25, 0.09))))
