"""The folds as stateful streams: per session the state alone is kept, and late rows are dropped by the watermark."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import frames  # noqa: F401  (adds folds)
from ..operators.folds import FOLDS, plain


def run(stream: DataFrame, name: str, lateness: str = "1 hour", idle_ms: int | None = None) -> DataFrame:
    """A streaming df (session, seq, ts timestamp, x[, sqi]) with the fold's outputs, as folds.run() gives in batch.

    Rows of one micro-batch are ordered by time; the state is JSON. A session whose last row is idle_ms behind the watermark is
    forgotten and would begin anew; without idle_ms states are kept.
    """
    step, outputs = FOLDS[name]
    names = [c.split()[0] for c in outputs.split(", ")]
    types = dict(stream.dtypes)
    rows = stream.withWatermark("ts", lateness).where("x IS NOT NULL").withColumn("t", F.unix_micros("ts") / 1e6)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = json.loads(state.get[0]) if state.exists else {}
        table = pd.concat(list(batches)).sort_values(["t", "seq"])
        out = []
        for row in table.to_dict("records"):
            now, got = step(now, plain(row))
            out.append([key[0], row["seq"], *(got[n] for n in names)])
        state.update((json.dumps(now),))
        if idle_ms is not None:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(1000 * table["t"].max())) + idle_ms)
        yield pd.DataFrame(out, columns=["session", "seq", *names])

    return rows.groupBy("session").applyInPandasWithState(fold, f"session {types['session']}, seq {types['seq']}, {outputs}", "state string", "append", GroupStateTimeout.EventTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout)


def sliding_means(stream: DataFrame, length: str = "10 minutes", hop: str = "5 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sliding event-time windows of a streaming df (session, ts, x): count and mean, final once the watermark has passed."""
    w = F.window("ts", length, hop).alias("w")
    return stream.withWatermark("ts", lateness).groupBy("session", w).agg(F.count("x").alias("n"), F.avg("x").alias("mean")).select("session", F.col("w.start").alias("start"), "n", "mean")
