"""Time alignment of predictions to references (survey E).

One-to-one pairs come from a sweep over both sides in order of time. Candidate pairs of the others come from an equi join on
(session, time bucket of the tolerance's width, its neighbours too), not from a range join, so the plan hashes and no side is
sent whole.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


#: Chains of a session that one call reads.
CHAINS = 256


def candidates(pred: DataFrame, ref: DataFrame, tolerance: float, strict: bool = False) -> DataFrame:
    """Pairs of pred (session, id, t, x) and ref (session, id, t, x) at most `tolerance` seconds apart (strict: less)."""
    width = max(tolerance, 1e-6)
    a = pred.where(~F.isnan("t") & ~F.isnan("x")).select("session", F.col("id").alias("pred_id"), F.col("t").alias("pred_t"), F.col("x").alias("pred_x"))
    a = a.withColumn("bucket", F.explode(F.expr(f"sequence(cast(floor(pred_t / {width}) as bigint) - 1, cast(floor(pred_t / {width}) as bigint) + 1)")))
    b = ref.select("session", F.col("id").alias("ref_id"), F.col("t").alias("ref_t"), F.col("x").alias("ref_x")).withColumn("bucket", F.floor(F.col("ref_t") / width))
    apart = F.abs(F.col("pred_t") - F.col("ref_t"))
    return a.join(b, ["session", "bucket"]).drop("bucket").withColumn("apart", apart).where(F.col("apart") < tolerance if strict else F.col("apart") <= tolerance)


def nearest(pred: DataFrame, ref: DataFrame, tolerance: float) -> DataFrame:
    """Each prediction with its nearest reference, which others may have too; of equally near ones the earliest.

    An aggregate with a map side, not a window: a prediction's candidates are never sorted.
    """
    best = F.min(F.struct("apart", "ref_t", "ref_id", "ref_x")).alias("best")
    return candidates(pred, ref, tolerance).groupBy("session", "pred_id", "pred_t", "pred_x").agg(best).select("session", "pred_id", "pred_t", "pred_x", "best.ref_id", "best.ref_t", "best.ref_x", "best.apart")


def greedy(pred: DataFrame, ref: DataFrame, tolerance: float, order: str = "t", compat: bool = False) -> DataFrame:
    """E1 (compat: E3, which allows anything less than tolerance + 1): one-to-one pairs, predictions in `order`.

    Each prediction takes the nearest reference that is still free, of equal ones the earliest. In order of time a session is
    swept: references and predictions come sorted, and only the free references within reach of the present prediction are
    held, however long the session is. Rows without a finite time, and predictions without a finite x, take no part.
    """
    reach = tolerance + 1 if compat else tolerance
    if order != "t":
        return _greedy_by(pred, ref, reach, order, compat)
    slack = 1e-6 + 1e-9 * reach  # a reference comes in a little early; what counts is the exact distance
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    cols = ("session", "id", "t", "x")
    a = pred.where(finite("t") & finite("x")).select(*cols, F.lit(1).alias("side"), F.col("t").alias("at"))
    b = ref.where(finite("t")).select(*cols, F.lit(0).alias("side"), (F.col("t") - (reach + slack)).alias("at"))
    types, theirs = dict(pred.dtypes), dict(ref.dtypes)
    out = {"session": types["session"], "pred_id": types["id"], "ref_id": theirs["id"], "pred_t": "double", "ref_t": "double", "pred_x": types["x"], "ref_x": theirs["x"], "apart": "double"}

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session: object = object()
        times, refs = [], []  # of the free references within reach, in order of time
        for batch in batches:
            found: list[tuple] = []
            for s, i, t, x, side in zip(*(batch.column(c).to_pylist() for c in (*cols, "side")), strict=True):
                if s != session:
                    session, times, refs = s, [], []
                if not side:
                    times.append(t)
                    refs.append((i, x))
                    continue
                gone = bisect_left(times, t - reach - slack)
                del times[:gone], refs[:gone]
                best = nearest_free(times, t)
                if best is not None:
                    apart = abs(t - times[best])
                    if apart < reach or (apart == reach and not compat):
                        found.append((s, i, refs[best][0], t, times[best], x, refs[best][1], apart))
                        del times[best], refs[best]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kinds[c]) for k, c in enumerate(out)], list(out))

    schema = StructType.fromDDL(", ".join(f"{c} {t}" for c, t in out.items()))
    kinds = {f.name: f.type for f in to_arrow_schema(schema)}
    return a.unionByName(b).repartition("session").sortWithinPartitions("session", "at", "side", "t", "id").mapInArrow(sweep, schema)


def nearest_free(times: list[float], t: float) -> int | None:
    """The place of the time nearest to t, of equally near or equal ones the first."""
    if not times:
        return None
    after = bisect_left(times, t)
    if after and (after == len(times) or t - times[after - 1] <= times[after] - t):
        return bisect_left(times, times[after - 1])
    return after


def _greedy_by(pred: DataFrame, ref: DataFrame, reach: float, order: str, strict: bool) -> DataFrame:
    """greedy() with predictions in another order than that of time.

    The choice is sequential within a chain of predictions that compete; sessions are cut where consecutive candidates are
    further apart than the reach, so a task holds one chain, not a session (a session without such a gap is one chain).
    """
    pred = pred.withColumn("o", F.col(order))
    pairs = candidates(pred, ref, reach, strict=strict).join(pred.select("session", F.col("id").alias("pred_id"), "o"), ["session", "pred_id"])
    times = pairs.select("session", F.col("pred_t").alias("at")).union(pairs.select("session", F.col("ref_t").alias("at"))).distinct()
    w = Window.partitionBy("session").orderBy("at")
    chains = times.withColumn("chain", F.sum(F.when(F.col("at") - F.lag("at").over(w) > reach, 1).otherwise(0)).over(w))
    pairs = pairs.join(chains.withColumnRenamed("at", "pred_t"), ["session", "pred_t"])

    out = ("session", "pred_id", "ref_id", "pred_t", "ref_t", "pred_x", "ref_x", "apart")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["o", "pred_id", "apart", "ref_t", "ref_id"])
        taken, served, kept = set(), set(), []
        for i, (p, r) in enumerate(zip(rows["pred_id"], rows["ref_id"], strict=True)):
            if p not in served and r not in taken:
                served.add(p)
                taken.add(r)
                kept.append(i)
        return rows.iloc[kept][list(out)]

    types = dict(pairs.dtypes)
    several = F.floor(F.col("chain") / CHAINS)  # chains don't compete, so some share a call
    return pairs.groupBy("session", several).applyInPandas(choose, ", ".join(f"{c} {types[c]}" for c in out))


def by_index(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """The last n of both by place from the end."""
    w = Window.partitionBy("session").orderBy(F.col("t").desc(), F.col("id").desc())
    a = pred.select("session", F.row_number().over(w).alias("back"), F.col("x").alias("pred_x"))
    b = ref.select("session", F.row_number().over(w).alias("back"), F.col("x").alias("ref_x"))
    return a.join(b, ["session", "back"])


def summary(pred: DataFrame, matched: DataFrame) -> DataFrame:
    """Matches, unmatched predictions and rate by session; rates are over all predictions."""
    n = pred.groupBy("session").agg(F.count("*").alias("predictions"))
    m = matched.groupBy("session").agg(F.count("*").alias("matches"), F.avg("apart").alias("mean_apart"), F.max("apart").alias("max_apart"))
    j = n.join(m, "session", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return j.withColumn("unmatched", F.col("predictions") - F.col("matches")).withColumn("rate", F.col("matches") / F.col("predictions"))


def days(n: float) -> float:
    return math.fabs(n) * 86400.0
