"""Closes large groups of candidates: finds links between their members of different components, only as many as connect them.

All pairs of a group are never emitted. Each group has a base, its most frequent component. The other members are held
against all members of that component once, whatever number of groups they share with it, and against each other by group;
both in a grid of chunks of a bounded number of rows and bytes. A task verifies its pairs itself, skips pairs that its
links so far have connected, and emits a spanning forest: fewer links than it has components.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, written

#: Rows and bytes of a chunk, about: a task holds two.
CHUNK, CHUNK_BYTES = 500, 16 << 20

#: Pairs that a task verifies at once, about.
PAIRS = 4096

#: From a task's rows: which of an array of rows can be linked with a row; and of two arrays of rows, which pairs are linked.
Judge = Callable[[pa.Table], tuple[Callable[[int, np.ndarray], np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]]]


def forest(node: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, possible, linked, ordered: bool = False) -> np.ndarray:
    """(links, 2): links between rows of left and right that connect all labels that any links between them connect.

    Pairs are verified in rounds: the next ones of every row together, four times as many in each round, without those that
    links found before connect.
    """
    _, root = np.unique(label, return_inverse=True)
    out, xs, ys = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x in left:
        y = right[root[right] != root[x]]
        if ordered:  # both sides are the same rows
            y = y[node[y] > node[x]]
        if len(y):
            y = y[possible(x, y)]
        xs.append(np.full(len(y), x, np.int64))
        ys.append(y)
    x, y, step = np.concatenate(xs), np.concatenate(ys), 1
    while len(x):
        at = np.arange(len(x))
        rank = at - np.maximum.accumulate(np.where(np.diff(x, prepend=-1) != 0, at, 0))
        now = np.flatnonzero(rank < step)[:PAIRS]
        for i in now[linked(x[now], y[now])]:
            if root[x[i]] != root[y[i]]:
                out.append((min(node[x[i]], node[y[i]]), max(node[x[i]], node[y[i]])))
                root[root == root[y[i]]] = root[x[i]]
        left_over = root[x] != root[y]
        left_over[now] = False
        x, y, step = x[left_over], y[left_over], 4 * step
    return np.array(out, np.int64).reshape(-1, 2)


def _cells(members: DataFrame, labels: DataFrame, sizes: DataFrame, sided: bool) -> DataFrame:
    """(kind, g, i, j, side, node, label): who is held against whom, by cell (i, j) of a group's grid of chunks."""
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    counted = labelled.groupBy("key", "label").agg(F.count("*").alias("m"))
    base = counted.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("base"), F.count("*").alias("labels")).where("labels > 1").select("key", "base")
    still = labelled.join(base, "key")
    whole = still.select(F.lit(0).alias("kind"), F.col("base").alias("g"), F.when(F.col("label") == F.col("base"), 1).otherwise(0).alias("side"), "node", "label").distinct()
    rest = still.where("label <> base")
    several = rest.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    side = F.col("side") if sided else F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    rest = rest.join(several, "key").select(F.lit(1).alias("kind"), F.col("key").alias("g"), side, "node", "label").distinct()
    rows = written(whole.union(rest).join(sizes, "node"), "members")
    chunks = rows.groupBy("kind", "g", "side").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("size") / CHUNK_BYTES)).alias("chunks"))
    grid = chunks.groupBy("kind", "g").agg(F.max(F.when(F.col("side") == 0, F.col("chunks"))).alias("c0"), F.max(F.when(F.col("side") == 1, F.col("chunks"))).alias("c1")).where("c0 IS NOT NULL AND c1 IS NOT NULL")
    grid = grid.select(F.concat_ws(":", "kind", "g").alias("group"), "c0", "c1")
    rows = hot_join(rows.withColumn("group", F.concat_ws(":", "kind", "g")), grid, "group").withColumn("own", F.expr("pmod(xxhash64(node), if(side = 0, c0, c1))")).withColumn("other", F.explode(F.expr("sequence(0L, if(side = 0, c1, c0) - 1)")))
    return rows.select("kind", "g", F.expr("if(side = 0, own, other)").alias("i"), F.expr("if(side = 0, other, own)").alias("j"), "side", "node", "label")


def closing_links(members: DataFrame, labels: DataFrame, payload: DataFrame, judge: Judge, sided: bool, sieve: tuple[DataFrame, Judge] | None = None) -> DataFrame:
    """(a, b) of members (key, node[, side 0 or 1]): with labels (node, component) they connect what any links in a group connect.

    payload (node, size in bytes, ...) has a row for each node, with what judge needs. If sided, links of a group are sought
    between its sides only (others are harmless: they are verified too). sieve: a small payload and a judge whose first function
    is asked which rows of a cell can have a link at all, so that only these fetch the payload.
    """
    cells = ["kind", "g", "i", "j"]
    rows = _cells(members, labels, payload.select("node", "size"), sided)

    def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
        at = table["side"].to_numpy()
        return np.flatnonzero(at == 0), np.flatnonzero(at == 1), not sided and table["kind"][0].as_py() == 1

    if sieve:
        small, judge_small = sieve

        def sift(table: pa.Table) -> pa.Table:
            left, right, ordered = sides(table)
            node, label = table["node"].to_numpy(), table["label"].to_numpy()
            possible, keep = judge_small(table)[0], np.zeros(table.num_rows, bool)
            for x in left:
                ys = right[label[right] != label[x]]
                ys = ys[node[ys] > node[x]] if ordered else ys
                ys = ys[possible(x, ys)] if len(ys) else ys
                keep[ys] = True
                keep[x] |= len(ys) > 0
            return table.select([*cells, "side", "node", "label"]).filter(pa.array(keep))

        # dealt by all of a cell, as the join with the grid leaves a group's cells together
        rows = written(rows.join(small, "node").repartition(*cells).groupBy(*cells).applyInArrow(sift, "kind int, g long, i long, j long, side int, node long, label long"), "members")

    def close(table: pa.Table) -> pa.Table:
        left, right, ordered = sides(table)
        found = forest(table["node"].to_numpy(), table["label"].to_numpy(), left, right, *judge(table), ordered=ordered)
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    return rows.join(payload.drop("size"), "node").repartition(*cells).groupBy(*cells).applyInArrow(close, "a long, b long").distinct()
