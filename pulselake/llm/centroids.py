"""Centroid clustering of embeddings in whole numbers, with a vantage-point tree over the centroids.

The vectors are scaled to whole numbers once and written as packs (one Arrow batch each), so that no round decodes arrays of
doubles again. Each round builds a tree of the few centroids on the driver and broadcasts it; a task searches it for all vectors
of a pack side by side, each vector by itself in the order of its own lower bounds, and adds up its vectors by centroid. What
is shuffled are a sum and a count for each centroid, component and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Scaled components from here on would let a squared distance of 64 components pass a long.
BEYOND = 1 << 27


@dataclass
class Tree:
    """One node for each centroid; node i has the children left[i] (near its centroid) and right[i] (far), -1 for none."""

    centroids: np.ndarray  #: by number
    number: np.ndarray  #: the centroid of each node
    children: np.ndarray  #: (nodes, 2)
    span: np.ndarray  #: (nodes, 2, 2): least and largest distance of the centroids of each side to the node's own


def build(centroids: np.ndarray) -> Tree:
    """A vantage-point tree: a node's centroid splits the others at the median of their distances to it."""
    number, children, span = [], [], []

    def add(members: list[int]) -> int:
        at = len(number)
        number.append(members[0])
        children.append([-1, -1])
        span.append([[0.0, 0.0], [0.0, 0.0]])
        rest = members[1:]
        if rest:
            far = {m: float(np.sqrt(float(((centroids[m] - centroids[members[0]]) ** 2).sum()))) for m in rest}
            rest.sort(key=far.__getitem__)
            for side, part in enumerate((rest[: (len(rest) + 1) // 2], rest[(len(rest) + 1) // 2 :])):
                if part:
                    span[at][side] = [far[part[0]], far[part[-1]]]
                    children[at][side] = add(part)
        return at

    if len(centroids):
        add(list(range(len(centroids))))
    return Tree(centroids, np.array(number, np.int64), np.array(children, np.int64).reshape(-1, 2), np.array(span, float).reshape(-1, 2, 2))


def nearest(tree: Tree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector the nearest centroid (of equally near ones the smallest number), its squared distance, and the distances taken.

    Every vector visits the node of its smallest lower bound next, until that bound passes its best distance. Bounds are doubles,
    lowered by more than their error, and a bound equal to the best distance is still followed; distances at nodes are exact.
    """
    n, nodes = len(vectors), len(tree.number)
    best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, nodes, np.int64)
    bound = np.full((n, nodes), np.inf)
    bound[:, 0] = 0.0
    open_rows, taken = np.arange(n), 0
    while len(open_rows):
        node = bound[open_rows].argmin(1)
        go = bound[open_rows, node] <= np.sqrt(best[open_rows].astype(float))
        open_rows, node = open_rows[go], node[go]
        for u in np.unique(node):
            rows = open_rows[node == u]
            d = ((vectors[rows] - tree.centroids[tree.number[u]]) ** 2).sum(1)
            taken += len(rows)
            closer = (d < best[rows]) | ((d == best[rows]) & (tree.number[u] < who[rows]))
            best[rows[closer]], who[rows[closer]] = d[closer], tree.number[u]
            root, own = np.sqrt(d.astype(float)), bound[rows, u]
            bound[rows, u] = np.inf
            for side in (0, 1):
                if tree.children[u, side] >= 0:
                    low, high = tree.span[u, side]
                    bound[rows, tree.children[u, side]] = np.maximum(np.maximum(root - high, low - root) - 1e-9 * (root + high) - 1e-9, own)
    return who, best, taken


def packs(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(ids, nulls, vectors: binary) of the vectors kept, floor(scale * x) as little-endian 32-bit integers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, ids = b.column("embedding"), b.column("vec_id")
            sized = pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False)
            lists, ids = lists.filter(sized), ids.filter(sized)
            x = np.floor(scale * pc.fill_null(lists.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim))
            with np.errstate(invalid="ignore"):
                keep = (np.abs(x) < BEYOND).all(1)  # false for what isn't a number
            if keep.any():
                ids, x = ids.filter(pa.array(keep)), x[keep].astype("<i4")
                row = (pc.fill_null(ids, 0).to_numpy().astype("<i8").tobytes(), pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), x.tobytes())
                yield pa.RecordBatch.from_pydict({n: pa.array([v], pa.binary()) for n, v in zip(("ids", "nulls", "vectors"), row, strict=True)})

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(pack, "ids binary, nulls binary, vectors binary")


def _opened(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for ids, nulls, x in zip(*(b.column(n).to_pylist() for n in ("ids", "nulls", "vectors")), strict=True):
            yield np.frombuffer(ids, "<i8"), np.frombuffer(nulls, bool), np.frombuffer(x, "<i4").reshape(-1, dim).astype(np.int64)


def _seeds(table: DataFrame, k: int, dim: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`; a null vec_id comes last, repeated ones by their components."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, nulls, x in _opened(batches, dim):
            keys = ["~" if null else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i, null in zip(ids, nulls, strict=True)]
            own = sorted(range(len(keys)), key=lambda i: (keys[i], x[i].tolist()))[:k]  # noqa: B023
            yield pa.RecordBatch.from_pydict({"h": [keys[i] for i in own], "x": pa.array([x[i].tolist() for i in own], pa.list_(pa.int64()))})

    rows = table.mapInArrow(first, "h string, x array<long>").orderBy("h", "x").limit(k).collect()  # k rows
    return np.array([r.x for r in rows], np.int64).reshape(-1, dim)


def _sums(dim: int, tree: Callable[[], Tree]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(cluster, part, total) of a task: of each cluster its vectors' number (part -2), distances (-1) and components (0, 1, ...)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree()
        totals = np.zeros((len(t.number), dim + 2), object)  # whole numbers without a bound
        for _, _, x in _opened(batches, dim):
            who, distance, _ = nearest(t, x)
            for c in np.unique(who):
                own = who == c
                d = distance[own]
                totals[c, 0] += int(own.sum())
                totals[c, 1] += int((d >> 32).sum()) * 2**32 + int((d & 0xFFFFFFFF).sum())
                totals[c, 2:] += x[own].sum(0)
        used = [(c, j - 2, str(v)) for c, row in enumerate(totals) for j, v in enumerate(row) if row[0]]
        yield pa.RecordBatch.from_pydict({"cluster": pa.array([u[0] for u in used], pa.int32()), "part": pa.array([u[1] for u in used], pa.int32()), "total": pa.array([u[2] for u in used], pa.string())})

    return add


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept row of vectors (vec_id, embedding, ...).

    Kept are vectors of exactly dim components, none null, infinite or not a number; those with a component that scales to
    2^27 or more, either way, are left out too, as their distances may not fit a long. Rows that repeat count as often as
    they occur; equal centroids get their vectors by the smaller number and the other one stays where it is. Fewer than k
    vectors give as many centroids, none gives no rows. A sum of distances beyond a long is null.
    """
    spark = vectors.sparkSession
    table = written(packs(vectors, dim, scale), "vectors")
    centroids = _seeds(table, k, dim, seed)
    out = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], out + ", cluster_inertia long, inertia long, centroid_sha256 string")

    def totals(tree: Tree) -> dict[tuple[int, int], int]:
        sent = spark.sparkContext.broadcast(tree)  # k centroids
        rows = table.mapInArrow(_sums(dim, lambda: sent.value), "cluster int, part int, total string")
        found = rows.groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # k * (dim + 2) rows
        sent.unpersist()
        return {(r.cluster, r.part): int(r.total) for r in found}

    for _ in range(rounds):
        found = totals(build(centroids))
        centroids = np.array([[found[c, j] // found[c, -2] for j in range(dim)] if (c, -2) in found else old.tolist() for c, old in enumerate(centroids)], np.int64)
    tree = build(centroids)
    found = totals(tree)
    in_long = lambda v: v if v < 2**63 else None
    inertia = in_long(sum(v for (_, part), v in found.items() if part == -1))
    facts = [(c, in_long(found.get((c, -1), 0)), inertia, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, nulls, x in _opened(batches, dim):
            who, distance, _ = nearest(tree, x)
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, mask=nulls), "cluster": pa.array(who, pa.int32()), "distance": pa.array(distance)})

    of = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return table.mapInArrow(assign, out).join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
