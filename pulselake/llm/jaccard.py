"""N-gram Jaccard join: parity sketches joined by pigeonhole, then exact similarity.

A document's set (distinct word shingles) is dealt by hash over the k blocks of a sketch, and each block holds the XOR of
its shingles' hashes: the number of blocks in which two sketches differ is at most the size of the sets' symmetric
difference. Sets of similarity >= 0.8 and sizes a, b differ in at most d = (a + b) / 9 shingles, so of k > d blocks at
least k - d are equal. k is fixed for a band of sizes; a set takes part in its own band and, as the larger side, in the
one below. A block without shingles tells little: it is used only by sets that have at least k - d such blocks.
Candidates pass a second sketch (one bit flipped for each shingle, whose Hamming distance also is a lower bound of the
symmetric difference) and are verified on the sets themselves.

Equal sets are one node. In a group of equal blocks with few nodes all pairs are candidates; in a larger one each node
with the smallest few. After the components of these links are known, larger groups that still span components are closed
(closing.py) by tasks that verify their pairs and emit a spanning forest. So no component is lost that a link would join,
and a large group of copies costs a few stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closing import closing_links
from .common import blocks, buckets_for, hash_strings, hot_join, mix, ranges, sent, shingle_hashes, split_words, starts, written
from .graphs import components

WIDTH, PERCENT = 5, 80
#: Groups of up to FEW nodes give all their pairs at once; larger ones each node with the PIVOTS smallest, and are closed later.
FEW, PIVOTS = 8, 2
#: Bits of the second sketch.
BITS = 4096
#: Ids up to so many are sent to all tasks to fetch their texts; more are joined.
MOST_SENT = 1_000_000


def sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and how many there are. A-Z are lower-cased first."""
    counts, codes, words = split_words(column, lower=True)
    hashes, runs = shingle_hashes(counts, hash_strings(words)[codes], width)
    at = starts(runs)
    for i, j in zip(at[:-1], at[1:], strict=True):
        hashes[i:j].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[at[:-1][runs > 0]] = True
    return hashes[new], np.diff(starts(new.astype(np.int64))[at])


def nodes(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; of the empty set 0."""
    at = starts(n)
    raw = hashes.tobytes()
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[8 * i : 8 * j]) if j > i else 0 for i, j in zip(at[:-1], at[1:], strict=True)), np.uint64, len(n)).view(np.int64)


def bands(most: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(first size, d, k) by band, up to the band of size `most`: in a pair of joint band i the smaller set is of band i."""
    out, first = [], 1
    while True:
        after = max(first + 1, -(-first * 100 // percent))
        largest = after - 1
        d = (largest + largest * 100 // percent) * (100 - percent) // (100 + percent)
        out.append((first, d, d + 2 + d // 10 if d else 1))
        if after > most:
            return out
        first = after


def block_keys(hashes: np.ndarray, n: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each set's blocks in its own band and the band below, and how many keys each set has."""
    table = bands(int(n.max(initial=1)), percent)
    firsts = np.array([b[0] for b in table])
    own = np.searchsorted(firsts, n, side="right") - 1
    owner, keys = [], []
    at = starts(n)
    for shift in (0, 1):
        for band in np.unique(own):
            beta = band - shift
            if band < 0 or beta < 0 or not table[beta][1]:
                continue
            _, d, k = table[beta]
            pick = np.flatnonzero((own == band) & (n > 0))
            if shift:  # only sets that a smaller one of that band can be similar to
                pick = pick[n[pick] * percent <= (firsts[band] - 1) * 100]
            if not len(pick):
                continue
            h = hashes[ranges(at[:-1][pick], n[pick])]
            block = (mix(h + np.uint64(beta + 1)) % np.uint64(k)).astype(np.int64) + k * np.repeat(np.arange(len(pick)), n[pick])
            order = np.argsort(block, kind="stable")
            block, h = block[order], h[order]
            first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            xor = np.bitwise_xor.reduceat(mix(h), first)
            used = block[first]
            zeros = k - np.bincount(used // k, minlength=len(pick))
            lone = np.flatnonzero(zeros >= k - d)
            if len(lone):
                every = (lone[:, None] * k + np.arange(k)).ravel()
                empty = np.setdiff1d(every, used, assume_unique=True)
                used, xor = np.concatenate((used, empty)), np.concatenate((xor, np.zeros(len(empty), np.uint64)))
            keys.append(mix(mix(xor + np.uint64(beta)) + (used % k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            owner.append(pick[used // k])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(len(n), np.int64)
    owner, keys = np.concatenate(owner), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    return keys[order], np.bincount(owner, minlength=len(n))


def flips(hashes: np.ndarray, n: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(sets, bits / 8) bytes: for each set the parity of its shingles by bit."""
    bit = (mix(hashes + np.uint64(0x5DEECE66D)) % np.uint64(bits)).astype(np.int64)
    at, out = starts(n), [np.zeros((0, bits // 8), np.uint8)]
    for i in range(0, len(n), 500):
        part = n[i : i + 500]
        odd = np.bincount(np.repeat(np.arange(len(part)), part) * bits + bit[at[i] : at[i + len(part)]], minlength=len(part) * bits) & 1
        out.append(np.packbits(odd.astype(np.uint8).reshape(len(part), bits), axis=1))
    return np.concatenate(out)


def _packs(docs: DataFrame, buckets: int, width: int) -> DataFrame:
    """For each block of documents and bucket of keys: the sets' ids, how many keys of the bucket each has, and the keys.

    Documents themselves (doc_id, set, size) travel with the packs of their block, dealt evenly: copies of one text don't meet.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            hashes, n = sets(b.column("text"), width)
            node = nodes(hashes, n)
            doc = b.column("doc_id").to_numpy(zero_copy_only=False)
            known = ~b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            _, one = np.unique(node, return_index=True)
            one = np.sort(one[n[one] > 0])
            keys, count = block_keys(hashes[ranges(starts(n)[:-1][one], n[one])], n[one])
            of = np.repeat(np.arange(len(one)), count)
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            by_key = starts(np.bincount(bucket, minlength=buckets))
            used = np.flatnonzero(np.diff(by_key) > 0)
            home = used[np.arange(len(node)) % len(used)] if len(used) else np.arange(len(node)) % buckets
            row_order = np.argsort(home, kind="stable")
            by_row = starts(np.bincount(home, minlength=buckets))
            rows = []
            for i in np.flatnonzero((np.diff(by_key) > 0) | (np.diff(by_row) > 0)):
                at, own = order[by_key[i] : by_key[i + 1]], row_order[by_row[i] : by_row[i + 1]]
                which, times = np.unique(of[at], return_counts=True)
                own = own[known[own]]
                small = np.ascontiguousarray((keys[at] // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
                rows.append((int(i), node[one][which].tobytes(), times.astype("<u4").tobytes(), small.tobytes(), doc[own].astype("<i8").tobytes(), node[own].tobytes(), n[own].astype("<i8").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows, strict=True))], ["bucket", "nodes", "times", "keys", "docs", "sets", "sizes"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, "bucket long, nodes binary, times binary, keys binary, docs binary, sets binary, sizes binary")


#: Kinds of rows that a bucket gives: a candidate pair, a node of a large group (a: its key), a document (a: doc_id, b: node, c: size).
PAIR, MEMBER, DOCUMENT = 0, 1, 2


def pairs_of_groups(key: np.ndarray, node: np.ndarray, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (smaller, larger node), and (key, node) of groups with more than `few` nodes."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[new], node[new]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    found = []
    for m in range(2, few + 1):
        at = first[size == m]
        for i in range(m):
            for j in range(i + 1, m):
                found.append(np.stack((node[at + i], node[at + j]), 1))
    large = size > few
    at = ranges(first[large], size[large])
    for i in range(min(PIVOTS, few + 1)):
        found.append(np.sort(np.stack((np.repeat(node[first[large] + i], size[large]), node[at]), 1), axis=1))
    pairs = np.concatenate(found)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0) if len(pairs) else pairs
    return pairs, np.stack((key[at], node[at]), 1)


def _candidates(docs: DataFrame, buckets: int, width: int) -> DataFrame:
    def close(table: pa.Table) -> pa.Table:
        keys, owner, members = [], [], []
        for r in table.to_pylist():
            raw = np.zeros((len(r["keys"]) // 6, 8), np.uint8)
            raw[:, :6] = np.frombuffer(r["keys"], np.uint8).reshape(-1, 6)
            keys.append(raw.view("<u8").ravel())
            owner.append(np.repeat(np.frombuffer(r["nodes"], "<i8"), np.frombuffer(r["times"], "<u4")))
            members.append(np.stack([np.frombuffer(r[c], "<i8") for c in ("docs", "sets", "sizes")], 1))
        key, node = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(key)
        ends = key[order]
        same = np.zeros(len(ends), bool)
        same[1:] = ends[1:] == ends[:-1]
        same[:-1] |= same[1:]
        keep = order[same]
        pairs, groups = pairs_of_groups(key[keep].view(np.int64), node[keep])
        own = np.concatenate(members)
        bucket = table["bucket"][0].as_py()
        a = np.concatenate((pairs[:, 0], groups[:, 0] * buckets + bucket, own[:, 0]))
        b = np.concatenate((pairs[:, 1], groups[:, 1], own[:, 1]))
        c = np.concatenate((np.zeros(len(pairs) + len(groups), np.int64), own[:, 2]))
        kind = np.repeat(np.array([PAIR, MEMBER, DOCUMENT], np.int32), [len(pairs), len(groups), len(own)])
        return pa.table({"kind": kind, "a": a, "b": b, "c": c})

    return _packs(docs, buckets, width).groupBy("bucket").applyInArrow(close, "kind int, a long, b long, c long")


def _sets_of(docs: DataFrame, active: DataFrame, width: int) -> DataFrame:
    """(node, n, flips, hashes) of active (node, doc_id): each node's set from the text of one of its documents."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            hashes, n = sets(b.column("text"), width)
            node = nodes(hashes, n)
            bits = flips(hashes, n)
            at = starts(n) * 8
            raw = hashes.astype("<u8").tobytes()
            ok = np.flatnonzero((node == b.column("node").to_numpy(zero_copy_only=False)) | b.column("every").to_numpy(zero_copy_only=False))  # rows of one doc_id can have other texts
            if len(ok):
                yield pa.RecordBatch.from_pydict({"node": pa.array(node[ok]), "n": pa.array(n[ok]), "flips": pa.array([bits[i].tobytes() for i in ok], pa.binary()), "hashes": pa.array([raw[at[i] : at[i + 1]] for i in ok], pa.binary())})

    def loaded(ids: DataFrame) -> DataFrame:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sent(ids, MOST_SENT), "doc_id").select("text", "node", "every")
        return rows.mapInArrow(load, "node long, n long, flips binary, hashes binary")  # a row more for a row of docs that repeats changes nothing

    ids = active.groupBy("doc_id").agg(F.min("node").alias("node"), (F.count("*") > 1).alias("every"))
    several = ids.where("every")  # doc_ids with more than one active node: the sets of all their rows, each once
    one = loaded(ids.where("NOT every"))
    return one if several.isEmpty() else one.union(loaded(several).dropDuplicates(["node"]))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b)).sum(-1, dtype=np.int64)


def _verified(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    small = found.select("node", "n", "flips")
    left, right = small.toDF("a", "na", "fa"), small.toDF("b", "nb", "fb")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fa, fb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("fa", "fb"))
            na, nb = (b.column(c).to_numpy() for c in ("na", "nb"))
            ok = possible(na, nb, _distances(fa, fb), percent)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))

    kept = written(hot_join(pairs, left, "a").join(right, "b").select("a", "b", "na", "nb", "fa", "fb").mapInArrow(prune, "a long, b long"), "kept")
    need = kept.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("ha").to_pylist(), b.column("hb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))

    full = found.select("node", "hashes").join(sent(need, MOST_SENT), "node", "left_semi")
    return hot_join(kept, full.toDF("a", "ha"), "a", share=32).join(full.toDF("b", "hb"), "b").select("a", "b", "ha", "hb").mapInArrow(verify, "a long, b long").distinct()


def possible(na: np.ndarray, nb: np.ndarray, differ: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of these sizes that differ in at least so many shingles can be similar."""
    return (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent) & (differ * (100 + percent) <= (na + nb) * (100 - percent))


def _by_sketch(percent: int):
    """Of rows with n and flips: which sets can be similar by sizes and sketches."""

    def judge(table: pa.Table):
        n = table["n"].to_numpy()
        bits = np.frombuffer(b"".join(table["flips"].to_pylist()), np.uint8).reshape(len(n), -1)
        return lambda x, ys: possible(n[x], n[ys], _distances(bits[x], bits[ys]), percent), None

    return judge


def _by_set(percent: int):
    """Of rows with n, flips and hashes: which sets can be similar, and which are."""

    def judge(table: pa.Table):
        n, sets_of = table["n"].to_numpy(), table["hashes"].to_pylist()

        def linked(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
            both = np.array([len(np.intersect1d(np.frombuffer(sets_of[x], "<u8"), np.frombuffer(sets_of[y], "<u8"), assume_unique=True)) for x, y in zip(xs, ys, strict=True)], np.int64)
            return 100 * both >= percent * (n[xs] + n[ys] - both)

        return _by_sketch(percent)(table)[0], linked

    return judge


def worth_closing(members: DataFrame) -> DataFrame:
    """members (key, node) of large groups without those that can't have a link there which isn't known yet.

    Sets that differ in d shingles at most share two of their d + 2 or more blocks at least. A pair that shares a block of a
    small group has been verified there, so what is left shares two large groups: a node that is in one only has no new link,
    nor has the last node of a group. Each round of leaving these out may make more of them.
    """
    now = written(members.distinct(), "members")
    while True:
        size = now.count()
        lone = now.groupBy("key").agg(F.count("*").alias("n")).where("n < 2").select("key")
        open_ = now.join(lone, "key", "left_anti")
        few = open_.groupBy("node").agg(F.count("*").alias("n")).where("n < 2").select("node")
        now = written(open_.join(few, "node", "left_anti").select("key", "node"), "members")
        if now.count() >= 0.9 * size:  # rounds that leave out little cost more than they spare
            return now


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text, ...).

    Words are runs without ASCII white space, A-Z lower-cased. A text with fewer than `width` words has one shingle, one
    without words (or null) none and links with nothing. Two documents link when 100 * intersection >= percent * union;
    component_id is the smallest doc_id that links lead to, the document's own included. Rows of a doc_id that occurs
    again each have their own set and the component of that set. Rows without doc_id are left out.
    """
    table = written(_candidates(docs, buckets or buckets_for(docs), width), "jaccard")
    pairs = table.where(F.col("kind") == PAIR).select("a", "b").distinct()
    members = table.where(F.col("kind") == MEMBER).select(F.col("a").alias("key"), F.col("b").alias("node"))
    owned = table.where(F.col("kind") == DOCUMENT).select(F.col("a").alias("doc_id"), F.col("b").alias("node"), F.col("c").alias("n_shingles"))
    pairs = written(pairs, "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    active = owned.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(asked, "node")
    found = written(_sets_of(docs, active, width), "sets")
    links = written(_verified(pairs, found, percent), "links")
    labels = components(links)
    members = written(worth_closing(members), "members")
    if not members.isEmpty():
        payload = found.withColumn("size", F.octet_length("hashes") + BITS // 8)
        more = written(closing_links(members, labels, payload, _by_set(percent), sided=False, sieve=(found.select("node", "n", "flips"), _by_sketch(percent))), "links")
        if not more.isEmpty():
            labels = components(links.union(more))
    classes = owned.groupBy("node").agg(F.min("doc_id").alias("least"))
    classes = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = hot_join(classes, ids, "component").select("node", "component_id")
    full = hot_join(owned.where("n_shingles > 0"), classes, "node").select("doc_id", "n_shingles", "component_id")
    return full.union(owned.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def representatives(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; all columns stay, and rows without doc_id.

    Of a doc_id that occurs with several texts all rows stay if one of them does; rows that repeat doc_id and text stay alike.
    """
    found = written(join(docs, width, percent), "components")
    gone = found.groupBy("doc_id").agg(F.min(F.col("component_id") != F.col("doc_id")).alias("gone")).where("gone").select(F.col("doc_id").alias("__pulselake_id"))
    return docs.join(sent(gone, MOST_SENT), F.col("doc_id").cast("long") == F.col("__pulselake_id"), "left_anti")
