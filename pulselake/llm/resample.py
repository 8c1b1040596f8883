"""Target-distribution importance resampling over hashed runs of one to three words.

A feature's bucket is the CRC-32 of its bytes modulo the number of buckets. A CRC of `a b` is the CRC state of `a ` carried over
the bytes of `b`, which is a linear map that depends on their number only, so a feature costs a few table reads. The head of
the vocabulary is sent to all tasks: the states of frequent words, and the states and buckets of frequent pairs. Words and
pairs outside it take the CRC of their own bytes, so totals and weights are the same whatever the head is.

Documents are read three times (head, totals, weights); what moves between tasks are frequent words, a count for each bucket
and task, and four numbers a document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, partitions, split_words, starts, written

BUCKETS = 10_000
#: The head: words and pairs that make up one in HEAD_SHARE of a block's words or more, the most frequent ones of all blocks.
HEAD_SHARE, HEAD_WORDS, HEAD_PAIRS = 20_000, 32_768, 65_536
#: Bytes of the longest word whose linear map is tabled, and of the head's longest word.
TABLED = 64
#: A-Z to a-z; ASCII characters other than letters and digits separate words; other bytes are letters.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Positions of words handled at once.
STEP = 1 << 19


def _tables() -> np.ndarray:
    """[n, k, v]: what n zero bytes make of a CRC whose byte k is v, the other bytes 0 (n up to TABLED)."""
    one = np.array([zlib.crc32(bytes([v])) ^ zlib.crc32(b"\0") for v in range(256)], np.uint32)
    now = np.array([[v << (8 * k) for v in range(256)] for k in range(4)], np.uint32)
    out = [now]
    for _ in range(TABLED):
        now = (now >> np.uint32(8)) ^ one[now & np.uint32(255)]
        out.append(now)
    return np.stack(out)


TABLES = _tables().reshape(-1)
SPACE = np.uint32(zlib.crc32(b" "))


def carried(state: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC states after `length` zero bytes more (TABLED at most); with the CRC of as many bytes the CRC of both together."""
    at = length.astype(np.intp) << 10
    out = TABLES[at + (state & np.uint32(255))]
    for k in (1, 2, 3):
        out ^= TABLES[at + (k << 8) + ((state >> np.uint32(8 * k)) & np.uint32(255))]
    return out


@dataclass
class Head:
    """Frequent words with their states (of the word, and of the word and a space), and frequent pairs of them by number."""

    words: pa.Array
    states: np.ndarray
    spaced: np.ndarray
    pairs: np.ndarray  #: ascending: number of the first word << 32 | number of the second
    pair_states: np.ndarray
    pair_buckets: np.ndarray


def _direct(words: pa.Array) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint32, len(words))


def head(words: list[str], pairs: list[str], buckets: int = BUCKETS) -> Head:
    number = {w: i for i, w in enumerate(words)}
    rows = sorted((number[a] << 32 | number[b], zlib.crc32(p.encode())) for p in pairs for a, b in [p.split(" ")] if a in number and b in number)
    states = _direct(column := pa.array(words, pa.large_string()))
    pair_states = np.array([s for _, s in rows], np.uint32)
    return Head(column, states, carried(states, np.ones(len(states), np.int64)) ^ SPACE, np.array([k for k, _ in rows], np.int64), pair_states, (pair_states % np.uint32(buckets)).astype(np.int32))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, n): words and pairs that make up one in HEAD_SHARE of a block's words or more."""
    for b in blocks(batches):
        counts, codes, words = split_words(b.column("text"), table=WORDS)
        least = max(2, len(codes) // HEAD_SHARE)
        n = np.bincount(codes, minlength=len(words))
        few = np.flatnonzero((n >= least) & (pc.binary_length(words).to_numpy(zero_copy_only=False) <= TABLED))
        names = words.take(pa.array(few)).to_pylist()
        place = np.full(len(words), -1, np.int64)
        place[few] = np.arange(len(few))
        at = place[codes]
        last = np.zeros(len(codes), bool)
        last[starts(counts)[1:][counts > 0] - 1] = True
        both = np.flatnonzero(~last[:-1] & (at[:-1] >= 0) & (at[1:] >= 0))
        keys, m = np.unique(at[both] * max(len(few), 1) + at[both + 1], return_counts=True)
        keys, m = keys[m >= least], m[m >= least]
        pairs = [f"{names[k // len(few)]} {names[k % len(few)]}" for k in keys.tolist()]
        yield pa.RecordBatch.from_pydict({"feature": pa.array([*names, *pairs], pa.string()), "n": pa.array([*n[few].tolist(), *m.tolist()], pa.int64())})


def frequent(docs: DataFrame, buckets: int = BUCKETS) -> Head:
    """The head of all texts of docs; every word of a share of 1 / HEAD_SHARE of the words passes in some block."""
    rows = docs.select(F.col("text").cast("string")).mapInArrow(_candidates, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    two = F.contains(F.col("feature"), F.lit(" "))
    rows = written(rows, "resample-head")
    first = lambda side, most: [r.feature for r in rows.where(side).orderBy(F.desc("n"), "feature").limit(most).collect()]  # noqa: E731  HEAD_WORDS or HEAD_PAIRS rows
    return head(first(~two, HEAD_WORDS), first(two, HEAD_PAIRS), buckets)


def _features(counts: np.ndarray, codes: np.ndarray, words: pa.Array, known: Head, buckets: int) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
    """Of a stretch of word positions: its start, the number of words up to the text's end, and the buckets of the runs of one, two and three words from there."""
    raw = None
    length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    number = pc.fill_null(pc.index_in(words.cast(pa.large_string()), known.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    state = np.zeros(len(words), np.uint32)
    tail = number < 0
    state[tail] = _direct(words.filter(pa.array(tail)))
    state[~tail] = known.states[number[~tail]]
    spaced = carried(state, np.ones(len(state), np.int64)) ^ SPACE
    spaced[~tail] = known.spaced[number[~tail]]
    bucket = (state % np.uint32(buckets)).astype(np.int32)
    left_of = np.repeat(starts(counts)[1:], counts) - np.arange(len(codes))

    def joined(before: np.ndarray, code: np.ndarray) -> np.ndarray:
        nonlocal raw
        size = length[code]
        out = carried(before, np.minimum(size, TABLED)) ^ state[code]
        for i in np.flatnonzero(size > TABLED):
            raw = raw or words.cast(pa.large_binary())
            out[i] = zlib.crc32(raw[int(code[i])].as_py(), int(before[i]))
        return out

    for at in range(0, len(codes), STEP):
        left = left_of[at : at + STEP]
        one = codes[at : at + STEP]
        i = np.flatnonzero(left > 1)
        a, b = one[i], codes[at + 1 + i]
        pair = np.empty(len(i), np.uint32)
        pair_bucket = np.empty(len(i), np.int32)
        key = np.where((number[a] >= 0) & (number[b] >= 0), number[a] << 32 | number[b], -1)
        found = np.minimum(np.searchsorted(known.pairs, key), max(len(known.pairs) - 1, 0))
        hit = known.pairs[found] == key if len(known.pairs) else np.zeros(len(i), bool)
        pair[hit], pair_bucket[hit] = known.pair_states[found[hit]], known.pair_buckets[found[hit]]
        pair[~hit] = joined(spaced[a[~hit]], b[~hit])
        pair_bucket[~hit] = pair[~hit] % np.uint32(buckets)
        three = left[i] > 2
        triple = joined(carried(pair[three], np.ones(int(three.sum()), np.int64)) ^ SPACE, codes[at + 2 + i[three]])
        yield at, left, (bucket[one], pair_bucket, (triple % np.uint32(buckets)).astype(np.int32))


def totals(texts: DataFrame, known: Head, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in blocks(batches):
            for _, _, found in _features(*split_words(b.column("text"), table=WORDS), sent.value, buckets):
                for x in found:
                    n += np.bincount(x, minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "n": pa.array(n[used])})

    rows = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # `buckets` rows
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much more often, smoothed, a bucket occurs in the target than in the corpus."""
    s, t, buckets = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * (s + buckets) / ((float(x) + 1) * (t + buckets)))) for x, y in zip(corpus, target, strict=True)], np.int64)


def weigh(docs: DataFrame, known: Head, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document: the sum of its features' gains."""
    sent = docs.sparkSession.sparkContext.broadcast((known, gain))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gain = sent.value
        for b in blocks(batches):
            counts, codes, words = split_words(b.column("text"), table=WORDS)
            doc = np.repeat(np.arange(len(counts)), counts)
            weight = np.zeros(len(counts), np.int64)
            for at, left, found in _features(counts, codes, words, known, len(gain)):
                value = gain[found[0]].copy()
                value[left > 1] += gain[found[1]]
                value[left > 2] += gain[found[2]]
                own = doc[at : at + STEP]
                edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                weight[own[edge]] += np.add.reduceat(value, edge)
            n = sum(np.maximum(counts - k, 0) for k in range(3))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_words": pa.array(counts), "n_features": pa.array(n), "weight": pa.array(weight)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(add, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs (doc_id, text, ...): rank 1, 2, ... of those drawn, else null.

    score is the weight and Gumbel noise from sha256 of `seed:doc_id`, in thousandths; the highest floor(percent N / 100)
    scores of the N documents with at least least_words words are drawn, which is sampling without replacement by weight.
    A null text has no words. Without doc_id a row has no score and takes no part in the draw; rows that repeat take part
    each by itself, in any order. An empty target or table weighs by smoothing alone.
    """
    known = frequent(docs, buckets)
    gain = gains(totals(docs, known, buckets), totals(target, known, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = weigh(docs, known, gain).withColumn("score", F.col("weight") + noise)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "resample-weights")  # row: tells equal rows apart
    takes_part = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    drawn = rows.where(takes_part).count() * percent // 100
    order = (F.col("score").desc(), F.col("doc_id"), F.col("row"))
    # ranks by ranges: in each range a row's place, and before it the rows of the ranges before
    ordered = rows.where(takes_part).repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ordered = written(ordered, "resample-order").withColumn("range", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1))
    sizes = sorted((r["range"], r["n"]) for r in ordered.groupBy("range").agg(F.count("*").alias("n")).collect())  # a row for each range
    bases = [(k, int(b)) for (k, _), b in zip(sizes, starts(np.array([n for _, n in sizes], np.int64)), strict=False)]
    ranked = ordered.join(F.broadcast(docs.sparkSession.createDataFrame(bases, "range long, base long")), "range").withColumn("rank", F.col("base") + F.col("place") + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(F.coalesce(~takes_part, F.lit(True))).withColumn("rank", F.lit(None).cast("long"))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*out).unionByName(rest.select(*out))
