"""LM scoring with an Elias-Fano trigram trie, sharded by context.

Blocks of documents send their distinct words to hash buckets, which count them over the table and give each word a number;
the blocks then send their distinct word triples to the shard of the word before. A shard counts its triples, builds the trie,
maps it from a file and answers each block with a value a triple, which the block adds up by document: a triple that every
document has costs a shard a row a block.

Levels of the trie: words as contexts, with back-off weights; each one's successors; the words before each one, which make
two-word contexts with back-off weights; and their successors, each by its place among the successors of the shorter context
(where it must occur). Every level but the first is ranges of ascending numbers that pointers cut, laid out as one Elias-Fano
sequence: a range goes on from the last value before it. A query walks the pointers and searches in its context's range.

Smoothing: interpolated absolute discounting, p(w|h) = max(c(h,w) - D, 0) / c(h) + D n(h) / c(h) p(w|h'), n(h) the number of
h's distinct successors, h' the shorter context, p(w) add-one over all training tokens and one unknown word. The triples of a
word that occurs more than SPREAD times are spread over shards by the successor's hash; counts of its contexts are summed
over the shards before the tries are built, so that scores don't depend on shards, partitions or SPREAD.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, buckets_for, freed, mix, partitions, ranges, starts, written
from .tokens import _dictionary, _pressed, _unpressed, totals

DISCOUNT = 0.75
#: Quantised log10 probabilities: codes 0 to 255 are 0 to LEAST in equal steps.
LEAST = -12.0
#: Tokens of a shard, about, and of a context word that has more than one part.
SHARD_TOKENS, SPREAD = 500_000, 800_000
#: Text bytes of a block: its triples are sorted at once.
BLOCK = 12 << 20
END = 0  #: the number of the end token, which also is the first context of a text

_ZEROS = np.array([8 - bin(b).count("1") for b in range(256)], np.int64)
_PLACE = np.array([([i for i in range(8) if not b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.int64)  # of a byte's zeros


def quantised(log10p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(log10p * (255 / LEAST)), 0, 255).astype(np.uint8)


def dequantised(code: np.ndarray) -> np.ndarray:
    return code * (LEAST / 255)


class EliasFano:
    """A sorted sequence in about 2 + log2(universe / n) bits an element; find() is one directory search and a short binary search."""

    def __init__(self, n: int, low_bits: int, high: np.ndarray, before: np.ndarray, low: np.ndarray):
        self.n, self.low_bits, self.high, self.before, self.low = n, low_bits, high, before, low

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        top = (values >> np.uint64(low_bits)).astype(np.int64)
        bits = np.zeros(-(-(n + (int(top[-1]) if n else 0) + 2) // 64) * 64, np.uint8)
        bits[top + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little")
        before = starts(_ZEROS[high.reshape(-1, 8)].sum(1))[:-1]
        low = np.zeros(n * low_bits, np.uint8)
        for i in range(low_bits):
            low[i::low_bits] = (values >> np.uint64(i)).astype(np.uint8) & 1
        low = np.packbits(low, bitorder="little")
        low = np.pad(low, (0, 16 + -len(low) % 8))
        return b"".join((np.array([n, low_bits, len(high), len(low)], "<i8").tobytes(), high.tobytes(), before.astype("<i8").tobytes(), low.tobytes()))

    @staticmethod
    def view(data: np.ndarray, at: int) -> tuple[EliasFano, int]:
        """The sequence that begins at byte `at` of a (memory-mapped) array, and where it ends."""
        n, low_bits, high, low = (int(x) for x in data[at : at + 32].view("<i8"))
        at += 32
        words = high // 8
        return EliasFano(n, low_bits, data[at : at + high], data[at + high : at + high + 8 * words].view("<i8"), data[at + high + 8 * words : at + high + 8 * words + low]), at + high + 8 * words + low

    def _unpacked(self, many: int) -> bool:
        """Whether the places of ones and zeros are at hand: they are unpacked once for a batch of more queries than the directory has words."""
        if not hasattr(self, "one_at"):
            if many <= len(self.before):
                return False
            bits = np.unpackbits(self.high, bitorder="little").view(bool)
            self.one_at, self.zero_at = np.flatnonzero(bits).astype(np.int32), np.flatnonzero(~bits).astype(np.int32)
        return True

    def zero(self, k: np.ndarray) -> np.ndarray:
        """Where zero k is among the high bits."""
        if self._unpacked(len(k)):
            return self.zero_at[k].astype(np.int64)
        word = np.searchsorted(self.before, k, side="right") - 1
        left = k - self.before[word]
        byte = self.high.reshape(-1, 8)[word]
        upto = np.cumsum(_ZEROS[byte], axis=1)
        which = (upto <= left[:, None]).sum(1)
        which = np.minimum(which, 7)
        row = np.arange(len(k))
        left = left - (upto[row, which] - _ZEROS[byte[row, which]])
        return word * 64 + which * 8 + _PLACE[byte[row, which], left]

    def lows(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low_bits
        at = bit >> 3
        if self.low_bits <= 57:  # eight bytes from any byte on hold them
            if not hasattr(self, "eight"):
                self.eight = np.ndarray((max(len(self.low) - 7, 0),), "<u8", np.ascontiguousarray(self.low), strides=(1,))
            return self.eight[at] >> (bit & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)
        out = np.zeros(len(i), np.uint64)
        for k in range(8):
            out |= self.low[at + k].astype(np.uint64) << np.uint64(8 * k)
        shift = (bit & 7).astype(np.uint64)
        out >>= shift
        out |= np.where(shift > 0, self.low[at + 8].astype(np.uint64) << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return out & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at these places."""
        if self._unpacked(len(i)):
            return ((self.one_at[i] - i).astype(np.uint64) << np.uint64(self.low_bits) | self.lows(i)).astype(np.int64)
        if not hasattr(self, "ones"):
            self.ones = 64 * np.arange(len(self.before), dtype=np.int64) - self.before
        word = np.searchsorted(self.ones, i, side="right") - 1
        left = i - self.ones[word]
        byte = ~self.high.reshape(-1, 8)[word]  # its zeros are the ones
        upto = np.cumsum(_ZEROS[byte], axis=1)
        which = np.minimum((upto <= left[:, None]).sum(1), 7)
        row = np.arange(len(i))
        left = left - (upto[row, which] - _ZEROS[byte[row, which]])
        top = word * 64 + which * 8 + _PLACE[byte[row, which], left] - i
        return (top.astype(np.uint64) << np.uint64(self.low_bits) | self.lows(i)).astype(np.int64)

    def find_in(self, lo: np.ndarray, hi: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Where each value is in its range of a sequence made by laid(), or -1."""
        if not self.n or not len(lo):
            return np.full(len(lo), -1, np.int64)
        at = self.find(np.where(lo > 0, self.get(np.maximum(lo - 1, 0)) + 1, 0) + values)
        return np.where((at >= lo) & (at < hi), at, -1)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, or -1."""
        values = np.asarray(values, np.uint64)
        top = (values >> np.uint64(self.low_bits)).astype(np.int64)
        zeros = int(self.before[-1] + _ZEROS[self.high[-8:]].sum()) if len(self.high) else 0
        out = np.full(len(values), -1, np.int64)
        inside = np.flatnonzero(top < zeros)
        top, low = top[inside], values[inside] & np.uint64((1 << self.low_bits) - 1)
        lo = np.where(top > 0, self.zero(np.maximum(top - 1, 0)) - np.maximum(top - 1, 0), 0)
        hi = self.zero(top) - top
        end = hi.copy()
        while True:  # the first element of the run lo..hi whose low bits reach the value's
            act = np.flatnonzero(lo < hi)
            if not len(act):
                break
            mid = (lo[act] + hi[act]) >> 1
            less = self.lows(mid) < low[act]
            lo[act[less]] = mid[less] + 1
            hi[act[~less]] = mid[~less]
        hit = np.flatnonzero(lo < end)
        hit = hit[self.lows(lo[hit]) == low[hit]]
        out[inside[hit]] = lo[hit]
        return out


def laid(first: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Ranks that ascend in each range first[i]:first[i + 1] as one ascending sequence."""
    n = np.diff(first)
    step = np.zeros(len(n), np.int64)
    step[n > 0] = rank[first[1:][n > 0] - 1] + 1
    return rank + np.repeat(starts(step)[:-1], n)


def _changes(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal rows begin, and each row's run."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


class Trie:
    """Contexts of one and two words, their successors and quantised log10 probabilities, read from one memory-mapped file."""

    SEQUENCES = ("context", "known", "prior", "follow_at", "follow", "longer_at", "longer", "third_at", "third")
    CODES = ("backoff", "code", "longer_backoff", "third_code")

    @staticmethod
    def pack(**levels: np.ndarray) -> bytes:
        """Words: context, known (successors), prior (words before a context), ascending. Ranges: follow (ranks of known) and
        longer (ranks of prior) cut by *_at for each context, third (places among the context's successors) for each longer one."""
        parts = [EliasFano.pack(levels[n]) for n in Trie.SEQUENCES]
        parts += [np.array([len(levels[n])], "<i8").tobytes() + levels[n].tobytes() + bytes(-len(levels[n]) % 8) for n in Trie.CODES]
        return b"".join(parts)

    def __init__(self, file: str):
        data, at = np.memmap(file, np.uint8, "r"), 0
        for name in self.SEQUENCES:
            found, at = EliasFano.view(data, at)
            setattr(self, name, found)
        for name in self.CODES:
            n = int(data[at : at + 8].view("<i8")[0])
            setattr(self, name, data[at + 8 : at + 8 + n])
            at += 8 + n + -n % 8

    def score(self, prior: np.ndarray, context: np.ndarray, word: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        """log10 p(word | prior, context), where unigram is the word's quantised log10 probability. Fastest where equal contexts stand together."""
        value = lambda code, at: dequantised(code[at].astype(np.float64))
        out = dequantised(unigram.astype(np.float64))
        begin, run = _changes(context)
        h = self.context.find(context[begin])
        on = np.flatnonzero(h >= 0)
        lo, hi, longer_lo, longer_hi = (np.zeros(len(h), np.int64) for _ in range(4))
        for ends, (x, y) in ((self.follow_at, (lo, hi)), (self.longer_at, (longer_lo, longer_hi))):
            x[on], y[on] = ends.get(h[on]), ends.get(h[on] + 1)
        known = (h >= 0)[run]
        out[known] += value(self.backoff, h[run[known]])
        rank = self.known.find(word)
        at = np.full(len(word), -1, np.int64)
        ask = np.flatnonzero(known & (rank >= 0))
        at[ask] = self.follow.find_in(lo[run[ask]], hi[run[ask]], rank[ask])
        seen = np.flatnonzero(at >= 0)
        out[seen] = value(self.code, at[seen])
        begin, pair = _changes(context, prior)
        own, rank = run[begin], self.prior.find(prior[begin])
        c = np.full(len(begin), -1, np.int64)
        ask = np.flatnonzero((h[own] >= 0) & (rank >= 0))
        c[ask] = self.longer.find_in(longer_lo[own[ask]], longer_hi[own[ask]], rank[ask])
        on = np.flatnonzero(c >= 0)
        lo3, hi3 = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        lo3[on], hi3[on] = self.third_at.get(c[on]), self.third_at.get(c[on] + 1)
        known = (c >= 0)[pair]
        out[known] += value(self.longer_backoff, c[pair[known]])
        ask = np.flatnonzero(known & (at >= 0))
        third = self.third.find_in(lo3[pair[ask]], hi3[pair[ask]], at[ask] - lo[run[ask]])
        out[ask[third >= 0]] = value(self.third_code, third[third >= 0])
        return out


def build(v: np.ndarray, u: np.ndarray, w: np.ndarray, times: np.ndarray, unigram: np.ndarray, one: tuple, two: tuple) -> bytes:
    """The trie of counted triples (prior u, context v, word w; distinct, sorted by v, u, w; times > 0) with quantised p(w).

    one: contexts, their counts and numbers of distinct successors; two: contexts, priors, and the same of both. Contexts
    ascend, and all have a count; these are counts over all data, the triples those of this shard.
    """
    contexts, count, followers = one
    weight = np.minimum(1.0, DISCOUNT * followers / count)
    of = np.searchsorted(contexts, v)
    known, rank = np.unique(w, return_inverse=True)
    pair, place, back = _grouped(of * max(len(known), 1) + rank)
    pair_times = np.bincount(back, times, len(pair))
    owner = pair // max(len(known), 1)
    p = np.maximum(pair_times - DISCOUNT, 0) / count[owner] + weight[owner] * 10 ** dequantised(unigram[place].astype(np.float64))
    code = quantised(np.log10(p))
    follow_at = np.searchsorted(owner, np.arange(len(contexts) + 1))
    contexts2, priors2, count2, followers2 = two
    weight2 = np.minimum(1.0, DISCOUNT * followers2 / count2)
    prior, prior_rank = np.unique(priors2, return_inverse=True)
    owner2 = np.searchsorted(contexts, contexts2)
    longer_at = np.searchsorted(owner2, np.arange(len(contexts) + 1))
    key2 = owner2 * max(len(prior), 1) + prior_rank  # ascending
    of2 = np.searchsorted(key2, of * max(len(prior), 1) + np.searchsorted(prior, u))
    p = (times - DISCOUNT) / count2[of2] + weight2[of2] * 10 ** dequantised(code[back].astype(np.float64))
    third_at = np.searchsorted(of2, np.arange(len(key2) + 1))
    return Trie.pack(
        context=contexts, known=known, prior=prior, follow_at=follow_at, follow=laid(follow_at, pair % max(len(known), 1)), longer_at=longer_at, longer=laid(longer_at, prior_rank),
        third_at=third_at, third=laid(third_at, back - follow_at[of]), backoff=quantised(np.log10(weight)), code=code, longer_backoff=quantised(np.log10(weight2)), third_code=quantised(np.log10(p)),
    )


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys ascending, where one of each is, and each key's place among them."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(key), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], order[new], place


def score(docs: DataFrame, learn: Column, buckets: int | None = None, tries: bool = False) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of docs (doc_id, text, ...).

    Learns from the rows where learn is true (null: false). Tokens: A-Z lower-cased words between ASCII white space, then one
    end; a null text has the end alone. n_known: tokens that occur in training; base_score: the add-one unigram's log10
    probability; score: the trigram model's. Repeated rows give repeated results. If no row is learned from, every token is
    unknown. docs is read twice, as in tokens.encode(). With tries=True the model instead: (shard, trie binary).
    """
    spark = docs.sparkSession
    buckets = buckets or buckets_for(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))

    def learned(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("learn").to_numpy(zero_copy_only=False).astype(bool)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, most=BLOCK):
            key, counts, codes, words, bucket = _dictionary(b, buckets, lower=True)
            times = np.bincount(codes[np.repeat(learned(b), counts)], minlength=len(words))
            order = np.argsort(bucket, kind="stable")
            sizes = np.bincount(bucket, minlength=buckets)
            at, full = starts(sizes), np.flatnonzero(sizes)
            ordered, times = words.take(pa.array(order)).to_pylist(), times[order]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int64()), pa.array([key] * len(full), pa.binary()), pa.array([zstandard.compress("\n".join(ordered[at[i] : at[i + 1]]).encode(), 3) for i in full], pa.binary()),
                 pa.array([_pressed(times[at[i] : at[i + 1]].astype("<u4")) for i in full], pa.binary())],
                ["bucket", "block", "words", "times"],
            )

    def count(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        lists = [zstandard.decompress(w).decode().split("\n") for w in table["words"].to_pylist()]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        coded = pa.array([w for ws in lists for w in ws], pa.string()).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        times = np.bincount(codes, np.concatenate([_unpressed(t, "<u4") for t in table["times"].to_pylist()]), len(coded.dictionary)).astype(np.int64)
        name = np.array(coded.dictionary.to_pylist(), object)
        by_name = np.argsort(name, kind="stable")
        order = by_name[np.argsort(-times[by_name], kind="stable")]  # frequent words get small numbers, the same ones each time
        number = np.empty(len(order), np.int64)
        number[order] = 1 + bucket + np.arange(len(order)) * buckets
        at = starts(sizes)
        lone = np.arange(len(sizes)) == 0
        return pa.table({
            "block": table["block"], "bucket": table["bucket"],
            "numbers": pa.array([_pressed(number[codes[i:j]].astype("<u8")) for i, j in zip(at, at[1:], strict=False)], pa.binary()),
            "times": pa.array([_pressed(times[codes[i:j]].astype("<u8")) for i, j in zip(at, at[1:], strict=False)], pa.binary()),
            "distinct": np.where(lone, (times > 0).sum(), 0), "tokens": np.where(lone, times.sum(), 0), "most": np.full(len(sizes), times.max(initial=0)),
        })

    packs = rows.mapInArrow(pack, "bucket long, block binary, words binary, times binary")
    words = written(packs.groupBy("bucket").applyInArrow(count, "block binary, bucket long, numbers binary, times binary, distinct long, tokens long, most long"), "words")
    ends = rows.where("learn").count()
    distinct, tokens, most = words.agg(*(F.coalesce(f(c), F.lit(0)) for f, c in ((F.sum, "distinct"), (F.sum, "tokens"), (F.max, "most")))).first()
    n_all, n_distinct = tokens + ends, distinct + (ends > 0)
    below = np.log10(n_all + n_distinct + 1)
    shards = max(partitions(spark), n_all // SHARD_TOKENS + 1)
    spread = SPREAD

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, most=BLOCK):
            key, counts, codes, _, bucket = _dictionary(b, buckets, lower=True)
            yield pa.RecordBatch.from_pydict({
                "block": [key], "doc_ids": pa.array([b.column("doc_id").to_pylist()], pa.list_(pa.int64())), "learn": [np.packbits(learned(b)).tobytes()],
                "counts": [_pressed(counts.astype("<u4"))], "codes": [_pressed(codes.astype("<u4"))], "buckets": [_pressed(bucket.astype("<u4"))],
            })

    def numbered(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
        """Of each block: its row, the words' numbers and counts (the last: the end), and (prior, context, word, document, shard) by token."""
        known = {r["bucket"]: r for r in right.to_pylist()}
        known = [known[k] for k in sorted(known)]
        numbers = np.concatenate([_unpressed(r["numbers"], "<u8") for r in known] or [np.zeros(0, "<u8")]).astype(np.int64)
        times = np.concatenate([_unpressed(r["times"], "<u8") for r in known] or [np.zeros(0, "<u8")]).astype(np.int64)
        for copy, row in enumerate(left.to_pylist()):
            bucket = _unpressed(row["buckets"], "<u4")
            if len(bucket) != len(numbers):
                raise ValueError("a block changed while it was scored: the input must give the same rows when it is read again")
            place = np.argsort(bucket, kind="stable")
            number, c = np.empty(len(place) + 1, np.int64), np.empty(len(place) + 1, np.int64)
            number[place], c[place] = numbers, times
            number[-1], c[-1] = END, ends
            counts = _unpressed(row["counts"], "<u4").astype(np.int64)
            size = counts + 1
            at = starts(size)
            w = np.full(at[-1], len(place), np.int32)
            w[ranges(at[:-1], counts)] = _unpressed(row["codes"], "<u4")
            v, u = np.empty_like(w), np.empty_like(w)
            for x, y in ((v, w), (u, v)):
                x[1:] = y[:-1]
                x[at[:-1]] = len(place)
            home = mix(number.astype(np.uint64))
            share = 1 + c // spread
            shard = ((home[v] + home[w] % share[v].astype(np.uint64)) % np.uint64(shards)).astype(np.int32)
            yield copy, row, number, c, size, u, v, w, np.repeat(np.arange(len(counts), dtype=np.int32), size), shard, share

    def ordered(n: int, *keys: np.ndarray) -> np.ndarray:
        """The stable order by the keys, the first of them first; all but the first below n."""
        if n ** (len(keys) - 1) >= 2**62:
            return np.lexsort(keys[::-1])
        inner = keys[1].astype(np.int64)
        for k in keys[2:]:
            inner = inner * n + k
        order = np.argsort(inner, kind="stable")
        first = keys[0][order]
        return order[np.argsort(first.astype(np.uint16) if shards < 2**16 else first, kind="stable")]

    def triples(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for copy, row, number, c, size, u, v, w, doc, shard, _ in numbered(left, right):
            docs_n = len(size)
            log_c = np.log10(c + 1.0)
            base = np.bincount(doc, log_c[w], docs_n) - size * below
            n_known = totals((c > 0)[w].astype(np.int64), size)
            block = row["block"] + copy.to_bytes(4, "little")
            unigram = quantised(log_c - below)
            order = ordered(len(c), shard, v, u, w)  # documents ascend within
            shard, u, v, w, doc = (x[order] for x in (shard, u, v, w, doc))
            begin, _ = _changes(shard, v, u, w, doc)  # a triple of a document
            again = np.diff(np.append(begin, len(w)))
            shard, u, v, w, doc = (x[begin] for x in (shard, u, v, w, doc))
            begin, of = _changes(shard, v, u, w)  # a triple of the block
            trained = np.bincount(of, np.unpackbits(np.frombuffer(row["learn"], np.uint8))[doc] * again, len(begin))
            shard, u, v, w = (x[begin] for x in (shard, u, v, w))
            cut = starts(np.bincount(shard, minlength=shards))
            info = b"".join((n_known.astype("<i8").tobytes(), size.astype("<i8").tobytes(), base.astype("<f8").tobytes()))
            out.append({"shard": int.from_bytes(block[:6], "little") % shards, "block": block, "doc_ids": row["doc_ids"], "info": info,
                        "docs": _pressed(doc.astype("<u4")), "again": _pressed(again.astype("<u4")), "entries": _pressed(np.diff(np.append(begin, len(doc))).astype("<u4"))})
            for s in np.flatnonzero(np.diff(cut)):
                i, j = cut[s], cut[s + 1]
                new, _ = _changes(v[i:j])
                new2, _ = _changes(v[i:j], u[i:j])
                h = v[i:j][new]
                out.append({"shard": int(s), "block": block, "contexts": _pressed(number[h].astype("<u8")), "times": _pressed(c[h].astype("<u8")), "runs": _pressed(np.diff(np.append(new, j - i)).astype("<u4")),
                            "priors": _pressed(number[u[i:j][new2]].astype("<u8")), "prior_runs": _pressed(np.diff(np.append(new2, j - i)).astype("<u4")), "trained": _pressed(trained[i:j].astype("<u4")),
                            "words": _pressed(number[w[i:j]].astype("<u8")), "unigrams": _pressed(unigram[w[i:j]])})
            freed()
        return pa.Table.from_pylist(out, schema)

    def hot(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of contexts that are spread: the distinct triples by shard, and how often each is trained here."""
        out = []
        for _, row, number, c, _, u, v, w, doc, shard, share in numbered(left, right):
            on = np.flatnonzero(share[v] > 1)
            if not len(on):
                continue
            u, v, w, shard, learn = u[on], v[on], w[on], shard[on], np.unpackbits(np.frombuffer(row["learn"], np.uint8))[doc[on]]
            order = ordered(len(c), shard, v, u, w)
            shard, u, v, w, learn = (x[order] for x in (shard, u, v, w, learn))
            begin, of = _changes(shard, v, u, w)
            trained = np.bincount(of, learn, len(begin))
            shard, u, v, w = (x[begin] for x in (shard, u, v, w))
            cut = starts(np.bincount(shard, minlength=shards))
            for s in np.flatnonzero(np.diff(cut)):
                i, j = cut[s], cut[s + 1]
                out.append({"shard": int(s), **{n: _pressed(number[x[i:j]].astype("<u8")) for n, x in (("priors", u), ("contexts", v), ("words", w))}, "times": _pressed(trained[i:j].astype("<u8"))})
        freed()
        return pa.Table.from_pylist(out, hot_schema)

    binary = ("block", "info", "contexts", "times", "runs", "priors", "prior_runs", "trained", "words", "unigrams", "docs", "again", "entries")
    schema = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in binary)])
    hot_schema = pa.schema([("shard", pa.int64()), *((c, pa.binary()) for c in ("priors", "contexts", "words", "times"))])
    coded = rows.mapInArrow(split, "block binary, doc_ids array<long>, learn binary, counts binary, codes binary, buckets binary").groupBy("block").cogroup(words.groupBy("block"))
    pairs = coded.applyInArrow(triples, "shard long, doc_ids array<long>, " + ", ".join(f"{c} binary" for c in binary))

    def follow(table: pa.Table) -> pa.Table:
        """Of a shard's part of each spread context: count and distinct trained successors of it (prior -1) and of it after each prior."""
        u, v, w, times = (np.concatenate([_unpressed(b, "<u8") for b in table[c].to_pylist()]).astype(np.int64) for c in ("priors", "contexts", "words", "times"))
        (vs, _, vi), (us, _, ui), (ws, _, wi) = map(_grouped, (v, u, w))
        key, _, back = _grouped((vi.astype(np.int64) * len(us) + ui) * len(ws) + wi)
        times = np.bincount(back, times, len(key)).astype(np.int64)
        longer, of = _changes(key // len(ws))
        of_v = key // (len(us) * len(ws))
        pair = _grouped((of_v * len(ws) + key % len(ws))[times > 0])[0] // len(ws)
        shard = table["shard"][0].as_py()
        freed()
        return pa.table({
            "shard": np.full(len(vs) + len(longer), shard), "context": np.concatenate((vs, vs[of_v[longer]])), "prior": np.concatenate((np.full(len(vs), -1), us[key[longer] // len(ws) % len(us)])),
            "count": np.concatenate((np.bincount(of_v, times, len(vs)), np.bincount(of, times, len(longer)))).astype(np.int64),
            "followers": np.concatenate((np.bincount(pair, minlength=len(vs)), np.bincount(of, times > 0, len(longer)))).astype(np.int64),
        })

    if max(most, ends) >= spread:  # else no context is spread
        # the exchanges below both uses of `coded` are the same, so blocks are split and numbered once
        followed = coded.applyInArrow(hot, "shard long, priors binary, contexts binary, words binary, times binary").groupBy("shard").applyInArrow(follow, "shard long, context long, prior long, count long, followers long")
        followed = followed.groupBy("context", "prior").agg(F.sum("count").alias("count"), F.sum("followers").alias("followers"), F.collect_list("shard").alias("shards"))  # a context has no more parts than its count over SPREAD
        pairs = pairs.unionByName(followed.select(F.explode("shards").alias("shard"), "context", "prior", "count", "followers"), allowMissingColumns=True)
    else:
        pairs = pairs.withColumns({c: F.lit(None).cast("long") for c in ("context", "prior", "count", "followers")})
    sum_binary = ("info", "docs", "again", "entries", "values", "trie")
    sum_schema = pa.schema([("block", pa.binary()), ("doc_ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in sum_binary), ("shard", pa.int64())])

    def answer(table: pa.Table) -> pa.Table:
        summed = table.filter(pc.is_valid(table["context"]))
        spread_v, spread_u, spread_count, spread_n = (summed[c].to_numpy() for c in ("context", "prior", "count", "followers"))
        got = table.filter(pc.is_null(table["context"])).to_pylist()
        out = [{c: r[c] for c in ("block", "doc_ids", "info", "docs", "again", "entries")} for r in got if r["info"] is not None]
        got = [r for r in got if r["info"] is None]
        if got:
            flat = lambda name, kind: np.concatenate([_unpressed(r[name], kind) for r in got])
            v_runs = flat("runs", "<u4").astype(np.int64)
            v, v_times = (np.repeat(flat(c, "<u8").astype(np.int64), v_runs) for c in ("contexts", "times"))
            u = np.repeat(flat("priors", "<u8").astype(np.int64), flat("prior_runs", "<u4").astype(np.int64))
            w, unigram, trained = flat("words", "<u8").astype(np.int64), flat("unigrams", "u1"), flat("trained", "<u4").astype(np.int64)
            (vs, one, vi), (us, _, ui), (ws, _, wi) = map(_grouped, (v, u, w))
            v_times = v_times[one]
            key, first, back = _grouped((vi.astype(np.int64) * len(us) + ui) * len(ws) + wi)
            times = np.bincount(back, trained, len(key)).astype(np.int64)
            del vi, ui, wi, trained, v_runs
            v, u, w, unigram = v[first], u[first], w[first], unigram[first]
            of_v = key // (len(us) * len(ws))
            followers = np.bincount(_grouped((of_v * len(ws) + key % len(ws))[times > 0])[0] // len(ws), minlength=len(vs))
            longer, of = _changes(key // len(ws))
            v2, u2 = v[longer], u[longer]
            count2, followers2 = np.bincount(of, times, len(longer)).astype(np.int64), np.bincount(of, times > 0, len(longer)).astype(np.int64)
            if len(spread_v):  # of contexts with parts elsewhere too
                short = spread_u < 0
                followers[np.searchsorted(vs, spread_v[short])] = spread_n[short]
                place = np.searchsorted(key[longer] // len(ws), np.searchsorted(vs, spread_v[~short]) * len(us) + np.searchsorted(us, spread_u[~short]))
                count2[place], followers2[place] = spread_count[~short], spread_n[~short]
            on, on1, on2 = times > 0, v_times > 0, count2 > 0
            trie = build(v[on], u[on], w[on], times[on], unigram[on], (vs[on1], v_times[on1], followers[on1]), (v2[on2], u2[on2], count2[on2], followers2[on2]))
            if tries:
                return pa.Table.from_pylist([{"trie": trie, "shard": table["shard"][0].as_py()}], sum_schema)
            with tempfile.TemporaryDirectory() as folder:
                file = os.path.join(folder, "trie")
                with open(file, "wb") as f:
                    f.write(trie)
                value = Trie(file).score(u, v, w, unigram)
            codes = np.rint(value * (255 / LEAST)).astype("<u2")[back]  # a sum of three codes at most
            del v, u, w, unigram, back, value
            at = starts(np.array([len(_unpressed(r["unigrams"], "u1")) for r in got]))
            out += [{"block": r["block"], "shard": r["shard"], "values": _pressed(codes[i:j])} for r, i, j in zip(got, at, at[1:], strict=False)]
            freed()
        return pa.Table.from_pylist([] if tries else out, sum_schema)

    sums = pairs.groupBy("shard").applyInArrow(answer, "block binary, doc_ids array<long>, " + ", ".join(f"{c} binary" for c in sum_binary) + ", shard long")
    if tries:
        return sums.where("trie IS NOT NULL").select("shard", "trie")

    def total(table: pa.Table) -> pa.Table:
        got = table.to_pylist()
        (head,) = [r for r in got if r["info"] is not None]
        n = len(head["doc_ids"])
        info = np.frombuffer(head["info"], "<i8").reshape(3, n)
        answered = sorted((r for r in got if r["info"] is None), key=lambda r: r["shard"])  # the block's triples are ordered by shard
        codes = np.concatenate([_unpressed(r["values"], "<u2") for r in answered] or [np.zeros(0, "<u2")]).astype(np.int64)
        each = np.repeat(codes, _unpressed(head["entries"], "<u4")) * _unpressed(head["again"], "<u4")
        score = dequantised(np.bincount(_unpressed(head["docs"], "<u4"), each, n))
        return pa.table({"doc_id": pa.array(head["doc_ids"], pa.int64()), "n_tokens": info[1], "n_known": info[0], "base_score": info[2].view("<f8"), "score": score})

    out = sums.groupBy("block").applyInArrow(total, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(int(n_all)).alias("train_tokens"), "base_score", "score")
