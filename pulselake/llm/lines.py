"""Line dedup: a segment-partition edit join of lines, verified with a banded bit-parallel edit distance.

A line may have an edit for every EVERY code points, EDITS at most, and is cut into one segment more, of even length. Of two
lines within the shorter one's edits the longer holds a segment of the
shorter at a place that only a few starts allow (the multi-match-aware ones of partition joins), so each line gives the
hashes of its segments, with its length, and asks for the substrings that could be a segment of a line up to EDITS shorter.
Equal hashes are candidates, in large groups those with a few of the group first (closing.py does the rest); they are
verified on the lines. Lines within reach of each other, directly or by others, are one class, of which the first line by
(doc_id, place) stays. Two 64-bit hashes of a line must agree before an occurrence of it goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .closing import closing_links
from .common import blocks, buckets_for, hot_join, mix, ranges, starts, written
from .graphs import components

#: Edits (insertions, deletions, replacements of code points) between near lines.
EDITS = 2
#: A line has an edit for so many code points: lines of 24 two, of 12 to 23 one; shorter ones are equal or not.
EVERY = 12
#: Groups of equal hashes that would give more pairs than FEW give those with PIVOTS lines of each side, and are closed later.
FEW, PIVOTS = 64, 4
#: Text bytes of a block whose lines are hashed at once: each code point has several 64-bit numbers then.
PACKED_BLOCK = 3 << 20
#: Base of the substring hashes (any odd number) and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)

PAIR, ASKED, ASKING, LINE = 0, 1, 2, 3


def segments(length: np.ndarray, edits: int = EDITS) -> tuple[np.ndarray, np.ndarray]:
    """(lines, edits + 1) starts and lengths of the even segments; the last ones are the longer."""
    k = edits + 1
    size = length[:, None] // k + (np.arange(k) >= k - (length % k)[:, None])
    return np.cumsum(size, axis=1) - size, size


def allowed(length: np.ndarray, edits: int = EDITS, every: int = EVERY) -> np.ndarray:
    """Edits between a line of this length and one that isn't shorter."""
    return np.minimum(edits, np.asarray(length) // every)


def line_keys(lines: list[str], edits: int = EDITS, every: int = EVERY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes to be asked for and their lines, hashes that ask and their lines."""
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    power = np.full(len(code) + 1, BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    back = np.full(len(code) + 1, INVERSE, np.uint64)
    back[0] = 1
    back = np.cumprod(back, dtype=np.uint64)
    upto = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code * power[:-1], out=upto[1:], dtype=np.uint64)
    del code, power
    first = starts(n)[:-1]

    def hashed(line: np.ndarray, at: np.ndarray, size: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
        a = first[line] + at
        return mix((upto[a + size] - upto[a]) * back[a] + mix((length * 16 + i).astype(np.uint64)))

    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    holds, asks = [none], [none]
    for e in range(1, edits + 1):
        own = np.flatnonzero(allowed(n, edits, every) == e)
        at, size = segments(n[own], e)
        holds += [(hashed(own, at[:, i], size[:, i], n[own], i), own) for i in range(e + 1)]
        for shorter in range(e + 1):
            own = np.flatnonzero((n >= shorter) & (allowed(n - shorter, edits, every) == e))
            length = n[own] - shorter
            at, size = segments(length, e)
            for i in range(e + 1):
                low, high = max(-i, shorter - (e - i)), min(i, shorter + (e - i))
                for move in range(low, high + 1):
                    p = at[:, i] + move
                    ok = (p >= 0) & (p + size[:, i] <= n[own])
                    asks.append((hashed(own[ok], p[ok], size[ok, i], length[ok], i), own[ok]))
    return (*map(np.concatenate, zip(*holds, strict=True)), *map(np.concatenate, zip(*asks, strict=True)))


def letter_counts(line: str) -> np.ndarray:
    return np.bincount(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") & 127, minlength=128)


def _stripped(a: str, b: str) -> tuple[str, str]:
    """Without what both begin and end with, which changes no edit distance; the longer first."""
    if len(a) < len(b):
        a, b = b, a
    for turn in (1, -1):
        x, y = (a, b) if turn == 1 else (a[::-1], b[::-1])
        lo, hi = 0, len(y)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if x[lo:mid] == y[lo:mid]:
                lo = mid
            else:
                hi = mid - 1
        a, b = (a[lo:], b[lo:]) if turn == 1 else (a[: len(a) - lo], b[: len(b) - lo])
    return a, b


def _short(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def within(pairs: list[tuple[str, str]], edits: int = EDITS) -> np.ndarray:
    """Whether the edit distance of each pair is at most `edits` (below 32).

    All pairs go through the band together, a column of the table in each step: one 64-bit word of a pair holds the
    vertical differences of the band's rows (row of bit 63: column + edits), after Myers and Hyyrö.
    """
    out = np.zeros(len(pairs), bool)
    todo = []
    for i, (a, b) in enumerate(pairs):
        a, b = _stripped(a, b)
        if len(a) - len(b) > edits:
            continue
        if len(a) <= 2 * edits + 1:
            out[i] = _short(a, b) <= edits
        elif np.abs(letter_counts(a) - letter_counts(b)).sum() <= 2 * edits:
            todo.append((i, a, b))
    todo.sort(key=lambda x: len(x[2]))
    at = 0
    while at < len(todo):
        end, most = at, 0
        while end < len(todo) and (end == at or (end - at + 1) * (len(todo[end][1]) + 1) <= 4_000_000):
            end += 1
        part = todo[at:end]
        at = end
        n, m = np.array([len(a) for _, a, _ in part]), np.array([len(b) for _, _, b in part])
        most = int(m.max())
        rows = np.zeros((len(part), int(n.max()) + 2 * edits + 2 + most), np.uint32)  # padded by code point 0 + 1, which no line has after the shift below
        text = np.zeros((len(part), most), np.uint32)
        for k, (_, a, b) in enumerate(part):
            rows[k, edits : edits + len(a)] = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), "<u4") + 1
            text[k, : len(b)] = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), "<u4") + 1
        one = np.uint64(1)
        vp = np.full(len(part), (2**64 - 1) << (63 - edits) & (2**64 - 1), np.uint64)
        vn = np.zeros(len(part), np.uint64)
        distance = np.full(len(part), edits, np.int64)
        level = np.full(len(part), 62, np.int64)
        for j in range(most):
            eq = np.zeros(len(part), np.uint64)
            for t in range(2 * edits + 1):  # row j - edits + t, at bit 63 - 2 edits + t
                eq |= (rows[:, j + t] == text[:, j]).astype(np.uint64) << np.uint64(63 - 2 * edits + t)
            d0 = (((eq & vp) + vp) ^ vp) | eq | vn
            hp, hn = vn | ~(d0 | vp), d0 & vp
            live = j < m
            along = live & (j < n - edits)  # the band's last row is still above the last row of the table
            distance += along & ((d0 >> np.uint64(63)) == 0)
            across = live & ~along
            bit = np.maximum(level, 0).astype(np.uint64)
            distance += across * (((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64))
            level -= across
            vp, vn = hn | ~((d0 >> one) | hp), (d0 >> one) & hp
        for k, (i, _, _) in enumerate(part):
            out[i] = distance[k] <= edits
    return out


def near(pairs: list[tuple[str, str]], edits: int = EDITS, every: int = EVERY) -> np.ndarray:
    """Whether each pair of lines is within the edits that the shorter one has."""
    may = allowed(np.array([min(len(a), len(b)) for a, b in pairs], np.int64), edits, every)
    out = np.zeros(len(pairs), bool)
    for e in np.unique(may):
        at = np.flatnonzero(may == e)
        out[at] = within([pairs[i] for i in at], int(e))
    return out


def _rows(docs: DataFrame) -> DataFrame:
    """Documents as (id, version, text): version tells rows of one doc_id with other texts apart; a null doc_id comes last."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("version"), F.col("text").cast("string").alias("text"))


def _digest(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - 2**63


def _proof(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 1) - 2**63


def _packs(rows: DataFrame, buckets: int, edits: int, every: int) -> DataFrame:
    """For each block of documents and bucket: hashes and their lines, and a share of the block's occurrences of lines.

    Occurrences are only passed on, so they are dealt evenly: those of one line don't meet.
    """
    names = ("held_keys", "held_lines", "ask_keys", "ask_lines", "lines", "proofs", "ids", "versions", "places")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, most=PACKED_BLOCK):
            seen: dict[str, int] = {}
            which, doc, place = [], [], []
            for d, text in enumerate(b.column("text").to_pylist()):
                for p, line in enumerate((text or "").split("\n")):
                    if line and not line.isspace():
                        which.append(seen.setdefault(line, len(seen)))
                        doc.append(d)
                        place.append(p)
            lines = list(seen)
            node = np.fromiter((_digest(x) for x in lines), np.int64, len(lines))
            proof = np.fromiter(map(_proof, lines), np.int64, len(lines))
            held, held_of, asks, asking = line_keys(lines, edits, every)
            parts: dict[int, dict[str, bytes]] = {}
            for keys, of, a, c in ((held, held_of, "held_keys", "held_lines"), (asks, asking, "ask_keys", "ask_lines")):
                home = (keys % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                at = starts(np.bincount(home, minlength=buckets))
                small = np.ascontiguousarray((keys // np.uint64(buckets)).astype("<u8")[order].view(np.uint8).reshape(-1, 8)[:, :6])
                owner = node[of[order]]
                for i in np.flatnonzero(np.diff(at)):
                    parts.setdefault(int(i), {}).update({a: small[at[i] : at[i + 1]].tobytes(), c: owner[at[i] : at[i + 1]].tobytes()})
            which, doc, place = (np.array(x, np.int64) for x in (which, doc, place))
            used = np.array(sorted(parts) or [0], np.int64)
            home = used[np.arange(len(which)) % len(used)]
            order = np.argsort(home, kind="stable")
            at = starts(np.bincount(home, minlength=buckets))
            ids, versions = b.column("id").to_numpy(zero_copy_only=False), b.column("version").to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(np.diff(at)):
                own = order[at[i] : at[i + 1]]
                parts.setdefault(int(i), {}).update({"lines": node[which[own]].tobytes(), "proofs": proof[which[own]].tobytes(), "ids": ids[doc[own]].astype("<i8").tobytes(), "versions": versions[doc[own]].astype("<i8").tobytes(), "places": place[own].tobytes()})
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), *(pa.array([p.get(c, b"") for p in parts.values()], pa.binary()) for c in names)], ["bucket", *names])

    return rows.mapInArrow(pack, "bucket long, " + ", ".join(f"{c} binary" for c in names))


def _wide(blobs: list[bytes]) -> np.ndarray:
    small = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    out = np.zeros((len(small), 8), np.uint8)
    out[:, :6] = small
    return out.view("<i8").ravel()


def _unique(key: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((line, key))
    key, line = key[order], line[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    return key[new], line[new]


def _candidates(rows: DataFrame, buckets: int, edits: int, every: int) -> DataFrame:
    def close(table: pa.Table) -> pa.Table:
        got = {c: table[c].to_pylist() for c in table.column_names}
        held, asks = _wide(got["held_keys"]), _wide(got["ask_keys"])
        held_of, ask_of = (np.frombuffer(b"".join(got[c]), "<i8") for c in ("held_lines", "ask_lines"))
        keep = np.isin(asks, held)
        asks, ask_of = _unique(asks[keep], ask_of[keep])
        keep = np.isin(held, asks)
        held, held_of = _unique(held[keep], held_of[keep])
        key, first, n_held = np.unique(held, return_index=True, return_counts=True)
        n_ask = np.bincount(np.searchsorted(key, asks), minlength=len(key))
        at = np.searchsorted(key, asks)
        few = n_held * n_ask <= FEW
        own = np.flatnonzero(few[at]) if len(at) else at
        x = np.repeat(ask_of[own], n_held[at[own]])
        y = held_of[ranges(first[at[own]], n_held[at[own]])]
        big = np.flatnonzero(~few)
        first_ask = np.searchsorted(asks, key)  # asks are sorted by key, then line
        for i in range(PIVOTS):
            for size, held_side in ((n_held, True), (n_ask, False)):
                own = big[size[big] > i]
                others = n_ask[own] if held_side else n_held[own]
                one = np.repeat(held_of[first[own] + i] if held_side else ask_of[first_ask[own] + i], others)
                x = np.concatenate((x, one))
                y = np.concatenate((y, ask_of[ranges(first_ask[own], others)] if held_side else held_of[ranges(first[own], others)]))
        pairs = np.stack((np.minimum(x, y), np.maximum(x, y)), 1)[x != y]
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
        bucket = got["bucket"][0]
        big_asks, big_held = np.flatnonzero(~few[at]) if len(at) else at, np.flatnonzero(~np.repeat(few, n_held))
        ids, versions, places, lines, proofs = (np.frombuffer(b"".join(got[c]), "<i8") for c in ("ids", "versions", "places", "lines", "proofs"))
        zero = np.zeros(len(pairs) + len(big_asks) + len(big_held), np.int64)
        return pa.table({
            "kind": np.repeat(np.array([PAIR, ASKING, ASKED, LINE], np.int32), [len(pairs), len(big_asks), len(big_held), len(lines)]),
            "a": np.concatenate((pairs[:, 0], asks[big_asks] * buckets + bucket, held[big_held] * buckets + bucket, lines)),
            "b": np.concatenate((pairs[:, 1], ask_of[big_asks], held_of[big_held], ids)),
            "c": np.concatenate((zero, versions)), "d": np.concatenate((zero, places)), "e": np.concatenate((zero, proofs)),
        })

    return _packs(rows, buckets, edits, every).groupBy("bucket").applyInArrow(close, "kind int, a long, b long, c long, d long, e long")


def _texts_of(rows: DataFrame, active: DataFrame) -> DataFrame:
    """(line, text) of active (line, id, version, place)."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            found = {}
            for text, asked, places in zip(b.column("text").to_pylist(), b.column("asked").to_pylist(), b.column("places").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                found.update({line: lines[p] for line, p in zip(asked, places, strict=True) if p < len(lines) and _digest(lines[p]) == line})
            yield pa.RecordBatch.from_pydict({"line": pa.array(list(found), pa.int64()), "text": pa.array(list(found.values()), pa.string())})

    asked = active.groupBy("id", "version").agg(F.collect_list("line").alias("asked"), F.collect_list("place").alias("places"))
    return rows.join(asked, ["id", "version"]).select("text", "asked", "places").mapInArrow(load, "line long, text string").dropDuplicates(["line"])


def _verified(pairs: DataFrame, found: DataFrame, edits: int, every: int) -> DataFrame:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = near(list(zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True)), edits, every)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))

    texts = found.select("line", "text")
    return hot_join(hot_join(pairs, texts.toDF("a", "ta"), "a"), texts.toDF("b", "tb"), "b", counted=pairs).select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")


def pair_counts(line: str, bins: int = 256) -> np.ndarray:
    """How many of a line's pairs of neighbouring code points fall into each bin: an edit changes at most four of them."""
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.bincount((code[:-1] * 31 + code[1:]) % bins, minlength=bins)


def _judge(edits: int, every: int):
    """Of rows with text: which lines can be near by length and the counts of letters and of pairs of them, and which are."""

    def judge(table: pa.Table):
        text = table["text"].to_pylist()
        size = np.array([len(t) for t in text], np.int64)
        letters = np.array([letter_counts(t) for t in text], np.int32).reshape(len(text), 128)
        pairs = np.array([pair_counts(t) for t in text], np.int32).reshape(len(text), 256)

        def possible(x: int, ys: np.ndarray) -> np.ndarray:
            ok = np.abs(size[ys] - size[x]) <= edits
            for counts, most in ((letters, 2 * edits), (pairs, 4 * edits)):
                own = np.flatnonzero(ok)
                ok[own] = np.abs(counts[ys[own]] - counts[x]).sum(1) <= most
            return ok

        return possible, lambda xs, ys: near([(text[x], text[y]) for x, y in zip(xs, ys, strict=True)], edits, every)

    return judge


def duplicates(docs: DataFrame, edits: int = EDITS, every: int = EVERY, buckets: int | None = None) -> DataFrame:
    """(id, version, places): the lines of each document that are not the first of their class; see dedup()."""
    rows = _rows(docs)
    table = written(_candidates(rows, buckets or buckets_for(docs), edits, every), "lines")
    pairs = written(table.where(F.col("kind") == PAIR).select("a", "b").distinct(), "pairs")
    held = table.where(F.col("kind") == LINE).select(F.col("a").alias("line"), F.col("b").alias("id"), F.col("c").alias("version"), F.col("d").alias("place"), F.col("e").alias("proof"))
    members = table.where(F.col("kind").isin(ASKING, ASKED)).select(F.col("a").alias("key"), F.col("b").alias("node"), F.when(F.col("kind") == ASKING, 0).otherwise(1).alias("side"))
    active = pairs.select(F.explode(F.array("a", "b")).alias("line")).union(members.select("node")).distinct()
    firsts = written(held.groupBy("line").agg(F.min(F.struct("id", "version", "place", "proof")).alias("at"), F.count("*").alias("n")).select("line", "at.*", "n"), "firsts")
    place = firsts.join(active, "line").select("line", "id", "version", "place")
    found = written(_texts_of(rows, place), "texts")
    links = written(_verified(pairs, found, edits, every), "links")
    labels = components(links)
    if not members.isEmpty():
        payload = found.select(F.col("line").alias("node"), (F.octet_length("text") + 600).alias("size"), "text")
        more = written(closing_links(members, labels, payload, _judge(edits, every), sided=True), "links")
        if not more.isEmpty():
            labels = components(links.union(more))
    classes = firsts.join(labels.toDF("line", "label"), "line", "left").withColumn("label", F.coalesce("label", "line"))
    winner = classes.groupBy("label").agg(F.min(F.struct("id", "version", "place")).alias("first"), F.sum("n").alias("total")).where("total > 1")
    known = hot_join(classes, winner, "label").select("line", "first", F.col("proof").alias("of"))
    drop = hot_join(held, known, "line").where((F.struct("id", "version", "place") != F.col("first")) & (F.col("proof") == F.col("of")))
    return drop.groupBy("id", "version").agg(F.collect_set("place").alias("places"))


def dedup(docs: DataFrame, edits: int = EDITS, every: int = EVERY, buckets: int | None = None) -> DataFrame:
    """docs (doc_id, text, ...) without the lines that an earlier line repeats, and n_lines, n_dropped long.

    Lines are what "\\n" separates; blank ones always stay. Lines are near when they are at most as many edits apart as the
    shorter one has blocks of `every` code points, and at most `edits`; lines under `every` only when equal. The first line of a class, by doc_id (null last) and place, stays;
    of rows that repeat doc_id and text all are treated alike. A null text stays null and has no lines. All rows stay,
    those left without any line too. Columns of docs named n_lines or n_dropped are replaced.
    """
    drop = duplicates(docs, edits, every, buckets).toDF("__pulselake_id", "__pulselake_version", "__pulselake_places")
    docs = docs.drop("n_lines", "n_dropped")
    keyed = docs.withColumns({"__pulselake_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "__pulselake_version": F.xxhash64(F.col("text").cast("string"))})
    names = docs.columns
    joined = keyed.join(drop, ["__pulselake_id", "__pulselake_version"], "left").select(*(docs[c] for c in docs.columns), "__pulselake_places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, n, gone = [], [], []
            for text, places in zip(b.column("text").to_pylist(), b.column("__pulselake_places").to_pylist(), strict=True):
                if places:
                    out_of = set(places)
                    kept = "\n".join(x for p, x in enumerate(text.split("\n")) if p not in out_of)
                else:
                    kept = text
                out.append(kept)
                n.append(text.count("\n") + 1 if text else 0)
                gone.append(len(places or ()))
            columns = [pa.array(out, pa.string()) if name == "text" else c for name, c in zip(b.schema.names, b.columns, strict=True) if name != "__pulselake_places"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_dropped"])

    return joined.mapInArrow(cut, T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))
