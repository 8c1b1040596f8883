"""BPE encoding and decoding over a table of distinct words.

Each block of documents is split into words once. Its distinct words go to the partition of their hash, where every
distinct word of the whole table is encoded once; the ids come back to the block and are joined to the word positions.
Decoding joins ids to their pieces. A vocabulary whose pre-tokenizer may not join text over ASCII white space is required, and pieces joined by a space
(as with `word_bpe_49k.json`; others raise ValueError), so that a text's ids are the ids of its words in order.
"""

from __future__ import annotations

import functools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, buckets_for, freed, joined, mix, offsets_array, ranges, split_words, starts

#: Words encoded by one call of the library.
WORDS_AT_ONCE = 200
#: Text bytes of a block here: its ids and pieces are held too.
ENCODED_BLOCK = 4 << 20


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


#: Texts that show whether a vocabulary can be encoded word by word and decoded piece by piece.
PROBES = ("one two", "x\n y", "the quick brown fox", "Ünïcode wörds, 123!", "a  b\tc")


@functools.lru_cache(maxsize=4)
def checked(path: str) -> str:
    """path, if its vocabulary gives a text the ids of its words in order and joins pieces by a space; else ValueError."""
    library = tokenizer(path)
    for probe in PROBES:
        ids = library.encode(probe, add_special_tokens=False).ids
        if ids != [i for word in probe.split() for i in library.encode(word, add_special_tokens=False).ids]:
            raise ValueError(f"{path} joins text over white space: its words can't be encoded one by one")
        if library.decode(ids, skip_special_tokens=False) != " ".join(library.id_to_token(i) for i in ids):
            raise ValueError(f"{path} has a decoder other than pieces joined by a space")
    return path


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> pa.Array:
    """The vocabulary as a table: piece of id i at position i, null where an id is free."""
    by_id = {i: piece for piece, i in tokenizer(path).get_vocab(with_added_tokens=True).items()}
    return pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.string())


@functools.lru_cache(maxsize=4)
def piece_bytes(path: str) -> np.ndarray:
    """How many bytes of text each id stands for, where pieces are written a character for a byte; checked where it is used."""
    return np.array([len((p or "").removesuffix("</w>")) for p in pieces(path).to_pylist()], np.int64)


def encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and how many each has.

    Many words are encoded in one call, with spaces between them: a word's ids are those whose bytes make up the word's. Where
    these don't add up (normalisation changed a length) a special token stands between the words instead.
    """
    library = tokenizer(path)
    special = library.get_added_tokens_decoder()
    if special:
        marker, mark = next((t.content, i) for i, t in sorted(special.items()))
        plain = np.fromiter((not any(t.content in w for t in special.values()) for w in words), bool, len(words)) if any("<" in w for w in words) else np.ones(len(words), bool)
    else:
        marker, mark, plain = "", -1, np.zeros(len(words), bool)
    counts = np.zeros(len(words), np.int64)
    own: dict[int, list[int]] = {}
    odd = np.flatnonzero(~plain)
    for i, e in zip(odd, library.encode_batch_fast([words[i] for i in odd], add_special_tokens=False), strict=True):
        own[i] = e.ids
        counts[i] = len(e.ids)
    at = np.flatnonzero(plain)
    runs = [at[i : i + WORDS_AT_ONCE] for i in range(0, len(at), WORDS_AT_ONCE)]
    size = piece_bytes(path)
    parts = [np.zeros(0, np.uint32)] * len(runs)
    left = []
    for r, e in enumerate(library.encode_batch_fast([" ".join(words[i] for i in run) for run in runs], add_special_tokens=False)):
        ids = np.array(e.ids, np.uint32)
        ends = np.cumsum(np.fromiter((len(w) if w.isascii() else len(unicodedata.normalize("NFC", w).lower().encode()) for w in (words[i] for i in runs[r])), np.int64, len(runs[r])))
        upto = np.cumsum(size[ids])
        cut = np.searchsorted(upto, ends)
        if len(upto) and upto[-1] == ends[-1] and np.array_equal(upto[cut], ends):  # each word ends where a piece ends
            counts[runs[r]] = np.diff(cut, prepend=-1)
            parts[r] = ids
        else:
            left.append(r)
    marked = library.encode_batch_fast([marker.join(words[i] for i in runs[r]) for r in left], add_special_tokens=False)
    for r, e in zip(left, marked, strict=True):
        ids = np.array(e.ids, np.uint32)
        cut = np.flatnonzero(ids == mark)
        counts[runs[r]] = np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1
        parts[r] = np.delete(ids, cut)
    out = np.zeros(int(counts.sum()), np.uint32)
    first = starts(counts)
    if parts:
        out[ranges(first[at], counts[at])] = np.concatenate(parts)
    for i, ids in own.items():
        out[first[i] : first[i] + len(ids)] = ids
    return out, counts


def spread(codes: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value runs of `codes` one after the other, where code c has lengths[c] values of flat; and the runs' lengths."""
    each = lengths[codes]
    return flat[ranges(starts(lengths)[:-1][codes], each)], each


def totals(each: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of `each` over runs of these lengths."""
    return np.diff(starts(each)[starts(counts)])


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words one after the other, and the words' starts in them."""
    words = words.cast(pa.large_string())
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8), offsets - offsets[0]


def block_key(doc_ids: pa.Array, counts: np.ndarray, codes: np.ndarray, words: pa.Array) -> bytes:
    """A block is known by its content, so that a block read again (or after a lost executor) keeps its key."""
    h = xxhash.xxh3_128()
    for part in (counts.tobytes(), codes.tobytes(), *(x.tobytes() for x in _flat(words)), repr(doc_ids.to_pylist()).encode()):
        h.update(part)
    return h.digest()


def word_buckets(words: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each (non-empty) word, by a polynomial of its bytes: it only has to be the same for the same word."""
    data, first = _flat(words)
    if not len(words):
        return np.zeros(0, np.int64)
    size = np.diff(first)
    power = np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    terms = (data.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(data)) - np.repeat(first[:-1], size)]
    return (mix(np.add.reduceat(terms, first[:-1])) % np.uint64(buckets)).astype(np.int64)


def _pressed(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    data = np.ascontiguousarray(values)
    return zstandard.compress(np.ascontiguousarray(data.view(np.uint8).reshape(-1, data.itemsize).T).tobytes(), 3)


def _unpressed(blob: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _dictionary(batch: pa.RecordBatch, buckets: int, lower: bool = False) -> tuple[bytes, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """A block's key, word counts, codes (frequent words first), distinct words and the words' buckets."""
    counts, codes, words = split_words(batch.column("text"), lower)
    order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes, words = rank[codes], words.take(pa.array(order))
    bucket = word_buckets(words, buckets)
    return block_key(batch.column("doc_id"), counts, codes, words), counts, codes, words, bucket


def _split(docs: DataFrame, buckets: int) -> DataFrame:
    """Block rows: key, the documents' ids and word counts, a code for each word, and a bucket for each code."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, most=ENCODED_BLOCK):
            key, counts, codes, _, bucket = _dictionary(b, buckets)
            yield pa.RecordBatch.from_pydict({
                "block": [key],
                "doc_ids": pa.array([b.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "counts": [_pressed(counts.astype("<u4"))],
                "codes": [_pressed(codes.astype("<u4"))],
                "buckets": [_pressed(bucket.astype("<u4"))],
            })

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(split, "block binary, doc_ids array<long>, counts binary, codes binary, buckets binary")


def _word_packs(docs: DataFrame, buckets: int) -> DataFrame:
    """For each block and hash bucket, the block's distinct words of that bucket, in the order of their codes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, most=ENCODED_BLOCK):
            key, _, _, words, bucket = _dictionary(b, buckets)
            sizes = np.bincount(bucket, minlength=buckets)
            full = np.flatnonzero(sizes)
            sorted_words = words.take(pa.array(np.argsort(bucket, kind="stable"))).to_pylist()
            at = starts(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int64()), pa.array([key] * len(full), pa.binary()), pa.array([zstandard.compress("\n".join(sorted_words[at[i] : at[i + 1]]).encode(), 3) for i in full], pa.binary())],
                ["bucket", "block", "words"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, "bucket long, block binary, words binary")


def pieces_of(ids: np.ndarray, counts: np.ndarray, path: str) -> pa.ChunkedArray:
    """The text of each run of ids: ids joined to their pieces, pieces joined by a space; ids without a piece are left out."""
    table = pieces(path)
    at, out, first = starts(counts), [], 0
    while first < len(counts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + 1_000_000, side="right")) - 1)
        flat, n = ids[at[first] : at[last]].astype(np.int64), counts[first:last]
        known = flat < len(table)
        found = table.take(pa.array(np.where(known, flat, 0)))
        if not known.all() or found.null_count:
            keep = known & found.is_valid().to_numpy(zero_copy_only=False)
            n, found = totals(keep.astype(np.int64), n), found.filter(pa.array(keep))
        out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(starts(n), pa.int32()), found), " "))
        first = last
    return pa.chunked_array(out, pa.string())


def encode(docs: DataFrame, path: str, buckets: int | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens long, ids binary) for each row of docs (doc_id, text, ...): ids are little-endian unsigned 32-bit.

    With decoded=True also a column `decoded`, as decode() gives, made while the ids are at hand.

    A null text is the empty text, which has no ids. Repeated rows give repeated results; a null doc_id stays null; an
    empty table gives an empty result. Texts are encoded whole, with no special tokens added. docs is read twice, so it
    should be a table (or common.written()); rows in another order the second time raise an error, never other results.
    """
    buckets = buckets or buckets_for(docs)

    checked(path)

    def encode_bucket(table: pa.Table) -> pa.Table:
        lists = [zstandard.decompress(w).decode().split("\n") for w in table["words"].to_pylist()]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        coded = pa.array([w for ws in lists for w in ws], pa.string()).dictionary_encode()
        ids, n = encode_words(coded.dictionary.to_pylist(), path)
        flat, each = spread(coded.indices.to_numpy(zero_copy_only=False), ids, n)
        by_word, by_id = starts(sizes), starts(totals(each, sizes))
        del lists, coded
        freed()
        return pa.table({
            "block": table["block"], "bucket": table["bucket"],
            "n": pa.array([_pressed(each[i:j].astype("<u4")) for i, j in zip(by_word, by_word[1:], strict=False)], pa.binary()),
            "ids": pa.array([_pressed(flat[i:j].astype("<u4")) for i, j in zip(by_id, by_id[1:], strict=False)], pa.binary()),
        })

    def join_back(left: pa.Table, right: pa.Table) -> pa.Table:
        packs = {r["bucket"]: r for r in right.to_pylist()}  # equal blocks send equal packs
        packs = [packs[k] for k in sorted(packs)]
        n = np.concatenate([_unpressed(r["n"], "<u4").astype(np.int64) for r in packs] or [np.zeros(0, np.int64)])
        ids = np.concatenate([_unpressed(r["ids"], "<u4") for r in packs] or [np.zeros(0, "<u4")])
        outs = []
        for row in left.to_pylist():
            bucket = _unpressed(row["buckets"], "<u4")
            if len(bucket) != len(n):
                raise ValueError("a block changed while it was encoded: the input must give the same rows when it is read again")
            place = np.argsort(bucket, kind="stable")
            lengths, first = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            lengths[place], first[place] = n, starts(n)[:-1]
            counts, codes = _unpressed(row["counts"], "<u4").astype(np.int64), _unpressed(row["codes"], "<u4")
            n_tokens = totals(lengths[codes], counts)
            out = np.concatenate([ids[ranges(first[part], lengths[part])] for part in np.array_split(codes, 1 + len(codes) // 500_000)])
            columns = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()), "ids": offsets_array(out, n_tokens)}
            outs.append(pa.table(columns | ({"decoded": pieces_of(out, n_tokens, path)} if decoded else {})))
            del out, codes
        freed()
        none = {"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())} | ({"decoded": pa.array([], pa.string())} if decoded else {})
        return pa.concat_tables(outs) if outs else pa.table(none)

    coded = _word_packs(docs, buckets).groupBy("bucket").applyInArrow(encode_bucket, "block binary, bucket long, n binary, ids binary")
    return _split(docs, buckets).groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(join_back, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with a column `decoded`: each id joined to its piece, pieces joined by a space; ids without a piece are left out.

    The vocabulary is a fixed table (49,408 rows here) that each task holds; no ids or null ids decode to the empty text.
    """

    checked(path)

    def decode_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pc.fill_null(b.column("ids"), b"")
            counts = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            text = pieces_of(joined(ids.to_pylist(), "<u4"), counts, path).combine_chunks()
            yield pa.RecordBatch.from_arrays([*b.columns, text], [*b.schema.names, "decoded"])
            freed()

    return encoded.mapInArrow(decode_ids, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
