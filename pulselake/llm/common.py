"""Shared pieces of the training-data operators: the shared folder, and word columns as flat NumPy arrays.

Text never moves word by word. A task turns a bounded block of documents into one dictionary of distinct words
and one code per word position (Arrow does both), so later shuffles carry a block's distinct words, not its tokens.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes of one block; the unit that a task holds in memory at once.
BLOCK_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (one machine only)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="pulselake-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and lost executors cost only the tasks they ran."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def sent(df: DataFrame, most: int) -> DataFrame:
    """df marked to be sent to all tasks if it has at most `most` (short) rows; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def hot_join(left: DataFrame, right: DataFrame, key: str, share: int = 256, least: int = 1000, counted: DataFrame | None = None) -> DataFrame:
    """left joined with right (at most a row for each key), for a left in which a few keys may have very many rows.

    Keys with more than 1 / share of left's rows, which are fewer than `share`, are joined by sending their rows of right to all
    tasks; the rest is joined as usual. Only how it is done depends on the counts. They are taken of `counted` where that is given:
    a table with as many rows of each key, for a left that is itself a join, which counting would run again.
    """
    counts = (left if counted is None else counted).groupBy(key).count()
    most = max(least, (counts.agg(F.sum("count")).first()[0] or 0) // share)
    hot = [r[0] for r in counts.where(F.col("count") > most).select(key).collect()]  # fewer than share
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    return left.where(is_hot).join(F.broadcast(right.where(is_hot)), key).unionByName(left.where(~is_hot).join(right, key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Text bytes that feed one bucket of keys or words, about: a task holds a bucket's share of what they give.
BUCKET_BYTES = 32 << 20


def buckets_for(docs: DataFrame) -> int:
    """Buckets for the keys of docs (text, ...): as many as there are shuffle partitions, more for more text."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    return max(partitions(docs.sparkSession), size // BUCKET_BYTES + 1)


#: A-Z to a-z, other bytes as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def texts(column: pa.Array | pa.ChunkedArray, lower: bool = False, table: bytes | None = None) -> pa.Array:
    """A text column as one Arrow array in which null is the empty text; A-Z lower-cased if asked, or ASCII bytes replaced by table.

    The array is laid out anew from offset 0: Arrow's ASCII functions read slices wrongly.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return pa.array([""] * len(column), pa.large_string())
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = memoryview(data)[offsets[0] : offsets[-1]].tobytes()
    table = table or (LOWER if lower else None)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data.translate(table) if table else data))


_LIBC = ctypes.CDLL(None)


def freed() -> None:
    """Gives memory that Arrow and malloc hold but don't use back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts pass `most` bytes (one longer text is a block of its own)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, total = 0, 0
        for i, n in enumerate(size):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                freed()
                start, total = i, 0
            total += n
        if len(size) > start:
            yield batch.slice(start)
            freed()


def split_words(column: pa.Array | pa.ChunkedArray, lower: bool = False, table: bytes | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: word counts by text, a code for each word in order, and the distinct words."""
    lists = pc.ascii_split_whitespace(texts(column, lower, table))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # beside leading and trailing white space
        counts = counts - np.bincount(np.repeat(np.arange(len(counts)), counts)[empty], minlength=len(counts))
        flat = flat.filter(pa.array(~empty))
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return counts, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def hash_strings(values: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit xxh3 of each string's UTF-8 bytes."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(v, seed) for v in values.cast(pa.large_binary()).to_pylist()), np.uint64, len(values))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (murmur3's): spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x


def starts(counts: np.ndarray) -> np.ndarray:
    """Offsets 0, c0, c0 + c1, ... of runs with these lengths."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def ranges(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for lengths[0] values, then the same from first[1], and so on."""
    at = starts(lengths)
    return np.arange(at[-1], dtype=np.int64) + np.repeat(first - at[:-1], lengths)


def shingle_hashes(counts: np.ndarray, word_hash: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each run of `width` words of each text, in order, and the runs by text.

    A text with fewer words gives its whole word sequence as one shingle, a text without words gives none.
    """
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    at = starts(counts)
    pos = ranges(at[:-1], runs)
    own = np.repeat(np.minimum(counts, width), runs)
    last = max(len(word_hash) - 1, 0)
    out = np.repeat(mix(np.minimum(counts, width).astype(np.uint64)), runs)
    for k in range(width):
        step = mix(out * np.uint64(0x9E3779B97F4A7C15) + word_hash[np.minimum(pos + k, last)]) if len(pos) else out
        out = np.where(own > k, step, out)
    return out, runs


def offsets_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary array: for each run of `counts` values its little-endian bytes."""
    data = np.ascontiguousarray(values)
    at = starts(counts) * data.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())


def joined(blobs: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)
