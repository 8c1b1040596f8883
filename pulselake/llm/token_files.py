"""Token ids as flat files: unsigned integers, and 64-bit offsets of the documents.

Each range of doc_ids is one shard of three files in the shared folder, read by memory map where the folder is local;
off one only the bytes asked for are read. `<shard>.bin` ids one after the other, `<shard>.idx` offsets (n + 1 unsigned 64-bit, in ids), `<shard>.doc` doc_ids.
Where a shard begins among all ids comes from the prefix sums of the shards' id counts.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, offsets_array, partitions, shared_folder, split_words, starts
from .tokens import checked, encode_words, spread, tokenizer, totals


#: Text bytes of a block: its distinct words are encoded once, so larger blocks encode less.
ENCODED_BLOCK = 16 << 20


@dataclass(frozen=True)
class TokenFiles:
    """What the driver keeps of written files: a few numbers for each shard."""

    folder: str
    dtype: str
    shards: list[tuple[int, int, int, int, int]]  #: shard, documents, ids, documents whose doc_id is null (they come first), base


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def opened(system: pafs.FileSystem, path: str, dtype: str, first: int, count: int) -> np.ndarray:
    """`count` numbers of a file from number `first` on: mapped where the file is local, else only these bytes are read."""
    size = np.dtype(dtype).itemsize
    if not count:
        return np.zeros(0, dtype)
    if isinstance(system, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r", first * size, (count,))
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read_at(count * size, first * size), dtype)


def write(docs: DataFrame, path: str, end_id: int, shards: int | None = None) -> TokenFiles:
    """Encodes docs (doc_id, text, ...) in ascending doc_id order, appends end_id to each, and writes the files.

    A null text is the empty text: end_id alone. A null doc_id comes first. Rows of one doc_id are ordered by text, so a
    task that runs again writes the same files (each is written under another name and then moved into place).
    """
    spark = docs.sparkSession
    checked(path)
    dtype = "<u2" if max(tokenizer(path).get_vocab_size(with_added_tokens=True), end_id + 1) <= 65536 else "<u4"
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    system, root = _place(folder)
    system.create_dir(root)

    def encoded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        counts, codes, words = split_words(batch.column("text"))
        flat, each = spread(codes, *encode_words(words.to_pylist(), path))
        n = totals(each, counts)
        out = np.full(len(flat) + len(n), end_id, dtype)
        keep = np.ones(len(out), bool)
        keep[starts(n + 1)[1:] - 1] = False
        out[keep] = flat
        return out, n + 1

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, system_root = TaskContext.get().partitionId(), _place(folder)
        system, root = system_root
        names = {k: f"{root}/{shard:08d}.{k}" for k in ("bin", "idx", "doc")}
        own = {k: f"{v}.{uuid.uuid4().hex}" for k, v in names.items()}
        n_docs = n_ids = n_null = 0
        with system.open_output_stream(own["bin"]) as ids, system.open_output_stream(own["idx"]) as idx, system.open_output_stream(own["doc"]) as doc:
            idx.write(np.zeros(1, "<u8").tobytes())
            for b in blocks(batches, most=ENCODED_BLOCK):
                out, n = encoded(b)
                ids.write(out.tobytes())
                idx.write((n_ids + np.cumsum(n)).astype("<u8").tobytes())
                doc.write(b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs, n_ids, n_null = n_docs + len(n), n_ids + len(out), n_null + b.column("doc_id").null_count
        for k, v in own.items():
            system.move(v, names[k])
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64()), "n_null": pa.array([n_null], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange(shards or partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    done = sorted(tuple(r) for r in rows.mapInArrow(save, "shard long, n_docs long, n_ids long, n_null long").collect())  # a row for each shard
    bases = starts(np.array([r[2] for r in done], np.int64))
    return TokenFiles(folder, dtype, [(*r, int(b)) for r, b in zip(done, bases, strict=False)])


def read(spark: SparkSession, files: TokenFiles, with_ids: bool = False, docs_at_once: int = 20_000) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids binary, little-endian unsigned 32-bit]) of each written document."""
    parts = [(s, first, min(n, first + docs_at_once), null, base) for s, n, _, null, base in files.shards for first in range(0, n, docs_at_once)]
    folder, dtype = files.folder, files.dtype
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                system, root = _place(folder)
                name = f"{root}/{r['shard']:08d}"
                idx = opened(system, f"{name}.idx", "<u8", r["first"], r["last"] - r["first"] + 1).astype(np.int64)
                doc = opened(system, f"{name}.doc", "<i8", r["first"], r["last"] - r["first"])
                ids = opened(system, f"{name}.bin", dtype, int(idx[0]), int(idx[-1] - idx[0]))
                n, own = np.diff(idx), idx - idx[0]
                null = np.arange(r["first"], r["last"]) < r["n_null"]
                crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(own[:-1], own[1:], strict=True)]
                out = {"doc_id": pa.array(np.asarray(doc, np.int64), mask=null), "start": pa.array(idx[:-1] + r["base"]), "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    out["ids"] = offsets_array(ids.astype("<u4"), n)
                yield pa.RecordBatch.from_pydict(out)

    table = spark.createDataFrame(parts, "shard long, first long, last long, n_null long, base long")
    return table.repartition(max(1, min(len(parts), partitions(spark)))).mapInArrow(load, schema)
