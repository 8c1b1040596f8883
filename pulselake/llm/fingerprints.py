"""Document fingerprints: every shingle hash below a fixed fraction of the hash range.

The kept hashes of two texts are the same fixed sample of their shingles, so sketches of very unequal documents can be
compared (likeness, containment) and joined (union) without their texts. Only where no hash is below the fraction the smallest
one is kept, so that every text with a word has a fingerprint; it never takes part beside kept hashes. As text: the scale, a
colon, and the kept hashes in ascending order, big-endian, in base64: about a fifth of the text's length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, hash_strings, partitions, shingle_hashes, split_words, starts, texts

#: One hash in SCALE is kept. The deviation of a likeness J is about sqrt(J (1 - J) SCALE / shingles): 0.13 at 0.5 for 120 words.
SCALE = 8
#: Words in a shingle.
WIDTH = 5


def below(hashes: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return hashes <= np.uint64(2**64 // scale - 1)


def sketches(column: pa.Array, scale: int = SCALE, width: int = WIDTH) -> list[np.ndarray]:
    """The kept hashes of each text, ascending."""
    counts, codes, words = split_words(column)
    hashes, runs = shingle_hashes(counts, hash_strings(words)[codes], width)
    doc = np.repeat(np.arange(len(runs)), runs)
    keep = below(hashes, scale)
    full = np.flatnonzero((runs > 0) & (np.bincount(doc[keep], minlength=len(runs)) == 0))
    if len(full):
        some = np.flatnonzero(runs)
        least = np.minimum.reduceat(hashes, starts(runs)[:-1][some])[np.searchsorted(some, full)]
        doc, hashes = np.concatenate((doc[keep], full)), np.concatenate((hashes[keep], least))
    else:
        doc, hashes = doc[keep], hashes[keep]
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    if len(doc):
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])))
        doc, hashes = doc[new], hashes[new]
    return np.split(hashes, starts(np.bincount(doc, minlength=len(runs)))[1:-1])


def as_text(sketch: np.ndarray, scale: int = SCALE) -> str:
    return f"{scale}:{base64.b64encode(sketch.astype('>u8').tobytes()).decode()}"


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint.partition(":")[2]), ">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of both texts' shingles together: the same that sketches() makes of them."""
    both = np.union1d(a, b)
    kept = both[below(both, scale)]
    return kept if len(kept) else both[:1]


def _comparable(a: np.ndarray, b: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """What of two sketches can be compared: the hashes below the fraction, the smallest ones only if neither has any."""
    x, y = a[below(a, scale)], b[below(b, scale)]
    return (x, y) if len(x) or len(y) else (a, b)


def likeness(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float:
    """Estimated Jaccard similarity of two texts' shingles; of two texts without words 1, of one such text 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = _comparable(a, b, scale)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float | None:
    """Estimated share of a's shingles that b has; of a text without words 1.

    None where the sketches can't tell: a has only its smallest hash, and b keeps smaller ones or a smaller smallest one.
    """
    if not len(a) or np.array_equal(a, b):
        return 1.0
    own = a[below(a, scale)]
    if len(own):
        return len(np.intersect1d(own, b, assume_unique=True)) / len(own)
    return None if len(b) and b[0] < a[0] else 0.0


def fingerprint(docs: DataFrame, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """docs (text, ...) with a column `fingerprint`; a null text is the empty text, whose fingerprint keeps no hash."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            found = pa.array([as_text(s, scale) for s in sketches(b.column("text"), scale, width)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, "fingerprint"])

    docs = docs.drop("fingerprint")
    return docs.mapInArrow(add, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", fingerprint string")


def compare_with_edited(docs: DataFrame, scale: int = SCALE, width: int = WIDTH, buckets: int | None = None) -> DataFrame:
    """Each row of docs (doc_id, text, ...) beside an edited text: its second half replaced by the next document's beginning.

    The next document is the one with the next smaller doc_id, after the smallest the largest; rows of one doc_id are
    ordered by a hash of their text, a null doc_id is the smallest, a null text is the empty text. Documents are dealt out by
    ranges (quantiles) of doc_id and hash, so one doc_id with very many texts is split too; the one document that a range
    needs of the next range goes to both.
    Returns doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark = docs.sparkSession
    n = buckets or partitions(spark)
    order = F.coalesce("doc_id", F.lit(-(2**63)))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("at", order.cast("double") + 0.5 - F.col("h") / 2.0**64)  # falls with the order of documents
    cuts = sorted(set(rows.approxQuantile("at", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    bounds = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="at", outputCol="range") if cuts else None
    rows = bounds.transform(rows) if bounds else rows.withColumn("range", F.lit(0.0))
    top = {r["range"]: (r["top"].doc_id, ~r["top"].h) for r in rows.groupBy("range").agg(F.max(F.struct(order.alias("doc_id"), F.bitwise_not("h").alias("h"))).alias("top")).collect()}  # a row for each range
    ranges = sorted(top, reverse=True)
    ghosts = [(*top[b], b, a) for a, b in zip(ranges, ranges[1:] + ranges[:1], strict=True)] or [(0, 0, 0.0, 0.0)]
    more = F.broadcast(spark.createDataFrame(ghosts, "top long, top_h long, range double, to double"))  # a row for each range
    extra = rows.join(more, "range").where((order == F.col("top")) & (F.col("h") == F.col("top_h"))).groupBy("doc_id", "to").agg(F.min("text").alias("text"))  # rows that repeat give one
    dealt = rows.select("doc_id", "text", "h", "range", F.lit(False).alias("ghost")).unionByName(extra.select("doc_id", "text", F.xxhash64("text").alias("h"), F.col("to").alias("range"), F.lit(True).alias("ghost")))
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("range").cast("int")).sortWithinPartitions("range", "ghost", F.col("doc_id").desc_nulls_last(), "h", "text").drop("h")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in blocks(batches):
            table = pa.Table.from_batches([b])
            table = table if held is None else pa.concat_tables([held, table])
            held = table.slice(table.num_rows - 1)
            where, ghost = table["range"].to_numpy(), table["ghost"].to_numpy(zero_copy_only=False)
            own = np.flatnonzero(~ghost[:-1] & (where[:-1] == where[1:]))
            if not len(own):
                continue
            column = texts(table["text"])
            text = column.to_pylist()
            edited = [text[i][: len(text[i]) - len(text[i]) // 2] + text[i + 1][: len(text[i]) // 2] for i in own]
            found = sketches(column, scale, width)
            changed = sketches(pa.array(edited, pa.large_string()), scale, width)
            yield pa.RecordBatch.from_pydict({
                "doc_id": table["doc_id"].combine_chunks().take(pa.array(own)),
                "n_chars": pa.array([len(text[i]) for i in own], pa.int64()),
                "edited_text": edited,
                "fingerprint": [as_text(found[i], scale) for i in own],
                "edited_fingerprint": [as_text(s, scale) for s in changed],
                "near_edited": [likeness(found[i], s, scale) for i, s in zip(own, changed, strict=True)],
                "near_next": [likeness(found[i], found[i + 1], scale) for i in own],
            })

    return dealt.mapInArrow(compare, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
