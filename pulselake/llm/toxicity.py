"""Toxicity: a cumulative-link ordinal regression over sparse text features.

Grades: 0 for documents labelled clean; documents labelled toxic have grades 1 to GRADES - 1 by how dense the terms
that mark toxic documents are in them (equal shares of the toxic sample). One weight vector serves all thresholds:
P(grade > k) = sigmoid(w x - b_k) with b_0 < b_1 < ...; the expected severity is the sum of these.

The model is fitted on a bounded sample of labelled documents (`most`, by the hash of doc_id); scoring reads every
document whole. Features are words and word beginnings (letters only, lower case), hashed; the few thousand that tell
the labels apart are kept, as presence, log(1 + count) and log(1 + count per 100 words).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, split_words, starts, written

#: Labelled documents that the model is fitted on, at most about.
MOST = 8_000
GRADES = 4
#: Hashed features; kept ones; documents that a kept feature must be in; least |z| of its log odds.
VIEWS = 3
SPACE, KEPT, LEAST_DOCS, LEAST_Z = 1 << 22, 4_000, 8, 3.0
#: Lengths of word beginnings, in letters; a whole word has length 0.
BEGINNINGS = (4, 5, 6, 7)
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    features: np.ndarray  #: kept hashed features, ascending
    weights: np.ndarray  #: VIEWS for each
    cuts: np.ndarray  #: b_0 < b_1 < ...


def word_features(word: str) -> list[int]:
    """Hashes of the word and its beginnings; of a word that is several runs of letters those of each, once."""
    runs = LETTERS.findall(word.lower())
    found = [xxhash.xxh3_64_intdigest(run, 0) % SPACE for run in runs]
    found += [xxhash.xxh3_64_intdigest(run[:n], n) % SPACE for run in runs for n in BEGINNINGS if len(run) >= n]
    return found if len(runs) < 2 else list(set(found))


def counted(column: pa.Array, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text and feature that it has: text, feature (its place in kept, if given), count. Also all word counts."""
    counts, codes, words = split_words(column)
    lists = [word_features(w) for w in words.to_pylist()]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((f for fs in lists for f in fs), np.int64, int(n.sum()))
    if kept is not None:
        at = np.searchsorted(kept, flat)
        good = (at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == flat) if len(kept) else np.zeros(len(flat), bool)
        n, flat = np.diff(starts(good.astype(np.int64))[starts(n)]), at[good]
    some = np.flatnonzero(n[codes] > 0)
    doc = np.repeat(np.arange(len(counts)), counts)[some]
    first = starts(n)[:-1][codes[some]]
    each = n[codes[some]]
    at = np.repeat(first - starts(each)[:-1], each) + np.arange(each.sum())
    width = np.int64(SPACE if kept is None else max(len(kept), 1))
    pairs, times = np.unique(np.repeat(doc, each) * width + flat[at], return_counts=True)
    return pairs // width, pairs % width, times, counts


def views(times: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a feature that occurs so many times in so many words counts: its presence, log(1 + count), log(1 + count per 100 words)."""
    return np.ones(len(times)), np.log1p(times), np.log1p(100 * times / np.maximum(words, 1))


def ordinal(row: np.ndarray, column: np.ndarray, value: np.ndarray, columns: int, y: np.ndarray, grades: int, rounds: int = 500, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts of the cumulative-link model of a sparse design, by Adam on the mean loss over thresholds."""
    theta = np.concatenate((np.zeros(columns), [1.0], np.zeros(grades - 2)))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    above = (y[:, None] > np.arange(grades - 1)).astype(float)
    split = lambda t: (t[:columns], t[columns] + np.concatenate(([0.0], np.cumsum(np.exp(t[columns + 1 :])))))
    for t in range(1, rounds + 1):
        w, cuts = split(theta)
        z = np.bincount(row, value * w[column], len(y))
        error = (1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -30, 30))) - above) / len(y)
        by_cut = -error.sum(0)
        steps = np.exp(theta[columns + 1 :]) * np.cumsum(by_cut[::-1])[::-1][1:]
        g = np.concatenate((np.bincount(column, value * error.sum(1)[row], columns) + l2 * w, [by_cut.sum()], steps))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return split(theta)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, grades: int = GRADES) -> Model:
    """Fits on about `most` documents that have a label (labels: doc_id, toxic 0/1), whole texts.

    Null labels and null ids are left out; of a doc_id with more labels the largest counts, of one with several rows the text
    whose hash is the smallest. Without both classes in the sample the model gives the one class (or grade 0, without any
    label) to all. The driver gets the kept features and, for each document of the sample (2 * most at most), their counts.

    The labels only say toxic or not. That grades 1 and up are quantiles of the toxic sample by density of the terms that mark
    it is an assumption: held-out labels can confirm the first cut, not the ones between the higher grades.
    """
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max(F.col("toxic").cast("int")) > 0).alias("toxic"))
    share = min(1.0, most / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most)  # so the sample can't pass this
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(rows), "doc_id")
    sample = written(found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias("toxic")), "sample")
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = size.get(True, 0), size.get(False, 0)
    if not bad or not good:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(grades - 1, -1e9 if bad else 1e9))

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            doc, feature, _, _ = counted(b.column("text"))
            toxic = b.column("toxic").to_numpy(zero_copy_only=False).astype(bool)[doc]
            used, place = np.unique(feature, return_inverse=True)
            yield pa.RecordBatch.from_pydict({"feature": used, "bad": np.bincount(place[toxic], minlength=len(used)), "good": np.bincount(place[~toxic], minlength=len(used))})

    found = sample.select("text", "toxic").mapInArrow(frequency, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = lambda x, n: F.log((F.col(x) + 0.5) / (n + 0.5 - F.col(x)))
    z = (odds("bad", bad) - odds("good", good)) / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = found.where(F.col("bad") + F.col("good") >= LEAST_DOCS).select("feature", z.alias("z")).where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "feature").limit(KEPT).collect()
    best = sorted((r["feature"], r["z"]) for r in best)
    kept, marks = np.array([f for f, _ in best], np.int64), np.array([v > 0 for _, v in best], bool)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            doc, feature, times, counts = counted(b.column("text"), kept)
            cut = starts(np.bincount(doc, minlength=len(counts)))
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "toxic": b.column("toxic"), "n": pa.array(counts, pa.int64()),
                "f": [feature[i:j].astype("<u4").tobytes() for i, j in zip(cut, cut[1:], strict=False)], "c": [times[i:j].astype("<u4").tobytes() for i, j in zip(cut, cut[1:], strict=False)],
            })

    got = sample.select("doc_id", "text", "toxic").mapInArrow(count, "doc_id long, toxic boolean, n long, f binary, c binary").collect()  # kept features of the sample
    got.sort(key=lambda r: (r["doc_id"], r["n"], bytes(r["f"])))
    counts, toxic = np.array([r["n"] for r in got]), np.array([r["toxic"] for r in got])
    feature = np.frombuffer(b"".join(r["f"] for r in got), "<u4").astype(np.int64)
    times = np.frombuffer(b"".join(r["c"] for r in got), "<u4").astype(np.int64)
    doc = np.repeat(np.arange(len(got)), [len(r["f"]) // 4 for r in got])
    dense = np.bincount(doc, times * marks[feature], len(counts)) / np.maximum(counts, 1)
    y = toxic.astype(int)
    y[toxic] += np.searchsorted(np.quantile(dense[toxic], np.arange(1, grades - 1) / (grades - 1)), dense[toxic], side="right")
    return Model(kept, *ordinal(np.tile(doc, VIEWS), np.concatenate([feature + i * len(kept) for i in range(VIEWS)]), np.concatenate(views(times, counts[doc])), VIEWS * len(kept), y, grades))


def linear(column: pa.Array, model: Model) -> np.ndarray:
    """w x of each text."""
    k = len(model.features)
    doc, feature, times, counts = counted(column, model.features)
    z = np.zeros(len(counts))
    if k:
        z = np.bincount(doc, sum(view * model.weights[i * k + feature] for i, view in enumerate(views(times, counts[doc]))), len(counts))
    return z


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, ...) with severity double (expected grade), grade int, p_toxic double, toxic boolean.

    A null or empty text has no features and gets the model's grade for such texts. Columns of docs with these names are
    replaced; all rows stay, repeated ones too.
    """

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            z = linear(b.column("text"), model)
            above = 1 / (1 + np.exp(-np.clip(z[:, None] - model.cuts, -700, 700)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(above.sum(1)), pa.array((above >= 0.5).sum(1), pa.int32()), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)],
                                             [*b.schema.names, "severity", "grade", "p_toxic", "toxic"])

    docs = docs.drop("severity", "grade", "p_toxic", "toxic")
    more = [T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())]
    return docs.mapInArrow(grade, T.StructType([*docs.schema.fields, *more]))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs (text, ...) that the model doesn't call toxic, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            yield b.filter(pa.array(linear(b.column("text"), model) < model.cuts[0]))

    return docs.mapInArrow(keep, docs.schema)
