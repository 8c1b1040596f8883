"""Language ID of mixed text: script ranges narrow the candidates, Viterbi over per-word scores labels the spans.

Each word has a score for each language: the log share of that language in a naive Bayes model of its letter n-grams.
Languages never seen in a word's script get a floor. The label sequence of a text maximises the sum of its words' scores
minus a penalty for each switch of language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix, ranges, split_words, starts

#: Training documents of one language, at most about (chosen by the hash of doc_id).
MOST = 3_000
#: Hashed n-grams; lengths of n-grams (with a mark before and after the word); added to each count.
SPACE, LENGTHS, ADDED = 1 << 16, (1, 2, 3, 4), 0.5
#: Cost of a switch, and the least score of a word, in nats.
SWITCH, FLOOR = 6.0, -8.0
#: First code points of ranges by script, in natural order; letters between them belong to the script named.
SCRIPTS = ((0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"),
           (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
           (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"))
NAMES = sorted({name for _, name in SCRIPTS})


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]  #: ascending
    table: np.ndarray  #: (SPACE, languages): log probability of an n-gram
    scripts: np.ndarray  #: (scripts, languages): whether the language is written in the script


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all words (lower case), how many each has, and the script of its first letter."""
    low = pc.utf8_lower(words)
    code = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    n = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    seen = np.unique(code)
    alpha = np.array([chr(c).isalpha() for c in seen], bool)[np.searchsorted(seen, code)] if len(seen) else np.zeros(0, bool)
    n = np.diff(starts(alpha.astype(np.int64))[starts(n)])
    code = code[alpha]
    by = np.array([NAMES.index(name) for _, name in SCRIPTS])[np.searchsorted([c for c, _ in SCRIPTS], code, side="right") - 1] if len(code) else np.zeros(0, np.int64)
    script = np.zeros(len(n), np.int64)
    script[n > 0] = by[starts(n)[:-1][n > 0]]
    return code, n, script


def ngrams(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each word between marks, and how many each word has; words without letters have none."""
    some = n > 0
    size = np.where(some, n + 2, 0)
    at = starts(size)
    text = np.zeros(at[-1], np.int64)
    text[ranges(at[:-1] + 1, n)] = code
    text[at[:-1][some]], text[at[1:][some] - 1] = 2, 3
    out, each = [], []
    for k in LENGTHS:
        m = np.maximum(size - k + 1, 0) if k > 1 else n
        first = ranges(at[:-1] + (k == 1), m)
        h = np.full(len(first), k, np.uint64)
        for j in range(k):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + text[first + j].astype(np.uint64))
        out.append((h % np.uint64(SPACE)).astype(np.int64))
        each.append(m)
    word = np.concatenate([np.repeat(np.arange(len(n)), m) for m in each])
    order = np.argsort(word, kind="stable")
    return np.concatenate(out)[order], np.sum(each, axis=0)


def word_scores(words: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(words, languages) scores, 0 for words without letters; and the words' letters."""
    code, n, script = letters_of(words)
    grams, each = ngrams(code, n)
    total = np.zeros((len(n) + 1, len(model.langs)))
    full = np.flatnonzero(each)
    if len(full):
        total[full] = np.add.reduceat(model.table[grams], starts(each)[:-1][full], axis=0)
    total = total[:-1] - total[:-1].max(1, keepdims=True)
    total -= np.log(np.exp(total).sum(1, keepdims=True))
    total = np.maximum(total, FLOOR)
    total[~model.scripts[script]] = FLOOR
    total[n == 0] = 0
    return total.astype(np.float32), n


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word (scores: words of all texts in order); of equal paths the one that stays, then the first language."""
    kind = np.int8 if scores.shape[1] <= 127 else np.int32
    labels = np.zeros(len(scores), kind)
    order = np.argsort(-counts, kind="stable")
    first, length = starts(counts)[:-1][order], counts[order]
    alive = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")  # texts that have a word at each step
    best = np.zeros((len(counts), scores.shape[1]), np.float32)
    back = np.zeros(scores.shape, kind)
    own = np.arange(scores.shape[1], dtype=kind)
    for t, k in enumerate(alive):
        at, now = first[:k] + t, best[:k]
        if t:
            top = now.argmax(1)
            most = now[np.arange(k), top] - switch
            moves = most[:, None] > now
            back[at] = np.where(moves, top[:, None].astype(kind), own)
            now = np.where(moves, most[:, None], now)
        best[:k] = now + scores[at]
    state = best.argmax(1).astype(kind)
    for t in range(len(alive) - 1, -1, -1):
        k = alive[t]
        at = first[:k] + t
        labels[at] = state[:k]
        state[:k] = back[at, state[:k]] if t else state[:k]
    return labels


def train(docs: DataFrame, keep: Column, most: int = MOST) -> Model:
    """Learns from text and lang of the rows of docs (doc_id, text, lang) where keep holds and neither is null.

    About `most` rows of each language are used, whole; the model's size doesn't depend on them.
    """
    rows = docs.where(keep & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.xxhash64("doc_id").alias("h"), F.col("text").cast("string"), F.col("lang").cast("string"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    langs = tuple(sorted(sizes))
    if not langs:
        return Model((), np.zeros((SPACE, 0)), np.zeros((len(NAMES), 0), bool))
    chosen = F.lit(False)
    for lang in langs:
        chosen |= (F.col("lang") == lang) & (F.pmod("h", F.lit(1_000_000)) < int(min(1.0, most / sizes[lang]) * 1_000_000))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            counts, codes, words = split_words(b.column("text"))
            code, n, script = letters_of(words)
            grams, each = ngrams(code, n)
            of = np.searchsorted(langs, b.column("lang").to_pylist())
            for i in np.unique(of):
                times = np.bincount(codes[np.repeat(of == i, counts)], minlength=len(words))
                by_gram = np.bincount(grams, np.repeat(times, each), SPACE)
                by_script = np.bincount(script, times * (n > 0), len(NAMES))
                full, used = np.flatnonzero(by_gram), np.flatnonzero(by_script)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(full) + len(used), i), pa.int32()), "feature": pa.array(np.concatenate((full, SPACE + used)), pa.int32()),
                                                  "n": pa.array(np.concatenate((by_gram[full], by_script[used])).astype(np.int64))})

    got = rows.where(chosen).select("text", "lang").mapInArrow(count, "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()  # SPACE rows a language at most
    table, scripts = np.zeros((SPACE, len(langs))), np.zeros((len(NAMES), len(langs)))
    gram = got["feature"].to_numpy() < SPACE
    table[got["feature"][gram], got["lang"][gram]] = got["n"][gram]
    scripts[got["feature"][~gram] - SPACE, got["lang"][~gram]] = got["n"][~gram]
    table = np.log(table + ADDED) - np.log(table.sum(0) + ADDED * SPACE)
    return Model(langs, table, scripts >= 0.01 * np.maximum(scripts.sum(0), 1))


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of each row of docs (doc_id, text, ...).

    spans are runs of words of one language (first and last word, from 0). lang_pred has the most letters in its spans (of
    equal ones the first by name), score is its share of the letters. A text that is null or has no letter gets `und`, score 0
    and no spans, as does every text if the model has no language.
    """
    langs = np.array(model.langs, object)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            counts, codes, words = split_words(b.column("text"))
            scores, letters = word_scores(words, model) if len(langs) else (np.zeros((len(words), 1), np.float32), np.zeros(len(words), np.int64))
            labels = viterbi(scores[codes], counts, switch)
            doc = np.repeat(np.arange(len(counts)), counts)
            weight = np.bincount(doc * max(len(langs), 1) + labels.astype(np.int64), letters[codes], len(counts) * max(len(langs), 1)).reshape(len(counts), -1)
            total = weight.sum(1)
            known = total > 0
            new = np.concatenate(([True], (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1]))) if len(labels) else np.zeros(0, bool)
            new &= known[doc]
            first = np.flatnonzero(new)
            n_spans = np.bincount(doc[first], minlength=len(counts))
            begin = starts(counts)[:-1][doc[first]]
            last = np.minimum(np.append(first[1:], len(labels)), starts(counts)[1:][doc[first]]) - 1
            best = weight.argmax(1)
            name = np.append(langs, "und")
            spans = pa.ListArray.from_arrays(pa.array(starts(n_spans), pa.int32()), pa.StructArray.from_arrays(
                [pa.array(name[labels[first]].tolist() if len(langs) else [], pa.string()), pa.array(first - begin, pa.int64()), pa.array(last - begin, pa.int64())], ["lang", "first", "last"]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(name[np.where(known, best, len(langs))].tolist(), pa.string()),
                                              pa.array(np.where(known, weight[np.arange(len(counts)), best] / np.maximum(total, 1), 0.0)), spans], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(label, "doc_id long, lang_pred string, score double, spans array<struct<lang: string, first: long, last: long>>")
