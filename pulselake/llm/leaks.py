"""Benchmark decontamination with DataFrame and SQL functions only.

A document's windows of an item's length are fingerprinted (SimHash over five-word shingles, weighted by how often each
occurs), and so are the items. Fingerprints are cut into RADIUS + 1 blocks, of which two fingerprints within RADIUS bits
share at least one: windows and items meet by (length, block, bits), stay if their distance is at most RADIUS, and are
verified by their weighted similarity, sum of min / sum of max of the shingles' counts.

Only windows that can be similar enough are fingerprinted: at least SIMILAR of a similar window's shingles occur in items
of its length. A window that begins with a shingle of no such item loses nothing when it is moved to the next that does,
so windows begin at shingles of items (or end with the document).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sent, written

WIDTH, SIMILAR = 5, 0.8
#: Items similar by SIMILAR have an expected distance of 9.7 bits, with a deviation of 2.9: the radius is more than four of these away.
BITS, RADIUS = 64, 22
#: Benchmark rows (shingles) up to so many are sent to all tasks; more are joined.
MOST_SENT = 2_000_000


def with_shingles(df: DataFrame, name: str) -> DataFrame:
    """df (text, ...) with column `name`: the hash of each five-word run of the text in order, of fewer words none.

    Words are runs without ASCII white space, lower-cased (all letters: leaks also hide in capitals); a null text has none.
    """
    plain = F.trim(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t\n\x0B\f\r]", " ")))
    hashes = F.transform(F.split(plain, " +"), lambda w: F.xxhash64(w))
    run = lambda words: lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WIDTH)))
    places = lambda words: F.when(F.size(words) >= WIDTH, F.sequence(F.lit(0), F.size(words) - WIDTH)).otherwise(F.array().cast("array<int>"))
    # an array of one element is how a lambda gets a name for the words' hashes, which are then computed once
    return df.withColumn(name, F.get(F.transform(F.array(hashes), lambda words: F.transform(places(words), run(words))), F.lit(0)))


def _fingerprints(windows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """windows (keys, column: array of hashes) with their SimHash as column `print`."""
    long = windows.select(*keys, F.explode(column).alias("h"))
    votes = [F.sum(F.when(F.expr(f"(shiftrightunsigned(h, {i}) & 1) = 1"), 1).otherwise(-1)).alias(f"v{i}") for i in range(BITS)]
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.col(f"v{i}") > 0, F.expr(f"shiftleft(1L, {i})")).otherwise(F.lit(0).cast("long")) for i in range(BITS)))
    return long.groupBy(*keys).agg(*votes).select(*keys, bits.alias("print"))


def _cut(df: DataFrame) -> DataFrame:
    """A row for each block of a fingerprint: (..., block, bits)."""
    ends = [BITS * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    parts = F.array(*(F.expr(f"shiftrightunsigned(print, {a}) & {2 ** (b - a) - 1}L") for a, b in zip(ends, ends[1:], strict=False)))
    return df.select("*", F.posexplode(parts).alias("block", "bits"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, version, item_id, similarity, first_word): documents' windows that are similar to an item, the best for each pair.

    Of docs (doc_id, text, ...) and benchmark (item_id, text, ...). version is the hash of the document's text, so that rows
    of one doc_id with other texts are told apart; rows that repeat both give one result. Items and documents with fewer
    than five words (or null) match nothing, nor do rows without id. A document shorter than an item is one window.
    Of windows that are equally similar the first of those that begin with a shingle of an item is given.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("version"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    items = with_shingles(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), "item").drop("text")
    items = items.where("item_id IS NOT NULL AND size(item) > 0").dropDuplicates().withColumns({"length": F.size("item"), "version": F.xxhash64("item")})
    items = written(items, "items")
    known = sent(items.select("length", F.explode("item").alias("h")).distinct(), MOST_SENT)

    every = with_shingles(docs, "runs").select("doc_id", "version", F.posexplode_outer("runs").alias("at", "h")).where("h IS NOT NULL")
    hits = every.join(known, "h").groupBy("doc_id", "version", "length").agg(F.array_sort(F.collect_set("at")).alias("hits"))  # places of one document
    hits = written(hits.where("size(hits) >= 1"), "hits")
    some = hits.select("doc_id", "version").distinct()
    found = with_shingles(docs.join(sent(some, MOST_SENT), ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"]), "runs").drop("text")

    windows = found.join(hits, ["doc_id", "version"]).where(F.size("runs") >= SIMILAR * F.col("length")).select("*", F.posexplode("hits").alias("i", "begin"))
    windows = windows.withColumn("at", F.greatest(F.lit(0), F.least("begin", F.size("runs") - F.col("length")))).withColumn("need", F.ceil(SIMILAR * F.least("length", F.size("runs")) - 1e-9).cast("int"))
    # places are ascending: enough lie in the window if the one `need` further, or `need` before the end, does
    inside = F.when(F.col("at") == F.col("begin"), F.get("hits", F.col("i") + F.col("need") - 1) < F.col("at") + F.col("length")).otherwise(F.get("hits", F.size("hits") - F.col("need")) >= F.col("at"))
    windows = windows.where(inside).withColumn("runs", F.expr("slice(runs, at + 1, length)"))
    windows = written(windows.select("doc_id", "version", "length", "at", "runs").distinct(), "windows")

    prints = _cut(_fingerprints(windows, ["doc_id", "version", "length", "at"], "runs"))
    of_items = _cut(_fingerprints(items, ["item_id", "version", "length"], "item").withColumnRenamed("print", "item_print").withColumn("print", F.col("item_print"))).drop("print").withColumnRenamed("version", "item_version")
    met = prints.join(sent(of_items, MOST_SENT), ["length", "block", "bits"]).where(F.bit_count(F.expr("print ^ item_print")) <= RADIUS)
    met = met.select("doc_id", "version", "length", "at", "item_id", "item_version").distinct().join(windows, ["doc_id", "version", "length", "at"])
    met = met.join(items.select("item_id", F.col("version").alias("item_version"), "item"), ["item_id", "item_version"])
    both = F.expr("aggregate(array_distinct(item), 0, (n, h) -> n + least(size(filter(item, x -> x = h)), size(filter(runs, x -> x = h))))")
    scored = met.withColumn("both", both).withColumn("similarity", F.col("both") / (F.size("item") + F.size("runs") - F.col("both")))
    best = scored.where(F.col("similarity") >= SIMILAR).groupBy("doc_id", "version", "item_id").agg(F.max(F.struct("similarity", (-F.col("at")).alias("first"))).alias("best"))
    return best.select("doc_id", "version", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.first")).cast("long").alias("first_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text leaks an item; all other rows, those without doc_id too, and all columns stay."""
    bad = written(leaks(docs, benchmark).select(F.col("doc_id").alias("__pulselake_id"), F.col("version").alias("__pulselake_version")).distinct(), "leaks")
    same = (F.col("doc_id").cast("long") == F.col("__pulselake_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__pulselake_version"))
    return docs.join(sent(bad, MOST_SENT), same, "left_anti")
