"""A training corpus from documents: toxicity, line dedup, near-duplicate join, benchmark decontamination, BPE encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.llm import jaccard, leaks, lines, tokens, toxicity
from pulselake.llm.common import written
from pulselake.llm.queries import VOCABULARY


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most likely grade is 0; the model is fitted on labelled documents of this stage's input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or line has; one that loses all its lines goes (its lines stay elsewhere)."""
    cut = lines.dedup(docs).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    return jaccard.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, exactly or nearly."""
    return leaks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the ids of each text, little-endian unsigned 32-bit, and what they decode to."""
    out = tokens.encode(docs, public_tokenizers.path(VOCABULARY), decoded=True)
    return out.select("doc_id", "n_tokens", "ids", F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", not_toxic),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", one_of_each_group),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: The learned and iterative stages can't be said in SQL; tests/llm hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again, the last is returned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
