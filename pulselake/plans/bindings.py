"""The operators' inputs as views of the tables: sample streams, windows, signals and grids. Nothing is copied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import epoch, settled

#: 2024-01-01, the first day of events, in seconds.
ORIGIN = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, event_id, t, x, roi) of events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session"), "event_id", epoch(F.col("ts")).alias("t"), F.col("value").alias("x"), F.col("event_type").alias("roi"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples with seq, the place in the session from 1."""
    return samples(spark, sf_dir).withColumn("seq", F.row_number().over(Window.partitionBy("session").orderBy("t", "event_id")))


SAMPLES = "samples AS (SELECT user_id AS session, event_id, epoch_us(ts) / 1e6 AS t, value AS x, event_type AS roi FROM events)"
SIGNAL = SAMPLES + ", signal AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, event_id) AS seq FROM samples)"


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-day windows of a user: estimate, reference, quality and the inputs of the condition detectors."""
    s = samples(spark, sf_dir).withColumn("w", F.floor((F.col("t") - ORIGIN) / 432000))
    g = s.groupBy("session", "w").agg(F.count("*").alias("n"), settled(F.avg("x")).alias("hr_estimate"), F.percentile("x", 0.5).alias("hr_reference"), F.min("x").alias("low"), F.max("x").alias("high"),
                                      F.avg(F.when(F.col("roi") == "click", 1.0).otherwise(0.0)).alias("motion"))
    return g.select(
        "session", "w", (F.col("session") % 10).alias("subject"), F.col("n").cast("bigint").alias("n"), "hr_estimate", "hr_reference",
        F.least(F.lit(1.0), F.col("n") / 20.0).alias("signal_quality"), F.when(F.col("n") % 4 != 0, F.least(F.lit(1.0), F.col("n") / 25.0)).alias("hr_confidence"),
        "hr_estimate", (F.col("high") - F.col("low")).alias("range"), (F.col("motion") / 4).alias("motion"), F.least(F.lit(1.0), F.col("n") / 15.0).alias("coverage"), (F.col("n") >= 3).alias("is_valid"),
    ).toDF("session", "w", "subject", "n", "hr_estimate", "hr_reference", "signal_quality", "hr_confidence", "luminance", "luminance_range", "motion", "coverage", "is_valid")


WINDOWS = (
    SAMPLES
    + f""", windows AS (
  SELECT session, w, session % 10 AS subject, n, hr_estimate, hr_reference, least(1.0, n / 20.0) AS signal_quality,
         CASE WHEN n % 4 <> 0 THEN least(1.0, n / 25.0) END AS hr_confidence, hr_estimate AS luminance, high - low AS luminance_range,
         motion / 4 AS motion, least(1.0, n / 15.0) AS coverage, n >= 3 AS is_valid
  FROM (SELECT session, floor((t - {ORIGIN}) / 432000)::BIGINT AS w, count(*) AS n, avg(x) AS hr_estimate, median(x) AS hr_reference, min(x) AS low, max(x) AS high,
               avg(CASE WHEN roi = 'click' THEN 1.0 ELSE 0.0 END) AS motion FROM samples GROUP BY ALL)
)"""
)


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x array<double>, label): embeddings as 64 samples at 30 frames a second."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


ARRAYS = "arrays AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings), points AS (SELECT id, unnest(x) AS v, unnest(range(64)) AS i FROM arrays)"


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, seq, r, g, b) of lineitem by supplier, in the order of all its columns."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("session"), *order)  # dealt by session, so that later steps by session needn't deal again
    li = li.withColumn("seq", F.row_number().over(Window.partitionBy("session").orderBy(*order)))
    return li.select("session", "seq", F.col("l_quantity").alias("r"), (F.col("l_extendedprice") / 1000).alias("g"), (F.col("l_discount") * 100 + 1).alias("b"))


RGB = """rgb AS (
  SELECT l_suppkey AS session, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS seq,
         l_quantity AS r, l_extendedprice / 1000 AS g, l_discount * 100 + 1 AS b FROM lineitem)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method, id, measured, reference, confidence, sigma, valid, rejected): prices of lineitem against the part's list price."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_brand")
    j = li.join(part, li.l_partkey == part.p_partkey)
    return j.select(
        F.col("l_returnflag").alias("method"), F.col("p_brand").alias("domain"), F.col("l_partkey").alias("id"), (F.col("l_extendedprice") / F.col("l_quantity") / 10).alias("measured"), (F.col("p_retailprice") / 10).alias("reference"),
        (100 * (1 - 5 * F.col("l_discount")) + 0.0).alias("confidence"), (1 + 100 * F.col("l_tax")).alias("sigma"), (F.col("l_linenumber") % 7 != 0).alias("valid"), (F.col("l_linenumber") % 5 == 0).alias("rejected"),
    )


PAIRS = """pairs AS (
  SELECT l_returnflag AS method, p_brand AS domain, l_partkey AS id, l_extendedprice / l_quantity / 10 AS measured, p_retailprice / 10 AS reference, 100 * (1 - 5 * l_discount) + 0.0 AS confidence,
         1 + 100 * l_tax AS sigma, l_linenumber % 7 <> 0 AS valid, l_linenumber % 5 = 0 AS rejected FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, subject, domain, value) of customer."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("sample"), F.col("c_nationkey").alias("subject"), F.col("c_mktsegment").alias("domain"), F.col("c_acctbal").alias("value"))


DOMAINS = "domains AS (SELECT c_custkey AS sample, c_nationkey AS subject, c_mktsegment AS domain, c_acctbal AS value FROM customer)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, y, x, v): embeddings as 8 x 8 frames."""
    return arrays(spark, sf_dir).select(F.col("id").alias("frame"), F.posexplode("x").alias("i", "v")).select("frame", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), "v")


PIXELS = ARRAYS + ", pixels AS (SELECT id AS frame, i // 8 AS y, i % 8 AS x, v FROM points)"
