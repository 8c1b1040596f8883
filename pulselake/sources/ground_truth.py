"""Reference series from CSV files (survey A1-A5): strings first, then split into rows and rejects with reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_strings(spark: SparkSession, path: str, columns: tuple[str, ...] = ("timestamp", "bpm"), comment: str | None = None) -> DataFrame:
    """The columns as strings, header names matched without case and surrounding blanks; a missing one raises ValueError."""
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    names = {c.strip().lower(): c for c in df.columns}
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return df.select(*(F.col(f"`{names[c]}`").cast("string").alias(c) for c in columns))


def load(spark: SparkSession, path: str, low: float = 20.0, high: float = 250.0) -> tuple[DataFrame, DataFrame]:
    """A1: (rows ts, bpm, warning) and (rejects timestamp, bpm, reason). Values out of range stay with a warning; rows
    without finite numbers are rejected (T19)."""
    raw = read_strings(spark, path).withColumn("ts", F.expr("try_cast(timestamp AS double)")).withColumn("value", F.expr("try_cast(bpm AS double)"))
    good = F.col("ts").isNotNull() & F.col("value").isNotNull() & ~F.isnan("ts") & ~F.isnan("value") & (F.abs("ts") < float("inf")) & (F.abs("value") < float("inf"))
    reason = F.when(F.col("ts").isNull(), "bad timestamp").when(F.col("value").isNull(), "bad bpm").otherwise("not finite")
    rows = raw.where(good).select("ts", F.col("value").alias("bpm"), F.when((F.col("value") < low) | (F.col("value") > high), "out of range").alias("warning"))
    return rows, raw.where(~F.coalesce(good, F.lit(False))).select("timestamp", "bpm", reason.alias("reason"))


def checks(rows: DataFrame, session: list[str] | None = None, low: float = 40.0, high: float = 200.0) -> DataFrame:
    """A5: n, duplicates, span, range and plausibility by session. Order is that of ts, so the mean step is the span by the steps
    and duplicates are what isn't distinct: no series is sorted."""
    n, span = F.count("*"), F.max("ts") - F.min("ts")
    return rows.groupBy(*(session or [])).agg(n.alias("n"), (F.count("ts") - F.count_distinct("ts")).alias("duplicates"), span.alias("span"), F.try_divide(span, (F.count("ts") - 1).cast("double")).alias("mean_step"), F.min("bpm").alias("low"), F.max("bpm").alias("high"),
                                              F.avg("bpm").alias("mean"), F.bool_and(F.col("bpm").between(low, high)).alias("plausible"))


def load_strict(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A2: as load(), but any reject fails the query that reads the rows; with a source column."""
    rows, rejects = load(spark, path)
    n = rejects.agg(F.count("*").alias("n"))
    guard = n.select(F.when(F.col("n") > 0, F.raise_error(F.concat(F.col("n").cast("string"), F.lit(" rows rejected")))).otherwise(F.lit(True)).alias("ok"))
    return rows.crossJoin(F.broadcast(guard)).where("ok").select("ts", "bpm", F.lit(source).alias("source"))  # one row on the right


def load_lenient(spark: SparkSession, path: str) -> DataFrame:
    """A3: (ts, bpm) by place, whatever the header calls them; lines of one field or without two numbers are skipped."""
    raw = spark.read.option("header", False).schema("ts string, bpm string").csv(path)
    number = lambda c: F.expr(f"try_cast(trim({c}) AS double)")
    return raw.select(number("ts").alias("ts"), number("bpm").alias("bpm")).where("ts IS NOT NULL AND bpm IS NOT NULL")


def import_sensor(spark: SparkSession, path: str, out: str) -> DataFrame:
    """A4: a sensor's export (# comments, unreadable rows skipped) as normalised CSV; returns its checks. Fewer than three rows raise."""
    raw = spark.read.option("comment", "#").schema("ts string, bpm string").csv(path)
    rows = raw.select(F.expr("try_cast(trim(ts) AS double)").alias("ts"), F.expr("try_cast(trim(bpm) AS double)").alias("bpm")).where("ts IS NOT NULL AND bpm IS NOT NULL")
    summary = checks(rows)
    if summary.first()["n"] < 3:
        raise ValueError(f"{path} has fewer than three readable rows")
    rows.select(F.format_string("%.3f", "ts").alias("timestamp"), F.format_string("%.1f", "bpm").alias("bpm")).write.mode("overwrite").option("header", True).csv(out)
    return summary


SESSION = T.StructType([T.StructField("id", T.LongType()), T.StructField("timestamp", T.StringType()), T.StructField("duration_sec", T.DoubleType()), T.StructField("avg_bpm", T.DoubleType()), T.StructField("notes", T.StringType())])


def save_sessions(rows: DataFrame, path: str) -> None:
    """Appends sessions to the history."""
    rows.write.mode("append").parquet(path)


def history(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """The latest sessions."""
    return spark.read.schema(SESSION).parquet(path).orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(limit)


def save_json(rows: DataFrame, path: str) -> None:
    """A10: a JSON object in each line, nulls left out."""
    rows.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A10: back with a schema: unknown keys are ignored, missing ones null, arrays and conditions restored."""
    return spark.read.schema(schema).json(path)
