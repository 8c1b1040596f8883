"""Experiment records (survey A8, A10, J6): flat windows and their conditions as sessions with nested windows, in JSON and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A condition that a window was under, and a window (its arrays are kept; nothing is lost on the way back).
CONDITION = T.StructType([T.StructField("type", T.StringType()), T.StructField("severity", T.DoubleType()), T.StructField("evidence", T.MapType(T.StringType(), T.DoubleType())), T.StructField("is_actionable", T.BooleanType()), T.StructField("description", T.StringType())])
WINDOW = T.StructType([
    T.StructField("window_id", T.StringType()), T.StructField("start_time", T.DoubleType()), T.StructField("end_time", T.DoubleType()), T.StructField("hr_estimate", T.DoubleType()), T.StructField("hr_reference", T.DoubleType()), T.StructField("hr_confidence", T.DoubleType()),
    T.StructField("signal_quality", T.DoubleType()), T.StructField("is_valid", T.BooleanType()), T.StructField("rgb_mean", T.ArrayType(T.DoubleType())), T.StructField("bvp_signal", T.ArrayType(T.DoubleType())), T.StructField("conditions", T.ArrayType(CONDITION)),
])
SESSION = T.StructType([T.StructField("experiment_id", T.StringType()), T.StructField("session_id", T.StringType()), T.StructField("subject_id", T.StringType()), T.StructField("part", T.LongType()), T.StructField("windows", T.ArrayType(WINDOW))])

#: Windows of one row of a session: longer sessions have several rows (parts).
PART = 1000


def tree(windows: DataFrame, conditions: DataFrame, experiment: str, part: int = PART) -> DataFrame:
    """SESSION rows of windows (session_id, subject_id, window_id, number, the fields of WINDOW) and conditions (window_id, the fields of CONDITION).

    A session's windows are in the order of number, `part` of them a row, so that no row grows with a session. Fields of WINDOW
    that windows doesn't have are null.
    """
    own = conditions.groupBy("window_id").agg(F.sort_array(F.collect_list(F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in CONDITION if f.name != "evidence"), F.to_json("evidence").alias("evidence")))).alias("found"))
    restored = F.transform("found", lambda c: F.struct(c["type"].alias("type"), c["severity"].alias("severity"), F.from_json(c["evidence"], CONDITION["evidence"].dataType).alias("evidence"), c["is_actionable"].alias("is_actionable"), c["description"].alias("description")))
    rows = windows.join(own, "window_id", "left").withColumn("conditions", F.coalesce(restored, F.array().cast(WINDOW["conditions"].dataType)))
    fields = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in WINDOW]
    rows = rows.select(F.lit(experiment).alias("experiment_id"), F.col("session_id").cast("string"), F.col("subject_id").cast("string"), F.floor(F.col("number") / part).cast("bigint").alias("part"), F.col("number"), F.struct(*fields).alias("window"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("number", "window")), lambda a, b: (a["number"] - b["number"]).cast("int")), lambda w: w["window"])
    return rows.groupBy("experiment_id", "session_id", "subject_id", "part").agg(ordered.alias("windows"))


def flat(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows and conditions of SESSION rows again."""
    w = sessions.select("experiment_id", "session_id", "subject_id", F.explode("windows").alias("w"))
    windows = w.select("experiment_id", "session_id", "subject_id", *(F.col(f"w.{f.name}").alias(f.name) for f in WINDOW if f.name != "conditions"))
    conditions = w.select("w.window_id", F.explode("w.conditions").alias("c")).select("window_id", *(F.col(f"c.{f.name}").alias(f.name) for f in CONDITION))
    return windows, conditions


def save(sessions: DataFrame, path: str) -> None:
    """Appends a JSON object a row, nulls left out."""
    sessions.write.mode("append").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """SESSION rows: unknown keys are ignored, missing ones null."""
    return spark.read.schema(SESSION).json(path)


#: Single readings of a session.
READING = T.StructType([T.StructField("session_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("timestamp", "bpm", "resp", "hrv_sdnn", "stress", "sqi"))])


def save_readings(rows: DataFrame, path: str) -> None:
    """Appends readings; columns that rows doesn't have are null."""
    rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in READING)).write.mode("append").parquet(path)


def summaries(readings: DataFrame) -> DataFrame:
    """A row of the session history from readings: duration and averages (rates of 0 or less don't count)."""
    above = F.when(F.col("bpm") > 0, F.col("bpm"))
    return readings.groupBy(F.col("session_id").alias("id")).agg(F.min("timestamp").alias("timestamp"), (F.max("timestamp") - F.min("timestamp")).alias("duration_sec"), F.avg(above).alias("avg_bpm"), F.avg("resp").alias("avg_resp"), F.avg("hrv_sdnn").alias("avg_hrv_sdnn"), F.avg("stress").alias("avg_stress"), F.avg("sqi").alias("avg_sqi"))
