"""The given sample tables as event, metric, poll and raw text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsweave.schemas import STORED_EVENTS

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_events(spark: SparkSession, path: str) -> DataFrame:
    """A stored event table without its embeddings, which no query reads."""
    return spark.read.schema(STORED_EVENTS).parquet(path).drop("embedding", "batch")


def shape_events(events: DataFrame) -> DataFrame:
    """The raw `events` table (batch or stream) as system events."""
    kind = F.col("event_type")
    user = F.col("user_id").cast("string")
    return events.withColumn("ts", F.col("ts").cast("timestamp")).select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("host"),
        "ts",
        F.when(kind == "error", "log_anomaly").when(kind == "signup", "service_fail")
        .when(kind == "purchase", "package_update").when(kind == "click", "system_metric")
        .otherwise("snapshot").alias("type"),
        F.when((kind == "error") & (F.col("value") >= 100), "critical").when(kind == "error", "warning")
        .otherwise("info").alias("severity"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("seen "), kind)).alias("summary"),
        F.concat(F.lit("unit=u"), user, F.lit(" msg="), kind, F.lit("["), F.col("event_id").cast("string"),
                 F.lit("]")).alias("raw_data"),
        F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("source"),
        F.when(F.col("event_id") % 7 == 0, "applied").when(F.col("event_id") % 11 == 0, "ignored")
        .alias("user_action"),
        "user_id", "event_type", "value")


def sample_events(spark: SparkSession, folder: str) -> DataFrame:
    return shape_events(table(spark, folder, "events"))


EVENT_COLUMNS = ["id", "host", "ts", "type", "severity", "summary", "raw_data", "source", "user_action"]


def system_events(spark: SparkSession, folder: str) -> DataFrame:
    return sample_events(spark, folder).select(*EVENT_COLUMNS)


def metric_samples(spark: SparkSession, folder: str, prefix: str = "u") -> DataFrame:
    """One series per user: host, metric, ts, value."""
    return sample_events(spark, folder).select(
        "host", F.concat(F.lit(prefix), F.col("user_id").cast("string")).alias("metric"), "ts", "value")


def daily_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """One poll per host and day on which the host had any event."""
    return (sample_events(spark, folder)
            .select("host", F.lit("poll").alias("source"), F.to_date("ts").alias("tick")).distinct())


def daily_errors(spark: SparkSession, folder: str) -> DataFrame:
    """The users with an error in each daily poll."""
    return (sample_events(spark, folder).where("event_type = 'error'")
            .select("host", F.lit("poll").alias("source"), F.to_date("ts").alias("tick"),
                    F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity")).distinct())


def daily_states(spark: SparkSession, folder: str) -> DataFrame:
    """Per user and day with any event: up means no error that day."""
    return (sample_events(spark, folder)
            .groupBy("host", F.lit("poll").alias("source"), F.to_date("ts").alias("tick"),
                     F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity"))
            .agg(F.every(F.col("event_type") != "error").alias("up")))


def raw_lines(events: DataFrame, line) -> DataFrame:
    """Collected text lines derived from events."""
    return events.select("id", "host", F.col("ts").alias("captured_at"), line.alias("line"))


def raw_blobs(events: DataFrame, body) -> DataFrame:
    return events.select("id", "host", F.col("ts").alias("captured_at"), body.alias("body"))
