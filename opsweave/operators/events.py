"""Queries on the event table: filters, newest rows, counts, retention, updates.

Orderings end in `id` so that results do not depend on how rows are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsweave.config import RetentionParams
from opsweave.functions import severity as sev
from opsweave.functions.text import display_text, fallback_summary, summary_fingerprint
from opsweave.functions.times import Instant, at, utc_clock, utc_day

def _on_or_after(df: DataFrame, since: Instant) -> Column:
    """ts >= since, with the day as well where the table is partitioned by it."""
    cond = F.col("ts") >= at(since)
    if "event_date" in df.columns:
        cond = cond & (F.col("event_date") >= utc_day(at(since)))
    return cond


def valid_events(df: DataFrame) -> DataFrame:
    """Rows with a known type and severity and a readable time; missing raw text becomes ''."""
    return _checked(df).where("_valid").drop("_valid")


def rejected_events(df: DataFrame) -> DataFrame:
    """The rows `valid_events` leaves out, with the reason."""
    return (_checked(df).where("not _valid")
            .withColumn("reason", F.when(~sev.known_type(F.col("type")), "type")
                        .when(~sev.known_severity(F.col("severity")), "severity").otherwise("ts"))
            .drop("_valid"))


def _checked(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "ts": F.col("ts").try_cast("timestamp"),
        "raw_data": F.coalesce("raw_data", F.lit("")),
    }).withColumn("_valid", sev.known_type(F.col("type")) & sev.known_severity(F.col("severity"))
                  & F.col("ts").isNotNull())


def events_since(df: DataFrame, since: Instant, event_type: str | None = None,
                 limit: int | None = None) -> DataFrame:
    """Events from `since` on; with `limit` the oldest so many, in order."""
    df = df.where(_on_or_after(df, since))
    if event_type is not None:
        df = df.where(F.col("type") == event_type)
    return df if limit is None else df.orderBy("ts", "id").limit(limit)


def unanalyzed_since(df: DataFrame, since: Instant, limit: int | None = None) -> DataFrame:
    """Events from `since` on that have no summary; with `limit` the oldest so many, in order."""
    return events_since(df.where(F.col("summary").isNull()), since, limit=limit)


def recent_events(df: DataFrame, limit: int = 50) -> DataFrame:
    return df.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def feed(df: DataFrame, n: int = 200) -> DataFrame:
    """The newest events as a reader sees them: time of day, text, severity, source."""
    return recent_events(df, n).select(
        "id", "host", utc_clock(F.col("ts")).alias("time"),
        display_text(F.col("summary"), F.col("raw_data"), 120).alias("text"), "severity", "source")


def count_by_type(df: DataFrame, since: Instant) -> DataFrame:
    return df.where(_on_or_after(df, since)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def type_counts_ranked(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts by type, largest first; equal counts in order of first occurrence.

    Time and id are taken as two plain minima, which aggregate by hashing; a minimum over a
    struct would sort every task's rows first.
    """
    keys = keys or []
    return (df.groupBy(*keys, "type")
            .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.min("id").alias("first_id"))
            .orderBy(*keys, F.desc("n"), "first_ts", "first_id"))


def severity_counts(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts by severity, critical first; severities that do not occur have no row."""
    keys = keys or []
    return (df.groupBy(*keys, "severity").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(*keys, sev.severity_rank(F.col("severity")).desc()))


def total_events(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def notable_events(df: DataFrame, n: int = 15) -> DataFrame:
    """The first `n` events by severity, then time."""
    return df.orderBy(sev.severity_rank(F.col("severity")).desc(), "ts", "id").limit(n)


def critical_first(df: DataFrame, n: int = 5) -> DataFrame:
    """The oldest `n` critical events with their display text."""
    return (df.where(F.col("severity") == "critical").orderBy("ts", "id").limit(n)
            .select("id", "host", "ts", "type",
                    display_text(F.col("summary"), F.col("raw_data"), 80).alias("text")))


def expired(as_of: Instant, params: RetentionParams = RetentionParams()) -> Column:
    """True for events past retention: service failures and applied fixes are kept longer."""
    long_kept = (F.col("type") == "service_fail") | F.coalesce(F.col("user_action") == "applied", F.lit(False))
    ordinary = at(as_of) - F.expr(f"INTERVAL {params.days} DAYS")
    extended = at(as_of) - F.expr(f"INTERVAL {params.critical_days} DAYS")
    return F.when(long_kept, F.col("ts") < extended).otherwise(F.col("ts") < ordinary)


def retention_keep(df: DataFrame, as_of: Instant, params: RetentionParams = RetentionParams()) -> DataFrame:
    return df.where(~expired(as_of, params))


def retention_deleted(df: DataFrame, as_of: Instant, params: RetentionParams = RetentionParams()) -> DataFrame:
    """How many rows retention deletes."""
    return df.agg(F.count_if(expired(as_of, params)).alias("deleted"))


def actionable(action: Column) -> Column:
    """The lower-cased action if it asks for something to be done, else null."""
    return F.when(F.lower(action).isin("restart_service", "reboot", "investigate"), F.lower(action))


def with_fallback_summary(df: DataFrame) -> DataFrame:
    return df.withColumn("summary", F.coalesce("summary", fallback_summary(F.col("raw_data"))))


def summary_update(df: DataFrame, summary: Column, updated_at: Column) -> DataFrame:
    """Update rows that set a summary together with its grouping hash."""
    return df.select("id", summary.alias("summary"), summary_fingerprint(summary).alias("summary_hash"),
                     F.lit(None).cast("string").alias("user_action"), updated_at.alias("updated_at"))


def action_update(df: DataFrame, action: Column, updated_at: Column) -> DataFrame:
    """Update rows that set the user action."""
    return df.select("id", F.lit(None).cast("string").alias("summary"),
                     F.lit(None).cast("string").alias("summary_hash"),
                     action.alias("user_action"), updated_at.alias("updated_at"))


UPDATED = ("summary", "summary_hash", "user_action")


def apply_updates(df: DataFrame, updates: DataFrame) -> DataFrame:
    """Events with an append-only update log applied: per column the last written value wins.

    updates: id, updated_at and any of summary, summary_hash, user_action; null leaves a
    column as it is. Updates are reduced to one row per id before the join.
    """
    present = [c for c in UPDATED if c in updates.columns]
    latest = updates.groupBy("id").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("updated_at", c))).alias(f"_new_{c}") for c in present])
    return (df.join(latest, "id", "left")
            .withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in present})
            .drop(*[f"_new_{c}" for c in present]))


def add_missing_columns(df: DataFrame, schema) -> DataFrame:
    """An older table brought to the given schema; columns it lacks are null."""
    have = set(df.columns)
    return df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in schema])


def union_events(*parts: DataFrame) -> DataFrame:
    """All sources as one event table; columns a source lacks are null."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first
