"""Rolling health status per host.

A host is critical while it had a critical event within the last hour, degraded while
it had a warning (or the analyzer is down), else healthy. Only the time of the last
event of either severity matters, so no row range has to be kept or replayed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsweave.operators.timeline import Timeline

HOUR = 3600.0


def _status(now: Column, critical_us: Column, warning_us: Column, width_us: int, analyzer_down: Column) -> Column:
    """An event exactly one window old no longer counts."""
    recent = lambda us: F.coalesce(now - us < width_us, F.lit(False))
    return (F.when(recent(critical_us), "critical")
            .when(recent(warning_us) | analyzer_down, "degraded").otherwise("healthy"))


def rolling_status(events: DataFrame, window: float = HOUR, analyzer_down: Column | None = None) -> DataFrame:
    """Each event with the status of its host right after it."""
    now = F.unix_micros("ts")
    crit = F.when(F.col("severity") == "critical", now)
    warn = F.when(F.col("severity") == "warning", now)
    rows = Timeline(events, ["host"], ["ts", "id"]).carry({"_crit": crit, "_warn": warn}).df
    down = F.lit(False) if analyzer_down is None else analyzer_down
    return rows.withColumn("status", _status(now, F.coalesce(crit, "_crit"), F.coalesce(warn, "_warn"),
                                             round(window * 1e6), down)).drop("_crit", "_warn")


def status_transitions(statuses: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rows whose status differs from the host's previous one, as old and new; hosts start healthy."""
    rows = Timeline(statuses, ["host"], order or ["ts", "id"]).carry({"_old": F.col("status")}).df
    return (rows.withColumn("old", F.coalesce("_old", F.lit("healthy"))).where(F.col("old") != F.col("status"))
            .withColumnRenamed("status", "new").drop("_old"))


def status_timeline(events: DataFrame, window: float = HOUR) -> DataFrame:
    """Status as intervals (host, start_ts, end_ts, status), expiry of old events included.

    The status can change only when an event arrives or leaves the window; those moments,
    one row per host and time, are the points at which it is evaluated. The last interval
    of a host has no end.
    """
    width = round(window * 1e6)
    loud = events.where(F.col("severity").isin("critical", "warning")).select(
        "host", F.unix_micros("ts").alias("us"), "severity")
    crit, warn = F.col("severity") == "critical", F.col("severity") == "warning"
    moments = (loud.select("host", "us", F.when(crit, F.col("us")).alias("crit"),
                           F.when(warn, F.col("us")).alias("warn"))
               .union(loud.select("host", F.col("us") + width, F.lit(None).cast("long"), F.lit(None).cast("long")))
               .groupBy("host", "us").agg(F.max("crit").alias("crit"), F.max("warn").alias("warn")))
    now = F.col("us")
    # what precedes a moment also tells the status at the moment before it
    rows = Timeline(moments, ["host"], ["us"]).carry({"_crit": F.col("crit"), "_warn": F.col("warn"), "_before": now})
    down = F.lit(False)
    rows = rows.with_columns({
        "status": _status(now, F.coalesce("crit", "_crit"), F.coalesce("warn", "_warn"), width, down),
        "_old": _status(F.col("_before"), F.col("_crit"), F.col("_warn"), width, down)})
    changes = rows.where(F.col("_old") != F.col("status"))
    return changes.carry({"_end": now}, reverse=True).df.select(
        "host", F.timestamp_micros("us").alias("start_ts"), F.timestamp_micros("_end").alias("end_ts"), "status")
