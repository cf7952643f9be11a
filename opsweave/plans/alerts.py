"""Alerts as rows of the event table: host, ts, type, severity, source, raw_data, summary and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsweave.config import LevelParams, TrendParams
from opsweave.functions.text import fixed
from opsweave.operators import change, series
from opsweave.plans.report import boot_events
from opsweave.plans.store import with_event_id
from opsweave.sources import tools

# The wording of raw_data and summary, and the names of the sources.
METRICS = "metrics"


def event_rows(alerts: DataFrame, event_type: str, source: str, raw_data: Column, summary: Column,
               severity: Column | str | None = None, ts: str = "ts") -> DataFrame:
    """Alerts in the shape of the event table, with an id made of their content."""
    level = F.col("severity") if severity is None else F.lit(severity) if isinstance(severity, str) else severity
    return with_event_id(alerts.select(
        "host", F.col(ts).cast("timestamp").alias("ts"), F.lit(event_type).alias("type"), level.alias("severity"),
        F.lit(source).alias("source"), raw_data.alias("raw_data"), summary.alias("summary")))


def _whole(number: Column) -> Column:
    return number.cast("long").cast("string")


def ram_trend_rows(samples: DataFrame, params: TrendParams = TrendParams(), above: float = 70.0, slope: float = 10.0) -> DataFrame:
    found = series.ram_projection(samples, params, above, slope)
    return event_rows(found, "trend_alert", METRICS, F.col("raw_data"), F.col("summary"))


def disk_trend_rows(samples: DataFrame, params: TrendParams = TrendParams(), slope: float = 0.5,
                    within_hours: float = 72) -> DataFrame:
    found = series.disk_projection(samples, params, slope, within_hours)
    return event_rows(found, "trend_alert", METRICS, F.col("raw_data"), F.col("summary"))


def disk_level_rows(samples: DataFrame, params: LevelParams = LevelParams()) -> DataFrame:
    found = series.two_level_alerts(samples, params)
    return event_rows(found, "disk_alert", METRICS, F.concat(F.lit("pct="), F.col("value").cast("string")), F.col("summary"))


def process_rows(processes: DataFrame, ticks: DataFrame, limit_gb: float = 10) -> DataFrame:
    found = series.top_process_alerts(processes, ticks, limit_gb)
    raw = F.concat(F.lit("pid="), _whole(F.col("pid")), F.lit(" name="), "name", F.lit(" gb="),
                   fixed(F.col("rss") / 1024 ** 3, 1))
    return event_rows(found, "system_metric", METRICS, raw, F.col("summary"), ts="tick")


def process_samples(processes: DataFrame, k: int = 5) -> DataFrame:
    """Memory of the largest processes of every poll as series proc_<name>_gb, for the trend; the last of a name counts."""
    top = series.top_k_processes(series.large_processes(processes), k)
    return (top.groupBy("host", "tick", "name").agg(F.min_by("rss", F.struct("rss", -F.col("pid"))).alias("rss"))
            .select("host", F.concat(F.lit("proc_"), "name", F.lit("_gb")).alias("metric"),
                    F.col("tick").cast("timestamp").alias("ts"), (F.col("rss") / 1024 ** 3).alias("value")))


def pressure_rows(samples: DataFrame) -> DataFrame:
    return event_rows(series.pressure_alerts(samples), "system_metric", METRICS, F.col("raw_data"), F.col("summary"))


def temperature_rows(samples: DataFrame) -> DataFrame:
    return event_rows(series.temperature_alerts(samples), "system_metric", METRICS, F.col("raw_data"), F.col("summary"))


def vram_rows(readings: DataFrame) -> DataFrame:
    """Graphics memory (host, ts, used, total in MB); alerts at 90 %, again only after less than 85 %."""
    share = F.when(F.col("total") > 0, F.col("used") / F.col("total") * 100).otherwise(0.0)
    found = series.vram_alerts(readings.withColumns({"metric": F.lit("gpu_vram_pct"), "value": share}))
    percent = fixed(F.col("value"), 0)
    return event_rows(found, "system_metric", METRICS, F.concat(F.lit("vram="), percent, F.lit("%")), F.concat(
        F.lit("GPU VRAM "), percent, F.lit("% ("), fixed(F.col("used"), 0), F.lit("/"), fixed(F.col("total"), 0), F.lit(" MB)")))


def gpu_temperature_rows(samples: DataFrame) -> DataFrame:
    degrees = F.col("value").cast("double").cast("string")
    return event_rows(series.gpu_temperature_alerts(samples), "system_metric", METRICS, F.concat(F.lit("gpu_temp="), degrees),
                      F.concat(F.lit("GPU "), degrees, F.lit("C critical")))


def media_error_rows(samples: DataFrame) -> DataFrame:
    raw = F.concat(F.lit("dev="), "metric", F.lit(" errors="), _whole(F.col("value")))
    return event_rows(series.media_error_alerts(samples), "system_metric", METRICS, raw, F.col("summary"))


def spare_rows(smart: DataFrame) -> DataFrame:
    """Scans (host, ts, device, spare, spare_threshold) of devices that run out of spare capacity."""
    spare = _whole(F.col("spare"))
    return event_rows(series.level_check(smart), "system_metric", METRICS,
                      F.concat(F.lit("dev="), "device", F.lit(" spare="), spare, F.lit("%")),
                      F.concat(F.lit("NVMe "), "device", F.lit(": spare "), spare, F.lit("% — failing")))


def storage_error_rows(samples: DataFrame) -> DataFrame:
    raw = F.concat(F.lit("btrfs "), "metric", F.lit("="), _whole(F.col("value")))
    return event_rows(series.storage_error_alerts(samples), "system_metric", METRICS, raw, F.col("summary"))


def coredump_rows(raw_lines: DataFrame) -> DataFrame:
    """Crashes not seen before; those that the first scan of a host finds are its silent baseline."""
    seen = change.first_seen(tools.parse_coredumps(raw_lines), ["host", "dump_key"], ["captured_at", "id"], prime=True)
    return event_rows(tools.coredump_events(seen), "log_anomaly", "coredump", F.col("raw_data"), F.col("summary"), ts="captured_at")


def audit_rows(raw_lines: DataFrame, ticks: DataFrame) -> DataFrame:
    """Vulnerable packages that the poll before did not list. raw_lines: host, source, tick, line."""
    fresh = change.new_entities(tools.parse_audit(raw_lines), ticks)
    return event_rows(tools.audit_events(fresh), "config_change", "security", F.col("raw_data"), F.col("summary"), ts="tick")


def orphan_rows(packages: DataFrame, ticks: DataFrame) -> DataFrame:
    """Polls that list more orphaned packages than the poll before."""
    n, added = F.col("n").cast("string"), F.col("added").cast("string")
    return event_rows(change.growth_alert(packages, ticks), "system_metric", "orphan", F.concat(F.lit("orphans="), n),
                      F.concat(n, F.lit(" orphans ("), added, F.lit(" new): "), "sample"), severity="info", ts="tick")


def accumulation_rows(snapshots: DataFrame, key: str = "number", order: str = "ts", warn: int = 50) -> DataFrame:
    """One row per host when its distinct snapshots reach `warn`."""
    n = F.col("n").cast("string")
    return event_rows(change.accumulation_alert(snapshots, key, [order], warn), "disk_alert", "snapshot",
                      F.concat(F.lit("snapshot_count="), n, F.lit(f" threshold={warn}")),
                      F.concat(n, F.lit(" snapshots accumulated — consider cleanup")), severity="warning", ts=order)


def boot_rows(reports: DataFrame) -> DataFrame:
    """What crash reports say of the session before, as an event of the boot that found it."""
    return with_event_id(boot_events(reports))
