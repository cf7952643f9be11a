"""Every alert as complete rows of the event table, alone and all together."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsweave.catalog import EV, ORACLES, POLLS, SAMPLES, query, us
from opsweave.catalog import change, reports  # noqa: F401 (their SQL is used here)
from opsweave.catalog.parse import _DUMPS, _dumps, _log
from opsweave.catalog.series import _CHIP, _FLOORED, _LIMIT, _PROC, _RAM, _RES, _TLIM, TREND, _alerts, _latch, _processes
from opsweave.config import LevelParams
from opsweave.operators.timeline import new_path
from opsweave.plans import alerts, report, store
from opsweave.sources.tables import daily_errors, daily_ticks, metric_samples, sample_events, scan_events

COLUMNS = ["host", "type", "severity", "source", "raw_data", "summary"]


def _rows(df: DataFrame) -> DataFrame:
    return df.select(us(), *COLUMNS)


def _sql(event_type: str, source: str, severity: str, raw: str, summary: str, ts: str = "us") -> str:
    return (f"SELECT {ts} AS ts_us, host, '{event_type}' AS type, {severity} AS severity, '{source}' AS source, "
            f"{raw} AS raw_data, {summary} AS summary")


@query(f"WITH {_RAM}, {_alerts('ram', '0.01')}, m AS (SELECT *, (100.0 - value) / slope * 60 AS mins FROM alerts WHERE slope > 0) "
       + _sql("trend_alert", "metrics", "CASE WHEN mins < 15 THEN 'critical' ELSE 'warning' END",
              "printf('ram=%.0f%% mins=%.0f', value, mins)", "printf('RAM %.0f%% — OOM in %.0f min', value, mins)")
       + " FROM m WHERE mins < 60")
def ram_trend_rows(spark, folder):
    s = metric_samples(spark, folder).withColumn("value", F.least("value", F.lit(99.99)))
    return _rows(alerts.ram_trend_rows(s, TREND, above=20.0, slope=0.01))


@query(f"WITH {_RAM}, {_alerts('ram', '0.01')}, m AS (SELECT *, (100.0 - value) / slope AS hrs FROM alerts WHERE slope > 0) "
       + _sql("trend_alert", "metrics", "'warning'", "printf('disk=%.0f%% hrs=%.0f', value, hrs)",
              "printf('Disk full in %.1f days', hrs / 24)") + " FROM m WHERE hrs < 720")
def disk_trend_rows(spark, folder):
    s = metric_samples(spark, folder).withColumn("value", F.least("value", F.lit(99.99))).where("value > 20")
    return _rows(alerts.disk_trend_rows(s, TREND, slope=0.01, within_hours=720))


@query(f"WITH {SAMPLES}, l AS (SELECT *, {_latch('value >= 95', 'value < 95')} AS c, "
       f"{_latch('value >= 60 AND value < 95', 'value < 60')} AS w FROM samples) "
       + _sql("disk_alert", "metrics", "CASE WHEN value >= 95 THEN 'critical' ELSE 'warning' END", "concat('pct=', value)",
              "printf('Disk %.0f%%', value)") + " FROM l WHERE (value >= 95 AND c = 0) OR (value >= 60 AND value < 95 AND w = 0)")
def disk_level_rows(spark, folder):
    return _rows(alerts.disk_level_rows(metric_samples(spark, folder), LevelParams(60, 95)))


_HEAVY = _PROC + """, heavy AS (SELECT host, tick, name, max(rss) AS rss, arg_min(pid, (-rss, pid)) AS pid FROM top
  WHERE rss / 1073741824.0 > 10 GROUP BY ALL),
prev AS (SELECT host, tick, lag(tick) OVER (PARTITION BY host ORDER BY tick) AS p FROM (SELECT DISTINCT host, tick FROM proc))
"""


@query(_HEAVY + _sql("system_metric", "metrics", "'warning'", "printf('pid=%d name=%s gb=%.1f', pid, name, rss / 1073741824.0)",
                     "printf('%s (PID %d) using %.1f GB RAM', name, pid, rss / 1073741824.0)", "epoch_us(h.tick)")
       + """ FROM heavy h JOIN prev USING (host, tick) WHERE NOT EXISTS
  (SELECT 1 FROM heavy b WHERE b.host = h.host AND b.name = h.name AND b.tick = prev.p)""")
def process_rows(spark, folder):
    p = _processes(spark, folder)
    return _rows(alerts.process_rows(p, p.select("host", "tick")))


@query(_PROC + "SELECT epoch_us(tick) AS ts_us, host, concat('proc_', name, '_gb') AS metric, "
       "round(min(rss) / 1073741824.0, 6) AS value FROM top GROUP BY ALL")
def process_samples(spark, folder):
    return alerts.process_samples(_processes(spark, folder)).select(us(), "host", "metric", F.round("value", 6).alias("value"))


@query(f"WITH {SAMPLES}, p AS (SELECT host, {_RES} AS metric, us, value, {_LIMIT} AS lim FROM samples), "
       f"l AS (SELECT *, {_latch('value >= lim', 'value < lim * 0.7')} AS latch FROM p) "
       + _sql("system_metric", "metrics", "CASE WHEN metric = 'memory' THEN 'critical' ELSE 'warning' END",
              "printf('psi_%s=%.1f', metric, value)", "printf('%s pressure %.0f%%', metric, value)")
       + " FROM l WHERE value >= lim AND latch = 0")
def pressure_rows(spark, folder):
    m = F.col("metric")
    s = metric_samples(spark, folder).withColumn("metric", F.when(m.endswith("0"), "psi_cpu").when(m.endswith("1"), "psi_memory")
                                                 .when(m.endswith("2"), "psi_io").otherwise("psi_irq"))
    return _rows(alerts.pressure_rows(s))


@query(f"WITH {SAMPLES}, l AS (SELECT *, {_CHIP} AS chip, {_TLIM} AS lim, {_latch(f'value >= {_TLIM}', f'value < {_TLIM} - 5')} AS latch "
       "FROM samples) " + _sql("system_metric", "metrics", "CASE WHEN value >= lim + 10 THEN 'critical' ELSE 'warning' END",
                               "printf('%s/%s=%.0fC', chip, metric, value)", "printf('%s/%s at %.0fC', chip, metric, value)")
       + " FROM l WHERE value >= lim AND latch = 0")
def temperature_rows(spark, folder):
    m = F.col("metric")
    s = metric_samples(spark, folder).withColumns({"chip": F.when(m.endswith("0"), "k10temp").when(m.endswith("1"), "nvme")
                                                   .otherwise("other"), "label": m})
    return _rows(alerts.temperature_rows(s))


_VRAM = (f"WITH {EV}, samples AS (SELECT host, 'vram' AS metric, us, id, value AS used, 120.0 AS total, value / 120.0 * 100 AS value FROM ev), "
         f"l AS (SELECT *, {_latch('value >= 90', 'value < 85')} AS latch FROM samples) ")


@query(_VRAM + _sql("system_metric", "metrics", "'warning'", "printf('vram=%.0f%%', value)",
                    "printf('GPU VRAM %.0f%% (%.0f/%.0f MB)', value, used, total)") + " FROM l WHERE value >= 90 AND latch = 0")
def vram_rows(spark, folder):
    return _rows(alerts.vram_rows(sample_events(spark, folder).select("host", "ts", F.col("value").alias("used"), F.lit(120.0).alias("total"))))


@query(f"WITH {SAMPLES}, l AS (SELECT *, {_latch('value >= 85', 'value < 80')} AS latch FROM samples) "
       + _sql("system_metric", "metrics", "'critical'", "concat('gpu_temp=', value)", "concat('GPU ', value, 'C critical')")
       + " FROM l WHERE value >= 85 AND latch = 0")
def gpu_temperature_rows(spark, folder):
    return _rows(alerts.gpu_temperature_rows(metric_samples(spark, folder)))


@query(_FLOORED + _sql("system_metric", "metrics", "'critical'", "concat('dev=', metric, ' errors=', CAST(v AS BIGINT))",
                       "concat('NVMe ', metric, ': ', CAST(v - p AS BIGINT), ' new media errors')") + " FROM l WHERE v > p")
def media_error_rows(spark, folder):
    return _rows(alerts.media_error_rows(metric_samples(spark, folder).withColumn("value", F.floor("value"))))


@query(f"WITH {EV} " + _sql("system_metric", "metrics", "'critical'", "concat('dev=/dev/', source, ' spare=', CAST(floor(value) AS BIGINT), '%')",
                            "concat('NVMe /dev/', source, ': spare ', CAST(floor(value) AS BIGINT), '% — failing')")
       .replace("'metrics' AS source", "'metrics' AS origin") + " FROM ev WHERE floor(value) <= user_id")
def spare_rows(spark, folder):
    smart = sample_events(spark, folder).select("host", "ts", F.concat(F.lit("/dev/"), "source").alias("device"),
                                                F.floor("value").alias("spare"), F.col("user_id").alias("spare_threshold"))
    return _rows(alerts.spare_rows(smart)).withColumnRenamed("source", "origin")


_ERRS = "concat(metric, CASE WHEN ends_with(metric, '1') THEN '.corruption_errs' ELSE '.write_errs' END)"


@query(_FLOORED + _sql("system_metric", "metrics", "CASE WHEN ends_with(metric, '1') THEN 'critical' ELSE 'warning' END",
                       f"concat('btrfs ', {_ERRS}, '=', CAST(v AS BIGINT))",
                       f"concat('btrfs: ', CAST(v - p AS BIGINT), ' new ', split_part({_ERRS}, '.', 2))") + " FROM l WHERE v > p")
def storage_error_rows(spark, folder):
    s = metric_samples(spark, folder).withColumns({"value": F.floor("value"), "metric": F.concat(
        "metric", F.when(F.col("metric").endswith("1"), ".corruption_errs").otherwise(".write_errs"))})
    return _rows(alerts.storage_error_rows(s))


@query(f"WITH {_DUMPS}, k AS (SELECT *, row_number() OVER (PARTITION BY host, user_id, signal ORDER BY us, id) AS r, "
       "min(us) OVER (PARTITION BY host) AS first FROM d) "
       + _sql("log_anomaly", "coredump", "CASE WHEN signal = 'SIGSEGV' THEN 'critical' ELSE 'warning' END",
              "concat('sig=', signal, ' exe=', coalesce(exe, 'None'))",
              "concat('Crash: ', coalesce(split_part(exe, '/', 4), 'unknown'), ' (', signal, ')')") + " FROM k WHERE r = 1 AND us > first")
def coredump_rows(spark, folder):
    return _rows(alerts.coredump_rows(_dumps(spark, folder)))


@query(f"WITH {POLLS}, fresh AS (SELECT e.* FROM ents e JOIN prev USING (host, tick) WHERE NOT EXISTS "
       "(SELECT 1 FROM ents b WHERE b.host = e.host AND b.entity = e.entity AND b.tick = prev.p)) "
       + _sql("config_change", "security", "'critical'", "concat('pkg=', entity, ' risk=High')",
              "concat('CVE: ', entity, ' — bad things (High)')", "epoch_us(tick)") + " FROM fresh")
def audit_rows(spark, folder):
    lines = daily_errors(spark, folder).select("host", "source", "tick", F.concat("entity", F.lit(
        " is affected by bad things. High risk!")).alias("line"))
    return _rows(alerts.audit_rows(lines, daily_ticks(spark, folder)))


@query(_sql("system_metric", "orphan", "'info'", "concat('orphans=', n)", "concat(n, ' orphans (', added, ' new): ', sample)",
            "epoch_us(tick)") + " FROM (" + ORACLES["growth_alert"] + ")")
def orphan_rows(spark, folder):
    return _rows(alerts.orphan_rows(daily_errors(spark, folder), daily_ticks(spark, folder)))


@query(_sql("disk_alert", "snapshot", "'warning'", "concat('snapshot_count=', n, ' threshold=40')",
            "concat(n, ' snapshots accumulated — consider cleanup')", "epoch_us(tick)") + " FROM (" + ORACLES["accumulation_alert"] + ")")
def accumulation_rows(spark, folder):
    return _rows(alerts.accumulation_rows(daily_errors(spark, folder), "entity", "tick", 40))


@query(_sql("boot_analysis", "boot", "'warning'", "'prev_state=booted'", "analysis", "ts_us") + " FROM (" + ORACLES["crash_report"] + ")")
def boot_rows(spark, folder):
    boots = sample_events(spark, folder).where("event_type = 'signup'").select(
        "host", F.to_date("ts").cast("string").alias("session"), "ts",
        F.when(F.col("value") >= 40, "clean").otherwise("booted").alias("state"))
    return _rows(alerts.boot_rows(report.crash_report(boots, _log(spark, folder))))


ALL = [ram_trend_rows, disk_trend_rows, disk_level_rows, process_rows, pressure_rows, temperature_rows, vram_rows, gpu_temperature_rows,
       media_error_rows, storage_error_rows, coredump_rows, audit_rows, orphan_rows, accumulation_rows]


@query("SELECT type, severity, source, count(*) AS n, count(DISTINCT summary) AS texts FROM ("
       + " UNION ALL ".join(f"SELECT * FROM ({ORACLES[f.__name__]})" for f in ALL) + ") GROUP BY ALL")
def all_alert_events(spark, folder):
    """All alerts in one table, stored and read back."""
    path = new_path(spark, "events")
    parts = [f(spark, folder).withColumn("ts", F.timestamp_micros("ts_us")).drop("ts_us") for f in ALL]
    store.append_events(reduce(DataFrame.unionByName, parts), path)
    return scan_events(spark, path).groupBy("type", "severity", "source").agg(
        F.count("*").alias("n"), F.count_distinct("summary").alias("texts"))
