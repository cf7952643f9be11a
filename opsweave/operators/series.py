"""Metric series: smoothing, trends, rates, counters and threshold alerts.

Samples are long rows (host, metric, ts, value). Latches ("fire once until it clears")
need no fold: whether a latch is set is the last row that set or cleared it.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsweave.config import LevelParams, TrendParams
from opsweave.functions.text import fixed
from opsweave.operators.change import new_entities
from opsweave.operators.throttle import MICROS, cooldown_rows
from opsweave.operators.timeline import Columns, Timeline, written

SERIES = ["host", "metric"]

# Alert thresholds by sensor chip and pressure resource, and trend
# thresholds in units per hour by metric.
TEMPERATURE_LIMITS = {"k10temp": 90.0, "nct6799": 85.0, "spd5118": 55.0, "amdgpu": 95.0, "nvme": 70.0}
TEMPERATURE_DEFAULT = 85.0
PRESSURE_LIMITS = {"cpu": 50.0, "memory": 20.0, "io": 80.0}
PRESSURE_DEFAULT = 50.0
SLOPE_LIMITS = {
    "cpu_pct": 20.0,
    "ram_pct": 10.0,
    "swap_pct": 5.0,
    "disk_pct": 0.5,
    "net_recv_mbps": 50.0,
    "net_sent_mbps": 50.0,
    "gpu_temp": 5.0,
    "gpu_vram_pct": 10.0,
    "io_util": 20.0,
}
# Metrics named by pattern: pressure, temperature and process memory series.
SLOPE_PATTERNS = {"psi_%": 10.0, "t\\_%": 5.0, "proc\\_%\\_gb": 1.0}


def lookup(key: Column, table: dict[str, float], default: float | None) -> Column:
    """Constant table lookup inside the projection; no join for a handful of fixed rows."""
    out = F.lit(default).cast("double")
    for name, limit in reversed(list(table.items())):
        out = F.when(key == name, limit).otherwise(out)
    return out


def slope_limit(metric: Column) -> Column:
    """Built-in trend threshold of a metric; null where there is none."""
    out = lookup(metric, SLOPE_LIMITS, None)
    for pattern, limit in SLOPE_PATTERNS.items():
        out = F.coalesce(out, F.when(metric.like(pattern), limit))
    return out


#: Configured metrics that are broadcast at most, some 2 MB.
BROADCAST_METRICS = 20_000


def with_thresholds(samples: DataFrame, configured: DataFrame | None = None,
                    explicit: float | None = None, default: Column | None = None) -> DataFrame:
    """Adds `threshold`: the explicit value, else the configured one for the metric, else `default`.

    configured: (metric, threshold). Up to BROADCAST_METRICS metrics are broadcast; more, which
    makes a metric's samples few, are joined by shuffle.
    """
    fallback = F.lit(None).cast("double") if default is None else default
    if explicit is not None:
        return samples.withColumn("threshold", F.lit(float(explicit)))
    if configured is None:
        return samples.withColumn("threshold", fallback)
    dim = configured.groupBy("metric").agg(F.max("threshold").alias("_configured"))
    few = dim.limit(BROADCAST_METRICS + 1).count() <= BROADCAST_METRICS
    return (samples.join(F.broadcast(dim) if few else dim, "metric", "left")
            .withColumn("threshold", F.coalesce("_configured", fallback)).drop("_configured"))


def samples_from_readings(readings: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Wide readings to long samples; missing readings give no sample."""
    return (readings.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
            .unpivot(ids, metrics, "metric", "value").where(F.col("value").isNotNull()))


def _trend_step(params: TrendParams):
    width = params.window
    half = width // 2

    def step(rows: Columns, state):
        us = rows["us"]
        last, tail = state or (float(rows["value"][0]), [])
        ema = _averages(last, rows["value"], params)
        y = np.concatenate(([e for _, e in tail], ema))
        t = np.concatenate([np.array([u for u, _ in tail], dtype=np.int64), us])
        slope = np.full(len(y), np.nan)
        if len(y) >= width:
            means = np.lib.stride_tricks.sliding_window_view(y, half).mean(axis=1)
            rise = means[half:] - means[:-half]
            hours = (t[width - 1:] - t[:len(t) - width + 1]) / 1e6 / 3600.0
            with np.errstate(divide="ignore", invalid="ignore"):
                slope[width - 1:] = np.where(hours < 0.001, np.nan, rise / hours)
        keep = list(zip(t[-(width - 1):].tolist(), y[-(width - 1):].tolist()))
        return None, {"ema": ema, "slope": slope[len(tail):]}, [float(ema[-1]), keep]

    return step


#: Runs of so few samples are carried as they are, which spares the rounding of a composition.
SHORT_RUN = 64


def _averages(before: float, value: np.ndarray, params: TrendParams) -> np.ndarray:
    if len(value) <= SHORT_RUN:  # less work than a series
        a, b = params.alpha, 1 - params.alpha
        return np.array(list(accumulate(value.tolist(), lambda y, x: a * x + b * y, initial=before))[1:])
    return pd.Series(np.concatenate(([before], value))).ewm(alpha=params.alpha, adjust=False).mean().to_numpy()[1:]


def trend_summary_of(rows: Columns, params: TrendParams) -> list:
    """What a run of samples does to any average y: the samples of a short run; of others the first value, and for
    the last samples, as many as a window needs, time, offset and factor of the average offset + factor * y."""
    value, tail = rows["value"], params.window - 1
    if len(value) <= SHORT_RUN:
        return [rows["us"].tolist(), value.tolist()]
    offset = _averages(0.0, value, params)[-tail:]
    factor = (1 - params.alpha) ** np.arange(len(value) - len(offset) + 1, len(value) + 1)
    return [float(value[0]), rows["us"][-tail:].tolist(), offset.tolist(), factor.tolist()]


def after_trend(summary: list, state: list | None, params: TrendParams) -> list:
    """[average, last (time, average) pairs] after a run."""
    if len(summary) == 2:
        us, value = summary
        before, kept = state or (value[0], [])
        ends = list(map(list, zip(us, _averages(before, np.array(value), params).tolist())))
    else:
        first, us, offset, factor = summary
        before, kept = state or (first, [])
        ends = [[t, o + f * before] for t, o, f in zip(us, offset, factor)]
    return [ends[-1][1], [*kept, *ends][-(params.window - 1):]]


def trend(samples: DataFrame, params: TrendParams = TrendParams()) -> DataFrame:
    """Each sample with its running average `ema` and `slope` per hour.

    The slope is the mean of the later half of the last `window` averages minus that of
    the earlier half, over the time from first to last; null before the window is full or
    when it spans less than 0.001 hours. A straight line of rate r reads about r/2, which
    is what the thresholds are tuned to.
    """
    narrow = samples.where(F.col("value").isNotNull()).select(
        *SERIES, F.unix_micros("ts").alias("us"), F.col("value").cast("double").alias("value"))
    out = Timeline(narrow, SERIES, ["us", "value"]).split_fold(
        _trend_step(params), "ema double, slope double", lambda rows: trend_summary_of(rows, params),
        lambda summary, state: after_trend(summary, state, params))
    return out.select(*SERIES, F.timestamp_micros("us").alias("ts"), "value", "ema",
                      F.when(~F.isnan("slope"), F.col("slope")).alias("slope"))


def ema(samples: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Exponential moving average: the first value, then alpha*x + (1-alpha)*previous."""
    return trend(samples, TrendParams(alpha=alpha)).drop("slope")


def latest_ema(samples: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Current average per series; a metric without samples has no row."""
    return (ema(samples, alpha).groupBy(*SERIES)
            .agg(F.max_by("ema", F.struct("ts", "value")).alias("ema"), F.max("ts").alias("ts")))


def trend_alerts(samples: DataFrame, params: TrendParams = TrendParams(),
                 configured: DataFrame | None = None, explicit: float | None = None) -> DataFrame:
    """Samples whose slope reaches the threshold in size, at most one per cooldown and series.

    Without thresholds given, the built-in ones by metric name apply; metrics with none
    never alert. The cooldown reads its rows more than once, so they are written first: the trend is computed once.
    """
    default = None if configured is not None else slope_limit(F.col("metric"))
    rated = with_thresholds(trend(samples, params).where(F.col("slope").isNotNull()),
                            configured, explicit, default)
    over = (rated.where(F.abs("slope") >= F.col("threshold"))
            .select(*SERIES, "ts", "value", "ema", "slope", "threshold"))
    if params.cooldown > 0:
        over = cooldown_rows(written(over, "over"), SERIES, params.cooldown, tie="value").drop("repeats")
    return over.withColumn("direction", F.when(F.col("slope") > 0, "rising").otherwise("falling"))


def ram_projection(samples: DataFrame, params: TrendParams = TrendParams(), above: float = 70.0,
                   slope: float = 10.0) -> DataFrame:
    """Memory readings on course to run out within the hour: minutes left, critical below 15.

    Only samples above 70 percent form the series.
    """
    rising = trend_alerts(samples.where(F.col("value") > above), params, explicit=slope).where("slope > 0")
    minutes = (100.0 - F.col("value")) / F.col("slope") * 60
    return (rising.withColumn("minutes", minutes).where(F.col("minutes") < 60)
            .withColumns({
                "severity": F.when(F.col("minutes") < 15, "critical").otherwise("warning"),
                "raw_data": F.concat(F.lit("ram="), fixed(F.col("value"), 0), F.lit("% mins="),
                                     fixed(F.col("minutes"), 0)),
                "summary": F.concat(F.lit("RAM "), fixed(F.col("value"), 0), F.lit("% — OOM in "),
                                    fixed(F.col("minutes"), 0), F.lit(" min")),
            }))


def disk_projection(samples: DataFrame, params: TrendParams = TrendParams(), slope: float = 0.5,
                    within_hours: float = 72) -> DataFrame:
    """Disk usage on course to be full within three days."""
    rising = trend_alerts(samples, params, explicit=slope).where("slope > 0")
    return (rising.withColumn("hours", (100.0 - F.col("value")) / F.col("slope"))
            .where(F.col("hours") < within_hours)
            .withColumns({
                "severity": F.lit("warning"),
                "raw_data": F.concat(F.lit("disk="), fixed(F.col("value"), 0), F.lit("% hrs="),
                                     fixed(F.col("hours"), 0)),
                "summary": F.concat(F.lit("Disk full in "), fixed(F.col("hours") / 24, 1), F.lit(" days")),
            }))


def _with_previous(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return (Timeline(samples, keys, order)
            .carry({"_p": F.struct(F.col("ts").alias("ts"), F.col("value").alias("value"))}).df)


def _seconds() -> Column:
    return (F.unix_micros("ts") - F.unix_micros("_p.ts")) / MICROS


def _delta_per_second(samples: DataFrame, scale: float) -> DataFrame:
    """Growth of a counter per second times `scale`; null on the first sample, on no
    elapsed time and when the counter was reset."""
    grown = F.col("value") - F.col("_p.value")
    return (_with_previous(samples, SERIES, ["ts", "value"])
            .withColumn("rate", F.when((_seconds() > 0) & (grown >= 0), grown * scale / _seconds()))
            .drop("_p"))


def counter_rate(samples: DataFrame) -> DataFrame:
    """Byte counters to megabits per second."""
    return _delta_per_second(samples, 8 / 1e6)


def counter_util(samples: DataFrame) -> DataFrame:
    """Busy-millisecond counters to percent of elapsed time."""
    return _delta_per_second(samples, 100 / 1000)


def counter_increase(samples: DataFrame) -> DataFrame:
    """Samples above the one before, with the increase; the first sample is the baseline."""
    return (_with_previous(samples, SERIES, ["ts", "value"])
            .where(F.col("value") > F.col("_p.value"))
            .withColumn("increase", F.col("value") - F.col("_p.value")).drop("_p"))


def storage_error_alerts(samples: DataFrame) -> DataFrame:
    """Grown per-device error counters (metric = device.counter); corruption is critical."""
    return (counter_increase(samples)
            .withColumn("severity", F.when(F.col("metric").contains("corruption"), "critical").otherwise("warning"))
            .withColumn("summary", F.concat(
                F.lit("btrfs: "), F.col("increase").cast("long").cast("string"), F.lit(" new "),
                F.element_at(F.split("metric", r"\."), -1))))


def media_error_alerts(samples: DataFrame) -> DataFrame:
    """Grown media error counters (metric = device)."""
    return counter_increase(samples).withColumns({
        "severity": F.lit("critical"),
        "summary": F.concat(F.lit("NVMe "), F.col("metric"), F.lit(": "),
                            F.col("increase").cast("long").cast("string"), F.lit(" new media errors"))})


def level_check(smart: DataFrame) -> DataFrame:
    """Scans whose spare capacity is at or below its threshold; alerts on every such scan."""
    return (smart.where(F.col("spare") <= F.col("spare_threshold"))
            .withColumn("severity", F.lit("critical")))


def latched(samples: DataFrame, fire: Column, clear: Column, keys: list[str] | None = None,
            order: list[str] | None = None) -> DataFrame:
    """Rows that fire while the latch is off; firing sets it and `clear` resets it."""
    state = F.when(F.col("_fire"), 1).when(F.col("_clear"), 0)
    marked = samples.withColumns({"_fire": F.coalesce(fire, F.lit(False)),
                                  "_clear": F.coalesce(clear, F.lit(False))})
    return (Timeline(marked, keys or SERIES, order or ["ts", "value"]).carry({"_latch": state}).df
            .where(F.col("_fire") & (F.coalesce("_latch", F.lit(0)) == 0)).drop("_fire", "_clear", "_latch"))


def hysteresis_alerts(samples: DataFrame, fire: Column | float, clear: Column | float) -> DataFrame:
    """Alerts when the value reaches `fire`; the next only after it fell below `clear`."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    value = F.col("value")
    return latched(samples, value >= as_col(fire), value < as_col(clear))


def pressure_alerts(samples: DataFrame) -> DataFrame:
    """Resource pressure (metric psi_cpu, psi_memory, psi_io); clears below 70 % of the limit."""
    resource = F.regexp_replace("metric", "^psi_", "")
    limit = lookup(resource, PRESSURE_LIMITS, PRESSURE_DEFAULT)
    return hysteresis_alerts(samples, limit, limit * 0.7).withColumns({
        "severity": F.when(resource == "memory", "critical").otherwise("warning"),
        "raw_data": F.concat("metric", F.lit("="), fixed(F.col("value"), 1)),
        "summary": F.concat(resource, F.lit(" pressure "), fixed(F.col("value"), 0), F.lit("%"))})


def temperature_alerts(samples: DataFrame) -> DataFrame:
    """Sensors (host, chip, label, ts, value); clears 5 degrees below, critical 10 above the limit."""
    limit = lookup(F.col("chip"), TEMPERATURE_LIMITS, TEMPERATURE_DEFAULT)
    value = F.col("value")
    name = F.concat("chip", F.lit("/"), "label")
    return latched(samples, value >= limit, value < limit - 5, ["host", "chip", "label"]).withColumns({
        "severity": F.when(value >= limit + 10, "critical").otherwise("warning"),
        "raw_data": F.concat(name, F.lit("="), fixed(value, 0), F.lit("C")),
        "summary": F.concat(name, F.lit(" at "), fixed(value, 0), F.lit("C"))})


def vram_alerts(samples: DataFrame) -> DataFrame:
    return hysteresis_alerts(samples, 90, 85).withColumn("severity", F.lit("warning"))


def gpu_temperature_alerts(samples: DataFrame) -> DataFrame:
    return hysteresis_alerts(samples, 85, 80).withColumn("severity", F.lit("critical"))


def two_level_alerts(samples: DataFrame, params: LevelParams = LevelParams()) -> DataFrame:
    """One critical alert on each entry to the critical range, one warning on the first value
    in the warning range since the value was last below it."""
    value = F.col("value")
    crit_on, warn_on = value >= params.crit, (value >= params.warn) & (value < params.crit)
    rows = Timeline(samples, SERIES, ["ts", "value"]).carry({
        "_crit": F.when(crit_on, 1).otherwise(0),
        "_warn": F.when(warn_on, 1).when(value < params.warn, 0)}).df
    off = lambda c: F.coalesce(c, F.lit(0)) == 0
    return (rows.withColumn("severity", F.when(crit_on & off("_crit"), "critical")
                            .when(warn_on & off("_warn"), "warning"))
            .where(F.col("severity").isNotNull())
            .withColumn("summary", F.concat(F.lit("Disk "), fixed(value, 0), F.lit("%")))
            .drop("_crit", "_warn"))


def large_processes(processes: DataFrame, min_rss: int = 500_000_000) -> DataFrame:
    return processes.where(F.col("rss") > min_rss)


def top_k_processes(processes: DataFrame, k: int = 5) -> DataFrame:
    """The k largest processes of every poll; each task trims to k before the shuffle."""
    rank = Window.partitionBy("host", "tick").orderBy(F.desc("rss"), "pid")
    return processes.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def top_process_alerts(processes: DataFrame, ticks: DataFrame, limit_gb: float = 10, k: int = 5) -> DataFrame:
    """Process names among the k largest that newly use more than `limit_gb`.

    A name alerts again only after a poll in which it was not so large; two processes of
    one name in a poll count once, with the larger.
    """
    gb = F.col("rss") / (1024 ** 3)
    heavy = (top_k_processes(large_processes(processes), k).where(gb > limit_gb)
             .groupBy("host", "tick", "name").agg(F.max_by(F.struct("pid", "rss"), F.struct("rss", -F.col("pid"))).alias("p"))
             .select("host", F.lit("processes").alias("source"), "tick", F.col("name").alias("entity"), "p.pid", "p.rss"))
    polls = ticks.select("host", F.lit("processes").alias("source"), "tick")
    return new_entities(heavy, polls).select(
        "host", "tick", F.col("entity").alias("name"), "pid", "rss", F.lit("warning").alias("severity"),
        F.concat(F.col("entity"), F.lit(" (PID "), F.col("pid").cast("string"), F.lit(") using "),
                 fixed(gb, 1), F.lit(" GB RAM")).alias("summary"))
