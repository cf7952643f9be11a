"""Metric series, throttling and status queries."""

from pyspark.sql import functions as F

from opsweave.catalog import EV, SAMPLES, query, us
from opsweave.config import DedupParams, LevelParams, TrendParams
from opsweave.functions.text import fingerprint
from opsweave.operators import rates, series, status, throttle
from opsweave.sources.tables import metric_samples, sample_events

TREND = TrendParams(alpha=0.1, window=20, cooldown=6 * 3600)
DEDUP = DedupParams(window=3600, baseline=18000, max_per_period=3, period=3600)


def _ema(source: str, alpha: float = 0.1) -> str:
    """The recurrence along each series, as a recursive query over row numbers."""
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY host, metric ORDER BY us, value) AS rn FROM {source}),
ema AS (WITH RECURSIVE r AS (
  SELECT host, metric, us, value, rn, {alpha} * value + (1 - {alpha}::DOUBLE) * value AS ema FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.host, n.metric, n.us, n.value, n.rn, {alpha} * n.value + (1 - {alpha}::DOUBLE) * r.ema
  FROM r JOIN numbered n ON n.host = r.host AND n.metric = r.metric AND n.rn = r.rn + 1) SELECT * FROM r)"""


_SLOPE = """sloped AS (SELECT *, CASE WHEN rn >= 20 AND (us - first_us) / 3.6e9 >= 0.001
    THEN (late - early) / ((us - first_us) / 3.6e9) END AS slope FROM (SELECT *,
  avg(ema) OVER (PARTITION BY host, metric ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS late,
  avg(ema) OVER (PARTITION BY host, metric ORDER BY rn ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) AS early,
  lag(us, 19) OVER (PARTITION BY host, metric ORDER BY rn) AS first_us FROM ema))"""


def _throttled(source: str, keys: str, gap_us: int, name: str = "kept") -> str:
    """Greedy cooldown: from each kept row jump to the first row at least the gap later."""
    on = " AND ".join(f"s.{k} = r.{k}" for k in keys.split(", "))
    return f"""{name}_n AS (SELECT {keys}, us, row_number() OVER (PARTITION BY {keys} ORDER BY us) AS rn FROM {source}),
{name} AS (WITH RECURSIVE r AS (
  SELECT {keys}, rn, us, us AS last, true AS kept FROM {name}_n WHERE rn = 1
  UNION ALL
  SELECT {', '.join('s.' + k for k in keys.split(', '))}, s.rn, s.us,
    CASE WHEN s.us - r.last >= {gap_us} THEN s.us ELSE r.last END, s.us - r.last >= {gap_us}
  FROM r JOIN {name}_n s ON {on} AND s.rn = r.rn + 1) SELECT * FROM r)"""


@query(f"WITH {SAMPLES}, {_ema('samples')} SELECT host, metric, us AS ts_us, round(ema, 6) AS ema FROM ema")
def ema(spark, folder):
    return series.ema(metric_samples(spark, folder)).select("host", "metric", us(), F.round("ema", 6).alias("ema"))


@query(f"WITH {SAMPLES}, {_ema('samples', 0.3)} SELECT host, metric, round(arg_max(ema, us), 6) AS ema, max(us) AS ts_us "
       "FROM ema GROUP BY ALL")
def latest_ema(spark, folder):
    return series.latest_ema(metric_samples(spark, folder), 0.3).select("host", "metric", F.round("ema", 6).alias("ema"), us())


@query(f"WITH {SAMPLES}, {_ema('samples')}, {_SLOPE} SELECT host, metric, us AS ts_us, round(slope, 6) AS slope FROM sloped")
def half_window_slope(spark, folder):
    return series.trend(metric_samples(spark, folder), TREND).select(
        "host", "metric", us(), F.round("slope", 6).alias("slope"))


def _alerts(source: str, threshold: str) -> str:
    return (f"{_ema(source)}, {_SLOPE}, over AS (SELECT s.*, {threshold} AS threshold FROM sloped s "
            f"WHERE abs(slope) >= {threshold}), {_throttled('over', 'host, metric', 6 * 3600 * 10**6)}, "
            "alerts AS (SELECT o.* FROM over o JOIN kept k USING (host, metric, us) WHERE k.kept)")


@query(f"WITH {SAMPLES}, {_alerts('samples', '0.05')} SELECT host, metric, us AS ts_us, round(slope, 6) AS slope, "
       "CASE WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS direction FROM alerts")
def trend_alerts(spark, folder):
    return series.trend_alerts(metric_samples(spark, folder), TREND, explicit=0.05).select(
        "host", "metric", us(), F.round("slope", 6).alias("slope"), "direction")


_RAM = SAMPLES + ", ram AS (SELECT host, metric, us, least(value, 99.99) AS value FROM samples WHERE least(value, 99.99) > 20)"


@query(f"WITH {_RAM}, {_alerts('ram', '0.01')} SELECT host, metric, us AS ts_us, "
       "round((100.0 - value) / slope * 60, 4) AS minutes, "
       "CASE WHEN (100.0 - value) / slope * 60 < 15 THEN 'critical' ELSE 'warning' END AS severity FROM alerts "
       "WHERE slope > 0 AND (100.0 - value) / slope * 60 < 60")
def ram_projection(spark, folder):
    s = metric_samples(spark, folder).withColumn("value", F.least("value", F.lit(99.99)))
    return series.ram_projection(s, TREND, above=20.0, slope=0.01).select(
        "host", "metric", us(), F.round("minutes", 4).alias("minutes"), "severity")


@query(f"WITH {_RAM}, {_alerts('ram', '0.01')} SELECT host, metric, us AS ts_us, "
       "round((100.0 - value) / slope, 4) AS hours FROM alerts WHERE slope > 0 AND (100.0 - value) / slope < 720")
def disk_projection(spark, folder):
    s = metric_samples(spark, folder).withColumn("value", F.least("value", F.lit(99.99))).where("value > 20")
    return series.disk_projection(s, TREND, slope=0.01, within_hours=720).select(
        "host", "metric", us(), F.round("hours", 4).alias("hours"))


_LAGGED = (f"WITH {SAMPLES}, l AS (SELECT *, value - lag(value) OVER w AS dv, (us - lag(us) OVER w) / 1e6 AS dt FROM samples "
           "WINDOW w AS (PARTITION BY host, metric ORDER BY us, value)) ")


@query(_LAGGED + "SELECT host, metric, us AS ts_us, CASE WHEN dt > 0 AND dv >= 0 THEN round(dv * 8e6 / 1e6 / dt, 6) END AS mbps FROM l")
def counter_rate(spark, folder):
    s = metric_samples(spark, folder).withColumn("value", F.col("value") * 1e6)
    return series.counter_rate(s).select("host", "metric", us(), F.round("rate", 6).alias("mbps"))


@query(_LAGGED + "SELECT host, metric, us AS ts_us, CASE WHEN dt > 0 AND dv >= 0 THEN round(dv * 1000 / (dt * 1000) * 100, 6) END "
       "AS util FROM l")
def counter_util(spark, folder):
    s = metric_samples(spark, folder).withColumn("value", F.col("value") * 1000)
    return series.counter_util(s).select("host", "metric", us(), F.round("rate", 6).alias("util"))


_FLOORED = (f"WITH {SAMPLES}, l AS (SELECT *, floor(value) AS v, lag(floor(value)) OVER (PARTITION BY host, metric ORDER BY us) AS p "
            "FROM samples) ")


@query(_FLOORED + "SELECT host, metric, us AS ts_us, CAST(v - p AS BIGINT) AS increase FROM l WHERE v > p")
def counter_increase(spark, folder):
    s = metric_samples(spark, folder).withColumn("value", F.floor("value"))
    return series.counter_increase(s).select("host", "metric", us(), F.col("increase").cast("long").alias("increase"))


@query(_FLOORED + "SELECT host, us AS ts_us, CASE WHEN ends_with(metric, '1') THEN 'critical' ELSE 'warning' END AS severity, "
       "concat('btrfs: ', CAST(v - p AS BIGINT), ' new ', CASE WHEN ends_with(metric, '1') THEN 'corruption_errs' "
       "ELSE 'write_errs' END) AS summary FROM l WHERE v > p")
def storage_error_alerts(spark, folder):
    s = metric_samples(spark, folder).withColumns({"value": F.floor("value"), "metric": F.concat(
        "metric", F.when(F.col("metric").endswith("1"), ".corruption_errs").otherwise(".write_errs"))})
    return series.storage_error_alerts(s).select("host", us(), "severity", "summary")


@query(_FLOORED + "SELECT host, us AS ts_us, 'critical' AS severity, concat('NVMe ', metric, ': ', CAST(v - p AS BIGINT), "
       "' new media errors') AS summary FROM l WHERE v > p")
def media_error_alerts(spark, folder):
    s = metric_samples(spark, folder).withColumn("value", F.floor("value"))
    return series.media_error_alerts(s).select("host", us(), "severity", "summary")


@query(f"WITH {EV} SELECT id, CAST(floor(value) AS BIGINT) AS spare FROM ev WHERE floor(value) <= user_id")
def level_check(spark, folder):
    smart = sample_events(spark, folder).select("id", F.floor("value").alias("spare"), F.col("user_id").alias("spare_threshold"))
    return series.level_check(smart).select("id", "spare")


def _latched(fire: str, clear: str, extra: str = "", source: str = "samples") -> str:
    return (f"WITH {SAMPLES}, l AS (SELECT *, coalesce(last_value(CASE WHEN {fire} THEN 1 WHEN {clear} THEN 0 END IGNORE NULLS) "
            "OVER (PARTITION BY host, metric ORDER BY us, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS latch "
            f"FROM {source}) SELECT host, metric, us AS ts_us{extra} FROM l WHERE ({fire}) AND latch = 0")


@query(_latched("value >= 90", "value < 40"))
def hysteresis_alerts(spark, folder):
    return series.hysteresis_alerts(metric_samples(spark, folder), 90, 40).select("host", "metric", us())


_RES = "CASE WHEN metric LIKE '%0' THEN 'cpu' WHEN metric LIKE '%1' THEN 'memory' WHEN metric LIKE '%2' THEN 'io' ELSE 'irq' END"
_LIMIT = f"CASE {_RES} WHEN 'memory' THEN 20.0 WHEN 'io' THEN 80.0 ELSE 50.0 END"


@query(f"WITH {SAMPLES}, p AS (SELECT host, {_RES} AS metric, us, value, {_LIMIT} AS lim FROM samples), l AS (SELECT *, "
       "coalesce(last_value(CASE WHEN value >= lim THEN 1 WHEN value < lim * 0.7 THEN 0 END IGNORE NULLS) OVER (PARTITION BY "
       "host, metric ORDER BY us, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS latch FROM p) "
       "SELECT host, concat('psi_', metric) AS metric, us AS ts_us, CASE WHEN metric = 'memory' THEN 'critical' ELSE 'warning' "
       "END AS severity FROM l WHERE value >= lim AND latch = 0")
def pressure_alerts(spark, folder):
    m = F.col("metric")
    s = metric_samples(spark, folder).withColumn("metric", F.when(m.endswith("0"), "psi_cpu").when(m.endswith("1"), "psi_memory")
                                                 .when(m.endswith("2"), "psi_io").otherwise("psi_irq"))
    return series.pressure_alerts(s).select("host", "metric", us(), "severity")


_CHIP = "CASE WHEN metric LIKE '%0' THEN 'k10temp' WHEN metric LIKE '%1' THEN 'nvme' ELSE 'other' END"
_TLIM = f"CASE {_CHIP} WHEN 'k10temp' THEN 90 WHEN 'nvme' THEN 70 ELSE 85 END"


@query(_latched(f"value >= {_TLIM}", f"value < {_TLIM} - 5",
                f", CASE WHEN value >= {_TLIM} + 10 THEN 'critical' ELSE 'warning' END AS severity"))
def temperature_alerts(spark, folder):
    m = F.col("metric")
    s = metric_samples(spark, folder).withColumns({"chip": F.when(m.endswith("0"), "k10temp").when(m.endswith("1"), "nvme")
                                                   .otherwise("other"), "label": m})
    return series.temperature_alerts(s).select("host", "metric", us(), "severity")


@query(_latched("value >= 90", "value < 85", ", 'warning' AS severity"))
def vram_alerts(spark, folder):
    return series.vram_alerts(metric_samples(spark, folder)).select("host", "metric", us(), "severity")


@query(_latched("value >= 85", "value < 80", ", 'critical' AS severity"))
def gpu_temperature_alerts(spark, folder):
    return series.gpu_temperature_alerts(metric_samples(spark, folder)).select("host", "metric", us(), "severity")


def _latch(on: str, off: str) -> str:
    return (f"coalesce(last_value(CASE WHEN {on} THEN 1 WHEN {off} THEN 0 END IGNORE NULLS) OVER (PARTITION BY host, metric "
            "ORDER BY us, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")


@query(f"WITH {SAMPLES}, l AS (SELECT *, {_latch('value >= 95', 'value < 95')} AS c, "
       f"{_latch('value >= 60 AND value < 95', 'value < 60')} AS w FROM samples) "
       "SELECT host, metric, us AS ts_us, CASE WHEN value >= 95 THEN 'critical' ELSE 'warning' END AS severity FROM l "
       "WHERE (value >= 95 AND c = 0) OR (value >= 60 AND value < 95 AND w = 0)")
def two_level_alerts(spark, folder):
    return series.two_level_alerts(metric_samples(spark, folder), LevelParams(60, 95)).select("host", "metric", us(), "severity")


def _processes(spark, folder):
    return sample_events(spark, folder).select(
        "host", F.to_date("ts").alias("tick"), F.col("id").alias("pid"),
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("name"),
        F.round(F.col("value") * 1e8).cast("long").alias("rss"))


_PROC = f"""WITH {EV}, proc AS (SELECT host, CAST(ts AS DATE) AS tick, id AS pid, concat('p', user_id) AS name,
  CAST(round(value * 1e8) AS BIGINT) AS rss FROM ev),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, tick ORDER BY rss DESC, pid) AS rank FROM proc
  WHERE rss > 500000000) WHERE rank <= 5)
"""


@query(f"WITH {EV} SELECT id AS pid, CAST(round(value * 1e8) AS BIGINT) AS rss FROM ev WHERE round(value * 1e8) > 500000000")
def large_processes(spark, folder):
    return series.large_processes(_processes(spark, folder)).select("pid", "rss")


@query(_PROC + "SELECT host, tick, pid, CAST(rank AS INTEGER) AS rank FROM top")
def top_k_processes(spark, folder):
    return series.top_k_processes(series.large_processes(_processes(spark, folder))).select("host", "tick", "pid", "rank")


@query(_PROC + """, heavy AS (SELECT host, tick, name, max(rss) AS rss FROM top WHERE rss / 1073741824.0 > 10 GROUP BY ALL),
prev AS (SELECT host, tick, lag(tick) OVER (PARTITION BY host ORDER BY tick) AS p FROM (SELECT DISTINCT host, tick FROM proc))
SELECT h.host, h.tick, h.name, h.rss FROM heavy h JOIN prev USING (host, tick) WHERE NOT EXISTS
  (SELECT 1 FROM heavy b WHERE b.host = h.host AND b.name = h.name AND b.tick = prev.p)""")
def top_process_alerts(spark, folder):
    p = _processes(spark, folder)
    return series.top_process_alerts(p, p.select("host", "tick")).select("host", "tick", "name", "rss")


@query(f"WITH {SAMPLES}, conf AS (SELECT metric, count(*) + 0.5 AS threshold FROM samples WHERE value > 200 GROUP BY metric) "
       "SELECT host, metric, us AS ts_us, CAST(coalesce(threshold, 50.0) AS DOUBLE) AS threshold FROM samples "
       "LEFT JOIN conf USING (metric)")
def with_thresholds(spark, folder):
    s = metric_samples(spark, folder)
    conf = s.where("value > 200").groupBy("metric").agg((F.count("*") + 0.5).cast("double").alias("threshold"))
    return series.with_thresholds(s, conf, default=F.lit(50.0)).select("host", "metric", us(), "threshold")


@query(f"WITH {EV} SELECT id, 'value' AS metric, value FROM ev UNION ALL SELECT id, 'doubled', value * 2 FROM ev WHERE value < 50")
def samples_from_readings(spark, folder):
    wide = sample_events(spark, folder).select("id", "value", F.when(F.col("value") < 50, F.col("value") * 2).alias("doubled"))
    return series.samples_from_readings(wide, ["id"], ["value", "doubled"])


@query(f"WITH {EV}, {_throttled('ev', 'host, source', 3 * 3600 * 10**6)} SELECT host, source, us AS ts_us FROM kept WHERE kept")
def throttled_events(spark, folder):
    return throttle.throttle(sample_events(spark, folder), ["host", "source"], 3 * 3600).select("host", "source", us())


def _marked(spark, folder):
    """Events with the fingerprint of their message; ids in brackets do not count."""
    e = sample_events(spark, folder)
    message = F.concat("event_type", F.lit("["), F.col("id").cast("string"), F.lit("]"))
    return e.select("id", "host", "source", "ts", fingerprint(F.col("source"), F.lit("app"), message).alias("fingerprint"))


_MARKED = EV + """, marked AS (SELECT id, host, source, us, ts,
  sha256(concat(source, ':app:', event_type, '[*]'))[1:16] AS fingerprint FROM ev)"""
_ONE = f"""{_throttled('marked', 'host, source, fingerprint', 3600 * 10**6)},
first AS (SELECT m.id, m.host, m.source, m.fingerprint, m.us, k.rn,
  k.rn - lag(k.rn) OVER (PARTITION BY m.host, m.source, m.fingerprint ORDER BY k.rn) AS gap
  FROM marked m JOIN kept k USING (host, source, fingerprint, us) WHERE k.kept)"""


@query(f"WITH {_MARKED}, {_ONE} SELECT id, fingerprint, us AS ts_us, coalesce(gap, 0) AS suppressed_count FROM first")
def dedup_by_fingerprint(spark, folder):
    return throttle.dedup_by_fingerprint(_marked(spark, folder), DEDUP).select("id", "fingerprint", us(), "suppressed_count")


@query(f"WITH {_MARKED}, {_ONE} SELECT id, fingerprint, us AS ts_us, 1 AS n FROM first")
def dedup_equal_rows(spark, folder):
    """Every row comes twice, equal in all columns: still one of the two is emitted."""
    twice = _marked(spark, folder).unionByName(_marked(spark, folder))
    return (throttle.dedup_by_fingerprint(twice, DEDUP).groupBy("id", "fingerprint", us())
            .agg(F.count("*").cast("int").alias("n")))


@query(f"WITH {_MARKED}, {_ONE} SELECT m.id, CASE WHEN f.id IS NULL THEN 'suppress' ELSE 'emit' END AS action, "
       "coalesce(f.gap, 0) AS suppressed_count FROM marked m LEFT JOIN first f USING (id)")
def dedup_decisions(spark, folder):
    return throttle.dedup_decisions(_marked(spark, folder), DEDUP).select("id", "action", "suppressed_count")


def rate_limited_sql(marked: str = _MARKED, limit: int = 3, period: int = 3600 * 10**6, cooldown: int = 3600 * 10**6,
                     stale: int = 36000 * 10**6) -> str:
    """The rules row by row along each source: the state is the list of recent emissions."""
    passes = (f"len(list_filter(r.log, lambda x: x.us >= n.us - {period})) < {limit} AND "
              f"len(list_filter(r.log, lambda x: x.fp = n.fingerprint AND n.us - x.us < {cooldown})) = 0")
    alive = f"list_filter(r.log, lambda x: x.us >= n.us - {max(period, cooldown)})"
    return f"""{marked}, numbered AS (SELECT *, row_number() OVER (PARTITION BY host, source ORDER BY us, id) AS rn FROM marked),
decided AS (WITH RECURSIVE r AS (
  SELECT host, source, id, fingerprint, us, rn, true AS passed, us AS prune_us, [{{'us': us, 'fp': fingerprint}}] AS log
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.host, n.source, n.id, n.fingerprint, n.us, n.rn, {passes},
    CASE WHEN n.us - r.prune_us >= {stale} THEN n.us ELSE r.prune_us END,
    CASE WHEN {passes} THEN list_append({alive}, {{'us': n.us, 'fp': n.fingerprint}}) ELSE {alive} END
  FROM r JOIN numbered n ON n.host = r.host AND n.source = r.source AND n.rn = r.rn + 1) SELECT * FROM r),
placed AS (SELECT *, row_number() OVER w AS pos, lag(us) OVER w AS before FROM decided
  WINDOW w AS (PARTITION BY host, source, fingerprint ORDER BY us, id)),
starts AS (SELECT *, before IS NULL OR before < prune_us - {stale} AS fresh FROM placed),
counted AS (SELECT *, CASE WHEN passed AND NOT fresh THEN pos - last_value(CASE WHEN passed OR fresh THEN pos END IGNORE NULLS)
  OVER (PARTITION BY host, source, fingerprint ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE 0 END AS n
  FROM starts)"""


@query(f"WITH {rate_limited_sql()} SELECT id, CASE WHEN passed THEN 'emit' ELSE 'suppress' END AS action, n AS suppressed_count "
       "FROM counted")
def dedup_rate_limited(spark, folder):
    return throttle.dedup_rate_limited(_marked(spark, folder), DEDUP).select("id", "action", "suppressed_count")


@query(f"WITH {_MARKED}, {_ONE} SELECT m.host, epoch_us(time_bucket(INTERVAL '6 hours', m.ts)) AS window_start_us, "
       "count(*) AS entries, count(f.id) AS published, count(*) - count(f.id) AS suppressed, "
       "count(DISTINCT m.fingerprint) AS tracked FROM marked m LEFT JOIN first f USING (id) GROUP BY ALL")
def dedup_stats(spark, folder):
    decisions = throttle.dedup_decisions(_marked(spark, folder), DEDUP)
    return throttle.dedup_stats(decisions, "6 hours").select(
        "host", us("window_start"), "entries", "published", "suppressed", "tracked")


@query(f"WITH {EV} SELECT id, us AS ts_us, us + {1800 * 10**6} AS fire_ts_us FROM (SELECT *, lead(us) OVER "
       f"(PARTITION BY host, source ORDER BY us, id) AS nxt FROM ev) WHERE nxt IS NULL OR nxt - us >= {1800 * 10**6}")
def debounce(spark, folder):
    return throttle.debounce(sample_events(spark, folder), ["host", "source"], 1800).select("id", us(), us("fire_ts"))


_RANKED = (f"WITH {EV}, st AS (SELECT id, host, us, CASE max(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) "
           "OVER (PARTITION BY host ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) "
           "WHEN 2 THEN 'critical' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS status FROM ev) ")


@query(_RANKED + "SELECT id, host, status FROM st")
def rolling_status(spark, folder):
    return status.rolling_status(sample_events(spark, folder)).select("id", "host", "status")


@query(_RANKED + "SELECT id, host, old, status AS new FROM (SELECT *, lag(status, 1, 'healthy') OVER (PARTITION BY host "
       "ORDER BY us, id) AS old FROM st) WHERE old <> status")
def status_transitions(spark, folder):
    st = status.rolling_status(sample_events(spark, folder))
    return status.status_transitions(st).select("id", "host", "old", "new")


@query(f"""WITH {EV}, steps AS (SELECT host, us, severity, 1 AS d FROM ev WHERE severity <> 'info'
  UNION ALL SELECT host, us + 3600000000, severity, -1 FROM ev WHERE severity <> 'info'),
moments AS (SELECT host, us, sum(d) FILTER (WHERE severity = 'critical') AS c, sum(d) FILTER (WHERE severity = 'warning') AS w
  FROM steps GROUP BY ALL),
levels AS (SELECT host, us, CASE WHEN sum(coalesce(c, 0)) OVER o > 0 THEN 'critical' WHEN sum(coalesce(w, 0)) OVER o > 0
  THEN 'degraded' ELSE 'healthy' END AS status FROM moments WINDOW o AS (PARTITION BY host ORDER BY us)),
changed AS (SELECT * FROM (SELECT *, lag(status, 1, 'healthy') OVER (PARTITION BY host ORDER BY us) AS old FROM levels)
  WHERE old <> status)
SELECT host, us AS start_ts_us, lead(us) OVER (PARTITION BY host ORDER BY us) AS end_ts_us, status FROM changed""")
def status_timeline(spark, folder):
    return status.status_timeline(sample_events(spark, folder)).select("host", us("start_ts"), us("end_ts"), "status")


@query(f"WITH {SAMPLES}, {_alerts('samples', '0.05')} SELECT host, metric, us AS ts_us, concat(metric, "
       "CASE WHEN slope > 0 THEN ' rising at ' ELSE ' falling at ' END, '~/hour') AS summary FROM alerts")
def trend_summaries(spark, folder):
    from opsweave.functions.text import trend_summary
    alerts = series.trend_alerts(metric_samples(spark, folder), TREND, explicit=0.05)
    said = trend_summary(F.col("metric"), F.col("slope"), F.col("value"))
    return alerts.select("host", "metric", us(), F.regexp_replace(said, r"at .*/hour.*$", "at ~/hour").alias("summary"))


@query(f"""WITH {EV} SELECT host, type, us // 3600000000 * 3600000000 AS window_us, count(*) AS n, round(count(*) / 60, 9) AS per_minute
FROM ev GROUP BY ALL""")
def rate_series(spark, folder):
    """Events per hour, host and type, merged from minutes."""
    return rates.rate_series(sample_events(spark, folder), ["host", "type"]).select(
        "host", "type", us("window"), "n", F.round("per_minute", 9).alias("per_minute"))


@query(f"""WITH {EV} SELECT host, us // 86400000000 * 86400000000 AS window_us, count(*) AS n, count(value) AS measured, true AS within
FROM ev GROUP BY ALL""")
def latency_series(spark, folder):
    """Daily quantiles of values by sketches merged from minutes to hours to days; their exact ranks are within the promised error."""
    events, shares = sample_events(spark, folder), [0.5, 0.95, 0.99]
    found = rates.latency_series(events, ["host"], "value", shares)
    errors = rates.rank_errors(found, events, ["host"], "value", shares)
    worst = F.greatest(*[F.col(f"q{round(s * 100)}_error") for s in shares])
    return found.join(errors, ["host", "window"]).select("host", us("window"), "n", "measured", (worst <= rates.RANK_ERROR).alias("within"))
