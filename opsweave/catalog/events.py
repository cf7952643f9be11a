"""Event table queries."""

from pyspark.sql import functions as F

from opsweave.catalog import EV, RANK, query, us
from opsweave.config import RetentionParams
from opsweave.functions import severity as sev
from opsweave.functions.text import display_text
from opsweave.operators import events as ev
from opsweave.operators.timeline import Timeline, new_path
from opsweave.plans import store, versions
from opsweave.schemas import SYSTEM_EVENTS
from opsweave.sources.logs import log_line
from opsweave.sources.tables import AS_OF, EVENT_COLUMNS, sample_events, scan_events, system_events

SINCE = "2024-01-15 00:00:00"
KEEP = RetentionParams(days=10, critical_days=20)


def _odd(spark, folder):
    """Events as a careless collector might store them: unknown kinds, unreadable times, no text."""
    e = sample_events(spark, folder)
    return e.select(
        "id", F.when(F.col("event_type") == "view", "mystery").otherwise(F.col("type")).alias("type"),
        F.when(F.col("value") > 150, "loud").otherwise(F.col("severity")).alias("severity"),
        F.when(F.col("value") < 5, "some day").otherwise(F.col("ts").cast("string")).alias("ts"),
        F.when(F.col("user_action").isNull(), F.col("raw_data")).alias("raw_data"))


_ODD = f"""WITH {EV}, odd AS (
  SELECT id, CASE WHEN event_type = 'view' THEN 'mystery' ELSE type END AS type,
    CASE WHEN value > 150 THEN 'loud' ELSE severity END AS severity,
    CASE WHEN value >= 5 THEN us END AS us,
    CASE WHEN user_action IS NULL THEN raw_data ELSE '' END AS raw_data FROM ev)
"""


@query(_ODD + "SELECT id, type, severity, us AS ts_us, raw_data FROM odd "
       "WHERE type <> 'mystery' AND severity <> 'loud' AND us IS NOT NULL")
def valid_events(spark, folder):
    return ev.valid_events(_odd(spark, folder)).select("id", "type", "severity", us(), "raw_data")


@query(_ODD + "SELECT id, CASE WHEN type = 'mystery' THEN 'type' WHEN severity = 'loud' THEN 'severity' ELSE 'ts' END "
       "AS reason FROM odd WHERE type = 'mystery' OR severity = 'loud' OR us IS NULL")
def rejected_events(spark, folder):
    return ev.rejected_events(_odd(spark, folder)).select("id", "reason")


@query(f"WITH {EV} SELECT id, us AS ts_us, type FROM ev WHERE ts >= '{SINCE}' ORDER BY ts, id LIMIT 1000")
def events_since(spark, folder):
    return ev.events_since(system_events(spark, folder), SINCE, limit=1000).select("id", us(), "type")


@query(f"WITH {EV} SELECT id, us AS ts_us, type FROM ev WHERE ts >= '{SINCE}' AND type = 'service_fail' "
       "ORDER BY ts, id LIMIT 1000")
def events_since_of_type(spark, folder):
    return ev.events_since(system_events(spark, folder), SINCE, "service_fail", limit=1000).select("id", us(), "type")


@query(f"WITH {EV} SELECT id, us AS ts_us FROM ev WHERE ts >= '{SINCE}' AND summary IS NULL ORDER BY ts, id LIMIT 50")
def unanalyzed_since(spark, folder):
    return ev.unanalyzed_since(system_events(spark, folder), SINCE, limit=50).select("id", us())


@query(f"WITH {EV} SELECT id, us AS ts_us, summary IS NULL AS waiting FROM ev WHERE ts >= '{SINCE}'")
def events_since_stored(spark, folder):
    """All events since an instant from a stored table, written and read under two other time zones."""
    path, out = new_path(spark, "events"), new_path(spark, "since")
    zone, events = spark.conf.get("spark.sql.session.timeZone"), system_events(spark, folder)
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        store.append_events(events, path)
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        stored = scan_events(spark, path)
        waiting = ev.unanalyzed_since(stored, SINCE).select("id", F.lit(True).alias("waiting"))
        (ev.events_since(stored, SINCE).join(waiting, "id", "left")
         .select("id", us(), F.coalesce("waiting", F.lit(False)).alias("waiting")).write.parquet(out))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    return spark.read.parquet(out)


@query(f"WITH {EV} SELECT id, us AS ts_us, host FROM ev ORDER BY ts DESC, id DESC LIMIT 50")
def recent_events(spark, folder):
    return ev.recent_events(system_events(spark, folder)).select("id", us(), "host")


@query(f"WITH {EV} SELECT id, host, strftime(ts, '%H:%M') AS time, coalesce(nullif(summary, ''), raw_data[1:120]) "
       "AS text, severity, source FROM ev ORDER BY ts DESC, id DESC LIMIT 200")
def feed(spark, folder):
    return ev.feed(system_events(spark, folder))


@query(f"WITH {EV} SELECT type, count(*) AS n FROM ev WHERE ts >= '{SINCE}' GROUP BY type")
def count_by_type(spark, folder):
    return ev.count_by_type(system_events(spark, folder), SINCE)


@query(f"WITH {EV} SELECT type, count(*) AS n, min(us) AS first_us FROM ev GROUP BY type ORDER BY n DESC, first_us")
def type_counts_ranked(spark, folder):
    return ev.type_counts_ranked(system_events(spark, folder)).select(
        "type", "n", F.unix_micros("first_ts").alias("first_us"))


@query(f"WITH {EV} SELECT severity, count(*) AS n FROM ev GROUP BY severity")
def severity_counts(spark, folder):
    return ev.severity_counts(system_events(spark, folder))


@query("SELECT count(*) AS n FROM events")
def total_events(spark, folder):
    return ev.total_events(system_events(spark, folder))


@query(f"WITH {EV} SELECT id, severity, type FROM ev ORDER BY {RANK} DESC, ts, id LIMIT 15")
def notable_events(spark, folder):
    return ev.notable_events(system_events(spark, folder), 15).select("id", "severity", "type")


@query(f"WITH {EV} SELECT id, host, us AS ts_us, type, coalesce(nullif(summary, ''), raw_data[1:80]) AS text FROM ev "
       "WHERE severity = 'critical' ORDER BY ts, id LIMIT 5")
def critical_first(spark, folder):
    return ev.critical_first(system_events(spark, folder)).select("id", "host", us(), "type", "text")


_EXPIRED = (f"CASE WHEN type = 'service_fail' OR coalesce(user_action = 'applied', false) "
            f"THEN ts < TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY ELSE ts < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY END")


@query(f"WITH {EV} SELECT id, type, user_action FROM ev WHERE NOT ({_EXPIRED})")
def retention_keep(spark, folder):
    return ev.retention_keep(system_events(spark, folder), AS_OF, KEEP).select("id", "type", "user_action")


@query(f"WITH {EV} SELECT count(*) FILTER (WHERE {_EXPIRED}) AS deleted FROM ev")
def retention_deleted(spark, folder):
    return ev.retention_deleted(system_events(spark, folder), AS_OF, KEEP)


@query(f"WITH {EV} SELECT CAST(ts AS DATE) AS event_date, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM ev "
       f"WHERE NOT ({_EXPIRED}) GROUP BY 1")
def apply_retention(spark, folder):
    """Store the events, delete the expired ones in place, read back what is left."""
    path = new_path(spark, "events")
    store.append_events(system_events(spark, folder), path)
    store.apply_retention(spark, path, AS_OF, KEEP)
    return scan_events(spark, path).groupBy("event_date").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"WITH {EV} SELECT CAST(ts AS DATE) AS event_date, host, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, "
       "count(summary) AS summaries FROM ev GROUP BY 1, 2")
def append_events(spark, folder):
    path = new_path(spark, "events")
    store.append_events(system_events(spark, folder), path)
    return scan_events(spark, path).groupBy("event_date", "host").agg(
        F.count("*").alias("n"), F.sum("id").alias("ids"), F.count("summary").alias("summaries"))


@query(f"""WITH {EV} SELECT id, host, concat_ws(' ',
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00'), upper(severity), source,
    concat('type=', type, ' summary=', coalesce(nullif(summary, ''), raw_data[1:200]))) AS line FROM ev""")
def log_lines_of_events(spark, folder):
    return log_line(system_events(spark, folder))


@query(f"""WITH {EV} SELECT concat_ws(' ',
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00'), upper(severity), source,
    concat('type=', type, ' summary=', coalesce(nullif(summary, ''), raw_data[1:200]))) AS line FROM ev""")
def write_log_lines(spark, folder):
    path = new_path(spark, "lines")
    store.write_log_lines(system_events(spark, folder), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(f"WITH {EV} SELECT id, {RANK} AS rank, CASE WHEN {RANK} >= CASE WHEN value >= 60 THEN 1 ELSE 0 END THEN severity "
       "WHEN value >= 60 THEN 'warning' ELSE 'info' END AS worst FROM ev")
def severity_max(spark, folder):
    e = sample_events(spark, folder)
    other = F.when(F.col("value") >= 60, "warning").otherwise("info")
    return e.select("id", sev.severity_rank(F.col("severity")).alias("rank"),
                    sev.severity_max(F.col("severity"), other).alias("worst"))


@query("SELECT event_id AS id, CASE WHEN CAST(floor(value / 10) AS INTEGER) BETWEEN 0 AND 3 THEN 'critical' "
       "WHEN CAST(floor(value / 10) AS INTEGER) = 4 THEN 'warning' ELSE 'info' END AS severity FROM events")
def priority_to_severity(spark, folder):
    e = sample_events(spark, folder)
    return e.select("id", sev.priority_to_severity(F.floor(F.col("value") / 10).cast("int")).alias("severity"))


@query(f"WITH {EV} SELECT id, coalesce(nullif(summary, ''), raw_data[1:80]) AS short, "
       "coalesce(nullif(summary, ''), raw_data[1:200]) AS long FROM ev")
def display_texts(spark, folder):
    text = lambda n: display_text(F.col("summary"), F.col("raw_data"), n)
    return system_events(spark, folder).select("id", text(80).alias("short"), text(200).alias("long"))


@query(f"WITH {EV} SELECT id, coalesce(summary, CASE WHEN contains(raw_data, 'msg=') "
       "THEN substr(raw_data, strpos(raw_data, 'msg=') + 4, 120) ELSE raw_data[1:120] END) AS summary FROM ev")
def fallback_summaries(spark, folder):
    return ev.with_fallback_summary(system_events(spark, folder)).select("id", "summary")


@query(f"WITH {EV} SELECT id, CASE event_type WHEN 'error' THEN 'restart_service' WHEN 'signup' THEN 'reboot' "
       "WHEN 'click' THEN 'investigate' END AS action FROM ev")
def actionable(spark, folder):
    kind = F.col("event_type")
    said = (F.when(kind == "error", "Restart_Service").when(kind == "signup", "reboot")
            .when(kind == "click", "INVESTIGATE").otherwise("ignore"))
    return sample_events(spark, folder).select("id", ev.actionable(said).alias("action"))


_UPDATES = f"""WITH {EV}, upd AS (
  SELECT id, 'postponed' AS v, us AS since FROM ev WHERE event_type IN ('error', 'click')
  UNION ALL SELECT id, 'restarted', us + 1 FROM ev WHERE event_type = 'error')
"""


@query(_UPDATES + "SELECT ev.id, coalesce(u.v, ev.user_action) AS user_action FROM ev LEFT JOIN "
       "(SELECT id, arg_max(v, since) AS v FROM upd GROUP BY id) u USING (id)")
def set_user_action(spark, folder):
    e = sample_events(spark, folder)
    later = F.timestamp_micros(F.unix_micros("ts") + 1)
    updates = (ev.action_update(e.where(F.col("event_type").isin("error", "click")), F.lit("postponed"), F.col("ts"))
               .union(ev.action_update(e.where("event_type = 'error'"), F.lit("restarted"), later)))
    return ev.apply_updates(e.select(*EVENT_COLUMNS), updates.drop("summary", "summary_hash")).select("id", "user_action")


@query(f"WITH {EV} SELECT id, CASE WHEN summary IS NULL THEN concat('Found ', event_type) ELSE summary END AS summary, "
       "CASE WHEN summary IS NULL THEN sha256(concat('found ', event_type))[1:16] END AS summary_hash FROM ev")
def set_summary(spark, folder):
    e = sample_events(spark, folder)
    updates = ev.summary_update(e.where(F.col("summary").isNull()), F.concat(F.lit("Found "), "event_type"), F.col("ts"))
    table = ev.add_missing_columns(e.withColumn("event_date", F.to_date("ts")), SYSTEM_EVENTS)
    return ev.apply_updates(table, updates.drop("user_action")).select("id", "summary", "summary_hash")


@query(f"WITH {EV} SELECT id, type, CAST(NULL AS VARCHAR) AS user_action, CAST(NULL AS VARCHAR) AS summary_hash FROM ev")
def add_missing_columns(spark, folder):
    old = system_events(spark, folder).drop("user_action")
    return ev.add_missing_columns(old, SYSTEM_EVENTS).select("id", "type", "user_action", "summary_hash")


@query(f"WITH {EV} SELECT source, type, count(*) AS n, count(extra) AS extras FROM ("
       "SELECT id, type, source, NULL AS extra FROM ev WHERE event_type <> 'error' UNION ALL "
       "SELECT id, type, 'journald', raw_data FROM ev WHERE event_type = 'error') GROUP BY ALL")
def union_events(spark, folder):
    e = sample_events(spark, folder)
    parts = [e.where(F.col("event_type") != "error").select("id", "type", "source"),
             e.where("event_type = 'error'").select("id", "type", F.lit("journald").alias("source"),
                                                    F.col("raw_data").alias("extra"))]
    return ev.union_events(*parts).groupBy("source", "type").agg(F.count("*").alias("n"), F.count("extra").alias("extras"))


def _versioned(spark, folder, batches: int = 5) -> str:
    """The events as a table in versions: appended in batches by id, so every batch has rows of every day."""
    path = new_path(spark, "versions")
    events = system_events(spark, folder)
    for n in range(batches):
        versions.append(events.where(F.col("id") % batches == n), path, f"b{n}")
    return path


@query(f"""WITH {EV} SELECT CAST(ts AS DATE) AS event_date, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids,
  count(*) FILTER (WHERE coalesce(user_action, '') = 'seen') AS seen, 1 AS folders FROM (
  SELECT * REPLACE (CASE WHEN id % 10 = 0 THEN 'seen' ELSE user_action END AS user_action) FROM ev) GROUP BY 1""")
def compact_events(spark, folder):
    """Batches appended, an update log folded in, days compacted: all rows are there, each day in one folder."""
    path = _versioned(spark, folder)
    events = system_events(spark, folder)
    log = events.where("id % 10 = 0").select("id", F.lit("seen").alias("user_action"), F.current_timestamp().alias("updated_at"))
    versions.fold_updates(spark, path, log)
    versions.compact(spark, path)
    rows = versions.read(spark, path).groupBy("event_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.count_if(F.col("user_action") == "seen").alias("seen"))
    listed = versions.folders(spark, path).groupBy(F.col("day").alias("event_date")).agg(F.count(F.lit(1)).cast("int").alias("folders"))
    return rows.join(listed, "event_date")


@query(f"WITH {EV} SELECT id, type, user_action FROM ev WHERE NOT ({_EXPIRED})")
def versioned_retention(spark, folder):
    """Retention as a new version of the table; the version before is still there to be read."""
    path = _versioned(spark, folder, 2)
    versions.retain(spark, path, AS_OF, KEEP)
    return versions.read(spark, path).select("id", "type", "user_action")


@query(f"WITH {EV} SELECT host, count(*) AS n, true AS in_order FROM ev GROUP BY host")
def increasing_ids(spark, folder):
    """Ids given on append rise with time within a batch and from batch to batch: pages can be read by id."""
    path = new_path(spark, "numbered")
    events = system_events(spark, folder).drop("id")
    half = events.agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0] or 0
    versions.append(events.where(F.unix_micros("ts") <= half), path, "first")
    versions.append(events.where(F.unix_micros("ts") > half), path, "second")
    rows = Timeline(versions.read(spark, path), ["host"], ["id"], width=1 << 33).carry({"before": F.col("ts")}).df
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(F.col("before") <= F.col("ts")), F.lit(True)).alias("in_order"))
