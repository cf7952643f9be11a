"""Change detection queries over daily polls."""

from pyspark.sql import functions as F

from opsweave.catalog import EV, POLLS, query, us
from opsweave.operators import change
from opsweave.sources.tables import daily_errors, daily_states, daily_ticks, sample_events

_NEW = f"""WITH {POLLS}, fresh AS (
  SELECT e.host, e.tick, e.entity, prev.p FROM ents e JOIN prev USING (host, tick)
  WHERE NOT EXISTS (SELECT 1 FROM ents b WHERE b.host = e.host AND b.entity = e.entity AND b.tick = prev.p))
SELECT host, tick, entity FROM fresh"""


@query(_NEW)
def new_entities(spark, folder):
    return change.new_entities(daily_errors(spark, folder), daily_ticks(spark, folder)).select("host", "tick", "entity")


@query(_NEW + " WHERE p IS NOT NULL")
def new_entities_primed(spark, folder):
    return change.new_entities(daily_errors(spark, folder), daily_ticks(spark, folder), prime=True).select(
        "host", "tick", "entity")


@query(f"WITH {POLLS} SELECT e.host, prev.n AS tick, e.entity FROM ents e JOIN prev USING (host, tick) "
       "WHERE prev.n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ents b WHERE b.host = e.host "
       "AND b.entity = e.entity AND b.tick = prev.n)")
def recovered_entities(spark, folder):
    return change.recovered_entities(daily_errors(spark, folder), daily_ticks(spark, folder)).select(
        "host", "tick", "entity")


_ADJACENT = (f"WITH {POLLS}, moved AS (SELECT s.host, s.tick, s.entity, b.up AS was, s.up FROM states s "
             "JOIN prev USING (host, tick) JOIN states b ON b.host = s.host AND b.entity = s.entity "
             "AND b.tick = prev.p WHERE b.up <> s.up) ")
_LAST = (f"WITH {POLLS}, moved AS (SELECT * FROM (SELECT host, tick, entity, up, lag(up) OVER "
         "(PARTITION BY host, entity ORDER BY tick) AS was FROM states) WHERE was <> up) ")


@query(_ADJACENT + "SELECT host, tick, entity, was, up FROM moved")
def state_transitions(spark, folder):
    return change.state_transitions(daily_states(spark, folder), daily_ticks(spark, folder)).select(
        "host", "tick", "entity", "was", "up")


@query(_LAST + "SELECT host, tick, entity, was, up FROM moved")
def state_transitions_last_known(spark, folder):
    return change.state_transitions(daily_states(spark, folder)).select("host", "tick", "entity", "was", "up")


@query(_ADJACENT + "SELECT host, tick, CASE WHEN up THEN 'info' ELSE 'warning' END AS severity, "
       "concat('peer=', entity) AS raw_data, concat('tailscale: ', entity, CASE WHEN up THEN ' online' ELSE ' offline' END) "
       "AS summary FROM moved")
def peer_events(spark, folder):
    return change.peer_events(daily_states(spark, folder), daily_ticks(spark, folder)).select(
        "host", "tick", "severity", "raw_data", "summary")


@query(_LAST + "SELECT host, tick, type, severity, raw_data, summary FROM (SELECT host, tick, 'service_fail' AS type, "
       "'warning' AS severity, concat('svc=', entity) AS raw_data, concat(entity, '.service down') AS summary FROM moved "
       "WHERE NOT up)")
def service_down_events(spark, folder):
    return change.service_down_events(daily_states(spark, folder)).select(
        "host", "tick", "type", "severity", "raw_data", "summary")


@query(_LAST + "SELECT host, tick, 'system_metric' AS type, concat('port=', entity) AS raw_data, "
       "concat('Port ', entity, ' (', entity, 'd) down') AS summary FROM moved WHERE NOT up")
def port_down_events(spark, folder):
    ports = daily_states(spark, folder).withColumn("label", F.concat("entity", F.lit("d")))
    return change.port_down_events(ports).select("host", "tick", "type", "raw_data", "summary")


@query(f"WITH f AS ({_NEW}) SELECT host, tick, 'critical' AS severity, concat('unit=', entity, ' state=failed') AS raw_data, "
       "concat('Service ', entity, ' has failed') AS summary FROM f")
def failed_unit_events(spark, folder):
    return change.failed_unit_events(daily_errors(spark, folder), daily_ticks(spark, folder)).select(
        "host", "tick", "severity", "raw_data", "summary")


@query(f"WITH f AS ({_NEW} WHERE p IS NOT NULL) SELECT host, tick, 'config_change' AS type, concat('path=', entity) AS raw_data, "
       "concat('New .pacnew: ', entity) AS summary FROM f")
def config_file_events(spark, folder):
    return change.config_file_events(daily_errors(spark, folder), daily_ticks(spark, folder)).select(
        "host", "tick", "type", "raw_data", "summary")


_SEEN = f"WITH {POLLS}, seen AS (SELECT host, entity, min(tick) AS tick FROM ents GROUP BY ALL) "


@query(_SEEN + "SELECT * FROM seen")
def first_seen(spark, folder):
    return change.first_seen(daily_errors(spark, folder), ["host", "entity"], ["tick"]).select("host", "entity", "tick")


@query(_SEEN + "SELECT s.* FROM seen s JOIN (SELECT host, min(tick) AS t FROM ents GROUP BY ALL) USING (host) WHERE s.tick > t")
def first_seen_primed(spark, folder):
    return change.first_seen(daily_errors(spark, folder), ["host", "entity"], ["tick"], prime=True).select(
        "host", "entity", "tick")


@query(_SEEN + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY tick, entity) AS n FROM seen) "
       "SELECT host, entity, tick, CAST(n AS INTEGER) AS n FROM ranked WHERE n = 40")
def accumulation_alert(spark, folder):
    return change.accumulation_alert(daily_errors(spark, folder), "entity", ["tick"], warn=40)


@query(f"""WITH {POLLS}, sized AS (SELECT t.host, t.tick, count(e.entity) AS n FROM ticks t LEFT JOIN ents e USING (host, tick)
  GROUP BY ALL), moved AS (SELECT *, n - lag(n) OVER (PARTITION BY host ORDER BY tick) AS added FROM sized),
names AS (SELECT host, tick, string_agg(entity, ', ' ORDER BY entity) AS sample FROM (SELECT *, row_number() OVER
  (PARTITION BY host, tick ORDER BY entity) AS r FROM ents) WHERE r <= 5 GROUP BY ALL)
SELECT host, tick, n, added, sample FROM moved JOIN names USING (host, tick) WHERE added > 0""")
def growth_alert(spark, folder):
    return change.growth_alert(daily_errors(spark, folder), daily_ticks(spark, folder)).drop("source")


_VERSIONS = f"""WITH {EV}, run AS (SELECT host, CAST(ts AS DATE) AS tick, concat('v', max(user_id)) AS version FROM ev GROUP BY ALL),
inst AS (SELECT DISTINCT host, CAST(ts AS DATE) AS tick, concat('v', user_id) AS version FROM ev WHERE event_type = 'error'),
bad AS (SELECT r.host, r.tick, concat('running=', r.version, ' installed=', coalesce(
    (SELECT string_agg(version, ',' ORDER BY version) FROM inst i WHERE i.host = r.host AND i.tick = r.tick), '')) AS mismatch
  FROM run r WHERE NOT EXISTS (SELECT 1 FROM inst i WHERE i.host = r.host AND i.tick = r.tick AND i.version = r.version))
"""


def _versions(spark, folder):
    e = sample_events(spark, folder).select("host", F.to_date("ts").alias("tick"), "user_id", "event_type")
    version = lambda c: F.concat(F.lit("v"), c.cast("string")).alias("version")
    return (e.groupBy("host", "tick").agg(version(F.max("user_id"))),
            e.where("event_type = 'error'").select("host", "tick", version(F.col("user_id"))))


@query(_VERSIONS + "SELECT host, tick, mismatch FROM bad")
def kernel_mismatch(spark, folder):
    return change.kernel_mismatch(*_versions(spark, folder))


@query(_VERSIONS + """, flag AS (SELECT r.host, r.tick, bad.mismatch, bad.mismatch IS NOT NULL AS due FROM run r
  LEFT JOIN bad USING (host, tick))
SELECT host, tick, concat('kernel_mismatch: ', mismatch) AS raw_data, 'System reboot required' AS summary FROM
  (SELECT *, lag(due, 1, false) OVER (PARTITION BY host ORDER BY tick) AS was FROM flag) WHERE due AND NOT was""")
def reboot_events(spark, folder):
    running, installed = _versions(spark, folder)
    flags = (running.select("host", "tick").join(change.kernel_mismatch(running, installed), ["host", "tick"], "left")
             .withColumn("sentinel", F.lit(False)))
    return change.reboot_events(flags).select("host", "tick", "raw_data", "summary")


@query(f"WITH {EV} SELECT id, host, us AS ts_us FROM (SELECT *, value >= 100 AS b, "
       "lag(value >= 100, 1, false) OVER (PARTITION BY host ORDER BY ts, id) AS was FROM ev) WHERE b AND NOT was")
def edge_alerts(spark, folder):
    e = sample_events(spark, folder)
    return change.edge_alerts(e, F.col("value") >= 100, ["host"], ["ts", "id"]).select("id", "host", us())


@query(f"WITH {EV}, s AS (SELECT host, us, CASE WHEN value >= 40 THEN 'clean' ELSE 'booted' END AS state FROM ev "
       "WHERE event_type = 'signup') SELECT host, us AS ts_us, previous_state FROM (SELECT *, "
       "lag(state) OVER (PARTITION BY host ORDER BY us) AS previous_state FROM s) "
       "WHERE state = 'booted' AND previous_state = 'booted'")
def unclean_sessions(spark, folder):
    s = sample_events(spark, folder).where("event_type = 'signup'").select(
        "host", "ts", F.when(F.col("value") >= 40, "clean").otherwise("booted").alias("state"))
    return change.unclean_sessions(s).select("host", us(), "previous_state")
