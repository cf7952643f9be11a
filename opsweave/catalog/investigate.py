"""What preceded failures and crashes, and events unlike a host's history."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.catalog import EV, query, us
from opsweave.operators import correlate
from opsweave.operators.anomaly import embedding_anomalies
from opsweave.schemas import EVENT_TYPES
from opsweave.sources.tables import sample_events, table

GROUPS = ["kernel", "graphics", "audio"]


@query(f"""WITH {EV}, fails AS (SELECT id, host, us FROM ev WHERE type = 'service_fail'),
near AS (SELECT f.id, f.host, f.us, e.type, e.us AS e_us, e.id AS e_id FROM fails f JOIN ev e
  ON e.host = f.host AND e.us >= f.us - 3600000000 AND (e.us < f.us OR e.us = f.us AND e.id < f.id))
SELECT id, host, us AS ts_us, type, count(*) AS n, arg_max(e_id, (e_us, e_id)) AS last_id, max(e_us) AS last_ts_us FROM near GROUP BY ALL""")
def failure_context(spark, folder):
    """Per failed service and type of event: how many there were on its host in the hour before, and the last one."""
    events = sample_events(spark, folder)
    found = correlate.kinds_before(events.where("type = 'service_fail'"), events, ["host"], "type", list(EVENT_TYPES), 3600)
    return found.select("id", "host", us(), "type", "n", "last_id", us("last_ts"))


_TABLES = f"""{EV}, crashes AS (SELECT id, host, us, source FROM ev WHERE type = 'log_anomaly' AND severity = 'critical'),
updates AS (SELECT id, host, us, concat('pkg', user_id) AS package, CASE user_id % 4 WHEN 0 THEN 'kernel' WHEN 1 THEN 'graphics'
  WHEN 2 THEN 'audio' ELSE 'other' END AS grp FROM ev WHERE type = 'package_update'),
asked AS (SELECT c.*, g.grp FROM crashes c, (VALUES ('kernel'), ('graphics'), ('audio')) g(grp)),
after AS (SELECT a.*, u.id AS update_id, u.us AS update_us, u.package, (a.us - u.us) / 3600e6 AS hours
  FROM asked a ASOF JOIN updates u ON a.host = u.host AND a.grp = u.grp AND a.us >= u.us WHERE a.us - u.us <= 172800000000)"""


def _crashes(spark, folder):
    events = sample_events(spark, folder)
    user = F.col("user_id")
    group = F.when(user % 4 == 0, "kernel").when(user % 4 == 1, "graphics").when(user % 4 == 2, "audio").otherwise("other")
    updates = events.where("type = 'package_update'").select(
        "id", "host", "ts", F.concat(F.lit("pkg"), user.cast("string")).alias("package"), group.alias("grp"))
    crashes = events.where("type = 'log_anomaly' AND severity = 'critical'").select("id", "host", "ts", "source")
    return crashes, updates


@query(f"""WITH {_TABLES} SELECT id, host, us AS ts_us, source, grp, update_id, update_us AS update_ts_us, package,
  round(hours, 6) AS hours FROM after""")
def crash_after_update(spark, folder):
    """Each crash with the last update of each watched package group on its host, up to 48 hours before."""
    crashes, updates = _crashes(spark, folder)
    found = correlate.updates_before_crashes(crashes, updates, GROUPS)
    return found.select("id", "host", us(), "source", "grp", "update_id", us("update_ts"), "package", F.round("hours", 6).alias("hours"))


@query(f"""WITH {_TABLES}, total AS (SELECT host, count(*) AS all_crashes FROM crashes GROUP BY host),
made AS (SELECT host, grp, count(*) AS updates FROM updates GROUP BY ALL)
SELECT host, grp, any_value(updates) AS updates, count(DISTINCT update_id) AS followed, count(*) AS crashes,
  round(min(hours), 6) AS soonest_hours, round(count(*) / any_value(all_crashes), 6) AS share
FROM after JOIN made USING (host, grp) JOIN total USING (host) GROUP BY host, grp""")
def update_suspects(spark, folder):
    """Package groups whose updates crashes follow."""
    crashes, updates = _crashes(spark, folder)
    after = correlate.updates_before_crashes(crashes, updates, GROUPS)
    return correlate.update_suspects(after, crashes, updates).withColumns(
        {"soonest_hours": F.round("soonest_hours", 6), "share": F.round("share", 6)})


@query(f"""WITH {EV}, rows AS (SELECT ev.id, host, us, us // 86400000000 AS day, embedding::DOUBLE[] AS v
  FROM ev JOIN embeddings ON vec_id * 20 = ev.id),
cells AS (SELECT host, day, i, sum(v[i]) AS s FROM rows, range(1, 65) t(i) GROUP BY ALL),
days AS (SELECT host, day, count(*) AS n, sum(list_inner_product(v, v)) AS square FROM rows GROUP BY ALL),
whole AS (SELECT host, day, n, square, list(s ORDER BY i) AS total FROM cells JOIN days USING (host, day) GROUP BY ALL),
pairs AS (SELECT d.host, d.day, b.n, b.square, b.total FROM whole d LEFT JOIN whole b ON b.host = d.host AND b.day BETWEEN d.day - 7 AND d.day - 1),
base AS (SELECT host, day, coalesce(sum(n), 0)::BIGINT AS base_n, sum(square) AS square FROM pairs GROUP BY ALL),
means AS (SELECT host, day, list(m ORDER BY i) AS mean FROM (SELECT host, day, i, sum(total[i]) / sum(n) AS m
  FROM pairs, range(1, 65) t(i) WHERE n IS NOT NULL GROUP BY ALL) GROUP BY ALL),
spreads AS (SELECT base.*, mean, sqrt(greatest(square / base_n - list_inner_product(mean, mean), 0)) AS spread,
  least(day - min(day) OVER (PARTITION BY host), 7) AS base_days FROM base LEFT JOIN means USING (host, day)),
far AS (SELECT id, host, us, base_n, base_days, base_days < 7 AS cold, CASE WHEN base_n >= 5 THEN sqrt(greatest(list_inner_product(v, v)
  - 2 * list_inner_product(v, mean) + list_inner_product(mean, mean), 0)) END AS distance, spread FROM rows JOIN spreads USING (host, day))
SELECT id, host, us AS ts_us, base_n, base_days, cold, round(distance, 6) AS distance, round(distance / spread, 6) AS ratio,
  distance / spread > CASE WHEN cold THEN 1.5 ELSE 1.2 END AS anomaly FROM far""", name="embedding_anomalies")
def _embedding_anomalies(spark, folder):
    """Events far from the mean of their host's last seven days."""
    vectors = table(spark, folder, "embeddings").select((F.col("vec_id") * 20).alias("id"), "embedding")  # spread over the month
    events = sample_events(spark, folder).select("id", "host", "ts").join(vectors, "id")
    return embedding_anomalies(events).select("id", "host", us(), "base_n", "base_days", "cold", F.round("distance", 6).alias("distance"),
                                              F.round("ratio", 6).alias("ratio"), "anomaly")
