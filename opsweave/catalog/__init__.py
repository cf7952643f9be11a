"""Every operator as a query over the given tables, with the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with its SQL where there is one."""
    def register(fn: Query) -> Query:
        key = name or fn.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return register


def us(column: str = "ts") -> Column:
    return F.unix_micros(column).alias(f"{column}_us")


# The sample tables in SQL, as in opsweave.sources.tables.
EV = """ev AS (
  SELECT event_id AS id, concat('h', user_id % 3) AS host, ts,
    CASE event_type WHEN 'error' THEN 'log_anomaly' WHEN 'signup' THEN 'service_fail'
      WHEN 'purchase' THEN 'package_update' WHEN 'click' THEN 'system_metric' ELSE 'snapshot' END AS type,
    CASE WHEN event_type = 'error' AND value >= 100 THEN 'critical' WHEN event_type = 'error' THEN 'warning'
      ELSE 'info' END AS severity,
    CASE WHEN event_id % 3 <> 0 THEN concat('seen ', event_type) END AS summary,
    concat('unit=u', user_id, ' msg=', event_type, '[', event_id, ']') AS raw_data,
    concat('s', user_id % 5) AS source,
    CASE WHEN event_id % 7 = 0 THEN 'applied' WHEN event_id % 11 = 0 THEN 'ignored' END AS user_action,
    user_id, event_type, value, epoch_us(ts) AS us
  FROM events)"""
RANK = "CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END"
SAMPLES = EV + """,
samples AS (SELECT host, concat('u', user_id) AS metric, ts, us, value FROM ev)"""
POLLS = EV + """,
ticks AS (SELECT DISTINCT host, CAST(ts AS DATE) AS tick FROM ev),
ents AS (SELECT DISTINCT host, CAST(ts AS DATE) AS tick, concat('u', user_id) AS entity FROM ev
         WHERE event_type = 'error'),
prev AS (SELECT host, tick, lag(tick) OVER (PARTITION BY host ORDER BY tick) AS p,
         lead(tick) OVER (PARTITION BY host ORDER BY tick) AS n FROM ticks),
states AS (SELECT host, CAST(ts AS DATE) AS tick, concat('u', user_id) AS entity,
           bool_and(event_type <> 'error') AS up FROM ev GROUP BY ALL)"""
