"""Briefings, crash reports and enrichment."""

from pyspark.sql import functions as F

from opsweave.catalog import EV, RANK, query, us
from opsweave.catalog.parse import _log
from opsweave.plans import enrich, report
from opsweave.sources.logs import log_tail
from opsweave.sources.tables import AS_OF, sample_events, system_events

END = "2024-01-20 12:00:00"

_DAY = f"""{EV}, day AS (SELECT *, {RANK} AS rank FROM ev
  WHERE ts >= TIMESTAMP '{END}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{END}'),
types AS (SELECT host, type, count(*) AS n, min(us) AS first_us FROM day GROUP BY ALL),
typed AS (SELECT host, sum(n) AS total, count(*) AS k, string_agg(concat('  ', type, ': ', n), chr(10) ORDER BY n DESC, first_us) AS t
  FROM types GROUP BY ALL)"""


@query(f"""WITH {_DAY}, ranked AS (SELECT d.host, row_number() OVER (PARTITION BY host ORDER BY rank DESC, ts, id) AS r,
  concat('- [', upper(severity), '] ', type, ': ', coalesce(nullif(summary, ''), raw_data[1:80])) AS line FROM day d),
shown AS (SELECT r.host, count(*) AS n, string_agg(line, chr(10) ORDER BY r) AS lines FROM ranked r JOIN typed USING (host)
  WHERE r <= greatest(1, 12 - k) GROUP BY ALL),
texts AS (SELECT host, total, concat('Total events: ', total, chr(10), t, chr(10), chr(10), 'Notable events:', chr(10), lines,
  CASE WHEN total > n THEN concat(chr(10), '  ... and ', total - n, ' more events') ELSE '' END) AS s FROM typed JOIN shown USING (host))
SELECT host, CAST(total AS BIGINT) AS total, CASE WHEN length(s) > 1200 THEN concat(s[1:1197], '...') ELSE s END AS raw_data FROM texts""")
def briefing(spark, folder):
    return report.briefing(system_events(spark, folder), END).select("host", "total", "raw_data")


@query(f"""WITH {_DAY}, sevs AS (SELECT host, string_agg(concat('  ', severity, ': ', n), chr(10) ORDER BY rank DESC) AS t FROM
  (SELECT host, severity, rank, count(*) AS n FROM day GROUP BY ALL) GROUP BY ALL),
crit AS (SELECT host, string_agg(concat('  - ', type, ': ', coalesce(nullif(summary, ''), raw_data[1:80])), chr(10) ORDER BY ts, id) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts, id) AS r FROM day WHERE severity = 'critical') WHERE r <= 5 GROUP BY ALL)
SELECT host, concat('Morning briefing (LLM unavailable — plain summary):', chr(10), 'Total events in last 24h: ', total, chr(10), chr(10),
  'By severity:', chr(10), sevs.t, chr(10), chr(10), 'By type:', chr(10), typed.t, CASE WHEN crit.t IS NULL THEN '' ELSE
  concat(chr(10), chr(10), 'Critical events requiring attention:', chr(10), crit.t) END) AS summary
FROM typed JOIN sevs USING (host) LEFT JOIN crit USING (host)""")
def plain_briefing(spark, folder):
    return report.briefing(system_events(spark, folder), END).select("host", "summary")


_TAIL = f"""{EV}, ll AS (SELECT host, CAST(CAST(ts AS DATE) AS VARCHAR) AS session, id, source, concat_ws(' ',
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00'), upper(severity), source,
  concat('type=', type, ' summary=', coalesce(nullif(summary, ''), raw_data))) AS line FROM ev),
tail AS (SELECT * FROM ll QUALIFY row_number() OVER (PARTITION BY host, session ORDER BY id DESC) <= 200),
stats AS (SELECT host, session, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(line, '\\bCRITICAL\\b')) AS n_critical,
  bool_or(regexp_matches(line, '(?i)\\b(oom|out.of.memory|killed.process)\\b')) AS oom,
  bool_or(regexp_matches(line, '(?i)\\b(panic|segfault|coredump)\\b')) AS panic, arg_max(source, id) AS last_source
  FROM tail GROUP BY ALL)"""


@query(f"WITH {_TAIL} SELECT * FROM stats")
def crash_stats(spark, folder):
    return report.crash_stats(log_tail(_log(spark, folder), 200))


@query(f"""WITH {_TAIL}, boots AS (SELECT host, CAST(CAST(ts AS DATE) AS VARCHAR) AS session, us,
  CASE WHEN value >= 40 THEN 'clean' ELSE 'booted' END AS state FROM ev WHERE event_type = 'signup'),
crashed AS (SELECT * FROM (SELECT *, lag(session) OVER w AS before, lag(state) OVER w AS previous FROM boots
  WINDOW w AS (PARTITION BY host ORDER BY us)) WHERE state = 'booted' AND previous = 'booted')
SELECT c.host, c.session, us AS ts_us, n_lines, concat('Previous session crashed (', n_lines, ' log lines recovered)',
  CASE WHEN n_critical > 0 THEN concat('. ', n_critical, ' CRITICAL events') ELSE '' END, CASE WHEN oom THEN '. OOM detected' ELSE '' END,
  CASE WHEN panic THEN '. kernel panic/segfault detected' ELSE '' END, '. last active source: ', last_source) AS analysis
FROM crashed c JOIN stats s ON s.host = c.host AND s.session = c.before""")
def crash_report(spark, folder):
    boots = sample_events(spark, folder).where("event_type = 'signup'").select(
        "host", F.to_date("ts").cast("string").alias("session"), "ts",
        F.when(F.col("value") >= 40, "clean").otherwise("booted").alias("state"))
    return report.crash_report(boots, _log(spark, folder)).select(
        "host", "session", us(), F.size("pre_crash_log").cast("long").alias("n_lines"), "analysis")


_BATCHED = f"""{EV}, waiting AS (SELECT *, us // 300000000 AS slot FROM ev WHERE summary IS NULL),
batched AS (SELECT *, (row_number() OVER (PARTITION BY host, slot ORDER BY us, id) - 1) // 50 AS batch FROM waiting)"""


@query(f"WITH {_BATCHED} SELECT host, slot, batch, count(*) AS n, string_agg(concat('[id=', id, '] [', severity, '] ', source, ': ', "
       "raw_data[1:200]), chr(10) ORDER BY us, id) AS lines FROM batched GROUP BY ALL")
def batch_prompts(spark, folder):
    prompts = enrich.batch_prompts(enrich.in_batches(system_events(spark, folder)))
    return prompts.select("host", "slot", "batch", "n",
                          F.regexp_extract("prompt", r"(?s)<events>\n(.*)\n</events>", 1).alias("lines"))


@query(f"WITH {_BATCHED} SELECT id, concat(source, ': ', event_type, '[', id, ']') AS summary, CASE severity WHEN 'critical' THEN "
       "'investigate' WHEN 'warning' THEN 'restart_service' ELSE user_action END AS user_action FROM batched")
def enrich_events(spark, folder):
    return enrich.enrich(system_events(spark, folder)).select("id", "summary", "user_action")


@query(f"WITH {_BATCHED} SELECT id, concat(event_type, '[', id, ']') AS summary FROM batched")
def enrich_without_analyzer(spark, folder):
    return enrich.enrich(system_events(spark, folder), lambda prompt, system, temperature: None).select("id", "summary")


@query(f"""WITH {_BATCHED}, per AS (SELECT host, slot, batch, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS c,
  list_sort(list(DISTINCT concat(source, ' ', severity)) FILTER (WHERE severity <> 'info')) AS p FROM batched GROUP BY ALL)
SELECT host, slot, batch, concat(c, ' critical of ', n, ' events', CASE WHEN len(p) > 0 THEN concat(' Patterns: ',
  array_to_string(p[1:3], '; ')) ELSE '' END)[1:200] AS summary FROM per""")
def patterns_summary(spark, folder):
    answers = enrich.analyze(enrich.batch_prompts(enrich.in_batches(system_events(spark, folder))))
    return enrich.patterns_summary(answers).select("host", "slot", "batch", "summary")


def _uneven_answers(spark, folder):
    """Answers that repeat ids, name unknown ones, leave some out or are no JSON."""
    batched = enrich.in_batches(system_events(spark, folder), every_seconds=86400)

    def generate(prompt, system, temperature):
        import json
        import re
        ids = [int(i) for i in re.findall(r"\[id=(\d+)\]", prompt)]
        if len(ids) % 2:
            return "I could not look at " + str(ids)
        items = [{"id": i, "summary": "draft", "action": "REBOOT"} for i in ids[::2]]
        items += [{"id": i, "summary": f"checked {i}"} for i in ids[::2]] + [{"id": 10 ** 12, "summary": "who"}]
        return json.dumps({"events": items, "patterns": [], "overall": ""})
    return batched, enrich.analyze(enrich.batch_prompts(batched), generate)


@query(f"""WITH {EV}, waiting AS (SELECT *, us // 86400000000 AS slot FROM ev WHERE summary IS NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY host, slot ORDER BY us, id) - 1 AS r FROM waiting),
batched AS (SELECT *, count(*) OVER (PARTITION BY host, slot, r // 50) AS n FROM numbered)
SELECT id, CASE WHEN n % 2 = 0 AND (r % 50) % 2 = 0 THEN concat('checked ', id) ELSE concat(event_type, '[', id, ']') END AS summary,
  CASE WHEN n % 2 = 0 AND (r % 50) % 2 = 0 THEN 'reboot' ELSE user_action END AS user_action FROM batched""")
def apply_enrichment(spark, folder):
    return enrich.apply_enrichment(*_uneven_answers(spark, folder)).select("id", "summary", "user_action")


@query("SELECT host, 'No events in the last 24 hours.' AS raw_data FROM (SELECT DISTINCT concat('h', user_id % 3) AS host FROM events)")
def quiet_briefing(spark, folder):
    e = system_events(spark, folder)
    return report.briefing(e, "2025-06-01 06:00:00", hosts=e.select("host").distinct()).select("host", "raw_data")


@query(f"WITH {EV} SELECT host, count(*) AS total FROM ev WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR GROUP BY host")
def generated_briefing(spark, folder):
    out = report.briefing(system_events(spark, folder), AS_OF, lambda prompt, system, temperature: f"{len(prompt)} read")
    return out.where("summary like '% read'").select("host", "total")
