"""Parsers over text lines that are built from the event table."""

from pyspark.sql import functions as F

from opsweave.catalog import EV, query, us
from opsweave.catalog.series import rate_limited_sql
from opsweave.operators import change
from opsweave.plans import journal
from opsweave.operators.series import level_check
from opsweave.sources import logs, tools
from opsweave.sources.tables import raw_blobs, raw_lines, sample_events

C = F.col
L = F.lit


def _s(column: str):
    return C(column).cast("string")


def _n(expr):
    return F.floor(expr).cast("string")


def _when(kind, yes, no=None):
    found = F.when(C("event_type") == kind, yes)
    return found if no is None else found.otherwise(no)


def _journal(spark, folder):
    e = sample_events(spark, folder)
    stamp = F.when(C("event_type") != "purchase", F.concat(
        L(',"__REALTIME_TIMESTAMP":"'), (F.unix_micros("ts") + 1).cast("string"), L('"'))).otherwise("")
    return raw_lines(e, F.concat(
        L('{"MESSAGE":"'), F.when(C("value") < 3, "").otherwise(F.concat("event_type", L("["), _s("id"), L("] at 0xff"), _s("id"))),
        L('","PRIORITY":"'), _n(C("value") / 15), L('","_TRANSPORT":"'), _when("view", "kernel", "journal"),
        L('","_SYSTEMD_UNIT":"'), F.when(C("event_type").isin("view", "click"), "").otherwise(C("source")),
        L('","SYSLOG_IDENTIFIER":"'), F.when((C("event_type") == "signup") & (C("value") < 20), "me").otherwise("app"),
        L('"'), stamp, L("}")))


_JOURNAL = f"""{EV}, jl AS (SELECT id, host, us, concat('{{"MESSAGE":"', CASE WHEN value < 3 THEN '' ELSE
    concat(event_type, '[', id, '] at 0xff', id) END, '","PRIORITY":"', CAST(floor(value / 15) AS INTEGER),
  '","_TRANSPORT":"', CASE WHEN event_type = 'view' THEN 'kernel' ELSE 'journal' END, '","_SYSTEMD_UNIT":"',
  CASE WHEN event_type IN ('view', 'click') THEN '' ELSE source END, '","SYSLOG_IDENTIFIER":"',
  CASE WHEN event_type = 'signup' AND value < 20 THEN 'me' ELSE 'app' END, '"',
  CASE WHEN event_type <> 'purchase' THEN concat(',"__REALTIME_TIMESTAMP":"', us + 1, '"') ELSE '' END, '}}') AS line FROM ev),
je AS (SELECT id, host, coalesce(CAST(json_extract_string(line, '$.__REALTIME_TIMESTAMP') AS BIGINT), us) AS us,
  coalesce(nullif(json_extract_string(line, '$._SYSTEMD_UNIT'), ''),
    CASE WHEN json_extract_string(line, '$._TRANSPORT') = 'kernel' THEN 'kernel' END, 'unknown') AS unit,
  CAST(json_extract_string(line, '$.PRIORITY') AS INTEGER) AS priority, json_extract_string(line, '$.MESSAGE') AS message,
  json_extract_string(line, '$.SYSLOG_IDENTIFIER') AS ident FROM jl)"""
_KEPT = "message <> '' AND priority <= 3 AND ident <> 'me'"


@query(f"WITH {_JOURNAL} SELECT id, us AS ts_us, unit, priority, message FROM je")
def parse_journal(spark, folder):
    return logs.parse_journal(_journal(spark, folder)).select("id", us(), "unit", "priority", "message")


@query(f"WITH {_JOURNAL} SELECT id, unit, priority FROM je WHERE priority <= 3")
def priority_filter(spark, folder):
    return logs.priority_filter(logs.parse_journal(_journal(spark, folder))).select("id", "unit", "priority")


@query(f"WITH {_JOURNAL} SELECT id, ident FROM je WHERE ident <> 'me'")
def exclude_self(spark, folder):
    return logs.exclude_self(logs.parse_journal(_journal(spark, folder)), ["me.service"], ["me"]).select("id", "ident")


@query(f"WITH {_JOURNAL} SELECT id, message FROM je WHERE message <> ''")
def non_empty_message(spark, folder):
    return logs.non_empty_message(logs.parse_journal(_journal(spark, folder))).select("id", "message")


@query(f"WITH {_JOURNAL} SELECT unit, count(*) AS n FROM je GROUP BY unit")
def default_unit(spark, folder):
    return logs.parse_journal(_journal(spark, folder)).groupBy("unit").agg(F.count("*").alias("n"))


@query(f"WITH {_JOURNAL} SELECT j.id FROM je j WHERE priority <= 2 OR NOT EXISTS (SELECT 1 FROM ev WHERE ev.host = j.host "
       "AND ev.severity = 'critical' AND j.us >= ev.us AND j.us - ev.us < 600000000)")
def startup_grace(spark, folder):
    starts = sample_events(spark, folder).where("severity = 'critical'").select("host", C("ts").alias("start_ts"))
    return logs.startup_grace(logs.parse_journal(_journal(spark, folder)), starts, 600).select("id")


@query(f"WITH {_JOURNAL} SELECT id, us AS ts_us, 'log_anomaly' AS type, 'critical' AS severity, "
       f"concat('unit=', unit, ' priority=', priority, ' msg=', message) AS raw_data FROM je WHERE {_KEPT}")
def journal_events(spark, folder):
    return journal.journal_to_events(_journal(spark, folder), None, units=["me.service"], idents=["me"]).select(
        "id", us(), "type", "severity", "raw_data")


@query(f"WITH {_JOURNAL} SELECT count(*) AS n, count(DISTINCT fp) AS fps FROM (SELECT host, sha256(concat('journald:', unit, ':', "
       "regexp_replace(regexp_replace(message, '\\[[0-9]+\\]', '[*]', 'g'), '0x[0-9a-fA-F]+', '0x*', 'g')))[1:16] AS fp, "
       f"us FROM je WHERE {_KEPT}) WHERE true")
def journal_fingerprints(spark, folder):
    marked = journal.with_fingerprint(logs.journal_filter(_journal(spark, folder), ["me.service"], ["me"]))
    return (marked.groupBy("fingerprint").agg(F.count("*").alias("n"))
            .agg(F.sum("n").alias("n"), F.count("*").alias("fps")))


_JOURNAL_MARKED = _JOURNAL + f""", marked AS (SELECT id, host, 'journald' AS source, us, unit, priority, message,
  sha256(concat('journald:', unit, ':', regexp_replace(regexp_replace(regexp_replace(message, '\\[[0-9]+\\]', '[*]', 'g'),
    '0x[0-9a-fA-F]+', '0x*', 'g'), '^ +| +$', '', 'g')))[1:16] AS fingerprint FROM je WHERE {_KEPT})"""


@query(f"WITH {rate_limited_sql(_JOURNAL_MARKED, 20, 60 * 10**6, 60 * 10**6, 600 * 10**6)} SELECT c.id, c.us AS ts_us, "
       "concat('unit=', unit, ' priority=', priority, ' msg=', message, CASE WHEN n > 0 THEN concat(' [+', n, ' suppressed]') "
       "ELSE '' END) AS raw_data FROM counted c JOIN marked m USING (id) WHERE passed")
def journal_to_events(spark, folder):
    return journal.journal_to_events(_journal(spark, folder), rate_limited=True, units=["me.service"], idents=["me"]).select(
        "id", us(), "raw_data")


@query(f"WITH {rate_limited_sql(_JOURNAL_MARKED, 20, 60 * 10**6, 60 * 10**6, 600 * 10**6)} SELECT c.host, c.us AS ts_us "
       "FROM counted c WHERE passed")
def journal_without_cursor(spark, folder):
    """Lines that come twice in one microsecond, without a cursor or an id to tell them apart, give one event."""
    lines = _journal(spark, folder).drop("id")
    return journal.journal_to_events(lines.unionByName(lines), rate_limited=True, units=["me.service"], idents=["me"]).select(
        "host", us())


def _packages(spark, folder):
    stamp = F.concat(L("["), _when("error", L("some day"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+0200'")), L("] "))
    pkg = F.concat(L("pkg"), _s("user_id"), L(" ("))
    what = (_when("purchase", F.concat(L("[ALPM] upgraded "), pkg, _s("id"), L("-1 -> "), _s("id"), L("-2)")))
            .when(C("event_type") == "signup", F.concat(L("[ALPM] installed "), pkg, _s("id"), L("-1)")))
            .when(C("event_type") == "view", L("[PACMAN] synchronizing package lists"))
            .otherwise(F.concat(L("[ALPM] removed "), pkg, _s("id"), L("-1)"))))
    return raw_lines(sample_events(spark, folder), F.concat(stamp, what))


_PACKAGES = rf"""{EV}, pl AS (SELECT id, concat('[', CASE WHEN event_type = 'error' THEN 'some day' ELSE
    strftime(ts, '%Y-%m-%dT%H:%M:%S+0200') END, '] ', CASE event_type
    WHEN 'purchase' THEN concat('[ALPM] upgraded pkg', user_id, ' (', id, '-1 -> ', id, '-2)')
    WHEN 'signup' THEN concat('[ALPM] installed pkg', user_id, ' (', id, '-1)')
    WHEN 'view' THEN '[PACMAN] synchronizing package lists'
    ELSE concat('[ALPM] removed pkg', user_id, ' (', id, '-1)') END) AS line FROM ev),
pm AS (SELECT id, line, regexp_extract(line, '^\[(.+?)\] \[ALPM\] (upgraded|installed|removed) (.+?) \((.+?)\)',
    ['t', 'action', 'name', 'v']) AS m FROM pl),
pe AS (SELECT id, epoch_us(try_strptime(m.t, '%Y-%m-%dT%H:%M:%S+0200')) - 7200000000 AS us, m.name AS name, m.action AS action,
    CASE WHEN m.action = 'upgraded' THEN split_part(m.v, ' -> ', 1) WHEN m.action = 'removed' THEN m.v END AS old_version,
    CASE WHEN m.action = 'upgraded' THEN split_part(m.v, ' -> ', 2) WHEN m.action = 'installed' THEN m.v END AS new_version
  FROM pm WHERE m.action <> '')
"""


@query(f"WITH {_PACKAGES} SELECT id, us AS ts_us, name, action, old_version, new_version FROM pe WHERE us IS NOT NULL")
def parse_package_log(spark, folder):
    return logs.parse_package_log(_packages(spark, folder)).select("id", us(), "name", "action", "old_version", "new_version")


@query(f"WITH {_PACKAGES} SELECT id, 'package_update' AS type, concat(name, ' ', action, ' (', "
       "concat_ws(' -> ', old_version, new_version), ')') AS summary FROM pe WHERE us IS NOT NULL")
def package_events(spark, folder):
    return logs.package_events(logs.parse_package_log(_packages(spark, folder))).select("id", "type", "summary")


def _containers(spark, folder):
    action = (_when("error", L("die web")).when(C("event_type") == "click", "exec_start web")
              .when(C("event_type") == "signup", "oom my app").when(C("event_type") == "view", "start db").otherwise("stop"))
    return raw_lines(sample_events(spark, folder), F.concat(L("  container "), action, L(" ")))


_CONTAINERS = f"""{EV}, c AS (SELECT id, regexp_split_to_array(trim(concat('  container ', CASE event_type WHEN 'error' THEN 'die web'
  WHEN 'click' THEN 'exec_start web' WHEN 'signup' THEN 'oom my app' WHEN 'view' THEN 'start db' ELSE 'stop' END, ' ')), '\\s+') AS p FROM ev),
ce AS (SELECT id, p[2] AS action, array_to_string(p[3:], ' ') AS container FROM c WHERE len(p) >= 3
  AND p[2] IN ('start', 'stop', 'die', 'kill', 'oom', 'restart', 'destroy'))"""


@query(f"WITH {_CONTAINERS} SELECT * FROM ce")
def parse_container_events(spark, folder):
    return tools.parse_container_events(_containers(spark, folder)).select("id", "action", "container")


@query(f"WITH {_CONTAINERS} SELECT id, CASE action WHEN 'die' THEN 'warning' WHEN 'oom' THEN 'critical' ELSE 'info' END AS severity, "
       "concat('container=', container, ' action=', action) AS raw_data, concat('docker: ', container, ' ', action) AS summary FROM ce")
def container_events(spark, folder):
    return tools.container_events(tools.parse_container_events(_containers(spark, folder))).select(
        "id", "severity", "raw_data", "summary")


@query(f"WITH {EV} SELECT id, concat('u', user_id) AS entity, event_type <> 'error' AS up FROM ev WHERE event_type <> 'view' "
       "UNION ALL SELECT id, '?', false FROM ev WHERE event_type <> 'view'")
def parse_peer_status(spark, folder):
    body = F.concat(L('{"Peer":{"a":{"HostName":"u'), _s("user_id"), L('","Online":'), _when("error", "false", "true"),
                    L('},"b":{"OS":"linux"}}}'))
    blobs = raw_blobs(sample_events(spark, folder), _when("view", L("not running"), body))
    return tools.parse_peer_status(blobs).select("id", "entity", "up")


@query(f"WITH {EV} SELECT id, CAST(user_id AS DOUBLE) AS gpu_temp, CAST(floor(value) AS DOUBLE) AS vram_used, "
       "CASE WHEN user_id > 0 THEN round(floor(value) / (user_id * 10) * 100, 6) ELSE 0 END AS gpu_vram_pct FROM ev "
       "WHERE event_type <> 'view'")
def parse_gpu_csv(spark, folder):
    line = F.concat_ws(", ", _s("user_id"), _n(C("value")), (C("user_id") * 10).cast("string"),
                       _when("view", L("[N/A]"), L("210.5")))
    return tools.parse_gpu_csv(raw_lines(sample_events(spark, folder), line)).select(
        "id", "gpu_temp", "vram_used", F.round("gpu_vram_pct", 6).alias("gpu_vram_pct"))


@query(f"WITH {EV} SELECT id, floor(value) + 0.25 AS avg10 FROM ev WHERE event_type <> 'view'")
def parse_pressure(spark, folder):
    some = F.concat(L("some avg10="), _n(C("value")), L(".25 avg60=0.00 avg300=0.00 total=1\n"))
    body = F.concat(_when("view", L(""), some), L("full avg10=9.99 avg60=0.00 total=1"))
    return tools.parse_pressure(raw_blobs(sample_events(spark, folder), body)).select("id", "avg10")


@query(f"WITH {EV} SELECT id, id * 10 AS io_ms FROM ev WHERE event_type NOT IN ('view', 'click')")
def parse_diskstats(spark, folder):
    line = F.concat(L(" 259  0 "), _when("view", L("sda"), L("nvme0n1")), L(" 1 2 3 4 5 6 7 8 9 "),
                    (C("id") * 10).cast("string"), _when("click", L(""), L(" 7")))
    return tools.parse_diskstats(raw_lines(sample_events(spark, folder), line)).select("id", "io_ms")


def _smart(spark, folder):
    body = F.concat(L("SMART\nAvailable Spare:   "), _n(C("value")), L("%\nAvailable Spare Threshold:  "), _s("user_id"), L("%\n"),
                    _when("error", F.concat(L("Media and Data Integrity Errors:  "), _s("id")), L("")))
    return raw_blobs(sample_events(spark, folder), _when("view", L("unavailable"), body))


@query(f"WITH {EV} SELECT id, CAST(CASE WHEN event_type = 'view' THEN 100 ELSE floor(value) END AS BIGINT) AS spare, "
       "CASE WHEN event_type = 'view' THEN 5 ELSE user_id END AS spare_threshold, CASE WHEN event_type = 'error' THEN id ELSE 0 END "
       "AS media_errors FROM ev")
def parse_smart(spark, folder):
    return tools.parse_smart(_smart(spark, folder)).select("id", "spare", "spare_threshold", "media_errors")


@query(f"WITH {EV} SELECT id, 'critical' AS severity FROM ev WHERE event_type <> 'view' AND floor(value) <= user_id")
def spare_alerts(spark, folder):
    return level_check(tools.parse_smart(_smart(spark, folder))).select("id", "severity")


@query(f"WITH {EV} SELECT id, '/dev/nvme0n1p2.write_io_errs' AS metric, CAST(floor(value) AS BIGINT) AS value FROM ev UNION ALL "
       "SELECT id, concat('/dev/sd', event_type, '.corruption_errs'), user_id FROM ev")
def parse_btrfs_stats(spark, folder):
    body = F.concat(L("[/dev/nvme0n1p2].write_io_errs    "), _n(C("value")), L("\n[/dev/sd"), "event_type",
                    L("].corruption_errs  "), _s("user_id"), L("\nno match here\n"))
    return tools.parse_btrfs_stats(raw_blobs(sample_events(spark, folder), body)).select("id", "metric", "value")


def _dumps(spark, folder):
    signal = F.when(C("value") > 50, "SIGSEGV").otherwise("SIGABRT")
    line = (_when("view", F.concat(L("Tue 2026-03-24 "), _s("user_id"), L(" no signal")))
            .when(C("event_type") == "click", F.concat(L("Tue "), _s("user_id"), L(" /usr/bin/x "), signal))
            .when(C("event_type") == "signup", F.concat(L("Tue "), _s("user_id"), L(" 1000 "), signal, L(" none")))
            .otherwise(F.concat(L("Tue 10:00:00 "), _s("user_id"), L(" 1000 "), signal, L(" present /usr/bin/"), "source")))
    return raw_lines(sample_events(spark, folder), line)


_DUMPS = f"""{EV}, d AS (SELECT id, host, us, user_id, CASE WHEN value > 50 THEN 'SIGSEGV' ELSE 'SIGABRT' END AS signal,
  CASE WHEN event_type <> 'signup' THEN concat('/usr/bin/', source) END AS exe FROM ev WHERE event_type NOT IN ('view', 'click'))"""


@query(f"WITH {_DUMPS} SELECT id, concat(user_id, '_', signal) AS dump_key, exe FROM d")
def parse_coredumps(spark, folder):
    return tools.parse_coredumps(_dumps(spark, folder)).select("id", "dump_key", "exe")


@query(f"WITH {_DUMPS}, k AS (SELECT *, row_number() OVER (PARTITION BY host, user_id, signal ORDER BY us, id) AS r FROM d) "
       "SELECT id, CASE WHEN signal = 'SIGSEGV' THEN 'critical' ELSE 'warning' END AS severity, concat('Crash: ', "
       "coalesce(split_part(exe, '/', 4), 'unknown'), ' (', signal, ')') AS summary FROM k WHERE r = 1")
def coredump_events(spark, folder):
    seen = change.first_seen(tools.parse_coredumps(_dumps(spark, folder)), ["host", "dump_key"], ["captured_at", "id"])
    return tools.coredump_events(seen).select("id", "severity", "summary")


@query(f"WITH {EV} SELECT id, concat('pkg', user_id) AS entity, CASE event_type WHEN 'error' THEN 'critical' WHEN 'signup' THEN "
       "'warning' ELSE 'info' END AS severity, concat('CVE: pkg', user_id, ' — ', event_type, '. more (', CASE event_type WHEN "
       "'error' THEN 'High' WHEN 'signup' THEN 'Medium' ELSE 'Unknown' END, ')') AS summary FROM ev WHERE event_type <> 'view'")
def audit_events(spark, folder):
    risk = _when("error", L("High")).when(C("event_type") == "signup", "Medium").otherwise("Unknown")
    line = F.concat(L(" pkg"), _s("user_id"), L(" is affected by "), "event_type", L(". more. "), risk,
                    _when("view", L(" risk?"), L(" risk!")))
    return tools.audit_events(tools.parse_audit(raw_lines(sample_events(spark, folder), line))).select(
        "id", "entity", "severity", "summary")


@query(f"WITH {EV} SELECT id, event_type AS entity FROM ev UNION ALL SELECT id, source FROM ev")
def parse_listing(spark, folder):
    body = F.concat("event_type", L(".x loaded failed\n\n   \n  "), "source", L(" y\n"))
    rows = tools.parse_listing(raw_blobs(sample_events(spark, folder), body), first_word=True)
    return rows.select("id", F.regexp_replace("entity", r"\.x$", "").alias("entity"))


@query(f"WITH {EV} SELECT id, CASE WHEN event_type = 'click' THEN 'temp1_input' ELSE source END AS label, "
       "floor(value * 1000) / 1000.0 AS value FROM ev WHERE event_type <> 'view'")
def parse_temps(spark, folder):
    e = sample_events(spark, folder)
    raw = e.select("id", L("nvme").alias("chip"), F.when(C("event_type") != "click", C("source")).alias("label"),
                   L("temp1_input").alias("file"), _when("view", L("n/a"), F.concat(L(" "), _n(C("value") * 1000), L("\n"))).alias("value"))
    return tools.parse_temps(raw).select("id", "label", "value")


def _snapshots(spark, folder):
    info = (_when("error", L("<snapshot><type>pre")).when(C("event_type") == "click", L(None).cast("string"))
            .when(C("event_type") == "signup", F.concat(L("<snapshot><description>"), "source", L("</description></snapshot>")))
            .otherwise(F.concat(L("<snapshot><type>post</type><description>"), "source", L("</description></snapshot>"))))
    return sample_events(spark, folder).select(
        "host", "ts", _when("view", F.concat(L("tmp"), _s("id")), _s("id")).alias("dir_name"), info.alias("info_xml"))


_SNAPSHOTS = f"""{EV}, sn AS (SELECT host, us, id AS number, CASE event_type WHEN 'signup' THEN 'single' WHEN 'purchase' THEN 'post'
  ELSE 'unknown' END AS snapshot_type, CASE WHEN event_type IN ('signup', 'purchase') THEN source ELSE '' END AS description
  FROM ev WHERE event_type <> 'view')"""


@query(f"WITH {_SNAPSHOTS} SELECT number, snapshot_type, description FROM sn")
def parse_snapshots(spark, folder):
    return tools.parse_snapshots(_snapshots(spark, folder)).select("number", "snapshot_type", "description")


@query(f"WITH {_SNAPSHOTS} SELECT host, number, snapshot_type FROM sn QUALIFY row_number() OVER (PARTITION BY host "
       "ORDER BY number DESC) <= 10")
def recent_snapshots(spark, folder):
    return tools.recent_snapshots(tools.parse_snapshots(_snapshots(spark, folder))).select("host", "number", "snapshot_type")


@query(f"WITH {_SNAPSHOTS} SELECT host, max(number) AS number, arg_max(snapshot_type, number) AS snapshot_type FROM sn GROUP BY host")
def latest_snapshot(spark, folder):
    return tools.latest_snapshot(tools.parse_snapshots(_snapshots(spark, folder))).select("host", "number", "snapshot_type")


@query(f"WITH {_SNAPSHOTS} SELECT host, us AS ts_us, concat('snapshot=', number, ' path=/.snapshots/', number) AS raw_data, "
       "concat('Snapshot #', number, ' created') AS summary FROM sn")
def snapshot_events(spark, folder):
    seen = change.first_seen(tools.parse_snapshots(_snapshots(spark, folder)), ["host", "number"], ["ts"])
    return tools.snapshot_events(seen).select("host", us(), "raw_data", "summary")


def _log(spark, folder):
    """The events as ring log lines, one session per day."""
    e = sample_events(spark, folder)
    days = e.select("id", F.to_date("ts").cast("string").alias("session"))
    return logs.log_line(e).join(days, "id").select("host", "session", C("id").alias("line_no"), "line")


_LOG = f"{EV}, ll AS (SELECT host, CAST(CAST(ts AS DATE) AS VARCHAR) AS session, id AS line_no, us, severity, source FROM ev)"


@query(f"WITH {_LOG} SELECT line_no, us AS ts_us, upper(severity) AS level, source AS log_source FROM ll")
def parse_log_lines(spark, folder):
    return logs.parse_log_lines(_log(spark, folder)).select("line_no", us(), "level", "log_source")


@query(f"WITH {_LOG} SELECT host, session, line_no FROM ll QUALIFY row_number() OVER (PARTITION BY host, session "
       "ORDER BY line_no DESC) <= 20")
def log_tail(spark, folder):
    return logs.log_tail(_log(spark, folder), 20).select("host", "session", "line_no")


@query(f"WITH {_LOG} SELECT host, session, line_no FROM ll QUALIFY row_number() OVER (PARTITION BY host "
       "ORDER BY session DESC, line_no DESC) <= 2000")
def retain_last_lines(spark, folder):
    return logs.retain_last_lines(_log(spark, folder), 500, 3).select("host", "session", "line_no")
