"""Parsers of collected text."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from opsweave.config import DedupParams
from opsweave.operators import change, series
from opsweave.plans import journal
from opsweave.sources import logs, tools

T0 = datetime(2026, 3, 26, 10, tzinfo=timezone.utc)


def lines(spark, *texts, name="line"):
    return spark.createDataFrame([("l", T0, i, t) for i, t in enumerate(texts)],
                                 f"host string, captured_at timestamp, id long, {name} string")


def got(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("id").collect()]


def entry(message, **fields):
    return json.dumps({"MESSAGE": message, **fields})


def test_journal(spark):
    raw = lines(
        spark, entry("disk error", PRIORITY="3", _SYSTEMD_UNIT="a.service", __REALTIME_TIMESTAMP="1774519200000000"),
        entry("", PRIORITY="0"), entry("kernel oops", PRIORITY="2", _TRANSPORT="kernel", _SYSTEMD_UNIT=""),
        entry("chatter", PRIORITY="4"), entry("no priority"), entry("own", PRIORITY="1", SYSLOG_IDENTIFIER="me"),
        entry("own", PRIORITY="1", _SYSTEMD_USER_UNIT="me.service"), entry("odd", PRIORITY="3"))
    kept = logs.journal_filter(raw, ["me.service"], ["me"])
    assert got(kept, "unit", "priority", "message") == [
        ("a.service", 3, "disk error"), ("kernel", 2, "kernel oops"), ("unknown", 3, "odd")]
    assert got(kept, "ts")[0][0] == datetime(2026, 3, 26, 10)
    assert got(logs.parse_journal(raw), "priority")[4] == (6,)
    events = logs.journal_events(kept)
    assert got(events, "severity", "summary", "raw_data")[0] == (
        "critical", None, "unit=a.service priority=3 msg=disk error")


def test_grace(spark):
    raw = spark.createDataFrame([(i, "l", T0 + timedelta(seconds=s), p) for i, (s, p) in enumerate(
        [(-1, 3), (0, 3), (5, 2), (9.9, 3), (10, 3)])], "id long, host string, ts timestamp, priority int")
    starts = spark.createDataFrame([("l", T0)], "host string, start_ts timestamp")
    assert got(logs.startup_grace(raw, starts), "id") == [(0,), (2,), (4,)]


def test_bulk_flush_keeps_all(spark):
    raw = spark.range(5000).select(
        "id", F.lit("l").alias("host"), F.lit(T0).alias("captured_at"),
        F.concat(F.lit('{"PRIORITY":"3","_SYSTEMD_UNIT":"test","MESSAGE":"error-'), "id", F.lit('"}')).alias("line"))
    assert journal.journal_to_events(raw, params=None).count() == 5000


@pytest.mark.parametrize("limited", [False, True])
def test_journal_to_events(spark, limited):
    raw = spark.range(100).select(
        "id", F.lit("l").alias("host"), F.lit(T0).alias("captured_at"),
        F.concat(F.lit('{"PRIORITY":"3","_SYSTEMD_UNIT":"t","MESSAGE":"app['), (F.col("id") + 10).cast("string"),
                 F.lit(']: failed"}')).alias("line"))
    assert journal.journal_to_events(raw, DedupParams(), rate_limited=limited).count() == 1


def test_package_log(spark):
    raw = lines(
        spark, "[2024-02-29T23:30:00-0130] [ALPM] upgraded tidy-core (0.9-3 -> 1:1.0rc2-1)",
        "[2024-03-01T01:00:00+0000] [ALPM] installed zz.fonts+extra (20240101-1)",
        "[2024-03-01T06:45:00+0545] [ALPM] removed old_tool (3-2)",
        "[2024-03-01T01:00:00+0000] [HOOK] upgraded nothing (1 -> 2)", "(no stamp) [ALPM] removed y (2)",
        "[soon] [ALPM] removed x (1)", "[2024-03-01T01:00:00+0000] [ALPM] upgraded half (7)")
    parsed = logs.parse_package_log(raw)
    assert got(parsed, "name", "action", "old_version", "new_version") == [
        ("tidy-core", "upgraded", "0.9-3", "1:1.0rc2-1"), ("zz.fonts+extra", "installed", None, "20240101-1"),
        ("old_tool", "removed", "3-2", None), ("half", "upgraded", "7", None)]
    assert {t for (t,) in got(parsed, "ts")} == {datetime(2024, 3, 1, 1)}
    assert got(logs.package_events(parsed), "summary") == [
        ("tidy-core upgraded (0.9-3 -> 1:1.0rc2-1)",), ("zz.fonts+extra installed (20240101-1)",), ("old_tool removed (3-2)",),
        ("half upgraded (7)",)]


def test_containers(spark):
    raw = lines(spark, "container die web", "container exec_start web", "container oom my app", "container die", "")
    assert got(tools.container_events(tools.parse_container_events(raw)), "action", "container", "severity") == [
        ("die", "web", "warning"), ("oom", "my app", "critical")]


def test_peers(spark):
    raw = lines(spark, '{"Peer":{"k1":{"HostName":"mac","Online":true},"k2":{"HostName":"pi"},"k3":{}}}', "no json", "{}",
                name="body")
    rows = tools.parse_peer_status(raw).orderBy("entity").collect()
    assert [(r["entity"], r["up"]) for r in rows] == [("?", False), ("mac", True), ("pi", False)]


def test_gpu(spark):
    raw = lines(spark, "71, 9000, 10000, 210.5", "71, 1, 0, 2", "71, 1, 2", "a, 1, 2, 3")
    assert got(tools.parse_gpu_csv(raw), "gpu_temp", "gpu_vram_pct", "power") == [(71.0, 90.0, 210.5), (71.0, 0.0, 2.0)]


def test_pressure_diskstats_smart(spark):
    psi = lines(spark, "some avg10=12.50 avg60=3.00 avg300=1.00 total=1\nfull avg10=99.0 total=2", "full avg10=1.0", name="body")
    assert got(tools.parse_pressure(psi), "avg10") == [(12.5,)]
    stats = lines(spark, " 259 0 nvme0n1 1 2 3 4 5 6 7 8 9 1234 11 12", "259 0 sda 1 2 3 4 5 6 7 8 9 10 11", "short")
    assert got(tools.parse_diskstats(stats), "io_ms") == [(1234,)]
    smart = lines(spark, "Available Spare:    3%\nAvailable Spare Threshold:  10%\nMedia and Data Integrity Errors: 7", "", name="body")
    parsed = tools.parse_smart(smart)
    assert got(parsed, "spare", "spare_threshold", "media_errors") == [(3, 10, 7), (100, 5, 0)]
    assert got(series.level_check(parsed), "spare") == [(3,)]


def test_btrfs(spark):
    raw = lines(spark, "[/dev/nvme0n1p2].write_io_errs    0\n[/dev/nvme0n1p2].corruption_errs   3", "none", name="body")
    assert sorted(got(tools.parse_btrfs_stats(raw), "metric", "value")) == [
        ("/dev/nvme0n1p2.corruption_errs", 3), ("/dev/nvme0n1p2.write_io_errs", 0)]


def test_coredumps(spark):
    raw = lines(spark, "Tue 2026-03-24 10:00:00 UTC 1234 1000 1000 SIGSEGV present /usr/bin/foo",
                "Tue 77 SIGABRT none", "Tue SIGABRT only", "Tue 77 /usr/bin/x SIGSEGV", "Tue /early 77 SIGBUS /a/b c/d")
    parsed = tools.parse_coredumps(raw)
    assert got(parsed, "dump_key", "exe") == [
        ("1234_SIGSEGV", "/usr/bin/foo"), ("77_SIGABRT", None), ("77_SIGBUS", "/a/b")]
    assert got(tools.coredump_events(parsed), "severity", "summary") == [
        ("critical", "Crash: foo (SIGSEGV)"), ("warning", "Crash: unknown (SIGABRT)"), ("critical", "Crash: b (SIGBUS)")]


def test_audit_listing_temps(spark):
    audit = lines(spark, " pam is affected by arbitrary code execution. High risk!", "x is fine",
                  "y is affected by a. b. Odd risk!")
    assert got(tools.audit_events(tools.parse_audit(audit)), "entity", "severity", "summary") == [
        ("pam", "critical", "CVE: pam — arbitrary code execution (High)"), ("y", "info", "CVE: y — a. b (Odd)")]
    listing = lines(spark, " a.service loaded failed\n\nb.service x\n", name="body")
    assert [r["entity"] for r in tools.parse_listing(listing, first_word=True).orderBy("pos").collect()] == ["a.service", "b.service"]
    temps = spark.createDataFrame([(0, "k10temp", "Tctl", "temp1_input", "71500"), (1, "nvme", None, "temp1_input", " 40000\n"),
                                   (2, "nvme", None, "temp2_input", "n/a")],
                                  "id int, chip string, label string, file string, value string")
    assert got(tools.parse_temps(temps), "chip", "label", "value") == [("k10temp", "Tctl", 71.5), ("nvme", "temp1_input", 40.0)]


@pytest.mark.parametrize("parse, pattern, groups", [(tools.parse_coredumps, tools.DUMP, 3), (tools.parse_coredumps, tools.SIGNAL_FIRST, 2),
                                                    (tools.parse_audit, tools.AUDIT, 3)])
def test_patterns_are_tried_once_a_group(spark, parse, pattern, groups):
    plan = parse(lines(spark, "a", None))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(pattern) == groups


def test_snapshots(spark):
    xml = "<snapshot><type>{}</type><description>{}</description></snapshot>"
    rows = [("9", xml.format("pre", "first")), ("10", "<snapshot><num>10</num></snapshot>"), ("100", None), ("11", "<broken"),
            ("tmp", xml.format("a", "b"))]
    raw = spark.createDataFrame([("l", T0 + timedelta(seconds=i), d, x) for i, (d, x) in enumerate(rows)],
                                "host string, ts timestamp, dir_name string, info_xml string")
    parsed = tools.parse_snapshots(raw)
    recent = tools.recent_snapshots(parsed, 10)
    assert [(r["number"], r["snapshot_type"], r["description"]) for r in recent.collect()] == [
        (100, "unknown", ""), (11, "unknown", ""), (10, "single", ""), (9, "pre", "first")]
    assert tools.latest_snapshot(parsed).first()["number"] == 100
    seen = tools.snapshot_events(change.first_seen(parsed, ["host", "number"], ["ts"]))
    assert seen.where("summary = 'Snapshot #100 created'").count() == 1


def test_readings(spark):
    df = spark.createDataFrame([("l", T0, 1.0, None)], "host string, ts timestamp, cpu_pct double, ram_pct double")
    assert [tuple(r) for r in series.samples_from_readings(df, ["host", "ts"], ["cpu_pct", "ram_pct"]).collect()] == [
        ("l", T0.replace(tzinfo=None), "cpu_pct", 1.0)]


def test_log_lines(spark):
    df = spark.createDataFrame([("l", "s", i, f"2026-03-26T10:00:00+00:00 INFO src{i} type=x y") for i in range(15)]
                               + [("l", "s", 15, "short")], "host string, session string, line_no long, line string")
    parsed = logs.parse_log_lines(df).orderBy("line_no").collect()
    assert (parsed[3]["log_source"], parsed[3]["level"], parsed[3]["message"]) == ("src3", "INFO", "type=x y")
    assert parsed[15]["log_source"] == "unknown"
    assert sorted(r["line_no"] for r in logs.log_tail(df, 3).collect()) == [13, 14, 15]
    assert logs.log_tail(df, 200).count() == 16
    assert sorted(r["line_no"] for r in logs.retain_last_lines(df, 2, 1).collect()) == [12, 13, 14, 15]
