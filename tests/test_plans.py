"""Event queries, enrichment, reports, storage and streams."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from opsweave.config import DedupParams, RetentionParams, TrendParams
from opsweave.operators import events as ev
from opsweave.operators import series, throttle
from opsweave.plans import enrich, report, store
from opsweave.schemas import SYSTEM_EVENTS
from opsweave.sources.logs import log_line
from opsweave.sources.tables import scan_events
from opsweave.streaming import dedup, feeds

NOW = datetime(2026, 3, 26, 12, tzinfo=timezone.utc)
EVENT = "id long, host string, ts timestamp, type string, severity string, summary string, raw_data string, source string, user_action string"


def events(spark, *rows):
    """(days ago, type, severity, summary, raw, action) with defaults."""
    full = []
    for i, row in enumerate(rows):
        days, kind, sev, summary, raw, action = (*row, *(0, "disk_alert", "warning", None, "test data", None)[len(row):])
        full.append((i, "local", NOW - timedelta(days=days), kind, sev, summary, raw, "test", action))
    return spark.createDataFrame(full, EVENT)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_since_and_recent(spark):
    df = events(spark, (85,), (1,), (0,))
    assert ids(ev.events_since(df, "2026-03-01")) == [1, 2]
    assert ids(ev.recent_events(df, 2)) == [2, 1]
    assert ids(ev.events_since(df, "2020-01-01", limit=1)) == [0]
    mixed = events(spark, (0.3,), (0.2, "service_fail"), (0.1,))
    assert ids(ev.events_since(mixed, "2026-01-01", "disk_alert")) == [0, 2]
    assert {r["type"]: r["n"] for r in ev.count_by_type(mixed, "2026-01-01").collect()} == {"disk_alert": 2, "service_fail": 1}
    assert ids(ev.unanalyzed_since(events(spark, (1, "snapshot", "info", "done"), (0,)), "2026-01-01")) == [1]


def test_valid(spark):
    df = events(spark, (0, "INVALID_TYPE"), (0, "snapshot", "loud"), (0, "snapshot", "info", None, None))
    assert ids(ev.valid_events(df)) == [2] and ev.valid_events(df).first()["raw_data"] == ""
    assert sorted(r["reason"] for r in ev.rejected_events(df).collect()) == ["severity", "type"]


@pytest.mark.parametrize("row, kept", [
    ((60,), False), ((0,), True), ((60, "service_fail"), True), ((60, "disk_alert", "info", None, "r", "applied"), True),
    ((60, "disk_alert", "info", None, "r", "ignored"), False), ((400, "service_fail"), False), ((30,), True)])
def test_retention(spark, row, kept):
    assert ev.retention_keep(events(spark, row), NOW).count() == kept
    assert ev.retention_deleted(events(spark, row), NOW).first()["deleted"] == (not kept)


def test_updates(spark):
    df = events(spark, (0,), (0,))
    first = ev.action_update(df.where("id = 0"), F.lit("postponed"), F.lit(NOW))
    second = ev.action_update(df.where("id = 0"), F.lit("applied"), F.lit(NOW + timedelta(1)))
    named = ev.summary_update(df.where("id = 1"), F.lit("Some Text"), F.lit(NOW))
    got = (ev.apply_updates(df.withColumn("summary_hash", F.lit(None).cast("string")), first.union(second).union(named))
           .orderBy("id").collect())
    assert (got[0]["user_action"], got[0]["summary"]) == ("applied", None)
    assert (got[1]["user_action"], got[1]["summary"], len(got[1]["summary_hash"])) == (None, "Some Text", 16)


def test_enrichment(spark):
    df = events(spark, (0.003, "disk_alert", "warning", None, "disk controller reset"), (0.002, "snapshot", "info", None, "x msg=left over"),
                (0.001,))
    batched = enrich.in_batches(df, every_seconds=86400)
    answer = {"events": [{"id": 0, "summary": "first"}, {"id": 0, "summary": "Controller reset observed", "action": "Investigate"},
                         {"id": 99, "summary": "unknown"}, {"id": 2, "action": "ignore"}],
              "patterns": ["a", "b", "c", "d"], "overall": "disk controller issue"}
    answers = enrich.analyze(enrich.batch_prompts(batched), lambda p, s, t: json.dumps(answer))
    got = enrich.apply_enrichment(batched, answers).orderBy("id").collect()
    assert [(r["summary"], r["user_action"]) for r in got] == [
        ("Controller reset observed", "investigate"), ("left over", None), ("test data", None)]
    note = enrich.patterns_summary(answers).first()
    assert note["summary"] == "disk controller issue Patterns: a; b; c"
    for bad in (None, "no json", "{}"):
        answers = enrich.analyze(enrich.batch_prompts(batched), lambda p, s, t: bad)
        assert [r["summary"] for r in enrich.apply_enrichment(batched, answers).orderBy("id").collect()] == [
            "disk controller reset", "left over", "test data"]
        assert enrich.patterns_summary(answers).count() == 0

    def down(prompt, system, temperature):
        raise OSError("down")
    assert enrich.enrich(df, down).where("summary is null").count() == 0
    failed = enrich.analyze(enrich.batch_prompts(enrich.in_batches(df)), down)
    assert [tuple(r) for r in enrich.analyzer_failures(failed).collect()] == [("OSError: down", failed.count())]
    assert enrich.enrich(df, available=False).where("summary is null").count() == 3


def test_batches_are_bounded_and_whole(spark, narrow_buckets):
    df = events(spark, *[(0,)] * 123)
    prompts = enrich.batch_prompts(enrich.in_batches(df)).orderBy("batch").collect()
    assert [p["n"] for p in prompts] == [50, 50, 23]
    assert enrich.enrich(df).where("summary is not null").count() == 123


@pytest.mark.parametrize("response, ok", [
    ('{"type":"log_anomaly","severity":"info","summary":"x","action":"ignore"}', True),
    ('{"type":"log_anomaly","severity":"info"}', False), ("nope", False), ("[1]", False), (None, False)])
def test_classification(spark, response, ok):
    df = spark.createDataFrame([(response,)], "r string").select(enrich.parse_classification(F.col("r")).alias("c"))
    assert (df.first()["c"] is not None) is ok


def test_briefing(spark):
    df = events(spark, (0.3, "disk_alert", "info"), (0.2,), (0.1, "service_fail", "critical", "nginx down"), (5,))
    row = report.briefing(df, NOW).first()
    assert row["total"] == 3
    assert row["raw_data"].splitlines() == [
        "Total events: 3", "  disk_alert: 2", "  service_fail: 1", "", "Notable events:",
        "- [CRITICAL] service_fail: nginx down", "- [WARNING] disk_alert: test data", "- [INFO] disk_alert: test data"]
    assert row["summary"].splitlines() == [
        "Morning briefing (LLM unavailable — plain summary):", "Total events in last 24h: 3", "", "By severity:",
        "  critical: 1", "  warning: 1", "  info: 1", "", "By type:", "  disk_alert: 2", "  service_fail: 1", "",
        "Critical events requiring attention:", "  - service_fail: nginx down"]
    assert report.briefing(df, NOW, lambda p, s, t: "all fine").first()["summary"] == "all fine"
    assert report.briefing(df, NOW, lambda p, s, t: None).first()["summary"] == row["summary"]


def test_briefing_limits(spark):
    long = report.briefing(events(spark, *[(0.01 * i, "disk_alert", "info", "x" * 200) for i in range(90)]), NOW).first()["raw_data"]
    assert len(long) == 1200 and long.endswith("...")
    short = report.briefing(events(spark, *[(0.01 * i,) for i in range(30)]), NOW).first()["raw_data"].splitlines()
    assert len(short) == 16 and short[-1] == "  ... and 19 more events"
    hosts = spark.createDataFrame([("quiet",)], "host string")
    row = report.briefing(events(spark, (9,)), NOW, hosts=hosts).first()
    assert (row["raw_data"], row["summary"]) == (report.QUIET, report.QUIET_PLAIN)


def test_crash_report(spark):
    sessions = spark.createDataFrame([("l", "s0", NOW, "booted"), ("l", "s1", NOW + timedelta(1), "booted"),
                                      ("l", "s1", NOW + timedelta(2), "clean"), ("l", "s2", NOW + timedelta(3), "booted"),
                                      ("l", "s3", NOW + timedelta(4), "booted")],
                                     "host string, session string, ts timestamp, state string")
    lines = spark.createDataFrame([("l", "s0", i, f"2026-03-26T10:00:0{i} {x}") for i, x in enumerate(
        ["INFO journald normal operation", "CRITICAL journald OOM killed process chrome", "CRITICAL journald kernel panic"])],
        "host string, session string, line_no long, line string")
    got = report.crash_report(sessions, lines).orderBy("ts").collect()
    assert [r["session"] for r in got] == ["s1", "s3"]
    assert got[0]["analysis"] == ("Previous session crashed (3 log lines recovered). 2 CRITICAL events. OOM detected. "
                                  "kernel panic/segfault detected. last active source: journald")
    assert len(got[0]["pre_crash_log"]) == 3 and got[1]["analysis"] == report.NO_LOG


def test_store(spark, tmp_path):
    path = str(tmp_path / "events")
    df = events(spark, (60,), (60, "service_fail"), (61,), (400, "service_fail"), (0,))
    store.append_events(df, path, "one")
    store.append_events(df, path, "one")
    assert scan_events(spark, path).count() == 5
    assert "embedding" not in scan_events(spark, path).columns
    assert store.apply_retention(spark, path, NOW, RetentionParams()) == 3
    assert sorted(r["id"] for r in scan_events(spark, path).collect()) == [1, 4]
    assert store.apply_retention(spark, path, NOW, RetentionParams()) == 0
    pruned = ev.events_since(scan_events(spark, path), "2026-03-01")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in pruned


def test_log_line(spark, tmp_path):
    row = log_line(events(spark, (0, "snapshot", "critical", "x" * 5000))).first()["line"]
    assert row.startswith("2026-03-26T12:00:00.000000+00:00 CRITICAL test type=snapshot summary=xxx")
    assert row.endswith("x...") and len(row.split(" ", 3)[3]) == 2003
    store.write_log_lines(events(spark, (0,), (0,)), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2


def test_route(spark, tmp_path):
    seen = {}
    count = lambda name: lambda batch, batch_id: seen.__setitem__(name, batch.count())
    feeds.route(events(spark, (0,), (0,), (0, "snapshot")), 0, [(None, count("all")), ("snapshot", count("snap"))])
    assert seen == {"all": 3, "snap": 1}


def test_hooks(spark):
    calls = spark.sparkContext.accumulator(0)
    feeds.on_event(lambda row: calls.add(1))(events(spark, (0,), (0,)), 0)
    assert calls.value == 2
    changed = spark.sparkContext.accumulator(0)
    moves = spark.createDataFrame([("h", "healthy", "degraded"), ("h", "degraded", "critical")], "host string, old string, new string")
    feeds.on_status_change(lambda host, old, new: changed.add(1))(moves, 0)
    assert changed.value == 2


def test_stream_names_have_one_owner(spark, tmp_path):
    path = str(tmp_path / "events")
    feeds.store_sink(spark, path, "a", "checkpoint-1")(events(spark, (0,)), 0)
    feeds.store_sink(spark, path, "b", "checkpoint-2")(events(spark, (0,)), 0)
    feeds.store_sink(spark, path, "a", "checkpoint-1")
    with pytest.raises(ValueError):
        feeds.store_sink(spark, path, "a", "checkpoint-3")
    assert scan_events(spark, path).count() == 2


def test_days_do_not_depend_on_the_session(spark, tmp_path):
    path, zone = str(tmp_path / "events"), spark.conf.get("spark.sql.session.timeZone")
    late = spark.sql("SELECT 1L AS id, 'h' AS host, timestamp_micros(1774567800000000) AS ts, 'snapshot' AS type, "
                     "'info' AS severity, 's' AS source")  # 2026-03-26 23:30 UTC
    try:
        for name in ("America/New_York", "Asia/Tokyo", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", name)
            store.append_events(late, path, name[:2])
        for name in ("Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert ev.events_since(scan_events(spark, path), "2026-03-26 23:00:00").count() == 3
            assert ev.feed(late.withColumns({"summary": F.lit("x"), "raw_data": F.lit("y")})).first()["time"] == "23:30"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_equal_rows_are_told_apart(spark):
    two = spark.createDataFrame([("h", NOW, "log_anomaly", "j", "same")] * 3, "host string, ts timestamp, type string, source string, raw_data string")
    assert store.with_event_id(two).select("id").distinct().count() == 3


def test_status_of_a_quiet_host(spark, tmp_path):
    dedup.use_rocksdb(spark)
    df = spark.createDataFrame(
        [(1, "h", NOW, "critical"), (2, "k", NOW + timedelta(hours=1), "info"), (3, "h", NOW + timedelta(hours=5), "info")],
        "id long, host string, ts timestamp, severity string")
    out = run_stream(feeds.status_changes(stream_of(spark, df, tmp_path / "in")), "out", tmp_path)
    assert sorted((r["id"], r["old"], r["new"]) for r in out.collect()) == [(1, "healthy", "critical"), (3, "critical", "healthy")]


def stream_of(spark, df, folder, parts=3):
    """The rows as files in time order, read one per micro-batch."""
    rows = df.orderBy("ts", df.columns[0]).collect()
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size:(k + 1) * size], df.schema).coalesce(1).write.parquet(f"{folder}/p{k}")
    return (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
            .parquet(str(folder)))


def run_stream(df, name, tmp_path):
    q = (df.writeStream.format("parquet").option("path", str(tmp_path / name))
         .option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start())
    assert q.awaitTermination(240)
    return df.sparkSession.read.parquet(str(tmp_path / name))


def messages(spark):
    times = [0, 3, 5, 12, 13, 14, 26, 30, 31, 33, 47, 48, 80, 81, 200, 201]
    return spark.createDataFrame([(i, "l", "s", f"f{i % 3}", NOW + timedelta(seconds=t)) for i, t in enumerate(times)],
                                 "id long, host string, source string, fingerprint string, ts timestamp")


@pytest.mark.parametrize("limited", [False, True])
def test_dedup_stream_equals_batch(spark, tmp_path, limited):
    dedup.use_rocksdb(spark)
    p, df = DedupParams(window=10, baseline=15, max_per_period=2, period=8), messages(spark)
    stream = stream_of(spark, df, tmp_path / "in")
    if limited:
        batch = throttle.dedup_rate_limited(df, p).where("action = 'emit'")
        out = run_stream(dedup.dedup_rate_limited_stream(stream, p), "out", tmp_path)
    else:
        batch = throttle.dedup_by_fingerprint(df, p)
        out = run_stream(dedup.dedup_stream(stream, p), "out", tmp_path)
    key = lambda d: sorted((r["id"], r["suppressed_count"]) for r in d.collect())
    assert key(out) == key(batch) and len(key(out)) > 4


def test_stream_state_expires(spark, tmp_path):
    """A fingerprint unseen for longer than it is kept counts as first again, one still seen does not."""
    dedup.use_rocksdb(spark)
    times = [(0, "a"), (600, "b"), (3600 * 2, "b"), (3600 * 4, "b"), (3600 * 6, "b"), (3600 * 8, "a"), (3600 * 8 + 1, "b")]
    df = spark.createDataFrame([(i, "l", "s", fp, NOW + timedelta(seconds=t)) for i, (t, fp) in enumerate(times)],
                               "id long, host string, source string, fingerprint string, ts timestamp")
    out = run_stream(dedup.dedup_stream(stream_of(spark, df, tmp_path / "in", 7), DedupParams(), keep_hours=3, delay="1 second"),
                     "out", tmp_path)
    assert sorted((r["id"], r["suppressed_count"]) for r in out.collect()) == [
        (0, 0), (1, 0), (2, 1), (3, 1), (4, 1), (5, 0), (6, 1)]


def test_trend_stream_equals_batch(spark, tmp_path):
    dedup.use_rocksdb(spark)
    df = spark.createDataFrame([("l", "m", NOW + timedelta(minutes=i), float(i * i % 37)) for i in range(60)],
                               "host string, metric string, ts timestamp, value double")
    p = TrendParams(0.5, 8, 300)
    batch = series.trend_alerts(df, p, explicit=5.0)
    out = run_stream(dedup.trend_stream(stream_of(spark, df.select("host", "metric", "ts", "value"), tmp_path / "in"), p, 5.0),
                     "out", tmp_path)
    key = lambda d: sorted((r["ts"], r["slope"], r["direction"]) for r in d.collect())
    assert key(out) == key(batch) and len(key(out)) > 2


def test_missing_columns(spark):
    old = events(spark, (0,)).drop("user_action")
    assert ev.add_missing_columns(old, SYSTEM_EVENTS).columns == SYSTEM_EVENTS.fieldNames()
