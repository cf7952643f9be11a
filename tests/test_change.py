"""Change detection, latches, counters, rolling status; the stateful ones also segmented."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from opsweave.config import LevelParams
from opsweave.operators import change, series, status
from opsweave.operators import timeline
from opsweave.operators.timeline import Timeline

T0 = datetime(2026, 3, 1, tzinfo=timezone.utc)


def polls(spark, sets):
    ticks = spark.createDataFrame([("l", "s", i) for i in range(len(sets))], "host string, source string, tick int")
    ents = spark.createDataFrame([("l", "s", i, e) for i, s in enumerate(sets) for e in s],
                                 "host string, source string, tick int, entity string")
    return ents, ticks


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("sets, prime, expected", [
    ([["bt"], ["bt"], ["bt"]], False, [(0, "bt")]),
    ([["bt"], ["bt", "cups"]], False, [(0, "bt"), (1, "cups")]),
    ([["bt"], [], ["bt"]], False, [(0, "bt"), (2, "bt")]),
    ([["bt"], ["bt", "cups"]], True, [(1, "cups")]),
])
def test_new_entities(spark, sets, prime, expected):
    assert pairs(change.new_entities(*polls(spark, sets), prime=prime), "tick", "entity") == expected


def test_recovered(spark):
    assert pairs(change.recovered_entities(*polls(spark, [["a", "b"], ["a"], [], ["b"]])), "tick", "entity") == [(1, "b"), (2, "a")]


def test_failed_unit_text(spark):
    row = change.failed_unit_events(*polls(spark, [["bt.service"]])).first()
    assert (row["severity"], row["summary"], row["raw_data"]) == (
        "critical", "Service bt.service has failed", "unit=bt.service state=failed")


def states(spark, ticks):
    st = spark.createDataFrame([("l", "s", i, e, up) for i, t in enumerate(ticks) for e, up in t.items()],
                               "host string, source string, tick int, entity string, up boolean")
    return st, st.select("host", "source", "tick").distinct()


def test_transitions(spark):
    st, ticks = states(spark, [{"a": True, "b": False}, {"a": False, "b": True}, {"b": True}, {"a": True, "b": False}])
    assert pairs(change.state_transitions(st, ticks), "tick", "entity", "up") == [(1, "a", False), (1, "b", True), (3, "b", False)]
    assert pairs(change.state_transitions(st), "tick", "entity", "up") == [
        (1, "a", False), (1, "b", True), (3, "a", True), (3, "b", False)]
    assert pairs(change.peer_events(st, ticks), "tick", "severity", "summary")[0] == (1, "info", "tailscale: b online")
    assert pairs(change.service_down_events(st), "tick", "summary") == [(1, "a.service down"), (3, "b.service down")]


def test_first_seen(spark):
    df = spark.createDataFrame([("l", 0, "148"), ("l", 1, "148"), ("l", 2, "149")], "host string, tick int, key string")
    assert pairs(change.first_seen(df, ["host", "key"], ["tick"]), "tick", "key") == [(0, "148"), (2, "149")]
    assert pairs(change.first_seen(df, ["host", "key"], ["tick"], prime=True), "tick", "key") == [(2, "149")]
    assert pairs(change.accumulation_alert(df, "key", ["tick"], warn=2), "tick", "key") == [(2, "149")]
    assert change.accumulation_alert(df, "key", ["tick"], warn=3).count() == 0


def test_growth(spark):
    ents, ticks = polls(spark, [["a 1", "b 1"], ["a 1", "b 1", "c 2"], [], ["x 9"]])
    assert pairs(change.growth_alert(ents, ticks), "tick", "n", "added", "sample") == [(1, 3, 1, "a, b, c"), (3, 1, 1, "x")]


def test_kernel_and_reboot(spark):
    running = spark.createDataFrame([("l", t, v) for t, v in enumerate(["6.1", "6.1", "6.2"])], "host string, tick int, version string")
    installed = spark.createDataFrame([("l", 0, "6.1"), ("l", 1, "6.2"), ("l", 1, "6.0"), ("l", 2, "6.2")],
                                      "host string, tick int, version string")
    bad = change.kernel_mismatch(running, installed)
    assert pairs(bad, "tick", "mismatch") == [(1, "running=6.1 installed=6.0,6.2")]
    flags = running.select("host", "tick").join(bad, ["host", "tick"], "left").withColumn("sentinel", F.lit(False))
    assert pairs(change.reboot_events(flags), "tick", "raw_data") == [(1, "kernel_mismatch: running=6.1 installed=6.0,6.2")]


def test_edges(spark):
    df = spark.createDataFrame([("l", i, b) for i, b in enumerate([True, True, False, True, None, True])],
                               "host string, tick int, b boolean")
    assert pairs(change.edge_alerts(df, F.col("b"), ["host"], ["tick"]), "tick") == [(0,), (3,), (5,)]


def test_unclean(spark):
    df = spark.createDataFrame([("l", T0 + timedelta(hours=i), s) for i, s in enumerate(["booted", "clean", "booted", "booted"])],
                               "host string, ts timestamp, state string")
    assert [r["ts"] for r in change.unclean_sessions(df).collect()] == [(T0 + timedelta(hours=3)).replace(tzinfo=None)]


def metric(spark, values, name="m"):
    return spark.createDataFrame([("l", name, T0 + timedelta(seconds=30 * i), float(v)) for i, v in enumerate(values)],
                                 "host string, metric string, ts timestamp, value double")


def at(df, *extra):
    return sorted((int((r["ts"] - T0.replace(tzinfo=None)).total_seconds()) // 30, *[r[c] for c in extra]) for r in df.collect())


def test_pressure(spark):
    assert at(series.pressure_alerts(metric(spark, [10, 55, 60, 40, 52, 34, 51], "psi_cpu"))) == [(1,), (6,)]


def test_temperature(spark):
    df = metric(spark, [89, 90, 86, 91, 84, 101]).withColumns({"chip": F.lit("k10temp"), "label": F.lit("Tctl")})
    assert at(series.temperature_alerts(df), "severity", "summary") == [
        (1, "warning", "k10temp/Tctl at 90C"), (5, "critical", "k10temp/Tctl at 101C")]


DISK = [79, 85, 96, 97, 90, 96, 70, 96, 85]
DISK_ALERTS = [(1, "warning"), (2, "critical"), (5, "critical"), (7, "critical"), (8, "warning")]


def test_two_levels(spark):
    assert at(series.two_level_alerts(metric(spark, DISK), LevelParams()), "severity") == DISK_ALERTS


def test_two_levels_over_buckets(spark, narrow_buckets):
    assert at(series.two_level_alerts(metric(spark, DISK * 3), LevelParams()), "severity") == sorted(
        (t + 9 * k, s) for k in range(3) for t, s in DISK_ALERTS)


def test_counters(spark):
    df = metric(spark, [0, 0, 3, 3, 4], "/dev/nvme0.corruption_errs")
    assert at(series.storage_error_alerts(df), "severity", "summary") == [
        (2, "critical", "btrfs: 3 new corruption_errs"), (4, "critical", "btrfs: 1 new corruption_errs")]
    rate = series.counter_rate(metric(spark, [0, 30e6, 10e6])).orderBy("ts").collect()
    assert [r["rate"] for r in rate] == [None, 8.0, None]
    assert series.counter_util(metric(spark, [0, 15000])).orderBy("ts").collect()[1]["rate"] == 50.0


def test_processes(spark):
    gb = 1024 ** 3
    rows = [("l", 0, 1, "web", 11 * gb), ("l", 0, 2, "web", 12 * gb), ("l", 1, 2, "web", 13 * gb), ("l", 2, 2, "web", 9 * gb),
            ("l", 3, 2, "web", 11 * gb), ("l", 3, 9, "tiny", 1000)]
    df = spark.createDataFrame(rows, "host string, tick int, pid long, name string, rss long")
    alerts = series.top_process_alerts(df, df.select("host", "tick"))
    assert pairs(alerts, "tick", "pid", "summary") == [
        (0, 2, "web (PID 2) using 12.0 GB RAM"), (3, 2, "web (PID 2) using 11.0 GB RAM")]


def test_thresholds(spark):
    df = metric(spark, [1], "cpu_pct").unionByName(metric(spark, [1], "psi_io")).unionByName(metric(spark, [1], "other"))
    assert {r["metric"]: r["x"] for r in df.select("metric", series.slope_limit(F.col("metric")).alias("x")).collect()} == {
        "cpu_pct": 20.0, "psi_io": 10.0, "other": None}
    conf = spark.createDataFrame([("other", 7.0)], "metric string, threshold double")
    got = {r["metric"]: r["threshold"] for r in series.with_thresholds(df, conf).collect()}
    assert got == {"cpu_pct": None, "psi_io": None, "other": 7.0}
    assert {r["threshold"] for r in series.with_thresholds(df, conf, explicit=3).collect()} == {3.0}


def events(spark, seq):
    return spark.createDataFrame([(i, "l", T0 + timedelta(minutes=m), s) for i, (m, s) in enumerate(seq)],
                                 "id long, host string, ts timestamp, severity string")


@pytest.mark.parametrize("seq, expected", [
    ([(0, "warning")], ["degraded"]),
    ([(0, "warning"), (1, "critical")], ["degraded", "critical"]),
    ([(0, "critical"), (61, "info")], ["critical", "healthy"]),
    ([(0, "warning"), (60, "info")], ["degraded", "healthy"]),
    ([(0, "critical"), (30, "warning"), (60, "info")], ["critical", "critical", "degraded"]),
])
def test_status(spark, seq, expected):
    assert [r["status"] for r in status.rolling_status(events(spark, seq)).orderBy("id").collect()] == expected


def test_status_changes(spark):
    st = status.rolling_status(events(spark, [(0, "warning"), (1, "warning"), (2, "critical")]))
    assert [(r["old"], r["new"]) for r in status.status_transitions(st).orderBy("ts").collect()] == [
        ("healthy", "degraded"), ("degraded", "critical")]


def test_status_timeline(spark):
    got = status.status_timeline(events(spark, [(0, "warning"), (30, "critical"), (200, "warning")])).orderBy("start_ts").collect()
    mins = lambda t: None if t is None else int((t - T0.replace(tzinfo=None)).total_seconds()) // 60
    assert [(mins(r["start_ts"]), mins(r["end_ts"]), r["status"]) for r in got] == [
        (0, 30, "degraded"), (30, 90, "critical"), (90, 200, "healthy"), (200, 260, "degraded"), (260, None, "healthy")]


def random_events(spark, n=120):
    rng, m, seq = random.Random(9), 0, []
    for _ in range(n):
        m += rng.choice([1, 5, 40, 70])
        seq.append((m, rng.choice(["info", "info", "warning", "critical"])))
    return events(spark, seq)


def test_bucket_width_changes_nothing(spark, monkeypatch):
    """Every window primitive gives the same rows for one bucket as for many, hot key included."""
    df = random_events(spark).cache()
    def run():
        t = (Timeline(df, ["host"], ["ts", "id"]).index("n")
             .carry({"prev": F.col("id"), "crit": F.when(F.col("severity") == "critical", F.col("id"))}))
        back = Timeline(df, ["host"], ["ts", "id"]).index("n", reverse=True).carry({"next": F.col("id")}, reverse=True)
        return [sorted(map(str, x.collect())) for x in (
            t.df, back.df, status.rolling_status(df), status.status_timeline(df),
            status.status_transitions(status.rolling_status(df)))]
    monkeypatch.setattr(timeline, "BUCKET_SECONDS", 10 ** 9)
    whole = run()
    for seconds in (61, 600, 86_400):
        monkeypatch.setattr(timeline, "BUCKET_SECONDS", seconds)
        assert run() == whole


@pytest.mark.parametrize("reverse", [False, True])
def test_carry_leaves_small_keys_whole(spark, monkeypatch, reverse):
    data = [(key, None if day == 1 else T0 + timedelta(days=day), i, None if i % 3 else i)
            for key, days in (("a", 9), (None, 5), ("b", 2)) for i, day in enumerate(range(days))]
    df = spark.createDataFrame(data, "key string, ts timestamp, id int, value int")

    def found():
        rows = Timeline(df, ["key"], ["ts", "id"]).carry({"last": F.col("value")}, reverse=reverse).df
        return rows.columns, sorted(rows.collect(), key=str)

    def buckets():
        marked = timeline._marked(Timeline(df, ["key"], ["ts", "id"]))
        return {(r["key"], r["n"]) for r in marked.groupBy("key").agg(F.count_distinct(timeline.BUCKET).alias("n")).collect()}

    whole = found()
    assert buckets() == {("a", 0), (None, 0), ("b", 0)}  # not one per day
    monkeypatch.setattr(timeline, "BUCKET_STEPS", 4)
    assert buckets() == {("a", 8), (None, 4), ("b", 0)}
    assert found() == whole


def test_first_seen_with_prime_reads_its_rows_once(spark):
    data = [("l", None, "a"), ("l", 1, "a"), ("l", 2, "b"), ("m", 3, "c"), ("m", 4, "d"), ("m", 5, "d"), (None, 6, "e"), ("n", None, "f")]
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for pdf in frames:
            read.add(len(pdf))
            yield pdf

    df = spark.createDataFrame(data, "host string, tick int, key string").mapInPandas(counted, "host string, tick int, key string")
    found = change.first_seen(df, ["host", "key"], ["tick"], prime=True)
    assert pairs(found, "host", "tick", "key") == [("l", 2, "b"), ("m", 4, "d")]
    assert read.value == len(data)
    assert pairs(change.first_seen(df, ["key"], ["tick"], prime=True, scan=["host"]), "host", "tick", "key") == [("l", 2, "b"), ("m", 4, "d")]
