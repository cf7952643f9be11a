import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsweave.config import RetentionParams
from opsweave.plans import versions

NOW = dt.datetime(2024, 6, 1, 12)
EVENTS = "id long, host string, ts timestamp, type string, severity string, source string, user_action string, raw_data string"


def event(i, days, kind="log_anomaly", action=None):
    return (i, "h", NOW - dt.timedelta(days=days, seconds=i), kind, "info", "s", action, f"r{i}")


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def count(spark, path):
    return versions.folders(spark, path).count()


def test_append_compact_and_read_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert versions.read(spark, path).count() == 0 and versions.latest(spark, path) == 0
    for b in range(3):
        rows = spark.createDataFrame([event(10 * b + i, days=i % 2) for i in range(4)], EVENTS)
        assert versions.append(rows, path, f"b{b}") == b + 1
    assert versions.append(spark.createDataFrame([event(20, 0), event(21, 1), event(29, 0)], EVENTS), path, "b2") == 4  # written again
    want = [0, 1, 2, 3, 10, 11, 12, 13, 20, 21, 29]
    assert ids(versions.read(spark, path)) == want and count(spark, path) == 6
    before = versions.read(spark, path)
    assert versions.compact(spark, path) == 6 and count(spark, path) == 2
    assert ids(versions.read(spark, path)) == want
    assert ids(before) == want, "a reader that began before reads on"
    assert ids(versions.read(spark, path, version=2)) == want[:8] and versions.compact(spark, path) == 0
    assert ids(versions.read(spark, path, since=NOW - dt.timedelta(hours=12))) == [0, 2, 10, 12, 20, 29]
    assert versions.vacuum(spark, path, keep=1) > 0 and ids(versions.read(spark, path)) == want
    assert versions.vacuum(spark, path, keep=1) == 0


def test_a_half_written_version_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.append(spark.createDataFrame([event(1, 0), event(2, 1)], EVENTS), path, "a")
    versions.append(spark.createDataFrame([event(3, 0)], EVENTS), path, "b")
    monkeypatch.setattr(versions, "_put", lambda *a: (_ for _ in ()).throw(OSError("stopped before the rename")))
    with pytest.raises(OSError):
        versions.compact(spark, path)
    monkeypatch.undo()
    assert ids(versions.read(spark, path)) == [1, 2, 3] and versions.latest(spark, path) == 2
    assert versions.compact(spark, path) == 2 and ids(versions.read(spark, path)) == [1, 2, 3]


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.append(spark.createDataFrame([event(1, 0)], EVENTS), path, "a")
    versions.append(spark.createDataFrame([event(2, 0)], EVENTS), path, "b")
    put, others = versions._put, []

    def late(session, source, target):
        if not others:  # another writer is first
            others.append(versions.append)
            versions.append(spark.createDataFrame([event(3, 0)], EVENTS), path, "c")
        return put(session, source, target)

    monkeypatch.setattr(versions, "_put", late)
    assert versions.compact(spark, path) == 2 and versions.latest(spark, path) == 4
    assert ids(versions.read(spark, path)) == [1, 2, 3]
    others.clear()

    def rival(session, source, target):
        if not others:
            others.append(1)
            versions.compact(spark, path)
        return put(session, source, target)

    monkeypatch.setattr(versions, "_put", rival)
    with pytest.raises(versions.Conflict):
        versions.compact(spark, path)
    assert ids(versions.read(spark, path)) == [1, 2, 3]


def test_ids_increase(spark, tmp_path):
    path = str(tmp_path / "t")
    bare = "host string, ts timestamp, type string, severity string, source string"
    for b in range(2):
        rows = [("h", NOW + dt.timedelta(seconds=100 * b + (i * 7) % 40), "snapshot", "info", "s") for i in range(40)]
        versions.append(spark.createDataFrame(rows, bare).repartition(5), path, f"b{b}")
    found = [(r["id"], r["ts"]) for r in versions.read(spark, path).orderBy("id").collect()]
    assert len({i for i, _ in found}) == 80 and [t for _, t in found] == sorted(t for _, t in found)


def test_updates_touch_only_their_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    for b in range(3):
        versions.append(spark.createDataFrame([event(10 * b + i, days=b) for i in range(5)], EVENTS), path, f"b{b}")
    log = spark.createDataFrame([(11, NOW, "first", None), (11, NOW + dt.timedelta(1), "second", None), (11, NOW, None, "applied"), (17, NOW, "none", None)],
                                "id long, updated_at timestamp, summary string, user_action string")
    before = {r["folder"] for r in versions.folders(spark, path).collect()}
    assert versions.fold_updates(spark, path, log) == 1
    assert len(before & {r["folder"] for r in versions.folders(spark, path).collect()}) == 2
    got = {r["id"]: (r["summary"], r["user_action"]) for r in versions.read(spark, path).collect()}
    assert got[11] == ("second", "applied") and len(got) == 15 and got[12] == (None, None)
    assert versions.fold_updates(spark, path, log.limit(0)) == 0
    assert versions.fold_updates(spark, path, log.where("id = 17")) == 0


def test_retention_reads_only_what_it_splits(spark, tmp_path, monkeypatch):
    path, params = str(tmp_path / "t"), RetentionParams(days=10, critical_days=100)
    rows = [event(1, 1), event(2, 20), event(3, 20, "service_fail"), event(4, 30), event(5, 30), event(6, 200, "service_fail"),
            event(7, 200), event(8, 50, "snapshot", "applied"), event(9, 10)]
    versions.append(spark.createDataFrame(rows, EVENTS), path, "a")
    read = []
    monkeypatch.setattr(versions, "_events", lambda s, p, names, f=versions._events: read.append(len(names)) or f(s, p, names))
    assert versions.retain(spark, path, NOW, params) == 6  # 2, 4, 5, 6, 7 and 9, which is ten days and nine seconds old
    assert read == [1], "of seven days one is split; whole days leave unread"
    assert ids(versions.read(spark, path)) == [1, 3, 8]
    assert versions.retain(spark, path, NOW, params) == 0
    none = str(tmp_path / "none")
    assert versions.retain(spark, none, NOW) == 0 and versions.compact(spark, none) == 0
    assert versions.read(spark, path).where(F.col("event_date").isNull()).count() == 0
