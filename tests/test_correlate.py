import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsweave.operators import correlate, timeline
from opsweave.operators.anomaly import embedding_anomalies

START = dt.datetime(2024, 3, 1)
EVENTS = "id long, host string, ts timestamp, type string"


def at(seconds):
    return None if seconds is None else START + dt.timedelta(seconds=seconds)


def events(seed, n=300, span=4000):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "b", None]), at(rng.randrange(span)), rng.choice(["x", "y", "z", "f"])) for i in range(n)]
    return rows + [(900, "a", None, "x"), (901, "a", None, "f"), (902, "a", rows[0][2], None), *rows[:3]]


@pytest.fixture(params=[7, 500, 10 ** 6])
def any_width(request, monkeypatch):
    monkeypatch.setattr(timeline, "BUCKET_SECONDS", request.param)


def test_kinds_before_are_those_of_all_pairs(spark, any_width):
    rows = events(1)
    df = spark.createDataFrame(rows, EVENTS)
    got = correlate.kinds_before(df.where("type = 'f'"), df, ["host"], "type", ["x", "y", "f"], 600)
    want = set()
    for i, host, ts, kind in rows:
        if kind != "f" or ts is None:
            continue
        for k in ("x", "y", "f"):
            near = [(t, j) for j, h, t, o in rows if o == k and h == host and t is not None
                    and ts - dt.timedelta(seconds=600) <= t and (t, j) < (ts, i)]
            if near:
                last = max(near)
                want.add((host, i, ts, k, len(near), last[1], last[0]))
    assert len(got.collect()) == len(want) and {tuple(r) for r in got.collect()} == want


def test_asof_join_is_the_nearest_earlier_row(spark, any_width):
    left, right = events(2), events(3)
    ldf = spark.createDataFrame(left, EVENTS).withColumn("prior_id", F.lit("kept")).withColumnRenamed("prior_id", "_us")
    got = correlate.asof_join(ldf, spark.createDataFrame(right, EVENTS), ["host"], ["id", "type"], within=90)
    want = []
    for i, host, ts, kind in left:
        near = [(t, j, o) for j, h, t, o in right if ts is not None and t is not None and h == host and t <= ts]
        best = max(near, key=lambda r: (r[0], r[1]), default=None)
        if best is not None and (ts - best[0]).total_seconds() > 90:
            best = None
        want.append((i, host, ts, kind, "kept", *(best or (None, None, None))))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_crashes_after_updates(spark):
    updates = spark.createDataFrame([(1, "h", at(0), "mesa", "graphics"), (2, "h", at(3600), "linux", "kernel"), (3, "h", at(7200), "mesa", "graphics"),
                                     (4, "g", at(0), "mesa", "graphics"), (5, "h", at(50), "vim", "other")],
                                    "id long, host string, ts timestamp, package string, grp string")
    crashes = spark.createDataFrame([(10, "h", at(7200)), (11, "h", at(7200 + 48 * 3600)), (12, "h", at(7200 + 48 * 3600 + 1)), (13, "g", at(0)),
                                     (14, "x", at(9)), (15, "h", None)], "id long, host string, ts timestamp")
    after = correlate.updates_before_crashes(crashes, updates, ["graphics", "kernel"])
    assert sorted((r["id"], r["grp"], r["update_id"], r["package"], r["hours"]) for r in after.collect()) == [
        (10, "graphics", 3, "mesa", 0.0), (10, "kernel", 2, "linux", 1.0), (11, "graphics", 3, "mesa", 48.0), (13, "graphics", 4, "mesa", 0.0)]
    seen = {(r["host"], r["grp"]): tuple(r)[2:] for r in correlate.update_suspects(after, crashes, updates).collect()}
    assert seen == {("h", "graphics"): (2, 1, 2, 0.0, 0.5), ("h", "kernel"): (1, 1, 1, 1.0, 0.25), ("g", "graphics"): (1, 1, 1, 0.0, 1.0)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], EVENTS)
    some = spark.createDataFrame(events(4, 5), EVENTS)
    assert correlate.kinds_before(some, none, ["host"], "type", ["x"], 60).collect() == []
    assert correlate.kinds_before(none, some, ["host"], "type", ["x"], 60).collect() == []
    joined = correlate.asof_join(some, none, ["host"], ["id"])
    assert joined.count() == some.count() and joined.where("prior_ts is not null").count() == 0
    assert embedding_anomalies(spark.createDataFrame([], "id long, host string, ts timestamp, embedding array<float>")).collect() == []


def anomalies_brute(rows, days=7, limit=1.2, cold_limit=1.5, least=5):
    day = {i: math.floor(ts.replace(tzinfo=dt.timezone.utc).timestamp() / 86400) for i, _, ts, _ in rows}
    out = {}
    for i, host, ts, v in rows:
        base = np.array([w for j, h, _, w in rows if h == host and day[i] - days <= day[j] < day[i]])
        age = min(days, day[i] - min(day[j] for j, h, *_ in rows if h == host))
        if len(base) < least:
            out[i] = (len(base), age < days, None, None, None)
            continue
        mean = base.mean(0)
        far, spread = np.linalg.norm(np.array(v) - mean), np.sqrt(((base - mean) ** 2).sum(1).mean())
        out[i] = (len(base), age < days, far, far / spread, far / spread > (cold_limit if age < days else limit))
    return out


def test_anomalies_by_definition(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "ab"[i % 2] if i % 11 else None, START + dt.timedelta(hours=5 * i), (rng.normal(size=6) * (3 if i % 17 == 0 else 1)).tolist())
            for i in range(120)]
    schema = "id long, host string, ts timestamp, embedding array<double>"
    odd = [(500, "a", None, [1.0] * 6), (501, "a", START, None), (502, "a", START, [float("nan")] * 6), (503, "a", START, [1.0]),
           (504, "a", START, [None] * 6)]
    df = spark.createDataFrame(rows + odd, schema).withColumns({"mean": F.lit(1), "day": F.lit(2), "spread": F.lit(3)})
    got = {r["id"]: r for r in embedding_anomalies(df).collect()}
    want = anomalies_brute(rows)
    assert got.keys() == want.keys() and sum(bool(w[4]) for w in want.values()) >= 3
    for i, (n, cold, far, ratio, anomaly) in want.items():
        r = got[i]
        assert (r["base_n"], r["cold"], r["anomaly"]) == (n, cold, anomaly)
        assert r["distance"] == (None if far is None else pytest.approx(far)) and r["ratio"] == (None if ratio is None else pytest.approx(ratio))


def test_equal_vectors_have_no_spread(spark):
    rows = [(i, "h", START + dt.timedelta(days=i // 6), [1.0, 2.0]) for i in range(18)] + [(99, "h", START + dt.timedelta(days=2), [1.0, 9.0])]
    got = {r["id"]: r for r in embedding_anomalies(spark.createDataFrame(rows, "id long, host string, ts timestamp, embedding array<double>")).collect()}
    assert got[13]["ratio"] == 0 and not got[13]["anomaly"] and got[99]["ratio"] == math.inf and got[99]["anomaly"]
