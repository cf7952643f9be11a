import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from opsweave.operators import rates, timeline
from opsweave.operators.preferences import GAIN, LEFT, preferences

START = dt.datetime(2024, 1, 1)
ACTS = "id long, host string, pattern string, ts timestamp, user_action string"


def test_four_confirmations_give_two_thirds(spark):
    acts = spark.createDataFrame([(i, "h", "fd leak", START + dt.timedelta(seconds=i), "ignored") for i in range(6)], ACTS)
    after = [preferences(acts.where(F.col("id") < n), "2024-01-01 00:01:00").first()["confidence"] for n in (1, 4)]
    assert after == [pytest.approx(GAIN, abs=1e-4), pytest.approx(2 / 3, abs=1e-4)]
    six = preferences(acts, "2024-01-01 00:01:00").first()
    assert six["change"] and six["samples"] == 6 and six["preference"] == "ignored"


@pytest.mark.parametrize("width", [3600, 10 ** 6])
def test_preferences_are_those_of_one_walk(spark, monkeypatch, width):
    monkeypatch.setattr(timeline, "BUCKET_SECONDS", width)
    rng = random.Random(1)
    names = ("ignored", "restarted", "postponed", "applied")
    rows = [(i, rng.choice("ab"), "p", START + dt.timedelta(seconds=rng.randrange(400_000)), rng.choice(names[:3])) for i in range(300)]
    odd = [(900, "a", "p", None, "ignored"), (901, "a", "p", START, None), (902, "a", "p", START, "unknown"),
           (903, "a", "p", START + dt.timedelta(days=300), "applied"), (rows[0][0], *rows[0][1:])]
    as_of, half = START + dt.timedelta(days=20), 5.0
    got = {(r["host"], r["preference"]): r for r in preferences(spark.createDataFrame(rows + odd, ACTS), as_of, half).collect()}
    fade = math.log(2) / (half * 86400)
    for host in "ab":
        for name in names:
            c, n, last = 0.0, 0, None
            for i, h, _, ts, action in sorted([*rows, odd[-1]], key=lambda r: (r[3], r[0])):
                if h == host:
                    c *= math.exp(-fade * (ts - last).total_seconds()) if last else 1
                    c = c + GAIN * (1 - c) if action == name else LEFT * c
                    n, last = n + (action == name), ts
            if not n:
                assert (host, name) not in got
                continue
            r = got[host, name]
            assert r["confidence"] == pytest.approx(c * math.exp(-fade * (as_of - last).total_seconds())) and r["samples"] == n and r["last_updated"] == last
    assert preferences(spark.createDataFrame([], ACTS), as_of).collect() == []


EVENTS = "host string, ts timestamp, value double"


def test_windows_merge_upward(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", None]), START + dt.timedelta(seconds=rng.randrange(3 * 86400)), rng.random()) for _ in range(800)]
    df = spark.createDataFrame([*rows, ("a", None, 1.0)], EVENTS)
    for seconds in (60, 3600, 86400):
        want = {}
        for host, ts, _ in rows:
            start = START + dt.timedelta(seconds=(ts - START).total_seconds() // seconds * seconds)
            want[host, start] = want.get((host, start), 0) + 1
        got = {(r["host"], r["window"]): (r["n"], r["per_minute"]) for r in rates.rate_series(df, ["host"], seconds).collect()}
        assert got == {k: (n, n / (seconds / 60)) for k, n in want.items()}


def test_quantiles_are_within_the_promised_rank(spark):
    rng = random.Random(3)
    rows = [("a", START + dt.timedelta(seconds=i), rng.lognormvariate(0, 2)) for i in range(30_000)]
    rows += [("same", START + dt.timedelta(seconds=i), 7.0) for i in range(50)]
    rows += [("none", START, None), ("none", START, float("nan")), ("mixed", START, None), ("mixed", START, 3.0)]
    df, shares = spark.createDataFrame(rows, EVENTS), [0.01, 0.5, 0.99]
    found = rates.latency_series(df, ["host"], "value", shares)
    by_host = {r["host"]: r for r in found.collect()}
    assert (by_host["none"]["n"], by_host["none"]["measured"], by_host["none"]["q50"]) == (2, 0, None)
    assert (by_host["mixed"]["n"], by_host["mixed"]["measured"], by_host["mixed"]["q99"]) == (2, 1, 3.0)
    assert by_host["same"]["q1"] == by_host["same"]["q99"] == 7.0
    for r in rates.rank_errors(found, df, ["host"], "value", shares).collect():
        assert max(r["q1_error"], r["q50_error"], r["q99_error"]) <= rates.RANK_ERROR
    assert rates.latency_series(df.limit(0), ["host"], "value", shares).collect() == []
