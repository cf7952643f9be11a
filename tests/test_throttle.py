"""Cooldown, repeat suppression and trends."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsweave.config import DedupParams, TrendParams
from opsweave.operators import rate_limit, series, throttle, timeline

T0 = datetime(2026, 3, 1, tzinfo=timezone.utc)


def rows(spark, seq):
    """(seconds, fingerprint, source) in order."""
    return spark.createDataFrame(
        [(i, "local", src, fp, T0 + timedelta(seconds=t)) for i, (t, fp, src) in enumerate(seq)],
        "id long, host string, source string, fingerprint string, ts timestamp")


def actions(df):
    return [(r["action"], r["suppressed_count"]) for r in df.orderBy("id").collect()]


def from_history(seq, p):
    """Each row's decision, worked out anew from all rows before it and from what they were decided."""
    cooldown, forget = min(p.window, p.baseline), 2 * p.baseline
    decided = []
    for i, (t, fp, src) in enumerate(seq):
        mates = [j for j in range(i) if seq[j][2] == src]
        ticks = []  # the rows of a source at which old fingerprints are forgotten
        for j in [*mates, i]:
            if not ticks or seq[j][0] - seq[ticks[-1]][0] >= forget:
                ticks.append(j)
        own = [j for j in mates if seq[j][1] == fp]
        # the rows of the fingerprint since it was last forgotten
        for k in range(len(own) - 1, -1, -1):
            later = own[k + 1] if k + 1 < len(own) else i
            if any(own[k] < c <= later and seq[own[k]][0] < seq[c][0] - forget for c in ticks):
                own = own[k + 1:]
                break
        emitted = [j for j in mates if decided[j][0] == "emit"]
        free = sum(seq[j][0] >= t - p.period for j in emitted) < p.max_per_period
        mine = [j for j in own if decided[j][0] == "emit"]
        if free and (not mine or t - seq[mine[-1]][0] >= cooldown):
            anchor = mine[-1] if mine else own[0] if own else i
            decided.append(("emit", sum(j > anchor for j in own) + (anchor < i)))
        else:
            decided.append(("suppress", 0))
    return decided


@pytest.mark.parametrize("params, seq, expected", [
    (DedupParams(window=60), [(0, "fp1", "s"), (0, "fp1", "s")], ["emit", "suppress"]),
    (DedupParams(window=10, baseline=300), [(0, "f", "s"), (5, "f", "s"), (15, "f", "s")], ["emit", "suppress", "emit"]),
    (DedupParams(max_per_period=3), [(0, f"fp{i}", "s") for i in range(4)], ["emit"] * 3 + ["suppress"]),
    (DedupParams(max_per_period=2), [(0, "a", "a"), (0, "b", "a"), (0, "c", "b")], ["emit"] * 3),
    (DedupParams(), [(0, "same", "s")] * 100, ["emit"] + ["suppress"] * 99),
])
def test_decisions(spark, params, seq, expected):
    assert [a for a, _ in actions(throttle.dedup_rate_limited(rows(spark, seq), params))] == expected


def test_repeats_are_reported(spark):
    seq = [(t, "f", "s") for t in [0, *range(1, 51), 61]]
    got = actions(throttle.dedup_decisions(rows(spark, seq), DedupParams(window=10, baseline=60)))
    assert got == from_history(seq, DedupParams(window=10, baseline=60, max_per_period=1000))
    assert got[-1] == ("emit", got[-1][1]) and got[-1][1] > 0


def test_pruned_fingerprint_starts_anew(spark):
    p = DedupParams(window=10, baseline=30)
    seq = [(0, "fp1", "s"), (1, "fp1", "s"), (62, "fp_new", "s"), (63, "fp1", "s")]
    assert actions(throttle.dedup_rate_limited(rows(spark, seq), p))[-1] == ("emit", 0)


def random_rows(seed, n=400, gap=8):
    rng, t, seq = random.Random(seed), 0, []
    for _ in range(n):
        t += rng.choice([0, 1, 2, gap, 3 * gap if rng.random() < 0.1 else 1])
        seq.append((t, f"f{rng.randrange(6)}", rng.choice(["hot", "hot", "cold"])))
    return seq


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("p", [DedupParams(20, 50, 3, 15), DedupParams(40, 10, 2, 30), DedupParams(5, 100, 50, 10)])
def test_rate_limited_matches_fold(spark, seed, p):
    seq = random_rows(seed)
    assert actions(throttle.dedup_rate_limited(rows(spark, seq), p)) == from_history(seq, p)


def test_rate_limited_over_buckets(spark, narrow_buckets):
    p, seq = DedupParams(20, 50, 3, 15), random_rows(3, n=150)
    assert actions(throttle.dedup_rate_limited(rows(spark, seq), p)) == from_history(seq, p)


def test_cooldown_of_even_cadence(spark):
    """A dense key whose phase never settles."""
    p = DedupParams(window=10, baseline=300, max_per_period=10 ** 6)
    seq = [(3 * i, "f", "s") for i in range(100)]
    assert actions(throttle.dedup_decisions(rows(spark, seq), p)) == from_history(seq, p)


def test_throttle_keeps_greedily(spark):
    df = rows(spark, [(t, "f", "s") for t in (0, 5, 9, 10, 19, 26)])
    kept = throttle.throttle(df, ["fingerprint"], 10)
    assert [r["id"] for r in kept.orderBy("id").collect()] == [0, 3, 5]


def samples(spark, values, step=60):
    return spark.createDataFrame(
        [("local", "m", T0 + timedelta(seconds=step * i), float(v)) for i, v in enumerate(values)],
        "host string, metric string, ts timestamp, value double")


def test_ema(spark):
    assert series.latest_ema(samples(spark, [100]), 0.5).first()["ema"] == 100
    assert abs(series.latest_ema(samples(spark, [50] * 200), 0.1).first()["ema"] - 50) < 1e-9


@pytest.mark.parametrize("values, direction", [([i for i in range(40)], "rising"), ([100 - i for i in range(40)], "falling")])
def test_trend_direction(spark, values, direction):
    alerts = series.trend_alerts(samples(spark, values), TrendParams(0.5, 20, 0), explicit=0.1).orderBy("ts").collect()
    assert alerts[-1]["direction"] == direction and alerts[-1]["value"] == values[-1]


def test_straight_line_reads_half_rate(spark):
    last = series.trend(samples(spark, range(60)), TrendParams(0.5, 20)).orderBy(F.desc("ts")).first()
    assert abs(last["slope"] - 60 * 10 / 19) < 0.01


def test_no_trend(spark):
    assert series.trend_alerts(samples(spark, [50] * 40), TrendParams(0.5, 20, 0), explicit=1.0).count() == 0
    assert series.trend_alerts(samples(spark, range(10)), TrendParams(0.5, 100, 0), explicit=0.1).count() == 0


def test_trend_cooldown(spark):
    assert series.trend_alerts(samples(spark, [5 * i for i in range(30)]), TrendParams(0.5, 10, 3600),
                               explicit=0.01).count() == 1


@pytest.mark.parametrize("alpha", [0, 1])
def test_alpha_bounds(alpha):
    with pytest.raises(ValueError):
        TrendParams(alpha=alpha)


def test_trend_passes_state_between_batches(spark):
    rng = random.Random(5)
    df = samples(spark, [rng.random() * 100 for _ in range(200)])
    def read():
        return [(r["ts"], r["value"], pytest.approx(r["ema"], rel=1e-12), r["slope"] and pytest.approx(r["slope"], rel=1e-9))
                for r in series.trend(df, TrendParams(0.3, 8)).orderBy("ts").collect()]

    whole = [(r["ts"], r["value"], r["ema"], r["slope"]) for r in series.trend(df, TrendParams(0.3, 8)).orderBy("ts").collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        assert read() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_debounce(spark):
    df = rows(spark, [(t, "f", "s") for t in (0, 0.1, 0.25, 1.0, 1.2)])
    fired = throttle.debounce(df, ["fingerprint"], 0.2).orderBy("ts").collect()
    assert [r["id"] for r in fired] == [2, 3, 4]


@pytest.mark.parametrize("times", ["even", "dense", "random", "bursts"])
@pytest.mark.parametrize("gap", [0, 9, 30, 331])
def test_one_hot_key_over_many_buckets(spark, monkeypatch, times, gap):
    """One key holds all rows; buckets of any width, and small Arrow batches, give the same as one plain walk."""
    rng = random.Random(gap)
    at = {"even": [3 * i for i in range(200)], "dense": [i // 4 for i in range(200)],
          "random": sorted(rng.randrange(3000) for _ in range(200)),
          "bursts": sorted(b + rng.randrange(20) for b in (0, 400, 401, 900, 2500) for _ in range(40))}[times]
    want, last, since = [], None, 0
    for i, t in enumerate(at):
        since += 1
        if last is None or t - last >= gap:
            want.append((i, 0 if last is None else since - 1))
            last, since = t, 1
    want = [(i, n if k == 0 else i - want[k - 1][0]) for k, (i, n) in enumerate(want)]
    df = rows(spark, [(t, "f", "s") for t in at])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        for width in (7, 100, 10 ** 6):
            monkeypatch.setattr(timeline, "BUCKET_SECONDS", width)
            got = throttle.cooldown_rows(df, ["host"], gap).orderBy("id").collect()
            assert [(r["id"], r["repeats"]) for r in got] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("warm", [0, 1, 20])
@pytest.mark.parametrize("kind", ["sparse", "at the limit", "bursts"])
def test_rate_limit_over_many_buckets(spark, monkeypatch, narrow_buckets, warm, kind):
    """Whatever the guesses at the ends of buckets, right, wrong or none at all, decisions are those of one walk."""
    rng = random.Random(warm)
    p = DedupParams(window=4, baseline=15, max_per_period=2, period=6)
    at = {"sparse": sorted(rng.randrange(700) for _ in range(120)), "at the limit": [i // 2 for i in range(160)],
          "bursts": sorted(b + rng.randrange(9) for b in (0, 30, 31, 90, 250) for _ in range(25))}[kind]
    seq = [(t, rng.choice("abcdefgh"), rng.choice("sst")) for t in at]
    monkeypatch.setattr(rate_limit, "WARM", warm)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert actions(throttle.dedup_rate_limited(rows(spark, seq), p)) == from_history(seq, p)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_source_is_worked_on_by_many_tasks(spark, monkeypatch):
    """A source with all rows: each bucket is walked by itself, and nothing is walked in order."""
    monkeypatch.setattr(timeline, "BUCKET_SECONDS", 600)
    walked = []

    def seen(df, name, write=rate_limit._written):
        out = write(df, name)
        walked.append((name, out.count()))
        return out

    monkeypatch.setattr(rate_limit, "_written", seen)
    rng = random.Random(2)
    p = DedupParams(window=20, baseline=60, max_per_period=5, period=20)
    seq = [(t, f"f{rng.randrange(40)}", "s") for t in sorted(rng.randrange(20_000) for _ in range(3000))]
    got = actions(throttle.dedup_rate_limited(rows(spark, seq), p))
    assert got == from_history(seq[:400], p) + got[400:] and 500 < sum(a == "emit" for a, _ in got) < 3000
    names = dict(walked)
    assert names["rate-starts"] == 34 and names["rate-decided"] == 3000
    assert names["rate-misled"] == 0 and "rate-in-order" not in names


def test_small_keys_are_folded_whole(spark, monkeypatch):
    df = rows(spark, [(90_000 * day, fp, "s") for fp in ("a", None) for day in range(5)]).withColumn("us", F.unix_micros("ts"))

    def run_lengths(part, state):
        n = len(part["us"])
        return None, {"n": np.full(n, n), "before": np.full(n, state or 0)}, (state or 0) + n

    def lengths():
        found = timeline.Timeline(df, ["host", "fingerprint"], ["us", "id"]).split_fold(
            run_lengths, "n long, before long", lambda part: len(part["us"]), lambda n, state: (state or 0) + n)
        return sorted(tuple(r) for r in found.select("id", "n", "before").collect())

    assert lengths() == [(i, 5, 0) for i in range(10)]  # not one run per day
    monkeypatch.setattr(timeline, "BUCKET_STEPS", 4)
    assert lengths() == [(i, 1, i % 5) for i in range(10)]


def test_the_trend_is_computed_once(spark):
    found = series.trend_alerts(samples(spark, [5 * i for i in range(30)]), TrendParams(0.5, 10, 3600), explicit=0.1)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 3  # those of the cooldown
