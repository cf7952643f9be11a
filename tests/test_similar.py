import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsweave.operators import similar as sim

SCHEMA = "id long, ts timestamp, embedding array<float>"
START = dt.datetime(2024, 1, 1)


def vectors(n, width=12, groups=6, seed=0, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    return (centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, width))).astype(np.float32).tolist()


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows, asked, k=3, past=False):
    """All similarities, rounded like the index's."""
    usable = [(i, t, np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float))) for i, t, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, tq, v in usable:
        if q not in asked:
            continue
        like = sorted((-round(float(v @ w), sim.DECIMALS), i) for i, t, w in usable
                      if len(w) == len(v) and i != q and (not past or t < tq))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(like[:k])]
    return sorted(out)


def found(df):
    return sorted((r["query"], r["rank"], r["id"], r["similarity"]) for r in df.collect())


def close(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-8)


@pytest.mark.parametrize("past", [False, True])
def test_exact_equals_all_pairs_with_hot_cells(spark, monkeypatch, past):
    monkeypatch.setattr(sim, "PART", 50)
    monkeypatch.setattr(sim, "QUERIES", 7)
    rows = [(i, START + dt.timedelta(seconds=(i * 7) % 600), v) for i, v in enumerate(vectors(600))]
    rows += [(1000 + i, START, rows[3][2]) for i in range(150)]  # copies: one cell holds many rows, ties go by id
    df = table(spark, rows)
    index = sim.build_index(df, at="ts", cells=12)
    assert max(index.parts) > 3
    asked = set(range(0, 600, 15))
    got = sim.similar(index, df.where(F.col("id").isin(asked)), at="ts" if past else None, probes=1, exact=True)
    close(found(got), brute(rows, asked, past=past))


def test_all_cells_probed_is_exact(spark):
    rows = [(i, START, v) for i, v in enumerate(vectors(200, seed=2))]
    df = table(spark, rows)
    got = sim.similar(sim.build_index(df, cells=9), df.where("id % 10 = 0"), k=5, probes=9)
    close(found(got), brute(rows, set(range(0, 200, 10)), k=5))


def test_recall_of_own_probes(spark):
    rows = [(i, START, v) for i, v in enumerate(vectors(2000, width=16, groups=25, seed=3, spread=0.4))]
    df = table(spark, rows)
    index = sim.build_index(df, cells=25)
    asked = set(range(0, 2000, 20))
    got = {(q, i) for q, _, i, _ in found(sim.similar(index, df.where("id % 20 = 0")))}
    want = {(q, i) for q, _, i, _ in brute(rows, asked)}
    assert index.probes < 25 and len(got & want) >= 0.9 * len(want)


def test_far_cells_are_not_searched(spark):
    """With well apart groups a query's further cells are ruled out by their radius."""
    rows = [(i, START, v) for i, v in enumerate(vectors(400, groups=8, seed=4, spread=0.01))]
    index = sim.build_index(table(spark, rows), cells=8)
    asked = sim.unit_vectors(table(spark, rows), "id", "embedding", None).selectExpr("id AS query", "at AS its_at", "vec", "0.99D AS floor")
    assert sim._probes(asked, index, 0, 8, True).count() == 400


def test_odd_rows(spark):
    good = vectors(30, width=4, seed=5)
    rows = [(i, START + dt.timedelta(seconds=i), v) for i, v in enumerate(good)]
    odd = [(None, START, good[0]), (50, START, None), (51, START, [0.0] * 4), (52, START, [float("nan")] + good[0][1:]),
           (53, START, [None] + good[0][1:]), (54, START, [float("inf")] * 4), (56, None, good[2]), (7, START, good[8])]
    df = table(spark, rows + odd).withColumns({n: F.lit(1) for n in ("cell", "part", "vec", "at", "query", "rank")})
    ids = set(range(60))
    usable = [r for r in rows + odd if r[0] is not None]
    got = found(sim.similar(sim.build_index(df, cells=4), df.where("id <> 7"), k=2, exact=True))
    close(got, brute(usable, ids - {7}, k=2))
    timed = found(sim.similar(sim.build_index(df, at="ts", cells=4), df.where("id = 20"), at="ts", exact=True))
    close(timed, brute(rows + [odd[-1]], {20}, past=True))
    empty = sim.build_index(df.limit(0))
    assert sim.similar(empty, df).collect() == [] and sim.similar(sim.build_index(df), df.limit(0), exact=True).collect() == []


def test_context(spark):
    events = spark.createDataFrame([(1, "disk full", "x", "applied"), (2, None, "raw text", None)],
                                   "id long, summary string, raw_data string, user_action string")
    similar = spark.createDataFrame([(9, 1, 2, 0.98765), (9, 2, 1, 0.5), (8, 1, 1, 1.0)], "query long, rank int, id long, similarity double")
    got = {r["query"]: (r["n"], r["context"]) for r in
           sim.past_context(similar, events, F.coalesce("summary", "raw_data")).collect()}
    assert got == {9: (2, "- [0.99] raw text\n- [0.50] disk full -> applied"), 8: (1, "- [1.00] disk full -> applied")}
