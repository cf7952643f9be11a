import math
import random

import numpy as np
import pytest

from opsweave.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, entries, rounds):
    """Codes, errors and codebooks by comparing every part with every entry, in whole numbers."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    cuts = [width * p // 4 for p in range(5)]
    books = [[v[a:b] for _, v, _ in kept[:entries]] for a, b in zip(cuts, cuts[1:])]

    def near(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(books[p], v[a:b])[1], []).append(v[a:b])
            for e, some in groups.items():
                books[p][e] = [sum(c) // len(c) for c in zip(*some)]
    out = []
    for i, v, label in kept:
        found = [near(books[p], v[a:b]) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    totals = {}
    for *_, error, label in out:
        totals[label] = totals.get(label, 0) + error
    return sorted(((i, c, e, totals[label]) for i, c, e, label in out), key=repr), books


def compare(spark, rows, entries=8, rounds=3):
    got, books = vc.compress(spark.createDataFrame(rows, SCHEMA), entries=entries, rounds=rounds)
    want, want_books = brute(rows, entries, rounds)
    assert books == want_books
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert got.columns == ["vec_id", "code", "error", "label_error"]


def vectors(n, width=8, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    return rng.normal(0, spread, (n, width)).astype(np.float32).tolist()


def test_equals_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vc, "BLOCK", 37)
    compare(spark, [(i, v, i % 3) for i, v in enumerate(vectors(300))])


def test_ties_copies_and_hot_label(spark):
    rng = random.Random(1)
    grid = [[float(rng.choice([-1, 0, 1])) for _ in range(8)] for _ in range(120)]
    compare(spark, [(i, v, None if i % 2 else 7) for i, v in enumerate(grid + [grid[0]] * 80)], entries=16)


def test_odd_rows(spark):
    v = vectors(40)
    rows = [(i, x, 1) for i, x in enumerate(v)] + [
        (None, v[3], None), (5, v[9], 2), (5, v[5], 2), (90, None, 1), (91, v[0][:7] + [None], 1), (92, v[0][:7] + [float("nan")], 1),
        (93, v[0][:7] + [float("-inf")], 1), (94, v[0][:5], 1), (95, [], 1), (96, [3e7] * 8, 3), (97, [-2e9] * 8, 3)]
    compare(spark, rows)
    compare(spark, [(i, x[:6], None) for i, x in enumerate(v)])  # a width that four does not divide
    compare(spark, [(1, [], 1), (2, [], 1)])
    got, books = vc.compress(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and vc.digest(books) == vc.digest([[], [], [], []])
    got, _ = vc.compress(spark.createDataFrame([(1, [1e38] * 4, 1), (2, [-1e38] * 4, 1)], SCHEMA), entries=1, rounds=0)
    assert {r["error"] for r in got.collect()} == {0, 2 ** 63 - 1}


def test_clashing_columns(spark):
    rows = [(i, v, i % 3) for i, v in enumerate(vectors(30))]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "v", "its", "parts", "entry", "error", "code"):
        df = df.withColumn(name, df["label"])
    plain, _ = vc.compress(spark.createDataFrame(rows, SCHEMA), entries=4)
    assert sorted(vc.compress(df, entries=4)[0].collect()) == sorted(plain.collect())


@pytest.mark.parametrize("seed", range(4))
def test_tree_holds_its_points_and_prunes(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-4000, 4000, (20, 4))
    points = (centres[rng.integers(0, 20, 3000)] + rng.integers(-30, 30, (3000, 4))).astype(float)
    tree = vc.grow(points)
    assert sorted(tree.order.tolist()) == list(range(3000))
    for n in range(len(tree.start)):
        some = points[tree.order[tree.start[n]:tree.stop[n]]]
        assert np.array_equal(tree.total[n], some.sum(0))
        assert np.sqrt(((some - tree.pivot[n]) ** 2).sum(1)).max() <= tree.radius[n]
        if tree.left[n] >= 0:
            assert {tree.start[tree.left[n]], tree.start[tree.right[n]]} >= {tree.start[n]}
            assert tree.stop[n] - tree.start[n] == sum(tree.stop[c] - tree.start[c] for c in (tree.left[n], tree.right[n]))
    book = centres.astype(float)
    owner, count, sums = vc.assign(tree, book)
    want = vc.squared(points, book).argmin(1)
    assert np.array_equal(owner, want) and np.array_equal(count, np.bincount(want, minlength=20))
    assert all(np.array_equal(sums[e], points[want == e].sum(0)) for e in range(20))
