"""Vector code compression: product codes from codebooks that exact k-means rounds improve.

Rows are dealt to blocks; every block has one metric tree per part position, built once from
the middle out (anchors hierarchy) and written to the shared folder. Balls cache the number
and sum of their points. A round sends the codebooks to the trees: a ball inherits the list
of candidate entries from its parent, strikes out those that another entry beats on the whole
ball, and, once a single one is left, is counted for it as a whole. What leaves a task are
sums per entry, so the driver sees one row per entry and part, whatever the size of the table.
"""

from __future__ import annotations

import ast
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsweave.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors in a block: bounds the memory of a task and the depth of a tree.
BLOCK = 4096
#: Points of a ball that is not split further.
LEAF = 48
LARGEST = 2 ** 63 - 1


def exact(width: int) -> int:
    """Components up to this size have exact squared distances in doubles."""
    return math.isqrt(2 ** 50 // max(1, width))


@dataclass
class Tree:
    """A metric tree over the rows of `points`: balls in order of depth, children after their parent.

    A ball's points are order[start:stop]; `pivot` is its centre, `radius` at least the distance of
    any of its points from it (rounded up), `total` the sum of its points, `left` and `right` its
    children or -1.
    """

    points: np.ndarray
    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    total: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between rows of integers in doubles, whole numbers up to `exact`."""
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]


def anchors(points: np.ndarray, rows: np.ndarray, count: int) -> list[np.ndarray]:
    """Rows dealt to the nearest of up to `count` anchors.

    Each anchor keeps its rows by falling distance. A new anchor is the point farthest from the
    anchor with the widest ball; it takes rows that are nearer to it, and looks in each ball only at
    rows farther than half the distance between the two anchors, as nearer ones cannot change.
    """
    def dist(i: int, which: np.ndarray) -> np.ndarray:
        return np.sqrt(((points[which] - points[i]) ** 2).sum(1))

    first = int(rows[0])
    d = dist(first, rows)
    by = np.argsort(-d, kind="stable")
    balls = [(first, rows[by], d[by])]
    while len(balls) < count:
        widest = max(range(len(balls)), key=lambda k: balls[k][2][0])
        if balls[widest][2][0] == 0:
            break  # every row is an anchor's copy
        new = int(balls[widest][1][0])
        stolen, stolen_d = [], []
        for k, (centre, own, away) in enumerate(balls):
            gap = math.sqrt(((points[new] - points[centre]) ** 2).sum())
            reach = int(np.searchsorted(-away, -gap / 2 * (1 - 1e-9), side="right"))
            if not reach:
                continue
            to_new = dist(new, own[:reach])
            take = to_new < away[:reach]
            if take.any():
                stolen.append(own[:reach][take])
                stolen_d.append(to_new[take])
                keep = np.concatenate([~take, np.ones(len(own) - reach, dtype=bool)])
                balls[k] = (centre, own[keep], away[keep])
        got, got_d = np.concatenate(stolen), np.concatenate(stolen_d)
        by = np.argsort(-got_d, kind="stable")
        balls.append((new, got[by], got_d[by]))
    return [own for _, own, _ in balls]


def grow(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """A tree from the middle out: about root-of-n anchors are joined pairwise up to one root, always the
    two whose common ball is smallest; each anchor's rows become a tree by the same rule below."""
    nodes: list[dict] = []

    def ball(rows: np.ndarray, left: int = -1, right: int = -1) -> int:
        some = points[rows]
        pivot = some.mean(0)
        nodes.append({"rows": rows, "left": left, "right": right, "pivot": pivot, "total": some.sum(0),
                      "radius": math.sqrt(((some - pivot) ** 2).sum(1).max())})
        return len(nodes) - 1

    def build(rows: np.ndarray) -> int:
        if len(rows) <= leaf:
            return ball(rows)
        groups = anchors(points, rows, max(2, math.isqrt(len(rows) // leaf) + 1))
        if len(groups) == 1:
            return ball(rows)
        tops = [build(g) for g in groups]
        width = {}

        def common(a: int, b: int) -> float:
            x, y = nodes[a], nodes[b]
            gap = math.sqrt(((x["pivot"] - y["pivot"]) ** 2).sum())
            return max(x["radius"], y["radius"], (gap + x["radius"] + y["radius"]) / 2)

        for i, a in enumerate(tops):
            for b in tops[i + 1:]:
                width[a, b] = common(a, b)
        while len(tops) > 1:
            a, b = min(width, key=lambda k: (width[k], k))
            new = ball(np.concatenate([nodes[a]["rows"], nodes[b]["rows"]]), a, b)
            tops = [t for t in tops if t not in (a, b)]
            width = {k: w for k, w in width.items() if a not in k and b not in k} | {(t, new): common(t, new) for t in tops}
            tops.append(new)
        return tops[0]

    root = build(np.arange(len(points)))
    rank, order, place = [root], [], {}
    for n in rank:  # breadth first
        rank.extend(c for c in (nodes[n]["left"], nodes[n]["right"]) if c >= 0)

    def lay(top: int) -> None:
        todo = [(top, False)]
        while todo:
            n, done = todo.pop()
            if done:
                place[n] = (place[n], len(order))
                continue
            place[n] = len(order)
            todo.append((n, True))
            if nodes[n]["left"] < 0:
                order.extend(nodes[n]["rows"].tolist())
            else:
                todo += [(nodes[n]["right"], False), (nodes[n]["left"], False)]
    lay(root)
    at = {n: i for i, n in enumerate(rank)} | {-1: -1}

    def get(name: str) -> list:
        return [nodes[n][name] for n in rank]

    return Tree(points, np.array(order, dtype=np.int32), np.array([place[n][0] for n in rank], dtype=np.int32),
                np.array([place[n][1] for n in rank], dtype=np.int32), np.array([at[x] for x in get("left")], dtype=np.int32),
                np.array([at[x] for x in get("right")], dtype=np.int32), np.array(get("pivot")),
                np.array(get("radius")) * (1 + 1e-9) + 1e-6, np.array(get("total")))


def assign(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each point, number of points per entry, their sums per entry): nearest entry, ties to the lower index.

    Depth by depth: a ball's candidates are its parent's without those that are farther than the
    candidate nearest to the pivot from every point of the ball: for e against the nearest c the
    difference of squared distances is at least that at the pivot less 2 radius |e - c|.
    """
    k = len(book)
    owner = np.zeros(len(tree.points), dtype=np.int64)
    count, sums = np.zeros(k, dtype=np.int64), np.zeros((k, tree.points.shape[1]))
    gaps = np.sqrt(np.maximum(squared(book, book), 0))
    level, listed = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
    while len(level):
        far = np.where(listed, squared(tree.pivot[level], book), np.inf)
        best = far.argmin(1)
        least = far[np.arange(len(level)), best]
        slack = 1e-6 + 1e-9 * np.abs(least)  # more than rounding: what is struck out is beaten beyond doubt
        listed = listed & (far - least[:, None] <= 2 * tree.radius[level][:, None] * gaps[best] + slack[:, None])
        owned = listed.sum(1) == 1
        for n, e in zip(level[owned], best[owned]):
            owner[tree.order[tree.start[n]:tree.stop[n]]] = e
        np.add.at(count, best[owned], (tree.stop - tree.start)[level[owned]])
        np.add.at(sums, best[owned], tree.total[level[owned]])
        leaf = ~owned & (tree.left[level] < 0)
        for n, names in zip(level[leaf], listed[leaf]):
            rows, some = tree.order[tree.start[n]:tree.stop[n]], np.flatnonzero(names)
            near = some[squared(tree.points[rows], book[some]).argmin(1)]
            owner[rows] = near
            np.add.at(count, near, 1)
            np.add.at(sums, near, tree.points[rows])
        split = ~owned & ~leaf
        level, listed = np.concatenate([tree.left[level[split]], tree.right[level[split]]]), np.concatenate([listed[split]] * 2)
    return owner, count, sums


def assign_wide(points: list[list[int]], book: list[list[int]]) -> list[tuple[int, int]]:
    """(entry, squared distance) per point in whole numbers of any size: for parts with components beyond `exact`."""
    return [min((sum((a - b) ** 2 for a, b in zip(p, c)), e) for e, c in enumerate(book))[::-1] for p in points]


ARRAYS = {"order": "<i4", "start": "<i4", "stop": "<i4", "left": "<i4", "right": "<i4", "pivot": "<f8", "radius": "<f8",
          "total": "<f8", "points": "<i4"}
Book = list[list[int]]


def packed(part: list[list[int]], width: int) -> dict:
    """A block's part with its tree, as bytes; without a tree where numbers are beyond doubles."""
    if not width or any(not -exact(width) <= x <= exact(width) for v in part for x in v):
        return dict.fromkeys(ARRAYS, b"") | {"width": width, "points": repr(part).encode()}
    tree = grow(np.array(part, dtype=float))
    return {a: np.ascontiguousarray(getattr(tree, a)).astype(t).tobytes() for a, t in ARRAYS.items()} | {"width": width}


def nearest(part: dict, book: Book) -> tuple[list[int], list[int] | None, dict[int, tuple[int, list[int]]]]:
    """(entry per point, squared distance per point, points and their sum per used entry) of a packed part."""
    width = part["width"]
    limit = exact(width)
    plain = bool(part["order"])
    if plain:
        found = {a: np.frombuffer(part[a], dtype=t) for a, t in ARRAYS.items()}
        found["points"] = found["points"].astype(float)
        tree = Tree(**{a: v.reshape(-1, width) if a in ("pivot", "total", "points") else v for a, v in found.items()})
    if plain and all(-limit <= x <= limit for c in book for x in c):
        centres = np.array(book, dtype=float)
        owner, count, sums = assign(tree, centres)
        error = ((tree.points - centres[owner]) ** 2).sum(1).astype(np.int64)
        return owner.tolist(), error.tolist(), {e: (int(count[e]), [int(x) for x in sums[e]]) for e in np.flatnonzero(count).tolist()}
    points = tree.points.astype(np.int64).tolist() if plain else ast.literal_eval(part["points"].decode())
    both, used = assign_wide(points, book), {}
    for (e, _), p in zip(both, points):
        n, total = used.get(e, (0, [0] * width))
        used[e] = (n + 1, [a + b for a, b in zip(total, p)])
    return [e for e, _ in both], [d for _, d in both], used


def borders(width: int) -> list[int]:
    """Where parts begin and end: equal parts where the width can be divided, else as equal as can be."""
    return [width * p // PARTS for p in range(PARTS + 1)]


def kept_vectors(vectors: DataFrame, key: str, vector: str, label: str | None) -> DataFrame:
    """(id, label, v): components as floor(1024 x); rows without a vector, or with a null, NaN or infinite component, go."""
    inf = float("inf")
    rows = vectors.select(F.col(key).alias("id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"),
                          F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    fine = F.forall("v", lambda x: F.coalesce((x > -inf) & (x < inf), F.lit(False)))  # NaN is above all numbers
    return rows.where(fine).withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE)))


def smallest(rows: DataFrame, entries: int) -> Book:
    got = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()  # entries, a parameter
    return [list(r["v"]) for r in got]


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """One row per block of at most BLOCK vectors: their keys and labels as texts, and each part with its tree."""
    cuts, size = borders(width), BLOCK

    def flush(some: list[tuple]) -> pd.DataFrame:
        parts = [packed([list(v[lo:hi]) for _, _, v in some], hi - lo) for lo, hi in zip(cuts, cuts[1:])]
        return pd.DataFrame({"ids": [[i for i, _, _ in some]], "labels": [[x for _, x, _ in some]], "parts": [parts]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in frames:
            held += [(i, x, v.tolist()) for i, x, v in zip(pdf["id"], pdf["label"], pdf["v"])]
            while len(held) >= size:
                yield flush(held[:size])
                held = held[size:]
        if held:
            yield flush(held)

    return (rows.select(F.col("id").cast("string").alias("id"), F.col("label").cast("string").alias("label"), "v")
            .mapInPandas(run, "ids array<string>, labels array<string>, parts array<struct<"
                         + ", ".join(f"{a}: binary" for a in ARRAYS) + ", width: int>>"))


def round_sums(trees: DataFrame, books: list[Book]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (points, sum of points): sums of a task first, then of all tasks."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for pdf in frames:
            for parts in pdf["parts"]:
                for p, part in enumerate(parts):
                    for e, (n, total) in nearest(part, books[p])[2].items():
                        had, old = found.get((p, e), (0, [0] * len(total)))
                        found[p, e] = (had + n, [a + b for a, b in zip(old, total)])
        yield pd.DataFrame([(p, e, i, n, str(x)) for (p, e), (n, total) in found.items() for i, x in enumerate(total)],
                           columns=["part", "entry", "place", "n", "x"])

    sums = (trees.select("parts").mapInPandas(run, "part int, entry int, place int, n long, x string")
            .groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")))
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in sorted(sums.collect(), key=lambda r: (r["part"], r["entry"], r["place"])):  # entries x width at most
        out.setdefault((r["part"], r["entry"]), (r["n"], []))[1].append(int(r["x"]))
    return out


def codes(trees: DataFrame, books: list[Book]) -> DataFrame:
    """(id, label, code, error) of every vector, texts all but the code's."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for ids, labels, parts in zip(pdf["ids"], pdf["labels"], pdf["parts"]):
                found = [nearest(part, book)[:2] for part, book in zip(parts, books)]
                yield pd.DataFrame({"id": list(ids), "label": list(labels),
                                    "code": ["".join(f"{e:02x}" for e in row) for row in zip(*[f[0] for f in found])],
                                    "error": [min(sum(row), LARGEST) for row in zip(*[f[1] for f in found])]})

    return trees.mapInPandas(run, "id string, label string, code string, error long")


def digest(books: list[Book]) -> str:
    """SHA-256 of all entries' components, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label",
             entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[Book]]:
    """(key, code, error, label_error of every kept vector; the codebooks by part, entry, position).

    Codebooks start as the parts of the `entries` smallest keys (null keys last, then by vector; repeated keys count
    as often as they stand); after `rounds` rounds vectors are coded by the nearest entries, ties to the lower index.
    Vectors that are null or hold a null, NaN or infinite component are left out; of the rest every row, repeated ones
    too, gives one row. The width is that of the first vector, vectors of another one are left out; a width that four
    does not divide is cut as evenly as can be, and vectors of no components have code 00000000 and no error.
    Components beyond `exact` are worked in whole numbers of any size, components and errors beyond a long are cut to
    the largest long. An empty table gives an empty result. Other columns are not read. Keys and labels may be of any
    type that a text holds without loss.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256: codes have two digits a part")
    rows = kept_vectors(vectors, key, vector, label)
    start = smallest(rows, entries)
    first = smallest(rows, 1)
    width = len(first[0]) if first else 0
    if any(len(v) != width for v in start):
        start = smallest(rows.where(F.size("v") == width), entries)
    cuts = borders(width)
    trees = written(blocks(rows.where(F.size("v") == width), width), "vector-trees")
    books = [[v[lo:hi] for v in start] for lo, hi in zip(cuts, cuts[1:])]
    for _ in range(rounds):
        for (p, e), (n, total) in round_sums(trees, books).items():
            books[p][e] = [x // n for x in total]
    types = {f.name: f.dataType for f in rows.schema}

    coded = written(codes(trees, books).select(
        F.col("id").cast(types["id"]).alias("id"), F.col("label").cast(types["label"]).alias("label"), "code", "error"), "codes")  # written: labels are summed, then joined
    by_label = coded.groupBy(F.col("label").alias("its")).agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return (coded.join(by_label, F.col("label").eqNullSafe(F.col("its")))
            .select(F.col("id").alias(key), "code", "error", "label_error"), books)
