"""Similar past events by embedding: an index of cells, probed nearest first.

Coarse centroids are trained on a bounded sample; every row belongs to the cell of its nearest
centroid, and every cell is cut into parts of at most `PART` rows, so that a cell with a third of
all rows is many groups. A query probes the cells whose centroids are nearest; with `exact`, it then
probes each further cell that can still hold something better, told by the cell's
angular radius, so that results are those of comparing with all rows. Each (cell, part) is compared
with its queries as a matrix product in one task, and puts out the best few per query only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsweave.operators.timeline import new_path

#: Rows the centroids are trained on, at most: those with the smallest hash of their id.
SAMPLE = 20_000
#: Rows of a part of a cell, and queries of a part compared in one task: bound its memory.
PART, QUERIES = 16_384, 4_096
#: Similarities are compared at this many decimals, equal ones go by id.
DECIMALS = 9


#: Recall on the sample that the number of probed cells is chosen for.
RECALL = 0.95


@dataclass(frozen=True)
class Index:
    """Written rows (id, at, vec, cell, part), parts per cell, and unit centroids with the cells' angular radii.

    `rows` holds unit vectors; `at` is the order in which rows came (null where none is given); `probes` is how many
    cells hold the sample's own neighbours with a recall of `RECALL`.
    """

    rows: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    parts: np.ndarray
    probes: int


def unit_vectors(rows: DataFrame, key: str, vector: str, at: str | None) -> DataFrame:
    """(id, at, vec) with vectors of length one; rows without a usable vector, or with one of no length, go."""
    v = F.col(vector).cast("array<double>")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    inf = float("inf")
    found = rows.select(F.col(key).alias("id"), (F.col(at) if at else F.lit(None).cast("timestamp")).alias("at"), v.alias("v"))
    return (found.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x) < inf, F.lit(False))))
            .withColumn("length", F.sqrt(square)).where((F.col("length") > 0) & (F.col("length") < inf))
            .select("id", "at", F.transform("v", lambda x: x / F.col("length")).alias("vec")))


def train_centroids(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids by rounds of spherical k-means; starts are spread by taking the sample row least like those taken."""
    if not len(sample):
        return np.zeros((0, 0))
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(cells, len(sample)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    centres = sample[chosen]
    for _ in range(rounds):
        owner = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, sample)
        length = np.sqrt((sums ** 2).sum(1))
        centres = np.where(length[:, None] > 1e-12, sums / np.maximum(length, 1e-12)[:, None], centres)
    return centres


def enough_probes(sample: np.ndarray, centres: np.ndarray, k: int = 3, asked: int = 256) -> int:
    """The least number of cells in which `RECALL` of the `k` nearest sample rows of `asked` sample rows lie."""
    some = sample[:asked]
    if len(sample) < 2:
        return max(1, len(centres))
    like = some @ sample.T
    like[np.arange(len(some)), np.arange(len(some))] = -9
    near = np.argpartition(-like, min(k, len(sample) - 1) - 1, axis=1)[:, :min(k, len(sample) - 1)]
    rank = np.argsort(np.argsort(-(some @ centres.T), axis=1, kind="stable"), axis=1)
    ranks = np.take_along_axis(rank, (sample @ centres.T).argmax(1)[near], axis=1)
    return int(np.sort(ranks, axis=None)[int(np.ceil(RECALL * ranks.size)) - 1]) + 1


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=float).reshape(len(vectors), width)


def build_index(rows: DataFrame, key: str = "id", vector: str = "embedding", at: str | None = None, cells: int = 32) -> Index:
    """An index of all rows that have a vector of the common width (that of the first row of the sample).

    Rows go to the folder that the session shares; a lost executor costs only its tasks. Rows that
    repeat an id are indexed each for itself. Without any usable row the index is empty.
    """
    spark = rows.sparkSession
    units = unit_vectors(rows, key, vector, at)
    got = units.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect()  # bounded by SAMPLE
    width = len(got[0]["vec"]) if got else 0
    sample = _matrix(pd.Series([r["vec"] for r in got if len(r["vec"]) == width], dtype=object), width)
    centres = train_centroids(sample, cells)

    def locate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            near = _matrix(pdf["vec"], width) @ centres.T
            cell = near.argmax(1) if len(pdf) else np.zeros(0, dtype=int)
            yield pdf.assign(cell=cell, away=np.arccos(np.clip(near[np.arange(len(pdf)), cell], -1, 1)))

    path = new_path(spark, "vector-index")
    kind = units.schema["id"].dataType.simpleString()
    when = units.schema["at"].dataType.simpleString()
    if width:
        (units.where(F.size("vec") == width).mapInPandas(locate, f"id {kind}, at {when}, vec array<double>, cell int, away double")
         .write.parquet(path))
        located = spark.read.parquet(path)
    else:
        located = units.limit(0).select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("away"))
    sizes = {r["cell"]: r for r in located.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect()}
    parts = np.array([-(-sizes[c]["n"] // PART) if c in sizes else 0 for c in range(len(centres))], dtype=np.int64)
    radius = np.array([sizes[c]["away"] if c in sizes else 0.0 for c in range(len(centres))])
    split = F.get(F.lit(parts.tolist()).cast("array<long>"), F.col("cell")) if len(parts) else F.lit(1)
    return Index(located.select("id", "at", "vec", "cell", F.pmod(F.xxhash64("id"), F.greatest(split, F.lit(1))).alias("part")),
                 centres, radius, parts, enough_probes(sample, centres) if width else 1)


def _probes(queries: DataFrame, index: Index, first: int, count: int, floor: bool) -> DataFrame:
    """(query, its_at, vec, cell): the cells at ranks `first` to `first + count - 1` by nearness of their centroids;
    with `floor`, of these only cells that can hold a row at least as similar as the query's `floor`."""
    centres, radius = index.centroids, index.radius
    filled = np.flatnonzero(index.parts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(filled):
                continue
            near = _matrix(pdf["vec"], centres.shape[1]) @ centres[filled].T
            order = np.argsort(-near, axis=1, kind="stable")[:, first:first + count]
            angle = np.arccos(np.clip(np.take_along_axis(near, order, 1), -1, 1))
            best = np.cos(np.maximum(0, angle - radius[filled][order] - 1e-9))  # no row of the cell is more similar
            use = best + 10.0 ** -DECIMALS >= (pdf["floor"].to_numpy()[:, None] if floor else -2)
            row, rank = np.nonzero(use)
            yield pd.DataFrame({"query": pdf["query"].to_numpy()[row], "its_at": pdf["its_at"].to_numpy()[row],
                                "vec": pdf["vec"].to_numpy()[row], "cell": filled[order[row, rank]]})

    kinds = dict(queries.dtypes)
    return queries.mapInPandas(run, f"query {kinds['query']}, its_at {kinds['its_at']}, vec array<double>, cell int")


def _compared(probes: DataFrame, index: Index, k: int, past: bool, itself: bool) -> DataFrame:
    """(query, id, similarity): the best `k` per query and part of a probed cell."""
    split = F.get(F.lit(index.parts.tolist()).cast("array<long>"), F.col("cell"))
    # a cell's queries are cut as well; each cut meets every part of the cell
    hot = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("cuts"))
    asked = (probes.join(F.broadcast(hot), "cell")  # one row per cell
             .withColumn("cut", F.pmod(F.xxhash64("query"), F.col("cuts")))
             .select("*", F.explode(F.sequence(F.lit(0).cast("long"), split - 1)).alias("part")))
    rows = (index.rows.join(F.broadcast(hot), "cell")
            .select("id", "at", "vec", "cell", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut")))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            width = len(left["vec"].iloc[0])
            theirs, ids = _matrix(right["vec"], width), right["id"].to_numpy()
            by_id = np.argsort(ids, kind="stable")
            theirs, ids, at = theirs[by_id], ids[by_id], right["at"].to_numpy()[by_id]
            for start in range(0, len(left), 512):
                some = left.iloc[start:start + 512]
                like = np.round(_matrix(some["vec"], width) @ theirs.T, DECIMALS)
                if past:
                    like[~(at[None, :] < some["its_at"].to_numpy()[:, None])] = -9
                if not itself:
                    like[ids[None, :] == some["query"].to_numpy()[:, None]] = -9
                top = np.argsort(-like, axis=1, kind="stable")[:, :k]
                row, rank = np.nonzero(np.take_along_axis(like, top, 1) > -9)
                out.append(pd.DataFrame({"query": some["query"].to_numpy()[row], "id": ids[top[row, rank]],
                                         "similarity": like[row, top[row, rank]]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "similarity": []})

    by, kinds = ["cell", "part", "cut"], dict(index.rows.dtypes)
    return (asked.select("query", "its_at", "vec", *by).groupBy(*by).cogroup(rows.groupBy(*by))
            .applyInPandas(best, f"query {dict(probes.dtypes)['query']}, id {kinds['id']}, similarity double"))


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar(index: Index, queries: DataFrame, k: int = 3, key: str = "id", vector: str = "embedding", at: str | None = None,
            probes: int | None = None, exact: bool = False, itself: bool = False) -> DataFrame:
    """(query, rank, id, similarity): the `k` indexed rows most similar to each query by cosine, best first.

    Similarities are rounded to 9 decimals, equal ones go by id. With `at` only rows that came before the query
    count; `itself` admits the row with the query's own id. Queries without a usable vector of the
    index's width have no rows. `probes` cells are searched (the index's own number unless given); with `exact` also all others
    that their radius does not rule out, and the result is that of comparing with every row.
    """
    spark, probes = queries.sparkSession, probes or index.probes
    asked = unit_vectors(queries, key, vector, at).select(F.col("id").alias("query"), F.col("at").alias("its_at"), "vec")
    asked = asked.where(F.size("vec") == index.centroids.shape[1])
    past = at is not None
    found = _compared(_probes(asked, index, 0, probes, False), index, k, past, itself)
    if exact and len(index.centroids) > probes:
        path = new_path(spark, "similar")
        _top(found, k).select("query", "id", "similarity").write.parquet(path)
        found = spark.read.schema(found.schema).parquet(path)
        # a query with fewer than k rows so far takes whatever there is
        worst = found.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("floor"))
        left = asked.join(worst, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        found = found.unionByName(_compared(_probes(left, index, probes, len(index.centroids), True), index, k, past, itself))
    return _top(found, k).select("query", "rank", "id", "similarity")


def past_context(found: DataFrame, events: DataFrame, shown: Column, key: str = "id") -> DataFrame:
    """(query, n, context): per query a text of its similar events, best first: what each was and what was done about it.

    `found` as from :func:`similar`, so a query has few rows; `shown` is the text of an event.
    """
    done = F.coalesce(F.concat(F.lit(" -> "), F.col("user_action")), F.lit(""))
    line = F.concat(F.lit("- ["), F.format_number("similarity", 2), F.lit("] "), shown, done)
    rows = found.join(events.select(F.col(key).alias("id"), "summary", "raw_data", "user_action"), "id")
    return rows.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda r: r["line"]), "\n").alias("context"))
