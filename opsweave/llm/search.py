"""Ranked lexical search: best-first document intervals bounded by range maxima of posting lists.

One pass over whole texts keeps, per document, its number of terms and the frequencies of the
queries' terms; corpus statistics are Spark aggregates of it. A second pass cuts the documents
into runs of `SHARD`, builds for each run the posting lists of the terms with sparse tables
for range maxima, and answers every query: an interval of documents is bounded by the sum of its
lists' maxima, the interval with the highest bound is split at the document with the greatest
single impact, which is scored in full, until no bound can change the best k. The best of a
task's runs prune its later runs; tasks' lists are merged in two steps.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from opsweave.llm.common import text_of, written

#: Documents whose posting lists are in memory at a time.
SHARD = 4096
SHARD_POSTINGS = 1 << 20
#: Groups in which tasks' lists of an item are merged first.
SALTS = 32
#: Intervals that are taken from the queue together.
STEP = 64
#: Distinct terms of a block of queries: bounds what a task holds besides its documents.
BLOCK_TERMS = 200_000

# ASCII that is no letter or digit parts terms, A-Z are lower-cased.
_KEEP = set(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
_TABLE = bytes(b if b in _KEEP else 32 for b in range(256)).lower()


def terms_of(text: bytes | str) -> list[bytes]:
    """The terms of a whole text, in order, with repeats: parted by ASCII other than letters and digits, only A-Z lower-cased."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text)
    return data.translate(_TABLE).split()


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) per term."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df.astype(float) + 1))).astype(np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """weight * ((10^9 tf) div (1000 tf + 12 m)), m = 75 + (25 n N) div L, in 64-bit integers."""
    m = 75 + (25 * n * n_docs) // max(1, n_terms)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Postings:
    """Posting lists of a run of documents, one behind the other, with sparse tables of range maxima.

    Documents are numbered by their place. `at[t]` to `at[t + 1]` is the list of term t: `docs` with their
    `score`. table[k][i] is the place of the greatest score among i to i + 2^k - 1, the first of equal ones;
    ranges asked for never leave a list.
    """

    def __init__(self, terms: np.ndarray, docs: np.ndarray, score: np.ndarray, n_docs: int, n_terms: int):
        by = np.lexsort((docs, terms))
        self.n_docs, self.docs, self.score = n_docs, docs[by], score[by]
        self.at = np.searchsorted(terms[by], np.arange(n_terms + 1))
        self.key = terms[by].astype(np.int64) * n_docs + self.docs
        longest = int((self.at[1:] - self.at[:-1]).max()) if len(docs) else 0
        self.table = [np.arange(len(docs), dtype=np.int32)]
        for k in range(1, max(1, longest).bit_length()):
            one, half = self.table[-1], 1 << (k - 1)
            two = np.concatenate([one[half:], np.repeat(one[-1:], half)])[:len(one)]
            self.table.append(np.where(self.score[two] > self.score[one], two, one))
        self.table = np.array(self.table)

    def place(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Where each term's list reaches each document: rows are documents."""
        return np.searchsorted(self.key, terms[None, :] * self.n_docs + docs[:, None])

    def maxima(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the maximum, maximum) of ranges lo to hi - 1; maximum 0 for empty ranges."""
        size = hi - lo
        some = size > 0
        k = np.frexp(np.maximum(size, 1).astype(float))[1] - 1
        last = len(self.docs) - 1
        a, b = self.table[k, np.minimum(lo, last)], self.table[k, np.clip(hi - (1 << k), 0, last)]
        best = np.where(self.score[b] > self.score[a], b, a)
        return best, np.where(some, self.score[best], 0)

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, found: list[tuple], names: list[tuple]) -> int:
        """Puts the documents that belong to the best k of all seen so far into `found`; returns how many were scored.

        `found` is a heap of (score, reversed order of the name, name), its worst entry first; `names[d]` is the name of
        document d in both forms. Documents of a run stand in the order of their names, so an interval whose bound
        only equals the worst score is of use if its first name comes before the worst entry's.
        """
        scored = 0

        def useful(bound: int, first: int) -> bool:
            return bound > 0 and (len(found) < k or (bound, names[first][0]) > found[0][:2])

        def bounded(lo: np.ndarray, hi: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
            if not len(lo):
                return
            place, most = self.maxima(start, stop)
            most = most * times[None, :]
            bound, top = most.sum(1), most.argmax(1)
            split = self.docs[place[np.arange(len(lo)), top]]
            for i in np.flatnonzero(bound > 0).tolist():
                if useful(int(bound[i]), int(lo[i])):
                    heapq.heappush(queue, (-int(bound[i]), int(lo[i]), int(hi[i]), int(split[i]), start[i], stop[i]))

        queue: list[tuple] = []
        if not len(terms) or not len(self.docs):
            return 0
        bounded(np.array([0]), np.array([self.n_docs]), self.at[terms][None, :], self.at[terms + 1][None, :])
        while queue:
            taken = []
            while queue and len(taken) < STEP and useful(-queue[0][0], queue[0][1]):
                taken.append(heapq.heappop(queue))
            if not taken:
                break  # bounds fall, and among equal ones names rise: none that follows is of use
            lo, hi, split = (np.array([t[i] for t in taken]) for i in (1, 2, 3))
            start, stop = np.array([t[4] for t in taken]), np.array([t[5] for t in taken])
            cut = np.clip(self.place(terms, split), start, stop)
            here = (cut < stop) & (self.docs[np.minimum(cut, len(self.docs) - 1)] == split[:, None])
            total = (np.where(here, self.score[np.minimum(cut, len(self.docs) - 1)], 0) * times[None, :]).sum(1)
            scored += len(split)
            for d, s in zip(split.tolist(), total.tolist()):
                entry = (s, *names[d])
                if s > 0 and len(found) < k:
                    heapq.heappush(found, entry)
                elif s > 0 and entry[:2] > found[0][:2]:
                    heapq.heapreplace(found, entry)
            left, right = lo < split, split + 1 < hi
            after = cut + here
            bounded(np.concatenate([lo[left], split[right] + 1]), np.concatenate([split[left], hi[right]]),
                    np.concatenate([start[left], after[right]]), np.concatenate([cut[left], stop[right]]))
        return scored


def frequencies(docs: DataFrame, key: str, text: str, wanted: dict[bytes, int]) -> DataFrame:
    """(id, bare, n, terms, tf) of every document with a term: n counts all its terms, the arrays hold those wanted;
    `bare` marks a null key."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            n, names, times = [], [], []
            for data in pdf["text"]:
                words = terms_of(data)
                n.append(len(words))
                count = Counter(wanted[w] for w in words if w in wanted)
                names.append(list(count))
                times.append(list(count.values()))
            yield pd.DataFrame({"id": pdf["id"], "bare": pdf["bare"], "n": n, "terms": names, "tf": times})[np.array(n) > 0]

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), F.col(key).isNull().alias("bare"),
                       text_of(text).cast("binary").alias("text"))
    return rows.mapInPandas(run, "id long, bare boolean, n long, terms array<int>, tf array<long>")


def shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in runs of SHARD documents, or fewer where they hold over SHARD_POSTINGS postings."""
    held = None
    for pdf in frames:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        while True:
            size = np.cumsum([len(t) for t in held["terms"]])
            cut = min(SHARD, int(np.searchsorted(size, SHARD_POSTINGS)) + 1)
            if len(held) <= cut:
                break
            yield held[:cut]
            held = held[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def best_of_tasks(found: DataFrame, df: np.ndarray, n_docs: int, n_terms: int,
                  queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(item, id, bare, score): of each task's documents the best k for each query (terms, how often each)."""
    weight = weights(df, n_docs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple]] = [[] for _ in queries]
        for pdf in shards(frames):
            pdf = pdf.iloc[np.lexsort((pdf["id"], pdf["bare"]))]
            names = [(-(1 << 63), None) if bare else (-i, i) for i, bare in zip(pdf["id"].tolist(), pdf["bare"].tolist())]
            sizes = [len(t) for t in pdf["terms"]]
            place = np.repeat(np.arange(len(pdf)), sizes)
            if not len(place):
                continue
            terms = np.concatenate(pdf["terms"].tolist()).astype(np.int64)
            tf = np.concatenate(pdf["tf"].tolist()).astype(np.int64)
            score = impacts(weight[terms], tf, pdf["n"].to_numpy()[place], n_docs, n_terms)
            lists = Postings(terms, place, score, len(pdf), len(weight))
            for q, (which, times) in enumerate(queries):
                lists.search(which, times, k, best[q], names)
        rows = [(q, name or 0, name is None, s) for q, heap in enumerate(best) for s, _, name in heap]
        yield pd.DataFrame(rows, columns=["item", "id", "bare", "score"])

    return found.mapInPandas(run, "item int, id long, bare boolean, score long")


def merged(best: DataFrame, k: int) -> DataFrame:
    """The best k of each item, ranked: within salts first, so that no task sees all tasks' lists of an item."""
    def top(df: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "bare", "id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    salted = best.withColumn("salt", F.pmod(F.xxhash64("id", "bare"), F.lit(SALTS)))
    return top(top(salted, "item", "salt"), "item")


def blocks(items: DataFrame, key: str, text: str) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Items in order of key and text, with their terms, in blocks of at most BLOCK_TERMS terms (or one item)."""
    keys, terms, size = [], [], 0
    for row in (items.select(F.col(key).alias("id"), text_of(text).alias("text")).orderBy(F.col("id").asc_nulls_last(), "text")
                .toLocalIterator()):
        own = terms_of(row["text"])
        if keys and size + len(own) > BLOCK_TERMS:
            yield keys, terms
            keys, terms, size = [], [], 0
        keys.append(row["id"])
        terms.append(own)
        size += len(own)
    if keys:
        yield keys, terms


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text",
           item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """item key, rank, key, score: the `k` documents with the highest scores above 0 for each item, best first.

    Equal scores go by ascending key, null keys last. Whole texts count; null and empty texts have no terms, so neither
    such documents nor such items have rows. Repeated documents are ranked each for itself; items that share a key are
    answered each for itself. An empty table gives an empty result. Only keys (whole numbers of documents, any type for
    items) and texts are read. Every row of documents is searched; items are worked in blocks, the documents being read
    once per block.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[key].dataType, items.schema[item_key].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField(item_key, item_type), T.StructField("rank", T.IntegerType()),
                                                  T.StructField(key, id_type), T.StructField("score", T.LongType())]))
    for keys, terms in blocks(items, item_key, item_text):
        wanted = {w: i for i, w in enumerate(sorted({w for own in terms for w in own}))}
        counts = [Counter(wanted[w] for w in own) for own in terms]
        queries = [(np.array(list(c), dtype=np.int64), np.array(list(c.values()), dtype=np.int64)) for c in counts]
        found = written(frequencies(docs, key, text, wanted), "frequencies")
        total = found.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = np.zeros(len(wanted), dtype=np.int64)
        for row in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # BLOCK_TERMS rows
            df[row["term"]] = row["count"]
        names = spark.createDataFrame(list(enumerate(keys)), T.StructType(
            [T.StructField("item", T.IntegerType()), T.StructField("name", item_type)]))
        best = merged(best_of_tasks(found, df, total["docs"], total["terms"], queries, k), k)
        rows = best.join(F.broadcast(names), "item").select(
            F.col("name").alias(item_key), "rank", F.when(~F.col("bare"), F.col("id")).cast(id_type).alias(key), "score")
        out = out.unionByName(written(rows, "ranked"))
    return out
