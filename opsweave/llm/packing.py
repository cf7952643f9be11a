"""Packing of documents into sequences: token pieces and a grouping genetic algorithm on islands."""

from __future__ import annotations

import math
import random
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsweave.llm.common import partitions, written
from opsweave.llm.tokens import default_tokenizer, ids_of

#: Pieces of one packing problem on average: bounds what a task holds.
SHARD_ITEMS = 1500
ISLANDS, POPULATION, GENERATIONS, EPOCHS = 2, 4, 10, 2
#: Sequences filled less than this after the first round are packed again with those of other shards.
WELL_FILLED = 0.98

Bins = list[list[int]]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2048, tokenizer: str | None = None,
           end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every row: its ids and `end_id`, cut into pieces.

    Only longer documents are cut, into pieces of `size` ids of which the first may be shorter.
    Null texts are empty: they have the end id alone. `ids` are little-endian 32-bit numbers.
    """
    path = tokenizer or default_tokenizer()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_in = ids_of(path)
        for pdf in frames:
            out = []
            for doc, content in zip(pdf["id"], pdf["content"]):
                ids = array("I", ids_in.of(content))
                ids.append(end_id)
                first = len(ids) % size or size
                cuts = [0, *range(first, len(ids) + 1, size)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[a:b].tobytes()
                    out.append((doc, i, a, b - a, zlib.crc32(part), *([part] if with_ids else [])))
            yield pd.DataFrame(out, columns=names)

    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kind = rows.schema["id"].dataType.simpleString()
    cut = rows.mapInPandas(run, f"id {kind}, piece int, start long, length long, ids_crc32 long"
                           + (", ids binary" if with_ids else ""))
    return cut.withColumnRenamed("id", key)


class _Open:
    """Room left in sequences; `take` finds the fullest one that an item fits in."""

    def __init__(self, size: int):
        self._by_room: list[list[int]] = [[] for _ in range(size + 1)]
        self._rooms = 0  # bit r is set if a sequence has room r

    def put(self, room: int, number: int) -> None:
        self._by_room[room].append(number)
        self._rooms |= 1 << room

    def take(self, need: int) -> tuple[int, int] | None:
        enough = self._rooms >> need
        if not enough:
            return None
        room = need + (enough & -enough).bit_length() - 1
        number = self._by_room[room].pop()
        if not self._by_room[room]:
            self._rooms &= ~(1 << room)
        return room, number


def best_fit(bins: Bins, items: list[int], lengths: list[int], size: int, rng: random.Random | None = None) -> Bins:
    """`bins` with `items`, each put where it leaves the least room: longest first, with `rng` in any order."""
    bins = [list(b) for b in bins]
    open_ = _Open(size)
    for number, b in enumerate(bins):
        open_.put(size - sum(lengths[i] for i in b), number)
    order = rng.sample(items, len(items)) if rng else sorted(items, key=lambda i: -lengths[i])
    for item in order:
        found = open_.take(lengths[item])
        if found is None:
            found = size, len(bins)
            bins.append([])
        room, number = found
        bins[number].append(item)
        open_.put(room - lengths[item], number)
    return bins


def _fill(b: list[int], lengths: list[int]) -> int:
    return sum(lengths[i] for i in b)


def fitness(bins: Bins, lengths: list[int]) -> tuple[int, int]:
    """Fewer sequences first; then fuller full ones, which leaves the last ones emptier."""
    return -len(bins), sum(_fill(b, lengths) ** 2 for b in bins)


def crossover(a: Bins, b: Bins, lengths: list[int], size: int, rng: random.Random) -> Bins:
    """Inject well-filled whole bins of `b` into `a`: bins of `a` that hold an injected item go, and
    their other items are displaced and best-fitted again."""
    fullest = sorted(b, key=lambda x: -_fill(x, lengths))[:max(1, len(b) // 2)]
    chosen = rng.sample(fullest, max(1, len(fullest) // 2))
    injected = {i for x in chosen for i in x}
    kept = [x for x in a if injected.isdisjoint(x)]
    displaced = [i for x in a if not injected.isdisjoint(x) for i in x if i not in injected]
    return best_fit(chosen + kept, displaced, lengths, size)


def mutate(bins: Bins, lengths: list[int], size: int, rng: random.Random) -> Bins:
    """Dissolve the emptiest bins and a few others, and best-fit their items again, in any order every other time."""
    order = sorted(bins, key=lambda x: _fill(x, lengths))
    few = max(2, len(bins) // 10)
    gone = order[:few] + rng.sample(order[few:], min(few, max(0, len(order) - few)))
    dissolved = {id(x) for x in gone}
    kept = [x for x in bins if id(x) not in dissolved]
    return best_fit(kept, [i for x in gone for i in x], lengths, size, rng if rng.random() < 0.5 else None)


def evolve(lengths: list[int], size: int, population: list[Bins], seed: int) -> list[Bins]:
    """Some generations on one island; the best individual comes first.

    Stops once the best needs no more sequences than the sum of lengths asks for.
    """
    rng = random.Random(seed)
    least = math.ceil(sum(lengths) / size)
    people = list(population)
    if not people:
        people = [best_fit([], list(range(len(lengths))), lengths, size)]
    while len(people[0]) > least and len(people) < POPULATION:
        people.append(best_fit([], list(range(len(lengths))), lengths, size, rng))
    for _ in range(GENERATIONS):
        people.sort(key=lambda x: fitness(x, lengths), reverse=True)
        if len(people[0]) <= least:
            break
        children = []
        for _ in range(max(1, POPULATION // 2)):
            a, b = rng.sample(people, 2) if len(people) > 1 else (people[0], people[0])
            children.append(mutate(crossover(a, b, lengths, size, rng), lengths, size, rng))
        people = sorted(people + children, key=lambda x: fitness(x, lengths), reverse=True)[:POPULATION]
    return people


def _numbers(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for number, b in enumerate(bins):
        for i in b:
            out[i] = number
    return out


def _bins(numbers: list[int]) -> Bins:
    out: Bins = [[] for _ in range(max(numbers) + 1)]
    for i, number in enumerate(numbers):
        out[number].append(i)
    return [b for b in out if b]


ISLAND = "shard long, island int, items array<long>, lengths array<int>, people array<array<int>>"


def _epoch(islands: DataFrame, size: int, epoch: int, tasks: int) -> DataFrame:
    """Every island evolves by itself; a row is an island. Rows are few bytes and much work, so the number of tasks is given."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            people = []
            for shard, island, lengths, old in zip(pdf["shard"], pdf["island"], pdf["lengths"], pdf["people"]):
                sizes = [int(x) for x in lengths]
                found = evolve(sizes, size, [_bins([int(x) for x in p]) for p in old],
                               hash((int(shard), int(island), epoch)))
                people.append([_numbers(b, len(sizes)) for b in found])
            yield pdf.assign(people=people)

    return islands.repartition(tasks, "shard", "island").mapInPandas(run, ISLAND)


def _migrate(islands: DataFrame) -> DataFrame:
    """The best individual of each island goes to the next island of its shard, in a ring."""
    elites = islands.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"),
                            F.slice("people", 1, 1).alias("guest"))
    return (islands.join(elites, ["shard", "island"])
            .select("shard", "island", "items", "lengths", F.concat("people", "guest").alias("people")))


def pack_items(items: DataFrame, size: int) -> DataFrame:
    """(item, shard, bin, offset) of every (item, length), lengths below `size`.

    Items are dealt to shards by a hash of the item, some SHARD_ITEMS in each: a row with
    all items of a shard is bounded, whatever the table's size. A shard is evolved on several
    islands from different seeds; between the epochs the islands exchange their elites, and the best
    packing of all its islands counts.
    """
    n = items.count()
    shards = max(1, math.ceil(n / SHARD_ITEMS))
    gathered = (items.groupBy(F.pmod(F.xxhash64("item"), F.lit(shards)).alias("shard"))
                .agg(F.array_sort(F.collect_list(F.struct("item", F.col("length").cast("int").alias("length")))).alias("all")))
    islands = gathered.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
                              F.col("all.item").alias("items"), F.col("all.length").alias("lengths"),
                              F.array().cast("array<array<int>>").alias("people"))
    tasks = min(shards * ISLANDS, 4 * partitions(items.sparkSession))
    for epoch in range(EPOCHS):
        islands = written(_epoch(islands if epoch == 0 else _migrate(islands), size, epoch, tasks), "islands")
    best = F.col("people")[0]
    chosen = islands.groupBy("shard").agg(F.min_by(F.struct("items", "lengths", best.alias("bins")),
                                                   F.struct(F.array_max(best), "island")).alias("best"))
    rows = chosen.select("shard", F.explode(F.arrays_zip("best.items", "best.lengths", "best.bins")).alias("x")).select(
        "shard", F.col("x.items").alias("item"), F.col("x.lengths").cast("long").alias("length"), F.col("x.bins").alias("bin"))
    before = Window.partitionBy("shard", "bin").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("shard", "bin")
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).withColumn("fill", F.sum("length").over(whole))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2048, tokenizer: str | None = None,
         with_ids: bool = False) -> DataFrame:
    """:func:`pieces` with sequence_id and offset: pieces lie in sequences of at most `size` ids, without gaps.

    Whole pieces are sequences of their own. The others are packed twice: in shards, and what
    lies in sequences that are not well filled once more, in new shards of all such pieces.
    Rows that repeat a key, null keys, null texts and clashing columns do no harm: only key and
    text are read and each row is packed for itself. An empty table gives an empty result.
    """
    cut = written(pieces(docs, key, text, size, tokenizer, with_ids=with_ids)
                  .withColumn("item", F.monotonically_increasing_id()), "pieces")
    first = written(pack_items(cut.where(F.col("length") < size).select("item", "length"), size), "packed")
    good = first.where(F.col("fill") >= WELL_FILLED * size)
    again = pack_items(first.where(F.col("fill") < WELL_FILLED * size).select("item", "length"), size)

    def placed(rows: DataFrame, lot: int) -> DataFrame:
        return rows.select("item", (F.col("shard") * (3 * 65536) + F.lit(lot * 65536) + F.col("bin")).alias("sequence_id"), "offset")

    whole = cut.where(F.col("length") == size).select("item", (-1 - F.col("item")).alias("sequence_id"),
                                                      F.lit(0).cast("long").alias("offset"))
    where = placed(good, 0).unionByName(placed(again, 1)).unionByName(whole)
    return cut.join(where, "item").drop("item")
