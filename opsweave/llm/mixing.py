"""Mixing of sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsweave.llm.common import hash_unit, text_of

#: Largest number of sources whose rates are broadcast (under 20 MB); beyond it they are joined by shuffle.
BROADCAST_SOURCES = 20_000
#: A mean above this is drawn as a sum of several draws, so that exp(-mean) stays exact.
CHUNK_MEAN = 16.0
#: Terms of a cumulative distribution: at mean 16 the rest is below 1e-30.
TERMS = 96


def rates_by_temperature(docs: DataFrame, source: str = "source", text: str = "text", power: float = 0.5,
                         epochs: float = 1.0) -> DataFrame:
    """(source, rate): mean repetitions that give each source a share proportional to size ** power.

    Sizes are code points of text; the mixture has `epochs` times the size of the corpus.
    Sources without text get rate `epochs`. Null is a source like any other.
    """
    sizes = (docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.length(text_of(text))).alias("size"))
             .withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(power))))
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    return sizes.join(F.broadcast(total)).select(  # one row
        "source", F.when(F.col("size") > 0, F.lit(epochs) * F.col("weight") / F.col("all_weight")
                         * F.col("all_size") / F.col("size")).otherwise(F.lit(epochs)).alias("rate"))


def cumulative(mean: Column) -> Column:
    """The first cumulative probabilities of a Poisson distribution."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(F.element_at(state["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step)["c"]


def drawn(key: Column, seed: int, draws: Column, cdf: Column) -> Column:
    """Sum of `draws` draws, each the inverse of `cdf` at a hash of seed, key and number."""
    each = F.transform(F.sequence(F.lit(1), draws), lambda j: F.transform(
        F.array(hash_unit(F.lit(str(seed)), key, j.cast("string"))), lambda u: F.size(F.filter(cdf, lambda c: c <= u)))[0])
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def mix_sources(docs: DataFrame, rates: DataFrame, key: str = "doc_id", source: str = "source", seed: int = 1) -> DataFrame:
    """All columns of `docs`, each row as often as its Poisson draw says, in globally shuffled order.

    Adds `mix_copy` (from 1), `mix_rate` (the mean) and `mix_order` (in [0, 1), the shuffled order;
    rows are dealt to partitions by it and sorted by it). The draw depends on seed and key
    alone: a retried task gives the same rows, rows that repeat a key get the same count, and
    rows with a null key share one draw. Sources missing in `rates` have rate 1; a rate of 0,
    below 0 or null gives no copy. Clashing columns (`mix_...`) of `docs` are replaced. An
    empty table gives an empty result.
    """
    rows = docs.drop("mix_copy", "mix_rate", "mix_order")
    mean = F.greatest(F.coalesce("rate", F.lit(0.0)), F.lit(0.0))
    table = (rates.select(F.col("source").alias("_source"), mean.alias("_rate"))
             .withColumn("_draws", F.greatest(F.ceil(F.col("_rate") / CHUNK_MEAN), F.lit(1)).cast("int"))
             .withColumn("_cdf", cumulative(F.col("_rate") / F.col("_draws"))))
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    found = rows.join(F.broadcast(table) if few else table, rows[source].eqNullSafe(table["_source"]), "left")
    name = rows[key].cast("string")
    n = drawn(name, seed, F.coalesce("_draws", F.lit(1)), F.coalesce("_cdf", cumulative(F.lit(1.0))))
    copied = (found.withColumn("_n", n).where("_n > 0")
              .select(*[rows[c] for c in rows.columns], F.coalesce("_rate", F.lit(1.0)).alias("mix_rate"),
                      F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("mix_copy"))
              .withColumn("mix_order", hash_unit(F.lit(f"{seed}:order"), F.col(key).cast("string"),
                                                 F.col("mix_copy").cast("string"))))
    return copied.repartition("mix_order").sortWithinPartitions("mix_order")
