"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsweave.llm.common import lower_ascii, text_of, written

SALTS = 16


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def content_classes(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct content of (id, content, digest): digest, content, keep_id (largest id), group_size.

    Three combining stages, each grouping by digest and by the whole content, so that two
    contents with one digest never meet: rows of one task first (the partial aggregation),
    then the task results of one (digest, salt), then the salt winners of one digest. The
    salt comes from the id, so a group holding a third of all rows is merged by `salts`
    tasks from at most one row per task, and by one task from at most one row per salt.
    """
    salted = (rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
              .groupBy("digest", "salt", "content")
              .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return (salted.groupBy("digest", "content")
            .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS,
                 digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Every row with the row of its group that stays: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal
    texts the row with the largest key stays; rows that repeat that very key stay together.
    A null key is smaller than any other. Other columns of `docs` are ignored; an empty table
    gives an empty result.

    Rows find their class by digest. The classes, made by comparing whole contents, tell
    whether a digest stands for more than one content; rows of such digests (there are none
    with SHA-256) find their class by content.
    """
    rows = (docs.select(F.col(key).alias("id"), lower_ascii(text_of(text)).alias("content"))
            .withColumn("digest", digest(F.col("content"))))
    classes = content_classes(rows, salts)
    by_digest = written(classes.groupBy("digest").agg(
        F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size")), "digests")
    columns = ["id", "digest", "keep_id", "group_size"]
    found = rows.select("id", "digest").join(by_digest.where("contents = 1"), "digest").select(*columns)
    shared = by_digest.where("contents > 1").select("digest")
    if not shared.isEmpty():
        found = found.unionByName(
            rows.join(shared, "digest", "left_semi").join(classes, ["digest", "content"]).select(*columns))
    return found.select(F.col("id").alias(key), "keep_id", "group_size",
                        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that :func:`exact_groups` keeps, with all their columns."""
    kept = exact_groups(docs, key, text).where("kept").select(F.col(key).alias("_kept")).distinct()
    return docs.join(kept, docs[key].eqNullSafe(kept["_kept"]), "left_semi")
