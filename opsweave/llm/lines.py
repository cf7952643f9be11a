"""Deduplication of lines against levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsweave.llm.common import lower_ascii, new_path, partitions, text_of, written

WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def row_key(key: str, text: str) -> Column:
    """A digest of a row's key and text: rows that share it have equal lines."""
    return F.unhex(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(""), text_of(text))))


@dataclass
class LineRuns:
    """Runs of (digest, first_doc, n_docs), each hash-partitioned and sorted by digest on disk.

    A run holds what one batch brought: `first_doc` for digests that no earlier run holds,
    null for the others, and in how many documents of the batch the digest occurs. Runs of
    one level are merged into one run of the next level once there are `fanout` of them, so
    a digest is rewritten once per level and a batch joins few runs. Runs are bucketed
    tables: a batch is shuffled once, and the merge joins read the runs as they lie.
    """

    spark: SparkSession
    fanout: int = 2
    levels: list[list[DataFrame]] = field(default_factory=list)
    names: list[str] = field(default_factory=list)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (digest, doc_id) line occurrences that all come after the earlier batches."""
        mine = batch.groupBy("digest").agg(F.max("doc_id").alias("first_doc"),
                                           F.count_distinct("doc_id").alias("n_docs"))
        if self.runs():
            fresh = mine.select("digest", F.lit(True).alias("fresh"))
            for run in self.runs():
                known = run.where("first_doc is not null").select("digest")
                fresh = fresh.join(known.hint("merge"), "digest", "left_anti")
            mine = mine.join(fresh.hint("merge"), "digest", "left").select(
                "digest", F.when(F.col("fresh"), F.col("first_doc")).alias("first_doc"), "n_docs")
        self._put(0, mine)

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._sorted_run(run))
        if len(self.levels[level]) >= self.fanout:
            merged = merge_runs(self.levels[level])
            self.levels[level] = []
            self._put(level + 1, merged)

    def _sorted_run(self, run: DataFrame) -> DataFrame:
        name, n = f"line_run_{uuid.uuid4().hex}", partitions(self.spark)
        (run.repartition(n, "digest").write.bucketBy(n, "digest").sortBy("digest")
         .option("path", new_path(self.spark, "run")).saveAsTable(name))
        self.names.append(name)
        return self.spark.table(name)

    def totals(self) -> DataFrame:
        return merge_runs(self.runs())

    def forget(self) -> None:
        """Take the runs' names out of the catalog; their files stay in the shared folder."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels, self.names = [], []


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    union = runs[0]
    for run in runs[1:]:
        union = union.unionByName(run)
    return union.groupBy("digest").agg(F.max("first_doc").alias("first_doc"), F.sum("n_docs").alias("n_docs"))


def batch_of(docs: DataFrame, key: str, batches: int) -> Column:
    """Number of the key range a row lies in, the range of the largest keys first, null keys last."""
    cuts = docs.agg(F.percentile_approx(key, [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    above = [F.when(F.col(key) > F.lit(c), 0).otherwise(1) for c in sorted(set(cuts))]
    number = F.lit(0)
    for one in above:
        number = number + one
    return number


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5,
                batches: int = 4) -> DataFrame:
    """Documents without the lines that many documents repeat: key, n_lines, n_dropped, kept_text.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at
    least `min_chars` code points that occur in at least `min_docs` documents lose their lines in
    all documents but the one with the largest key. A null text is one empty line. Rows
    that repeat a document key count as one document. Rows with a null key lose repeated
    lines and are no document of their own. An empty table gives an empty result.

    The corpus is taken in `batches` ranges of falling keys, so the first document that
    brings a line is the one that keeps it; their number has no influence on the result.
    Lines are cut up once into a table of digests; texts are shuffled once, at the end.
    """
    spark = docs.sparkSession
    lines = F.split(text_of(text), "\n", -1)
    digests = F.transform(F.split(text_of(text), "\n", -1), lambda line: F.when(
        F.length(F.btrim(line, F.lit(WHITE))) >= min_chars, F.md5(line_key(line))))
    cut = written(
        docs.select(F.col(key).alias("doc_id"), row_key(key, text).alias("row"), batch_of(docs, key, batches).alias("batch"),
                    F.posexplode(digests).alias("pos", "digest"))
        .where("digest is not null").withColumn("digest", F.unhex("digest")), "lines")
    index = LineRuns(spark)
    for number in range(batches):
        index.add(cut.where(F.col("batch") == number))
    common = written(index.totals().where(F.col("n_docs") >= min_docs).select("digest", "first_doc"), "common")
    index.forget()
    dropped = (cut.select("row", "doc_id", "pos", "digest").join(common, "digest")
               .where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
               .groupBy("row").agg(F.collect_set("pos").alias("dropped")))
    joined = docs.select(F.col(key), row_key(key, text).alias("row"), text_of(text).alias("_text")).join(dropped, "row", "left")
    parts = F.split("_text", "\n", -1)
    kept = F.when(F.col("dropped").isNull(), F.col("_text")).otherwise(F.array_join(
        F.transform(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "dropped")),
                    lambda i: F.get(F.col("_lines"), i)), "\n"))
    return (joined.withColumn("_lines", parts)
            .select(key, F.size("_lines").cast("long").alias("n_lines"),
                    F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text")))
