"""The event table in versions: a reader sees one whole version, whatever is being rewritten.

A version is a list of data folders, one or more per day, with counts and ranges; it is a small table of its own,
written by Spark and put in place by one rename, which fails if another writer was first. Writers then
begin again from the newer version. Data folders are written once and never changed: appending adds folders,
compaction replaces a day's folders by one, updates and retention replace those that hold what they change. So
nothing is deleted while it may be read; `vacuum` removes what no recent version lists.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsweave.config import RetentionParams
from opsweave.functions.times import Instant, at, utc_day
from opsweave.operators.events import UPDATED, add_missing_columns, apply_updates, expired
from opsweave.schemas import STORED_EVENTS
from opsweave.sources.tail import filesystem

FOLDERS = ("folder string, day date, batch string, rows long, long_rows long, min_ts timestamp, max_ts timestamp, "
           "min_id long, max_id long")
TRIES = 10


class Conflict(RuntimeError):
    """Another writer changed what this one was about to replace."""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, path: str) -> int:
    """The number of the newest version; 0 for a table that has none yet."""
    where, files = _files(spark, f"{path}/_versions")
    if not files.exists(where):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def folders(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The folders of a version, the newest one by default."""
    number = latest(spark, path) if version is None else version
    return spark.read.schema(FOLDERS).parquet(f"{path}/_versions/{number:012d}") if number else spark.createDataFrame([], FOLDERS)


def read(spark: SparkSession, path: str, version: int | None = None, since: Instant | None = None) -> DataFrame:
    """The events of a version; with `since` only folders that reach so far are read."""
    listed = folders(spark, path, version)
    if since is not None:
        listed = listed.where(F.col("max_ts") >= at(since))
    found = _events(spark, path, [r["folder"] for r in listed.select("folder").toLocalIterator()])
    return found if since is None else found.where(F.col("ts") >= at(since))


def _events(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], STORED_EVENTS)
    return spark.read.schema(STORED_EVENTS).parquet(*[f"{path}/{n}" for n in names])


def _put(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder, unless the target exists: then the other writer's stays and this one is not put."""
    (src, _), (dst, _) = _files(spark, source), _files(spark, target)
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(dst.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(context.makeQualified(src), context.makeQualified(dst), options)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or "already exists" in str(e) or "not empty" in str(e):
            return False
        raise
    return True


def commit(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> int:
    """Put a new version in place: what `change` makes of the newest one's folders. Begins again if another writer was
    first; `change` may raise :class:`Conflict`."""
    for _ in range(TRIES):
        number = latest(spark, path)
        draft = f"{path}/_versions/.draft-{uuid.uuid4().hex}"
        change(folders(spark, path, number)).write.parquet(draft)
        if _put(spark, draft, f"{path}/_versions/{number + 1:012d}"):
            return number + 1
        where, files = _files(spark, draft)
        files.delete(where, True)
    raise Conflict(f"{path}: other writers were first {TRIES} times")


def _write(rows: DataFrame, path: str, batch: str) -> DataFrame:
    """Data folders of these rows, by day, as a list like a version's; large days are split into files, small ones are one."""
    spark, name = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    whole = add_missing_columns(rows.withColumn("event_date", utc_day(F.col("ts"))), STORED_EVENTS).withColumn("batch", F.coalesce("batch", F.lit(batch)))
    (whole.withColumn("day", F.col("event_date")).hint("rebalance", F.col("day")).sortWithinPartitions("day", "ts", "id")
     .write.partitionBy("day").parquet(f"{path}/{name}"))
    long_kept = (F.col("type") == "service_fail") | F.coalesce(F.col("user_action") == "applied", F.lit(False))
    written = spark.read.schema(whole.schema.add("day", "date")).parquet(f"{path}/{name}")
    return written.groupBy("day").agg(
        F.lit(batch).alias("batch"), F.count(F.lit(1)).alias("rows"), F.count_if(long_kept).alias("long_rows"), F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"), F.min("id").alias("min_id"), F.max("id").alias("max_id")).select(
        F.concat(F.lit(f"{name}/day="), F.col("day").cast("string")).alias("folder"), "day", "batch", "rows", "long_rows", "min_ts", "max_ts",
        "min_id", "max_id")


def append(df: DataFrame, path: str, batch: str | None = None) -> int:
    """Add events as a new version; returns its number. A batch that is written again replaces itself.

    Events without an `id` get increasing ones, above all that the table holds and in order of time within the batch,
    with gaps; so pages of the table can be read by id. An empty batch makes a version too.
    """
    spark, batch = df.sparkSession, batch or uuid.uuid4().hex
    for _ in range(TRIES):
        top = folders(spark, path).where(F.col("batch") != batch).agg(F.max("max_id")).first()[0] or 0
        rows = df
        if "id" not in df.columns:
            ordered = df.repartitionByRange("ts").sortWithinPartitions("ts", *[c for c in ("host", "source", "raw_data") if c in df.columns])
            rows = ordered.withColumn("id", F.monotonically_increasing_id() + F.lit(top + 1))
        added = _write(rows, path, batch)

        def change(now: DataFrame) -> DataFrame:
            others = now.where(F.col("batch") != batch)
            if "id" not in df.columns and (others.agg(F.max("max_id")).first()[0] or 0) > top:
                raise Conflict(f"{path}: ids above {top} are taken")
            return others.unionByName(added)
        try:
            return commit(spark, path, change)
        except Conflict:
            continue
    raise Conflict(f"{path}: other writers were first {TRIES} times")


def _replace(spark: SparkSession, path: str, gone: list[str], added: DataFrame | None) -> int:
    """A version without the folders `gone` and with those `added`; all of the former must still be listed."""
    names = spark.createDataFrame([(n,) for n in gone], "folder string")

    def change(now: DataFrame) -> DataFrame:
        if now.join(names, "folder", "left_semi").count() != len(gone):
            raise Conflict(f"{path}: folders to be replaced are no longer listed")
        left = now.join(names, "folder", "left_anti")
        return left if added is None else left.unionByName(added)
    return commit(spark, path, change)


def compact(spark: SparkSession, path: str, most: int = 1) -> int:
    """Days of more than `most` folders become one folder each; returns how many folders were replaced.

    Readers of older versions go on reading the old folders. Raises :class:`Conflict` if another writer replaced one of
    the folders in the meantime; what others appended stays.
    """
    listed = folders(spark, path)
    many = listed.groupBy("day").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    names = [r["folder"] for r in listed.join(many, "day", "left_semi").select("folder").toLocalIterator()]
    if names:
        _replace(spark, path, names, _write(_events(spark, path, names), path, f"compact-{uuid.uuid4().hex}"))
    return len(names)


def fold_updates(spark: SparkSession, path: str, updates: DataFrame) -> int:
    """Rewrite the folders that hold updated ids with the updates applied (last written value per column); returns how many.

    Folders whose range of ids no update falls into are not looked at; of the others only ids are read to find those that
    hold one. `updates`: as for `apply_updates`.
    """
    present = [c for c in ("id", "updated_at", *UPDATED) if c in updates.columns]
    span = updates.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    if span["low"] is None:
        return 0
    near = [r["folder"] for r in folders(spark, path).where((F.col("max_id") >= span["low"]) & (F.col("min_id") <= span["high"]))
            .select("folder").toLocalIterator()]
    if not near:
        return 0
    ids = _events(spark, path, near).select("id", F.regexp_extract("_metadata.file_path", r"(data/[0-9a-f]+/day=[^/]+)/[^/]*$", 1).alias("folder"))
    names = [r["folder"] for r in ids.join(updates.select("id").distinct(), "id", "left_semi").select("folder").distinct().toLocalIterator()]
    if names:
        _replace(spark, path, names, _write(apply_updates(_events(spark, path, names), updates.select(*present)), path, f"updates-{uuid.uuid4().hex}"))
    return len(names)


def retain(spark: SparkSession, path: str, as_of: Instant, params: RetentionParams = RetentionParams()) -> int:
    """A version without expired events; returns how many went.

    Folders of which all rows have expired, by their counts and times, leave the list unread; those that keep some rows are
    rewritten in one job; all others are not touched.
    """
    ordinary = at(as_of) - F.expr(f"INTERVAL {params.days} DAYS")
    extended = at(as_of) - F.expr(f"INTERVAL {params.critical_days} DAYS")
    whole = (F.col("max_ts") < F.least(ordinary, extended)) | ((F.col("long_rows") == 0) & (F.col("max_ts") < ordinary)) | (
        (F.col("long_rows") == F.col("rows")) & (F.col("max_ts") < extended))
    partly = ((F.col("min_ts") < ordinary) & (F.col("long_rows") < F.col("rows"))) | ((F.col("min_ts") < extended) & (F.col("long_rows") > 0))
    listed = list(folders(spark, path).where(whole | partly).select("folder", "rows", whole.alias("whole")).toLocalIterator())
    if not listed:
        return 0
    some = [r["folder"] for r in listed if not r["whole"]]
    kept = _write(_events(spark, path, some).where(~F.coalesce(expired(as_of, params), F.lit(False))), path, f"kept-{uuid.uuid4().hex}") if some else None
    left = kept.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] if some else 0
    _replace(spark, path, [r["folder"] for r in listed], kept)
    return sum(r["rows"] for r in listed) - left


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the data folders that older versions list and the newest `keep` do not; returns how many. Older versions
    can no longer be read, and their lists go as well. Tasks delete; what they delete again after a retry is gone already."""
    last = latest(spark, path)
    recent = range(max(1, last - keep + 1), last + 1)
    where, files = _files(spark, f"{path}/_versions")
    old = [n for n in (int(s.getPath().getName()) for s in files.listStatus(where) if s.getPath().getName().isdigit()) if n not in recent]
    if not old:
        return 0

    def listed(numbers) -> DataFrame:
        return spark.read.schema(FOLDERS).parquet(*[f"{path}/_versions/{n:012d}" for n in numbers]).select("folder").distinct()

    gone = listed(old).join(listed(recent), "folder", "left_anti")

    def delete(rows) -> None:
        from pyarrow import fs
        store, place = filesystem(path)
        for row in rows:
            if store.get_file_info(f"{place}/{row['folder']}").type != fs.FileType.NotFound:
                store.delete_dir(f"{place}/{row['folder']}")

    n = gone.count()
    gone.foreachPartition(delete)
    for number in old:
        files.delete(_files(spark, f"{path}/_versions/{number:012d}")[0], True)
    return n
