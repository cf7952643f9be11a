"""The stored event table: Parquet partitioned by day, appended to and cleaned by day."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsweave.config import RetentionParams
from opsweave.functions.times import Instant, at, utc_day
from opsweave.operators.events import add_missing_columns, expired
from opsweave.schemas import STORED_EVENTS, SYSTEM_EVENTS
from opsweave.sources.logs import log_line


def with_event_id(df: DataFrame) -> DataFrame:
    """An id for events that have none: a hash of the row and of how many like it came before, the same on every retry."""
    if "id" in df.columns:
        return df
    named = ["host", "ts", "type", "source", "raw_data"]
    nth = F.row_number().over(Window.partitionBy(*named).orderBy(F.lit(0)))
    return df.withColumn("_nth", nth).withColumn("id", F.xxhash64(*named, "_nth")).drop("_nth")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED_EVENTS).parquet(path)


def append_events(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Add events to the table, as folders event_date=../batch=...

    Writing a batch again replaces its own folders only, so a retried micro-batch adds
    nothing twice. Rebalancing by day writes few files and splits large days.
    """
    rows = with_event_id(df).withColumn("event_date", utc_day(F.col("ts")))
    (add_missing_columns(rows, SYSTEM_EVENTS).withColumn("batch", F.lit(batch or uuid.uuid4().hex))
     .hint("rebalance", F.col("event_date"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("event_date", "batch").parquet(path))


def claim(spark: SparkSession, path: str, name: str, owner: str) -> None:
    """Enter `owner` (a stream's checkpoint folder) as the one writer called `name` under `path`.

    A second owner of the name is refused: its batches would replace those of the first.
    """
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_writers/{name}")
    files = file.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(file.getParent())
    if files.createNewFile(file):
        out = files.create(file, True)
        out.write(owner.encode())
        out.close()
        return
    known = spark.read.text(file.toString(), wholetext=True).first()
    if known is None or known[0] != owner:
        raise ValueError(f"{name} already writes to {path} from another checkpoint: {known and known[0]}")


def write_log_lines(events: DataFrame, path: str) -> None:
    log_line(events).select("line").write.mode("append").text(path)


def apply_retention(spark: SparkSession, path: str, as_of: Instant,
                    params: RetentionParams = RetentionParams()) -> int:
    """Delete expired events; returns how many. Folders without expired events are not touched.

    What reaches the driver is one count per folder that loses rows, which is less than
    listing the folders takes. Folders left empty are removed, the others rewritten by
    dynamic partition overwrite.
    """
    newest = utc_day(at(as_of) - F.expr(f"INTERVAL {min(params.days, params.critical_days)} DAYS"))
    old = read_table(spark, path).where(F.col("event_date") <= newest)
    gone = F.coalesce(expired(as_of, params), F.lit(False))
    folders = (old.groupBy("event_date", "batch").agg(F.count(F.lit(1)).alias("n"), F.count_if(gone).alias("gone"))
               .where("gone > 0").collect())
    partly = [(f.event_date, f.batch) for f in folders if f.gone < f.n]
    if partly:
        touched = spark.createDataFrame(partly, "event_date date, batch string")
        (old.where(F.col("event_date").isin(sorted({d for d, _ in partly})) & ~gone)
         .join(touched, ["event_date", "batch"], "left_semi").hint("rebalance", F.col("event_date"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("event_date", "batch").parquet(path))
    for f in folders:
        if f.gone == f.n:
            _remove(spark, f"{path}/event_date={f.event_date}/batch={f.batch}")
    return sum(f.gone for f in folders)


def _remove(spark: SparkSession, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
