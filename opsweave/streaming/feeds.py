"""Stream sources, cadences and sinks.

Intake is bounded per trigger instead of dropping rows when a buffer is full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from opsweave.functions.text import strip
from opsweave.plans.enrich import Generate, enrich, rule_analyzer
from opsweave.operators.status import HOUR
from opsweave.plans.store import append_events, claim

# Seconds between polls by feed.
POLL_SECONDS = {
    "metrics": 30,
    "storage_stats": 300,
    "disk_health": 3600,
    "external": 60,
    "audit": 3600,
    "orphans": 3600,
    "config_files": 3600,
    "services": 300,
    "reboot": 300,
    "enrichment": 300,
}
FLUSH_SECONDS = 5.0
URGENT_SECONDS = 0.5
URGENT_PRIORITY = 2
#: A time before all others, with room to subtract it.
NEVER = -(1 << 61)


def every(writer: DataStreamWriter, seconds: float) -> DataStreamWriter:
    return writer.trigger(processingTime=f"{round(seconds * 1000)} milliseconds")


def polled(writer: DataStreamWriter, feed: str) -> DataStreamWriter:
    """A feed's query at the feed's own pace."""
    return every(writer, POLL_SECONDS[feed])


def read_files(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
               max_files: int = 1000, pattern: str | None = None) -> DataFrame:
    """A folder as a stream; what exceeds `max_files` waits for the next trigger."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def tail_lines(spark: SparkSession, path: str, host: str = "local", max_files: int = 1000) -> DataFrame:
    """Log chunks as a stream of non-blank lines; the checkpoint remembers what was read.

    Collectors land new lines as new files, so rotation needs no handling.
    """
    return (spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
            .select(F.lit(host).alias("host"), F.current_timestamp().alias("captured_at"),
                    strip(F.col("value")).alias("line")).where(F.col("line") != ""))


def with_late_data(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", delay)


def debounce_stream(stream: DataFrame, keys: list[str], quiet: str = "200 milliseconds",
                    delay: str = "10 minutes") -> DataFrame:
    """One row per burst, once the watermark has passed the quiet time after its last event."""
    return (with_late_data(stream, delay).groupBy(F.session_window("ts", quiet).alias("w"), *keys)
            .agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
            .select(*keys, "ts", F.col("w.end").alias("fire_ts"), "n"))


@dataclass(frozen=True)
class FlushPlan:
    """Two queries over one entry stream: ordinary entries in batches, urgent ones at once."""

    ordinary: DataFrame
    urgent: DataFrame


def batch_flush(entries: DataFrame) -> FlushPlan:
    urgent = F.col("priority") <= URGENT_PRIORITY
    return FlushPlan(entries.where(~urgent), entries.where(urgent))


def start_flush(plan: FlushPlan, write: Callable[[DataStreamWriter], DataStreamWriter]) -> list:
    return [write(every(plan.urgent.writeStream, URGENT_SECONDS)).start(),
            write(every(plan.ordinary.writeStream, FLUSH_SECONDS)).start()]


Sink = Callable[[DataFrame, int], None]


def route(batch: DataFrame, batch_id: int, sinks: list[tuple[str | None, Sink]]) -> None:
    """Hand a batch to every sink whose event type matches; None matches all."""
    batch = batch.persist()
    try:
        for event_type, sink in sinks:
            sink(batch if event_type is None else batch.where(F.col("type") == event_type), batch_id)
    finally:
        batch.unpersist()


def route_events(stream: DataFrame, sinks: list[tuple[str | None, Sink]]) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(lambda batch, batch_id: route(batch, batch_id, sinks))


def store_sink(spark: SparkSession, path: str, name: str, checkpoint: str) -> Sink:
    """Append each batch under the stream's name and the batch's number; a batch that is retried replaces itself.

    A name belongs to one checkpoint for all time: another stream, or one started anew, needs a name of its own.
    """
    claim(spark, path, name, checkpoint)
    return lambda batch, batch_id: append_events(batch, path, f"{name}-{batch_id}")


def on_event(callback: Callable[[Row], None]) -> Sink:
    """A sink that calls `callback` for every event, in the tasks that hold the rows."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.foreach(callback)
    return sink


class _Status(StatefulProcessor):
    """Last status, and times of the last critical event and last warning, of one host."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "status string, critical_us long, warning_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["us", "id"], kind="stable", ignore_index=True)
        status, *last = self.state.get() if self.state.exists() else ("healthy", None, None)
        recent = {}
        for level, before in zip(("critical", "warning"), last):
            seen = pd.Series(np.where(pdf["severity"] == level, pdf["us"], NEVER)).cummax().to_numpy()
            seen = np.maximum(seen, NEVER if before is None else before)
            recent[level] = pdf["us"].to_numpy() - seen < self.window_us
            last[level == "warning"] = int(seen[-1]) if seen[-1] > NEVER else None
        new = np.where(recent["critical"], "critical", np.where(recent["warning"], "degraded", "healthy"))
        old = np.concatenate(([status], new[:-1]))
        self.state.update((str(new[-1]), *last))
        out = pdf[["host", "id", "us"]].assign(old=old, new=new)
        yield out[out["old"] != out["new"]]

    def close(self) -> None:
        pass


def status_changes(stream: DataFrame, window: float = HOUR) -> DataFrame:
    """Status changes (host, id, ts, old, new) of an event stream, however long a host was quiet before.

    Keyed state per host, of fixed size, kept for as long as the host is known: a host that falls
    silent keeps its last status, as in the batch operators. Needs the RocksDB state store.
    """
    rows = stream.select("host", "id", F.unix_micros("ts").alias("us"), "severity")
    kind = dict(rows.dtypes)["id"]
    out = rows.groupBy("host").transformWithStateInPandas(
        statefulProcessor=_Status(round(window * 1e6)), outputStructType=f"host string, id {kind}, us long, old string, new string",
        outputMode="Append", timeMode="None")
    return out.select("host", "id", F.timestamp_micros("us").alias("ts"), "old", "new")


def on_status_change(callback: Callable[[str, str, str], None]) -> Sink:
    """A sink for :func:`status_changes` that calls `callback(host, old, new)`, where the rows are."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.foreach(lambda r: callback(r["host"], r["old"], r["new"]))
    return sink


def enrich_sink(spark: SparkSession, path: str, name: str, checkpoint: str, generate: Generate = rule_analyzer) -> Sink:
    """A sink that appends (id, summary, user_action, updated_at) rows to an update log; names as in :func:`store_sink`."""
    claim(spark, path, name, checkpoint)

    def sink(batch: DataFrame, batch_id: int) -> None:
        (enrich(batch, generate).select("id", "summary", "user_action", F.current_timestamp().alias("updated_at"))
         .write.mode("overwrite").parquet(f"{path}/batch={name}-{batch_id}"))
    return sink
