"""Streaming queries: the event table read as a stream, run to its end, results read back."""

from itertools import groupby

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsweave.catalog import EV, ORACLES, query, us
from opsweave.catalog.series import DEDUP, TREND
from opsweave.functions.text import fingerprint
from opsweave.operators.timeline import new_path
from opsweave.plans.store import append_events
from opsweave.sources import tail
from opsweave.sources.logs import package_events, parse_package_log
from opsweave.sources.tables import EVENT_COLUMNS, sample_events, scan_events, shape_events, table
from opsweave.streaming import dedup, feeds, late


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return shape_events(feeds.read_files(spark, folder, schema, pattern="events.parquet"))


def _run(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there and read its output back."""
    spark = stream.sparkSession
    out = new_path(spark, "stream")
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "progress"))
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(out)


def _drain(writer, progress: str) -> None:
    writer.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def _marked(spark, folder):
    message = F.concat("event_type", F.lit("["), F.col("id").cast("string"), F.lit("]"))
    return _stream(spark, folder).select(
        "id", "host", "source", "ts", fingerprint(F.col("source"), F.lit("app"), message).alias("fingerprint"))


@query(ORACLES["dedup_by_fingerprint"])
def dedup_stream(spark, folder):
    dedup.use_rocksdb(spark)
    return _run(dedup.dedup_stream(_marked(spark, folder), DEDUP)).select("id", "fingerprint", us(), "suppressed_count")


@query("SELECT id, suppressed_count FROM (" + ORACLES["dedup_rate_limited"] + ") WHERE action = 'emit'")
def dedup_rate_limited_stream(spark, folder):
    dedup.use_rocksdb(spark)
    return _run(dedup.dedup_rate_limited_stream(_marked(spark, folder), DEDUP)).select("id", "suppressed_count")


@query(ORACLES["trend_alerts"])
def trend_stream(spark, folder):
    dedup.use_rocksdb(spark)
    samples = _stream(spark, folder).select(
        "host", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("metric"), "ts", "value")
    return _run(dedup.trend_stream(samples, TREND, 0.05)).select(
        "host", "metric", us(), F.round("slope", 6).alias("slope"), "direction")


@query(f"WITH {EV} SELECT type, host, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM ev GROUP BY ALL UNION ALL "
       "SELECT 'service_fail only', host, count(*), CAST(sum(id) AS BIGINT) FROM ev WHERE type = 'service_fail' GROUP BY ALL")
def route_events(spark, folder):
    """All events to one table, service failures to a second one as well."""
    every, fails, progress = (new_path(spark, x) for x in ("events", "fails", "progress"))
    stream = _stream(spark, folder).select(*EVENT_COLUMNS)
    sinks = [(None, feeds.store_sink(spark, every, "all", progress)),
             ("service_fail", feeds.store_sink(spark, fails, "failures", progress))]
    _drain(feeds.route_events(stream, sinks), progress)
    both = scan_events(spark, every).unionByName(scan_events(spark, fails).withColumn("type", F.lit("service_fail only")))
    return both.groupBy("type", "host").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"WITH {EV} SELECT id, concat(source, ': ', event_type, '[', id, ']') AS summary FROM ev WHERE summary IS NULL")
def enrich_stream(spark, folder):
    """The update log an enrichment stream leaves."""
    log, progress = new_path(spark, "updates"), new_path(spark, "progress")
    stream = _stream(spark, folder).select(*EVENT_COLUMNS)
    _drain(feeds.route_events(stream, [(None, feeds.enrich_sink(spark, log, "enrich", progress))]), progress)
    return spark.read.parquet(log).select("id", "summary")


@query(f"""WITH {EV}, gaps AS (SELECT host, source, us, coalesce(us - lag(us) OVER w >= 1800000000, true) AS opens
  FROM ev WINDOW w AS (PARTITION BY host, source ORDER BY us)),
bursts AS (SELECT host, source, us, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY host, source ORDER BY us) AS b FROM gaps)
SELECT host, source, max(us) AS ts_us, max(us) + 1800000000 AS fire_ts_us, count(*) AS n FROM bursts GROUP BY host, source, b
HAVING max(us) + 1800000000 <= ((SELECT max(us) FROM ev) - 600000000) // 1000 * 1000""")
def debounce_stream(spark, folder):
    """Closed bursts only: the last ones stay open until the watermark passes them."""
    return _run(feeds.debounce_stream(_stream(spark, folder), ["host", "source"], "30 minutes")).select(
        "host", "source", us(), us("fire_ts"), "n")


@query(f"WITH {EV} SELECT id FROM ev WHERE value < 45 UNION ALL SELECT id + 1000000000 FROM ev WHERE value >= 45")
def batch_flush(spark, folder):
    """Urgent entries by one query and ordinary ones by another; together they are all entries."""
    entries = _stream(spark, folder).withColumn("priority", F.floor(F.col("value") / 15))
    plan = feeds.batch_flush(entries.select("id", "priority"))
    urgent, ordinary = _run(plan.urgent), _run(plan.ordinary)
    return urgent.select("id").union(ordinary.select((F.col("id") + 1_000_000_000).alias("id")))


@query("SELECT concat('pkg', user_id, ' installed (', event_id, '-1)') AS summary FROM events")
def tail_package_log(spark, folder):
    """Package log lines written as new files, read as a stream of events."""
    e = table(spark, folder, "events")
    landed = new_path(spark, "log")
    e.select(F.concat(F.date_format("ts", "'['yyyy-MM-dd'T'HH:mm:ss'+0000] [ALPM] installed pkg'"),
                      F.col("user_id").cast("string"), F.lit(" ("), F.col("event_id").cast("string"), F.lit("-1)"),
                      F.lit("\n")).alias("value")).write.text(landed)
    return _run(package_events(parse_package_log(feeds.tail_lines(spark, landed)))).select("summary")


_CHANGES = (ORACLES["status_transitions"].replace("SELECT id, host, old, status AS new", "SELECT host, old, status AS new, count(*) AS n")
            + " GROUP BY ALL")


@query(_CHANGES)
def on_status_change(spark, folder):
    """The changes that status callbacks are called for, written out."""
    dedup.use_rocksdb(spark)
    changes = _run(feeds.status_changes(_stream(spark, folder)))
    return changes.groupBy("host", "old", "new").agg(F.count("*").alias("n"))


def _slices(spark, folder: str, n: int) -> DataFrame:
    """The event stream in `n` micro-batches of consecutive times."""
    raw = table(spark, folder, "events")
    cuts = raw.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).agg(
        F.percentile_approx("us", [i / n for i in range(1, n)])).first()[0]
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    landed = new_path(spark, "slices")
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = raw.where((us > low if low is not None else F.lit(True)) & (us <= high if high is not None else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(landed)
    return shape_events(feeds.read_files(spark, landed, raw.schema, max_files=1))


@query(_CHANGES)
def status_changes_of_batches(spark, folder):
    """The same over several micro-batches: hosts are quiet in between, their status is not forgotten."""
    dedup.use_rocksdb(spark)
    return (_run(feeds.status_changes(_slices(spark, folder, 6))).groupBy("host", "old", "new").agg(F.count("*").alias("n")))


@query(f"WITH {EV} SELECT host, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM ev GROUP BY ALL")
def append_two_streams(spark, folder):
    """Two streams, each with batch numbers from 0, write one table: no row is lost."""
    path = new_path(spark, "events")
    for name, part in (("odd", "id % 2 = 1"), ("even", "id % 2 = 0")):
        progress = new_path(spark, "progress")
        sink = feeds.store_sink(spark, path, name, progress)
        _drain(feeds.route_events(_stream(spark, folder).select(*EVENT_COLUMNS).where(part), [(None, sink)]), progress)
    return scan_events(spark, path).groupBy("host").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"WITH {EV} SELECT host, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM ev GROUP BY ALL")
def append_restarted_stream(spark, folder):
    """A stream that is stopped after some batches and goes on from its checkpoint writes every row once."""
    path, progress = new_path(spark, "events"), new_path(spark, "progress")
    stream = _slices(spark, folder, 4).select(*EVENT_COLUMNS)
    done = []

    def failing(batch, batch_id):
        if batch_id == 2 and not done:
            done.append(batch_id)
            append_events(batch.where("id % 2 = 0"), path, f"main-{batch_id}")  # the batch is cut off half written
            raise RuntimeError("stopped")
        sink(batch, batch_id)

    for _ in range(2):
        sink = feeds.store_sink(spark, path, "main", progress)
        try:
            _drain(stream.writeStream.foreachBatch(failing), progress)
        except StreamingQueryException:
            pass
    return scan_events(spark, path).groupBy("host").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


_LATE = "30 minutes"
_ARRIVAL = "(id * 7919 % 1200) * 1000000 + CASE WHEN id % 17 = 0 THEN 172800000000 ELSE 0 END"


def _arrived(rows: str) -> str:
    """SQL: `seen` are the rows as they come in six micro-batches, `late` if the watermark has passed them; `ontime`
    are those that are not and have left the buffer at the end."""
    return f"""cut AS (SELECT *, ((arrival - min(arrival) OVER ()) * 6) // (max(arrival) OVER () - min(arrival) OVER () + 1) AS slice
  FROM (SELECT *, us + {_ARRIVAL} AS arrival FROM ev)),
tops AS (SELECT slice, max(us) AS top FROM cut WHERE {rows} GROUP BY slice),
marks AS (SELECT slice, coalesce(max(top) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 - 1800000, 0) AS w
  FROM tops),
seen AS (SELECT cut.*, us // 1000 < w AS late FROM cut JOIN marks USING (slice) WHERE {rows}),
final AS (SELECT max(top) // 1000 - 1800000 AS w FROM tops),
ontime AS (SELECT seen.* FROM seen, final WHERE NOT late AND us // 1000 < w)"""


def _shuffled(spark, folder: str) -> DataFrame:
    """The event stream in six micro-batches by time of arrival: up to 20 minutes after the event, some two days."""
    raw = table(spark, folder, "events").withColumn("id", F.col("event_id"))
    came = raw.withColumn("arrival", F.unix_micros(F.col("ts").cast("timestamp")) + F.expr(_ARRIVAL)).drop("id")
    low, high = came.agg(F.min("arrival"), F.max("arrival")).first()
    if low is None:
        return _stream(spark, folder)
    landed, files = new_path(spark, "slices"), 4
    for n in range(6):
        part = came.where(F.expr(f"((arrival - {low}) * 6) div ({high} - {low} + 1) = {n}")).drop("arrival")
        part.repartition(files).write.mode("append").parquet(landed)
    return shape_events(feeds.read_files(spark, landed, table(spark, folder, "events").schema, max_files=files))


def _late_dedup(spark, folder):
    dedup.use_rocksdb(spark)
    message = F.concat("event_type", F.lit("["), F.col("id").cast("string"), F.lit("]"))
    rows = _shuffled(spark, folder).select(
        "id", "host", "source", "ts", fingerprint(F.col("source"), F.lit("app"), message).alias("fingerprint"))
    return _run(late.dedup_late_stream(rows, DEDUP, _LATE))


@query(ORACLES["dedup_by_fingerprint"].replace(f"WITH {EV}, marked", f"WITH {EV}, {_arrived('true')}, marked")
       .replace("AS fingerprint FROM ev)", "AS fingerprint FROM ontime)"))
def dedup_late_stream(spark, folder):
    """Suppression of a stream that arrives shuffled: what batch gives for the rows that came in time."""
    return _late_dedup(spark, folder).where("not late").select("id", "fingerprint", us(), "suppressed_count")


@query(f"WITH {EV}, {_arrived('true')} SELECT id, host, source, us AS ts_us FROM seen WHERE late")
def late_rows(spark, folder):
    """The side table of the same stream: rows that the watermark had passed when they came."""
    return _late_dedup(spark, folder).where("late").select("id", "host", "source", us())


_TIMELINE = ORACLES["status_timeline"]
_TIMELY = (_TIMELINE[:_TIMELINE.rindex("SELECT host, us AS start_ts_us")]
           .replace(f"WITH {EV}, steps", f"WITH {EV}, {_arrived("severity <> 'info'")}, steps")
           .replace("FROM ev WHERE severity <> 'info'", "FROM ontime"))


@query(_TIMELY + " SELECT host, us AS ts_us, old, status AS new FROM changed, final WHERE us // 1000 < w")
def status_expiry_stream(spark, folder):
    """Status changes of the shuffled stream, those by expiry included, up to the watermark."""
    dedup.use_rocksdb(spark)
    changes = _run(late.status_expiry_stream(_shuffled(spark, folder), delay=_LATE))
    return changes.where("not late").select("host", us(), "old", "new")


def _write_logs(lines: DataFrame, folder: str, append: bool) -> None:
    """Lines (host, id, line) into one file per host, written by the tasks that hold them."""
    def write(batches):
        store, place = tail.filesystem(folder)
        store.create_dir(place)
        host, out = None, None
        for batch in batches:
            rows = zip(batch.column("host").to_pylist(), batch.column("line").to_pylist())
            for name, run in groupby(rows, key=lambda row: row[0]):
                if name != host:
                    if out is not None:
                        out.close()
                    host, path = name, f"{place}/{name}.log"
                    out = store.open_append_stream(path) if append else store.open_output_stream(path)
                out.write("".join(line + "\n" for _, line in run).encode())
            yield batch.slice(0, 0)
        if out is not None:
            out.close()

    rows = lines.repartition("host").sortWithinPartitions("host", "id").select("host", "line")
    rows.mapInArrow(write, rows.schema).write.format("noop").mode("overwrite").save()


@query("SELECT concat('h', user_id % 3) AS host, concat('pkg', user_id, ' installed (', event_id, '-1)') AS summary FROM events")
def tail_growing_log(spark, folder):
    """Package logs, a file per host, that grow, are truncated and are rotated between triggers: every line is read once."""
    e = sample_events(spark, folder)
    lines = e.select("host", "id", F.concat(F.date_format("ts", "'['yyyy-MM-dd'T'HH:mm:ss'+0000] [ALPM] installed pkg'"),
                                            F.col("user_id").cast("string"), F.lit(" ("), F.col("id").cast("string"), F.lit("-1)")).alias("line"))
    logs, out, progress = (new_path(spark, x) for x in ("growing", "read", "progress"))
    for part, append in enumerate((True, True, False, False)):  # the third is shorter than what it replaces, the fourth as long
        _write_logs(lines.where(F.col("id") % 4 == part), logs, append)
        stream = package_events(parse_package_log(tail.tail_files(spark, logs, ".log", range_bytes=100_000))).select("host", "summary")
        (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema("host string, summary string").parquet(out)
