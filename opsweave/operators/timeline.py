"""Rows of one key in time order, for keys of any size.

Operators that look back along a key (previous row, last known state, running
count) need its rows in order, yet a key may hold a large share of the table. So work
always goes by (key, bucket), buckets being fixed ranges of the order: what a bucket
needs from those before it is one value, its carry. Every bucket is reduced to what it
leaves behind (a combined aggregate of few columns), carries run through one small window over
the buckets of a key, and come back as one row in front of each bucket's own rows. The
width of a bucket never changes the result, and the plan is the same at every size.
`carry` leaves keys of at most BUCKET_STEPS rows whole: cut by day, they would be about as many buckets as rows.

Folds, whose decisions depend on their own earlier output, stream sorted rows through
tasks in Arrow batches with a state of bounded size. Where what a run of rows does to any
state can be summed up (`split_fold`), that too goes by (key, bucket): runs are summed up side by
side, the summaries of a key are composed in order, and every bucket starts from its true state.
A key of at most BUCKET_STEPS rows is one run, so that many small keys cost no summaries and no state per bucket.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Width of a bucket: seconds of a time (or of microseconds in `us`, `_us`), steps of another number.
BUCKET_SECONDS, BUCKET_STEPS = 86_400, 65_536
BUCKET, REAL, LARGE = "_bucket", "_real", "_large"


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only when running locally."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="opsweave-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read again: what reads it more than once has it made once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_of(df: DataFrame, column: str, width: int | None = None) -> Column:
    """A number (or the value itself) that never falls as `column` grows."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        micros = F.unix_micros(F.col(column).cast("timestamp"))
        return F.call_function("div", micros, F.lit((width or BUCKET_SECONDS) * 1_000_000))
    if isinstance(kind, T.IntegralType):
        step = (width or BUCKET_SECONDS) * 1_000_000 if column in ("us", "_us") else width or BUCKET_STEPS
        return F.call_function("div", F.col(column), F.lit(step))
    return F.col(column)


class Timeline:
    """A table viewed as ordered rows per key.

    `order` must order the rows of a key totally. Methods return a new Timeline; `df` is the
    table with the columns added so far.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], width: int | None = None):
        self.df, self.keys, self.order, self.width = df, keys, order, width

    def _with(self, df: DataFrame) -> Timeline:
        return Timeline(df, self.keys, self.order, self.width)

    def with_columns(self, columns: dict[str, Column]) -> Timeline:
        return self._with(self.df.withColumns(columns))

    def where(self, condition: Column) -> Timeline:
        return self._with(self.df.where(condition))

    def _window(self, reverse: bool):
        """Rows of a bucket in order, its carry first."""
        return (Window.partitionBy(*self.keys, BUCKET)
                .orderBy(REAL, *[F.desc(c) if reverse else F.asc(c) for c in self.order]))

    def _earlier(self, reverse: bool):
        return (Window.partitionBy(*self.keys).orderBy(F.desc(BUCKET) if reverse else F.asc(BUCKET))
                .rowsBetween(Window.unboundedPreceding, -1))

    def _led(self, rows: DataFrame, carries: DataFrame) -> DataFrame:
        return rows.withColumn(REAL, F.lit(True)).unionByName(
            carries.withColumn(REAL, F.lit(False)), allowMissingColumns=True)

    def carry(self, values: dict[str, Column], reverse: bool = False) -> Timeline:
        """For each name, the last non-null value among the rows strictly before this one;
        with `reverse`, the next one among the rows after it."""
        held = {name: f"_value_{name}" for name in values}
        marked = _marked(self._with(self.df.withColumns({held[n]: v for n, v in values.items()})))
        rows = marked.drop(LARGE)
        at, nearest = F.struct(*self.order), F.min_by if reverse else F.max_by
        ends = marked.where(LARGE).groupBy(*self.keys, BUCKET).agg(
            *[nearest(h, F.when(F.col(h).isNotNull(), at)).alias(h) for h in held.values()])
        carries = ends.select(*self.keys, BUCKET, *[
            F.last(h, ignorenulls=True).over(self._earlier(reverse)).alias(h) for h in held.values()])
        before = self._window(reverse).rowsBetween(Window.unboundedPreceding, -1)
        found = self._led(rows, carries).withColumns(
            {n: F.last(h, ignorenulls=True).over(before) for n, h in held.items()})
        return self._with(found.where(REAL).drop(BUCKET, REAL, *held.values()))

    def index(self, name: str, reverse: bool = False) -> Timeline:
        """Position of the row within its key, from 1; with `reverse`, counted from the end."""
        rows = self.df.withColumn(BUCKET, bucket_of(self.df, self.order[0], self.width))
        counts = rows.groupBy(*self.keys, BUCKET).agg(F.count(F.lit(1)).alias("_ones"))
        carries = counts.select(*self.keys, BUCKET, F.sum("_ones").over(self._earlier(reverse)).alias("_ones"))
        upto = self._window(reverse).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = self._led(rows.withColumn("_ones", F.lit(1).cast("long")), carries).withColumn(name, F.sum("_ones").over(upto))
        return self._with(found.where(REAL).drop(BUCKET, REAL, "_ones"))

    def running(self, values: dict[str, Column]) -> Timeline:
        """For each name, the sum of a whole number over the rows strictly before this one; 0 for the first."""
        held = {name: f"_value_{name}" for name in values}
        rows = self.df.withColumns({held[n]: F.coalesce(v, F.lit(0)).cast("long") for n, v in values.items()}).withColumn(
            BUCKET, bucket_of(self.df, self.order[0], self.width))
        totals = rows.groupBy(*self.keys, BUCKET).agg(*[F.sum(h).alias(h) for h in held.values()])
        carries = totals.select(*self.keys, BUCKET, *[F.sum(h).over(self._earlier(False)).alias(h) for h in held.values()])
        before = self._window(False).rowsBetween(Window.unboundedPreceding, -1)
        found = self._led(rows, carries).withColumns(
            {n: F.coalesce(F.sum(h).over(before), F.lit(0)) for n, h in held.items()})
        return self._with(found.where(REAL).drop(BUCKET, REAL, *held.values()))

    def fold(self, step: Step, added: str, reads: list[str] = ()) -> DataFrame:
        """Run `step` along each key; see :func:`fold_rows`."""
        return fold_rows(self, step, added, reads)

    def split_fold(self, step: Step, added: str, summarize: Summarize, advance: Advance, reads: list[str] = ()) -> DataFrame:
        """Like `fold`, with a key's buckets worked on side by side; see :func:`split_fold`."""
        return split_fold(self, step, added, summarize, advance, reads)


# A step takes the columns of consecutive rows of one key and the state left by the rows
# before (None at the start of the key). It returns the positions of the rows to put out
# (None for all), new columns for them, and the new state, of bounded size.
Columns = dict[str, np.ndarray]
Step = Callable[[Columns, Any], "tuple[np.ndarray | None, Columns, Any]"]


def _plain(key: tuple) -> tuple:
    return tuple(None if k is None or k != k else str(k) for k in key)


def _runs(columns: Columns, by: list[str], n: int) -> list[tuple[int, int]]:
    """Start and end of each run of rows with equal keys."""
    new = np.zeros(n, dtype=bool)
    for k in by:
        here = pd.Series(columns[k])
        before = here.shift()
        new |= (here.ne(before) & ~(here.isna() & before.isna())).to_numpy()
    new[0] = True
    starts = np.flatnonzero(new).tolist()
    return list(zip(starts, [*starts[1:], n]))


# What a run of rows does to any state, as a JSON value, and the state after a run by that value.
Summarize = Callable[[Columns], Any]
Advance = Callable[[Any, Any], Any]


def _folded(rows: DataFrame, keys: list[str], order: list[str], step: Step, added: str, reads: list[str],
            entry: str | None = None) -> DataFrame:
    """Sorted rows through `step`. With `entry`, a row where REAL is false leads a key and holds its first state."""
    seen = list(dict.fromkeys([*keys, *[c for c in order if c != REAL], *reads]))
    names = [field.split()[0] for field in added.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: _values(batch.column(c)) for c in seen}
            taken, new_columns = [np.array([], dtype=np.int64)], defaultdict(list)
            for a, b in _runs(columns, keys, batch.num_rows):
                key = _plain(tuple(columns[k][a] for k in keys))
                if key != held:
                    held, state = key, None
                if entry and not batch.column(REAL)[a].as_py():
                    state = json.loads(batch.column(entry)[a].as_py())
                    a += 1
                    if a == b:
                        continue
                keep, new, state = step({c: v[a:b] for c, v in columns.items()}, state)
                taken.append(np.arange(a, b) if keep is None else keep + a)
                for name in names:
                    new_columns[name].append(new[name])
            if not new_columns:
                continue
            out = batch.take(pa.array(np.concatenate(taken), type=pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*out.columns, *[pa.array(np.concatenate(new_columns[n])) for n in names]], names=[*out.schema.names, *names])

    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(added).fields])
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _values(column: pa.Array) -> np.ndarray:
    """Whole numbers stay whole where the rows that lead a bucket have none."""
    whole = pa.types.is_integer(column.type) and column.null_count
    return (column.fill_null(0) if whole else column).to_pandas().to_numpy()


def fold_rows(timeline: Timeline, step: Step, added: str, reads: list[str] = ()) -> DataFrame:
    """Apply a step that depends on its own earlier output; adds the columns `added` ("name type, ..").

    Rows are shuffled by key, sorted by Spark and streamed through in Arrow batches, many
    keys to a batch; the state passes from batch to batch, so a key need not fit in memory.
    The step sees keys, order and `reads`; all other columns stay in Arrow as they are.
    """
    return _folded(timeline.df, timeline.keys, timeline.order, step, added, list(reads))


def _marked(timeline: Timeline) -> DataFrame:
    """The rows with LARGE, whether their key has more than BUCKET_STEPS rows, and their bucket, which is null if not.

    The keys of more rows, of which there is at most one per so many rows, are broadcast.
    """
    df, keys = timeline.df, timeline.keys
    large = (df.groupBy(*[F.col(k).alias(f"_large_{k}") for k in keys]).agg(F.count(F.lit(1)).alias(LARGE))
             .where(F.col(LARGE) > BUCKET_STEPS))
    same = [F.col(k).eqNullSafe(F.col(f"_large_{k}")) for k in keys]
    return (df.join(F.broadcast(large), reduce(Column.__and__, same), "left").withColumn(LARGE, F.col(LARGE).isNotNull())
            .withColumn(BUCKET, F.when(F.col(LARGE), bucket_of(df, timeline.order[0], timeline.width)))
            .drop(*[f"_large_{k}" for k in keys]))


def split_fold(timeline: Timeline, step: Step, added: str, summarize: Summarize, advance: Advance,
               reads: list[str] = ()) -> DataFrame:
    """A fold whose runs of rows can be summed up: no task holds more than the buckets dealt to it.

    Keys of at most BUCKET_STEPS rows are folded whole. Of the others one pass over the narrow columns sums up each run of
    a bucket; the summaries of a key, one per bucket or Arrow batch, are composed in order; the rows then fold from
    their bucket's entry state. The rows are read for the count of a key's rows, for the summaries and for the fold.
    """
    keys, order = timeline.keys, timeline.order
    rows = _marked(timeline).drop(LARGE)
    by = [*keys, BUCKET]
    narrow = rows.where(F.col(BUCKET).isNotNull()).select(*dict.fromkeys([*by, *order, *reads]))
    kinds = {f.name: f for f in narrow.schema.fields}

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(c).to_pandas().to_numpy() for c in kinds}
            starts, numbers, texts = [], [], []
            for a, b in _runs(columns, by, batch.num_rows):
                key = _plain(tuple(columns[k][a] for k in by))
                held, number = key, number + 1 if key == held else 0
                starts.append(a)
                numbers.append(number)
                texts.append(json.dumps(summarize({c: v[a:b] for c, v in columns.items()})))
            first = batch.select(by).take(pa.array(starts, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([*first.columns, pa.array(numbers, type=pa.int64()), pa.array(texts)],
                                             names=[*by, "_number", "_summary"])

    summaries = narrow.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(
        summed, T.StructType([*[kinds[c] for c in by], T.StructField("_number", T.LongType()), T.StructField("_summary", T.StringType())]))

    def compose(columns: Columns, state):
        before = []
        for text in columns["_summary"]:
            before.append(json.dumps(state))
            state = advance(json.loads(text), state)
        return None, {"_state": np.array(before, dtype=object)}, state

    states = _folded(summaries, keys, [BUCKET, "_number"], compose, "_state string", ["_summary"]).where("_number = 0").select(*by, "_state")
    led = rows.withColumn(REAL, F.lit(True)).unionByName(states.withColumn(REAL, F.lit(False)), allowMissingColumns=True)
    return _folded(led, by, [REAL, *order], step, added, list(reads), entry="_state").drop(BUCKET, REAL, "_state")
