"""Repeat suppression and trends on streams, with keyed state.

Rows are taken in time order within a micro-batch; across batches the source is expected
to deliver them in order. The batch operators give the answer for out-of-order history.
State lives in RocksDB, one small record per key, and expires by event time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opsweave.config import DedupParams, TrendParams
from opsweave.operators.series import SERIES, _trend_step
from opsweave.operators.throttle import FP, MICROS, _types, greedy_kept, rate_limited_step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


class _Cooldown(StatefulProcessor):
    """Last emission, rows since, and last row of one fingerprint; forgotten after `keep_ms` of event time if given."""

    def __init__(self, params: DedupParams, keep_ms: int | None):
        self.gap, self.keep_ms = round(params.cooldown * MICROS), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "last long, since long, seen_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, ["us", "id"])
        known = self.state.exists()
        last, since, _ = self.state.get() if known else (None, 0, 0)
        us = pdf["us"].to_numpy()
        kept = greedy_kept(us, self.gap, last)
        counts, previous = [], -since if known else None
        for k in kept.tolist():
            counts.append(0 if previous is None else k - previous)
            previous = k
        if len(kept):
            last, since = int(us[kept[-1]]), int(len(us) - kept[-1])
        else:
            since += len(us)
        self.state.update((last, since, int(us[-1])))
        if not known and self.keep_ms is not None:
            self.handle.registerTimer(int(us[-1]) // 1000 + self.keep_ms)
        yield pdf.iloc[kept].assign(suppressed_count=pd.Series(counts, dtype="int64").to_numpy())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.state.get()[2] // 1000 + self.keep_ms
        if due <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        else:
            self.handle.registerTimer(due)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class _RateLimited(StatefulProcessor):
    """Decisions from the same step as in batch; counts per fingerprint in a map, dropped when pruned."""

    def __init__(self, params: DedupParams):
        self.step, self.stale = rate_limited_step(params), round(2 * params.baseline * MICROS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.carry = handle.getValueState("carry", "state string")
        self.seen = handle.getMapState("seen", "fingerprint string", "count long, last_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, ["us", "id"])
        state = json.loads(self.carry.get()[0]) if self.carry.exists() else None
        pruned = state[1] if state else None
        _, added, state = self.step({c: pdf[c].to_numpy() for c in ("us", "fingerprint")}, state)
        out = pdf.assign(**added)
        self.carry.update((json.dumps(state),))
        local: dict[str, tuple[int, int] | None] = {}
        counts = []
        for fp, us, passed, clock in zip(out["fingerprint"], out["us"], out["passed"], out["prune_us"]):
            if fp not in local:
                local[fp] = self.seen.getValue((fp,)) if self.seen.containsKey((fp,)) else None
            known = local[fp]
            if known is not None and known[1] < clock - self.stale:
                known = None
            count = 0 if known is None else known[0]
            counts.append(count if passed else 0)
            local[fp] = (1 if passed or known is None else count + 1, int(us))
        for fp, (count, us) in local.items():
            self.seen.updateValue((fp,), (count, us))
        if state[1] != pruned:
            old = [k[0] for k, v in self.seen.iterator() if v[1] < state[1] - self.stale]
            for fp in old:
                self.seen.removeKey((fp,))
        emitted = out.assign(suppressed_count=counts)
        yield emitted[emitted["passed"]].drop(columns=["passed", "prune_us"])

    def close(self) -> None:
        pass


def _narrow(stream: DataFrame) -> DataFrame:
    return stream.select(*FP, F.unix_micros("ts").alias("us"), "id",
                         *[c for c in stream.columns if c not in (*FP, "ts", "id")])


def _widen(out: DataFrame) -> DataFrame:
    return out.withColumn("ts", F.timestamp_micros("us")).drop("us")


def dedup_stream(stream: DataFrame, params: DedupParams = DedupParams(), keep_hours: float | None = None,
                 delay: str = "10 minutes") -> DataFrame:
    """Emitted rows, keyed by fingerprint, decided as in batch.

    State is one small record per fingerprint. With `keep_hours` one unseen for so long is
    forgotten and counts as first again, which bounds the state and is not what batch does.
    """
    rows = _narrow(stream.withWatermark("ts", delay))
    out = rows.groupBy(*FP).transformWithStateInPandas(
        statefulProcessor=_Cooldown(params, None if keep_hours is None else int(keep_hours * 3_600_000)),
        outputStructType=f"{_types(rows, rows.columns)}, suppressed_count long",
        outputMode="Append", timeMode="EventTime")
    return _widen(out)


def dedup_rate_limited_stream(stream: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """Emitted rows under cooldown, rate limit and pruning, keyed by (host, source)."""
    rows = _narrow(stream)
    out = rows.groupBy("host", "source").transformWithStateInPandas(
        statefulProcessor=_RateLimited(params),
        outputStructType=f"{_types(rows, rows.columns)}, suppressed_count long",
        outputMode="Append", timeMode="None")
    return _widen(out)


class _Trend(StatefulProcessor):
    def __init__(self, params: TrendParams, threshold: float):
        self.step, self.threshold = _trend_step(params), threshold
        self.cooldown = round(params.cooldown * MICROS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.carry = handle.getValueState("carry", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, ["us", "value"])
        series, last = json.loads(self.carry.get()[0]) if self.carry.exists() else (None, None)
        _, added, series = self.step({c: pdf[c].to_numpy() for c in ("us", "value")}, series)
        out = pdf.assign(**added)
        over = out[out["slope"].abs() >= self.threshold]
        kept = greedy_kept(over["us"].to_numpy(), self.cooldown, last)
        alerts = over.iloc[kept]
        if len(alerts):
            last = int(alerts["us"].iloc[-1])
        self.carry.update((json.dumps([series, last]),))
        yield alerts

    def close(self) -> None:
        pass


def trend_stream(samples: DataFrame, params: TrendParams, threshold: float) -> DataFrame:
    """Trend alerts of a sample stream, keyed by series."""
    rows = samples.where(F.col("value").isNotNull()).select(
        *SERIES, F.unix_micros("ts").alias("us"), F.col("value").cast("double").alias("value"))
    out = rows.groupBy(*SERIES).transformWithStateInPandas(
        statefulProcessor=_Trend(params, threshold),
        outputStructType="host string, metric string, us long, value double, ema double, slope double",
        outputMode="Append", timeMode="None")
    return _widen(out).withColumn("direction", F.when(F.col("slope") > 0, "rising").otherwise("falling"))
