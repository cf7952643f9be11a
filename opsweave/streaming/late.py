"""Rows that arrive out of order: held back until the watermark has passed them, then taken in order.

The stateful steps expect a key's rows in time order. `in_order` puts a buffer before any of them: a
row waits, keyed like the step, until the watermark is past its time; a timer then hands all that is due
to the step, sorted. A row older than the watermark when it comes can no longer be placed: it goes out
marked `late` and leaves the step's state alone, so what is put out otherwise is exactly what the batch
operators give for the rows that came in time. All times are compared in milliseconds, the watermark's unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opsweave.config import DedupParams, TrendParams
from opsweave.operators.status import HOUR
from opsweave.operators.throttle import FP, _types
from opsweave.streaming.dedup import SERIES, _Cooldown, _RateLimited, _Trend


class InOrder(StatefulProcessor):
    """A buffer of waiting rows before another processor, which gets them sorted.

    State of a key: its rows of the last `delay`, and the time of the earliest one, for which a timer runs. A
    processor with a method `expire(key, timerValues)` is called after every release as well.
    """

    def __init__(self, inner: StatefulProcessor, columns: list[str], state: str, order: list[str], out: list[str]):
        self.inner, self.columns, self.state, self.order, self.out = inner, columns, state, order, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.state)
        self.due = handle.getValueState("due", "ms long")
        self.inner.init(handle)

    def _shaped(self, frame: pd.DataFrame, late: bool) -> pd.DataFrame:
        rows = frame.reset_index(drop=True)
        missing = {c: pd.Series([None] * len(rows), dtype=object) for c in self.out if c not in rows}
        return rows.assign(**missing, late=late)[[*self.out, "late"]]

    def _wait_for(self, ms: int) -> None:
        due = self.due.get()[0] if self.due.exists() else None
        if due is None or ms < due:
            self.handle.registerTimer(ms + 1)
            self.due.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            late = frame["us"] // 1000 < now
            fresh = frame.loc[~late, self.columns].astype(object)
            if len(fresh):
                fresh = fresh.where(fresh.notna(), None)
                self.waiting.appendList([tuple(r) for r in fresh.itertuples(index=False)])
                self._wait_for(int(fresh["us"].min()) // 1000)
            if late.any():
                yield self._shaped(frame[late], True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        at = self.columns.index("us")
        ready, rest = [r for r in held if r[at] // 1000 < now], [r for r in held if r[at] // 1000 >= now]
        if ready:
            self.due.clear()
            if rest:
                self.waiting.put(rest)
                self._wait_for(min(r[at] for r in rest) // 1000)
            else:
                self.waiting.clear()
            frame = pd.DataFrame(ready, columns=self.columns).sort_values(self.order, kind="stable", ignore_index=True)
            for out in self.inner.handleInputRows(key, iter([frame]), timerValues):
                if len(out):
                    yield self._shaped(out, False)
        if hasattr(self.inner, "expire"):
            for out in self.inner.expire(key, timerValues):
                if len(out):
                    yield self._shaped(out, False)

    def close(self) -> None:
        self.inner.close()


def in_order(stream: DataFrame, keys: list[str], inner: StatefulProcessor, out: str, delay: str,
             order: list[str] = ("us", "id")) -> DataFrame:
    """What `inner` puts out (columns `out`) for rows that come within `delay`, and `late` rows.

    `stream` needs `ts`, which the processor sees as `us` (microseconds); rows without a time are not taken. Late
    rows have the columns of `out` that the stream has, the rest is null. What is younger than the watermark stays
    in the buffer when a stream ends. State is RocksDB's, so a key's buffer need not fit in memory between batches.
    """
    rows = (stream.where(F.col("ts").isNotNull()).withWatermark("ts", delay)
            .select(*[c for c in stream.columns if c != "ts"], F.unix_micros("ts").alias("us")))
    # the column with the watermark is gone: the engine would drop late rows unseen
    names = [f.name for f in T.StructType.fromDDL(out).fields]
    shaped = rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=InOrder(inner, rows.columns, _types(rows, rows.columns), list(order), names),
        outputStructType=f"{out}, late boolean", outputMode="Append", timeMode="EventTime")
    return shaped.withColumn("ts", F.timestamp_micros("us")).drop("us")


def dedup_late_stream(stream: DataFrame, params: DedupParams = DedupParams(), delay: str = "10 minutes") -> DataFrame:
    """Emitted rows of a stream in any order, decided as in batch, keyed by fingerprint; and the late rows, undecided."""
    kinds = stream.withColumn("us", F.lit(0).cast("long")).drop("ts")
    return in_order(stream, FP, _Cooldown(params, None), f"{_types(kinds, kinds.columns)}, suppressed_count long", delay)


def dedup_rate_limited_late_stream(stream: DataFrame, params: DedupParams = DedupParams(), delay: str = "10 minutes") -> DataFrame:
    """The same under the rate limit of a source, keyed by (host, source)."""
    kinds = stream.withColumn("us", F.lit(0).cast("long")).drop("ts")
    return in_order(stream, ["host", "source"], _RateLimited(params), f"{_types(kinds, kinds.columns)}, suppressed_count long", delay)


def trend_late_stream(samples: DataFrame, params: TrendParams, threshold: float, delay: str = "10 minutes") -> DataFrame:
    """Trend alerts of samples in any order, and the late samples."""
    rows = samples.where(F.col("value").isNotNull()).select(*SERIES, "ts", F.col("value").cast("double").alias("value"))
    return in_order(rows, SERIES, _Trend(params, threshold),
                    "host string, metric string, us long, value double, ema double, slope double", delay, ["us", "value"])


class ExpiringStatus(StatefulProcessor):
    """Status of one host, from rows in order; a timer tells when an event leaves the window, with no row coming.

    State: status, times of the last critical event and the last warning that still count, time of the timer.
    """

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", "status string, critical_us long, warning_us long, alarm_ms long")

    def _advance(self, host: str, rows: list[tuple], now: int) -> pd.DataFrame:
        """Changes at the times of `rows` (us, id, severity) and at all moments before the watermark at which one expires."""
        status, critical, warning, alarm = self.state.get() if self.state.exists() else ("healthy", None, None, None)
        out, i, width = [], 0, self.window_us
        while True:
            leaves = min((t + width for t in (critical, warning) if t is not None), default=None)
            comes = rows[i][0] if i < len(rows) else None
            if comes is None and (leaves is None or leaves // 1000 >= now):
                break
            at = comes if leaves is None or (comes is not None and comes < leaves) else leaves
            cause = None
            while i < len(rows) and rows[i][0] == at:
                if rows[i][2] == "critical":
                    critical = at
                else:
                    warning = at
                cause = rows[i][1]
                i += 1
            critical = None if critical is not None and at - critical >= width else critical
            warning = None if warning is not None and at - warning >= width else warning
            new = "critical" if critical is not None else "degraded" if warning is not None else "healthy"
            if new != status:
                out.append((host, cause, at, status, new))
                status = new
        if leaves is not None and (alarm is None or alarm <= now or leaves // 1000 + 1 < alarm):
            alarm = leaves // 1000 + 1
            self.handle.registerTimer(alarm)
        self.state.update((status, critical, warning, alarm))
        frame = pd.DataFrame(out, columns=["host", "id", "us", "old", "new"], dtype=object)
        return frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            loud = [(int(us), i, level) for us, i, level in zip(pdf["us"], pdf["id"], pdf["severity"])]
            yield self._advance(key[0], loud, timerValues.getCurrentWatermarkInMs())

    def expire(self, key, timerValues) -> Iterator[pd.DataFrame]:
        yield self._advance(key[0], [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def status_expiry_stream(events: DataFrame, window: float = HOUR, delay: str = "10 minutes") -> DataFrame:
    """Status changes (host, ts, id, old, new) of a stream in any order, those by expiry included, and late events.

    A host falls back by itself once the watermark passes the end of its last event's window; such rows have no
    `id`. All hosts share the watermark, so a silent host expires while others speak. Changes are those of
    `status_timeline` up to the watermark.
    """
    loud = events.where(F.col("severity").isin("critical", "warning")).select("host", "id", "ts", "severity")
    kind = dict(loud.dtypes)["id"]
    return in_order(loud, ["host"], ExpiringStatus(round(window * 1e6)),
                    f"host string, id {kind}, us long, severity string, old string, new string", delay)
