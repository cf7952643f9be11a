"""Greedy cooldowns and repeat suppression.

Whether a row is kept depends on which earlier rows were kept, which no window
function can say; each operator here is a fold along a key (see `timeline`).
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsweave.config import DedupParams
from opsweave.operators import rate_limit
from opsweave.operators.timeline import Columns, Timeline

MICROS = 1_000_000


def greedy_kept(ts: np.ndarray, gap: int, last: int | None) -> np.ndarray:
    """Positions kept when a row passes iff it is `gap` after the last row that passed."""
    if gap <= 0:
        return np.arange(len(ts))
    kept = []
    i = 0 if last is None else int(np.searchsorted(ts, last + gap, "left"))
    while i < len(ts):
        kept.append(i)
        i = int(np.searchsorted(ts, ts[i] + gap, "left"))
    return np.array(kept, dtype=np.int64)


def cooldown_summary(us: np.ndarray, gap: int) -> list:
    """What a run of rows does to any cooldown: rows, and for the rows at which it can enter (those within a gap
    of the first, and one after) the last row kept from there and the rows from that on. Entries that
    end alike are one piece, told by its latest entry time; chains of an irregular series soon merge."""
    n = len(us)
    following = np.append(np.searchsorted(us, us + gap, "left") if gap > 0 else np.arange(1, n + 1), n)
    jumps = [following]
    while (jumps[-1][:n] < n).any():
        jumps.append(jumps[-1][jumps[-1]])
    entries = np.arange(min(int(np.searchsorted(us, us[0] + max(gap, 0), "left")), n - 1) + 1)
    at = entries
    for jump in reversed(jumps):  # doubling: as far as the chain goes within the run
        at = np.where(jump[at] < n, jump[at], at)
    last_of = np.append(np.flatnonzero(at[1:] != at[:-1]), len(at) - 1)
    return [n, us[entries[last_of]].tolist(), us[at[last_of]].tolist(), (n - at[last_of]).tolist()]


def after_cooldown(summary: list, state: list | None, gap: int) -> list:
    """[time of the last row kept, rows since, that one included] after a run."""
    n, entry, last, since = summary
    piece = 0 if state is None else bisect_left(entry, state[0] + gap)
    return [state[0], state[1] + n] if piece == len(entry) else [last[piece], since[piece]]


def _types(df: DataFrame, columns: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def cooldown_rows(df: DataFrame, keys: list[str], gap: float, ts: str = "ts", tie: str = "id",
                  kept_only: bool = True) -> DataFrame:
    """All columns of the rows a cooldown of `gap` seconds keeps, with `repeats`; or of all rows, with `passed` as well.

    `repeats` counts the key's rows since the row kept before, that row included; 0 for the
    first. Rows are told apart by their place in the order, so equal rows are decided one by one.
    """
    width = round(gap * MICROS)

    def step(rows: Columns, state):
        us = rows["_us"]
        last, since = state or (None, 0)
        kept = greedy_kept(us, width, last)
        repeats = np.diff(kept, prepend=0 if last is None else -since)
        if len(kept):
            last, since = int(us[kept[-1]]), int(len(us) - kept[-1])
        else:
            since += len(us)
        if kept_only:
            return kept, {"repeats": repeats}, [last, since]
        every, passed = np.zeros(len(us), dtype=np.int64), np.zeros(len(us), dtype=bool)
        every[kept], passed[kept] = repeats, True
        return None, {"repeats": every, "passed": passed}, [last, since]

    timed = df.withColumn("_us", F.unix_micros(ts))
    return Timeline(timed, keys, ["_us", tie]).split_fold(
        step, "repeats long" if kept_only else "repeats long, passed boolean",
        lambda rows: cooldown_summary(rows["_us"], width), lambda summary, state: after_cooldown(summary, state, width)).drop("_us")


def throttle(df: DataFrame, keys: list[str], gap: float, ts: str = "ts", tie: str = "id") -> DataFrame:
    """The first row per key, then every row at least `gap` seconds after the last row kept."""
    return cooldown_rows(df, keys, gap, ts, tie).drop("repeats")


FP = ["host", "source", "fingerprint"]


def dedup_by_fingerprint(df: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """Rows to emit, one fingerprint at a time, with `suppressed_count`.

    df: host, source, fingerprint, ts, id and any payload. A repeat passes once the
    cooldown since the last emission is over; of rows equal in all columns only one can pass.
    """
    return cooldown_rows(df, FP, params.cooldown).withColumnRenamed("repeats", "suppressed_count")


def dedup_decisions(df: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """Every row with its action (emit or suppress) and suppressed count."""
    return _actions(cooldown_rows(df, FP, params.cooldown, kept_only=False).withColumn("_n", F.when(F.col("passed"), F.col("repeats")))
                    .drop("passed", "repeats"))


def _actions(df: DataFrame) -> DataFrame:
    return df.select("*", F.when(F.col("_n").isNotNull(), "emit").otherwise("suppress").alias("action"),
                     F.coalesce("_n", F.lit(0)).alias("suppressed_count")).drop("_n")


def rate_limited_step(params: DedupParams):
    """Fold step over one source: which rows pass cooldown and rate limit, and the prune clock.

    A row passes if its source has fewer than `max_per_period` emissions in the last
    `period` seconds and its fingerprint's cooldown is over. The state holds the emissions
    that can still matter, which the rate limit itself bounds, and the last prune time.
    """
    period, cooldown = round(params.period * MICROS), round(params.cooldown * MICROS)
    prune_gap = round(2 * params.baseline * MICROS)
    limit, reach = params.max_per_period, max(period, cooldown)

    def step(rows: Columns, state):
        us, fps = rows["us"], rows["fingerprint"]
        emitted, pruned = state or ([], None)
        recent = deque(t for t, _ in emitted)
        last_of = {fp: t for t, fp in emitted}
        log = [tuple(e) for e in emitted]
        passed = np.zeros(len(us), dtype=bool)
        i = 0
        while i < len(us):
            now = int(us[i])
            while recent and recent[0] < now - period:
                recent.popleft()
            if len(recent) >= limit:  # blocked until the oldest of the emissions leaves the period
                i = int(np.searchsorted(us, recent[-limit] + period, "right"))
                continue
            last = last_of.get(fps[i])
            if last is None or now - last >= cooldown:
                passed[i] = True
                last_of[fps[i]] = now
                recent.append(now)
                log.append((now, fps[i]))
            i += 1

        prunes = us[greedy_kept(us, prune_gap, pruned)]
        if pruned is not None:
            prunes = np.insert(prunes, 0, pruned)
        clock = prunes[np.searchsorted(prunes, us, "right") - 1]
        live = [[t, fp] for t, fp in log if t >= int(us[-1]) - reach]
        return None, {"passed": passed, "prune_us": clock}, [live, int(prunes[-1])]

    return step


def dedup_rate_limited(df: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """Every row with its action under cooldown, rate limit and state pruning.

    The rate limit couples all fingerprints of a source; :mod:`rate_limit` walks the buckets of a source side by
    side all the same, and writes what it decided. Counts of suppressed rows need no walk: they are differences of
    positions within the fingerprint, which is keyed finer. A fingerprint unseen for
    twice the baseline when the prune clock ticks is forgotten, and counts as first again.
    """
    timed = df.withColumn("us", F.unix_micros("ts"))
    decided = rate_limit.decided(timed, params, rate_limited_step(params), cooldown_summary, after_cooldown)
    # a total order again, for rows that are equal: at one time, what passed comes first
    decided = decided.withColumn("_late", ~F.col("passed"))
    gap = round(2 * params.baseline * MICROS)
    rows = Timeline(decided, FP, ["us", "id", "_late"]).carry({"_prev": F.col("us")}).index("_pos")
    rows = rows.with_columns({"_first": F.col("_prev").isNull() | (F.col("_prev") < F.col("prune_us") - gap)})
    rows = rows.carry({"_anchor": F.when(F.col("passed") | F.col("_first"), F.col("_pos"))})
    n = F.when(F.col("passed"), F.when(F.col("_first"), 0).otherwise(F.col("_pos") - F.col("_anchor")))
    return _actions(rows.df.withColumn("_n", n).drop("us", "passed", "prune_us", "_late", "_prev", "_pos", "_first", "_anchor"))


def dedup_stats(decisions: DataFrame, width: str = "1 hour") -> DataFrame:
    """Per time window: rows in, emitted, suppressed, and fingerprints seen.

    Distinct fingerprints are counted over (window, fingerprint) groups, so that no
    window's rows meet in one task before they are reduced.
    """
    per_fp = (decisions.groupBy(F.window("ts", width).alias("w"), "host", "fingerprint")
              .agg(F.count(F.lit(1)).alias("entries"),
                   F.count_if(F.col("action") == "emit").alias("published")))
    return (per_fp.groupBy("w", "host")
            .agg(F.sum("entries").alias("entries"), F.sum("published").alias("published"),
                 F.count(F.lit(1)).alias("tracked"))
            .select("host", F.col("w.start").alias("window_start"), "entries", "published",
                    (F.col("entries") - F.col("published")).alias("suppressed"), "tracked"))


def debounce(df: DataFrame, keys: list[str], quiet: float = 0.2) -> DataFrame:
    """One firing per burst: rows with nothing after them for `quiet` seconds fire once it has passed."""
    width = round(quiet * MICROS)
    later = Timeline(df, keys, ["ts", "id"]).carry({"_next": F.col("ts")}, reverse=True).df
    gap = F.unix_micros("_next") - F.unix_micros("ts")
    return (later.where(F.col("_next").isNull() | (gap >= width))
            .withColumn("fire_ts", F.timestamp_micros(F.unix_micros("ts") + width)).drop("_next"))
