"""The rate limit of a source, with a source's history worked on by many tasks.

Which rows pass couples all rows of a (host, source), yet only emissions of the last period or cooldown
matter to a row. History is cut into buckets of time at least that long, so a bucket needs from the one before it
just those emissions, and two histories that differ soon emit the same rows. Hence, in rounds:

1. each bucket's end is guessed by walking its last stretch from nothing, all buckets side by side;
2. all buckets are walked from their neighbours' guesses, side by side, and written, with their true ends;
3. buckets that began from a guess that was not their neighbour's end are walked again from that end;
4. where ends still differ, which takes a source that is held at its limit for whole buckets, what is
   left of that source's history from the first such bucket on is walked in order by one task, in bounded memory.

The result is that of one walk, whatever the guesses were. The clock at which old fingerprints are forgotten does not
depend on emissions; it is composed from summaries of runs.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsweave.config import DedupParams
from opsweave.operators import timeline
from opsweave.operators.timeline import BUCKET, REAL, Columns, _folded, new_path

SOURCE = ["host", "source"]
#: Periods (or cooldowns, if longer) that a guess walks at the end of a bucket.
WARM = 20
MICROS = 1_000_000


def bucket_width(params: DedupParams) -> int:
    """Microseconds: a bucket must be longer than the time for which an emission matters."""
    return max(round(timeline.BUCKET_SECONDS * MICROS), round(max(params.period, params.cooldown) * MICROS) + 1)


def _stamp(live: list, end: int, reach: int) -> str:
    """The emissions that matter from `end` on, as a text that is equal if they are."""
    return json.dumps([[int(t), fp] for t, fp in live if t >= end - reach])


def _written(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def decided(timed: DataFrame, params: DedupParams, step, summarize, advance) -> DataFrame:
    """All rows (with `us`) and `passed`, `prune_us`, written to the shared folder.

    `step` is the walk over (us, fingerprint) with the state [emissions, clock]; `summarize(us, gap)` and
    `advance(summary, state, gap)` are those of a cooldown, for the clock.
    """
    width, reach = bucket_width(params), round(max(params.period, params.cooldown) * MICROS)
    gap, warm = round(2 * params.baseline * MICROS), WARM * reach
    by = [*SOURCE, BUCKET]
    rows = timed.withColumn(BUCKET, F.floor(F.col("us") / F.lit(width)))

    def end_of(columns: Columns) -> int:
        return (int(columns[BUCKET][0]) + 1) * width

    def look(columns: Columns, state):
        """Per run of a bucket: the guess of its end so far, and its summary for the clock; one row each."""
        us, end = columns["us"], end_of(columns)
        live, run = state or ([], 0)
        a = int(np.searchsorted(us, end - warm))
        if a < len(us):
            _, _, (live, _) = step({"us": us[a:], "fingerprint": columns["fingerprint"][a:]}, [live, None] if live else None)
        return (np.array([len(us) - 1]), {"_guess": np.array([_stamp(live, end, reach)], dtype=object), "_run": np.array([run]),
                                          "_ticks": np.array([json.dumps(summarize(us, gap))], dtype=object)}, [live, run + 1])

    narrow = rows.select(*by, "us", "id", "fingerprint")
    looked = (_folded(narrow, by, ["us", "id"], look, "_guess string, _run long, _ticks string", ["fingerprint"])
              .select(*by, "_guess", "_run", "_ticks"))

    def entries(columns: Columns, state):
        """The state in which each bucket begins, at its first run: its neighbour's guess, and the clock."""
        out = []
        for bucket, run, guess, ticks in zip(*[columns[c].tolist() for c in (BUCKET, "_run", "_guess", "_ticks")]):
            before, live, clock = state or [None, "[]", None]
            out.append(json.dumps([json.loads(live) if before == bucket - 1 else [], clock and clock[0]]) if run == 0 else None)
            state = [bucket, guess, advance(json.loads(ticks), clock, gap)]  # of a bucket's runs the last one's guess stays
        return None, {"_state": np.array(out, dtype=object)}, state

    starts = _written(_folded(looked, SOURCE, [BUCKET, "_run"], entries, "_state string", ["_guess", "_ticks"])
                      .where(F.col("_state").isNotNull()).select(*by, "_state"), "rate-starts")

    def walk(columns: Columns, state):
        inner, run = (state[:2], state[2] if len(state) > 2 else 0) if state else (None, 0)
        _, added, (live, clock) = step(columns, inner)
        ends = np.full(len(columns["us"]), None, dtype=object)
        # buckets of one run of rows: a row that ends one tells the emissions that matter after it
        borders = np.append(np.flatnonzero(columns[BUCKET][1:] != columns[BUCKET][:-1]), len(ends) - 1)
        emitted = [*(inner[0] if inner else []), *[[int(t), fp] for t, fp in zip(columns["us"][added["passed"]],
                                                                                 columns["fingerprint"][added["passed"]])]]
        for i in borders.tolist():
            end = (int(columns[BUCKET][i]) + 1) * width
            ends[i] = _stamp([e for e in emitted if e[0] <= columns["us"][i]], end, reach)
        return None, {**added, "_end": ends, "_run": np.full(len(ends), run)}, [live, clock, run + 1]

    def walked(which: DataFrame, begin: DataFrame, keys: list[str], name: str) -> DataFrame:
        led = which.withColumn(REAL, F.lit(True)).unionByName(begin.withColumn(REAL, F.lit(False)), allowMissingColumns=True)
        out = _folded(led, keys, [REAL, "us", "id"], walk, "passed boolean, prune_us long, _end string, _run long",
                      [BUCKET, "fingerprint"], entry="_state")
        return _written(out.drop(REAL, "_state"), name)

    def ends_of(found: DataFrame) -> DataFrame:
        return (found.where(F.col("_end").isNotNull()).groupBy(*by)
                .agg(F.max_by("_end", F.struct("_run", "us", "id")).alias("_end")))

    def misled(found: DataFrame, begun: DataFrame) -> DataFrame:
        """Buckets whose state at the beginning was not what the bucket before it left, with the state they ought to have."""
        live = F.coalesce("_end", F.lit("[]"))
        after = ends_of(found).withColumn(BUCKET, F.col(BUCKET) + 1)
        clock = F.get_json_object("_state", "$[1]")
        right = F.concat(F.lit("["), live, F.lit(", "), F.coalesce(clock, F.lit("null")), F.lit("]"))
        return _written(begun.join(after, by, "left").withColumn("_right", right).where(F.col("_right") != F.col("_state"))
                        .select(*by, F.col("_right").alias("_state")), "rate-misled")

    found = walked(rows, starts, by, "rate-decided")
    wrong = misled(found, starts)
    if not wrong.isEmpty():
        again = walked(rows.join(wrong.select(*by), by, "left_semi"), wrong, by, "rate-again")
        found = found.join(wrong.select(*by), by, "left_anti").unionByName(again)
        begun = starts.join(wrong.select(*by), by, "left_anti").unionByName(wrong)
        wrong = misled(found, begun)
        if not wrong.isEmpty():
            first = wrong.groupBy(*SOURCE).agg(F.min_by("_state", BUCKET).alias("_state"), F.min(BUCKET).alias("_from"))
            tail = rows.join(first.select(*SOURCE, "_from"), SOURCE).where(F.col(BUCKET) >= F.col("_from")).drop("_from")
            rest = walked(tail, first.select(*SOURCE, "_state"), SOURCE, "rate-in-order")
            head = (found.join(first.select(*SOURCE, "_from"), SOURCE, "left")
                    .where(F.col("_from").isNull() | (F.col(BUCKET) < F.col("_from"))).drop("_from"))
            found = head.unionByName(rest)
    return found.drop(BUCKET, "_end", "_run")
