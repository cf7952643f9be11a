"""What users prefer to do about a pattern of events, learned from what they did.

Confidence that a pattern's preference is an action moves with every action taken on the pattern: towards one if
it was that action, towards zero if it was another, and fades with time between. Each of these steps takes a
confidence c to factor * c + offset, and so does any run of them: runs are summed up side by side as such
pairs and composed in order, so a pattern with a third of all actions is not one task's work.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsweave.functions.times import Instant, at
from opsweave.operators.timeline import Columns, Timeline

# The actions a user can take on an event.
ACTIONS = ("ignored", "restarted", "postponed", "applied")
#: Share of the way to one that a confirming action goes: four of them give two thirds. Share that a contrary one leaves.
GAIN, LEFT = 1 - 3 ** -0.25, 0.5
DAY = 86_400_000_000


def confidence_rows(actions: DataFrame, half_life_days: float = 90.0) -> DataFrame:
    """Every action (host, pattern, ts, id, user_action) once for each preference it speaks for or against, with the
    `confidence` after it and `samples`, how often the preference was confirmed so far.

    Actions that are not known and rows without a time do not count. Rows at one time go by id.
    """
    known = actions.where(F.col("user_action").isin(list(ACTIONS)) & F.col("ts").isNotNull())
    each = (known.select("host", "pattern", "ts", "id", "user_action", F.explode(F.array(*map(F.lit, ACTIONS))).alias("preference"))
            .withColumns({"us": F.unix_micros("ts"), "hit": F.col("user_action") == F.col("preference")}))
    fade = np.log(2) / (half_life_days * DAY)

    def pairs(rows: Columns, last: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(factor, offset) of each row, the fading since the row before included."""
        us, hit = rows["us"], rows["hit"].astype(bool)
        gone = np.diff(us, prepend=us[0] if last is None else last)
        return np.where(hit, 1 - GAIN, LEFT) * np.exp(-fade * gone), np.where(hit, GAIN, 0.0)

    def step(rows: Columns, state):
        last, c, n = state or (None, 0.0, 0)
        out = []
        for factor, offset in zip(*[p.tolist() for p in pairs(rows, last)]):
            c = factor * c + offset
            out.append(c)
        samples = n + np.cumsum(rows["hit"].astype(np.int64))
        return None, {"confidence": np.array(out), "samples": samples}, [int(rows["us"][-1]), c, int(samples[-1])]

    def summarize(rows: Columns) -> list:
        whole, added = 1.0, 0.0
        for factor, offset in zip(*[p.tolist() for p in pairs(rows, None)]):
            whole, added = factor * whole, factor * added + offset
        return [int(rows["us"][0]), int(rows["us"][-1]), whole, added, int(rows["hit"].sum())]

    def advance(summary: list, state: list | None) -> list:
        first, end, whole, added, hits = summary
        last, c, n = state or (first, 0.0, 0)
        return [end, whole * c * float(np.exp(-fade * (first - last))) + added, n + hits]

    return Timeline(each, ["host", "pattern", "preference"], ["us", "id"]).split_fold(
        step, "confidence double, samples long", summarize, advance, reads=["hit"]).drop("us", "hit")


def preferences(actions: DataFrame, as_of: Instant, half_life_days: float = 90.0, change_above: float = 0.8) -> DataFrame:
    """(host, pattern, preference, confidence, samples, last_updated, change): what each pattern's user prefers as of an
    instant, faded until then; preferences that were never confirmed have no row.

    `change` marks those certain enough to change how such events are shown. Later actions do not count.
    """
    seen = confidence_rows(actions.where(F.col("ts") <= at(as_of)), half_life_days)
    ends = seen.groupBy("host", "pattern", "preference").agg(
        F.max_by(F.struct("confidence", "samples", "ts"), F.struct("ts", "id")).alias("_last"))
    faded = F.col("_last.confidence") * F.exp(-np.log(2) / (half_life_days * DAY) * (F.unix_micros(at(as_of)) - F.unix_micros("_last.ts")))
    return (ends.where(F.col("_last.samples") > 0).select(
        "host", "pattern", "preference", faded.alias("confidence"), F.col("_last.samples").alias("samples"), F.col("_last.ts").alias("last_updated"))
        .withColumn("change", F.col("confidence") > change_above))
