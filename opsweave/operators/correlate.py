"""What came before: as-of matches and counts in a time range, without pairing rows.

Both tables are merged into one timeline per key (see `timeline`): the nearest earlier row is a value
carried along it, and counts in a range are differences of running counts at its two ends. So no row meets
another in a join, a key of any size is cut into buckets, and results grow with the asking rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsweave.operators.timeline import Timeline

MICROS = 1_000_000


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], payload: list[str], within: float | None = None,
              ts: str = "ts", tie: str = "id", prefix: str = "prior_") -> DataFrame:
    """Each left row with the nearest right row of its keys at its time or before, at most `within` seconds before.

    Adds `payload` of the right row, each name prefixed, and `<prefix>ts`; null where there is none. Of right rows at
    one time the one with the greatest `tie` counts. Null keys match null keys; rows without a time match nothing, and
    left ones stay. Rows that are equal are matched one by one.
    """
    ids = [*keys, "_us", "_side", "_tie"]
    offered = (right.where(F.col(ts).isNotNull())
               .select(*keys, F.unix_micros(ts).alias("_us"), F.lit(0).alias("_side"), F.col(tie).cast("string").alias("_tie"), F.col(tie).alias("_number"),
                       F.struct(F.col(ts).alias("ts"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(payload)]).alias("_offer")))
    asking = left.select(*keys, F.unix_micros(ts).alias("_us"), F.lit(1).alias("_side"), F.col(tie).cast("string").alias("_tie"),
                         F.struct(*[F.col(c).alias(f"l{i}") for i, c in enumerate(left.columns)]).alias("_row"))
    timed, untimed = asking.where(F.col("_us").isNotNull()), asking.where(F.col("_us").isNull())
    merged = offered.unionByName(timed, allowMissingColumns=True)
    found = Timeline(merged, keys, ["_us", "_side", "_number", "_tie"]).carry({"_match": F.col("_offer")}).df.where("_side = 1")
    rows = found.select(*ids, "_row", "_match").unionByName(untimed.select(*ids, "_row"), allowMissingColumns=True)
    near = F.col("_match").isNotNull()
    if within is not None:
        near = near & (F.col("_us") - F.unix_micros("_match.ts") <= round(within * MICROS))
    return rows.select(*[F.col(f"_row.l{i}").alias(c) for i, c in enumerate(left.columns)],
                       F.when(near, F.col("_match.ts")).alias(f"{prefix}ts"),
                       *[F.when(near, F.col(f"_match.c{i}")).alias(prefix + c) for i, c in enumerate(payload)])


def kinds_before(asking: DataFrame, rows: DataFrame, keys: list[str], kind: str, kinds: list[str], width: float,
                 ts: str = "ts", tie: str = "id") -> DataFrame:
    """(keys, tie, ts, kind, n, last_id, last_ts): per asking row and kind how many rows its keys had in the `width`
    seconds before, and the last of them; kinds with none have no row.

    Before is in order of time and `tie`, so of rows at the asking row's time those with a smaller id count, and the
    asking row, if it is one of `rows`, does not; a row exactly `width` before does. `kinds` is a fixed set, so each
    asking row has so many results at most. Rows without a time, or of another kind, do not count.
    """
    wide = round(width * MICROS)
    us = F.unix_micros(ts)
    seen = (rows.where(F.col(ts).isNotNull() & F.col(kind).isin(kinds))
            .select(*keys, us.alias("_us"), F.col(tie).alias("_id"), F.lit(1).alias("_what"), F.col(kind).alias("_kind")))
    points = asking.where(F.col(ts).isNotNull()).select(*keys, us.alias("_us"), F.col(tie).alias("_id"))
    # where the range begins, all rows at that time still lie ahead; where it ends, rows with a smaller id are past
    opens = points.withColumns({"_at": F.col("_us"), "_us": F.col("_us") - wide, "_what": F.lit(0)})
    closes = points.withColumns({"_at": F.col("_us"), "_what": F.lit(1), "_ask": F.lit(True)})
    merged = seen.withColumn("_ask", F.lit(False)).unionByName(opens, allowMissingColumns=True).unionByName(
        closes, allowMissingColumns=True).withColumn("_order", F.when(F.coalesce("_ask", F.lit(True)), 0).otherwise(1))
    is_row = F.col("_at").isNull()
    line = Timeline(merged, keys, ["_us", "_what", "_id", "_order"])
    line = line.running({f"_n{i}": (is_row & (F.col("_kind") == k)).cast("long") for i, k in enumerate(kinds)})
    line = line.carry({f"_last{i}": F.when(is_row & (F.col("_kind") == k), F.struct(F.col("_us").alias("us"), F.col("_id").alias("id")))
                       for i, k in enumerate(kinds)})
    ends = line.df.where(~is_row).withColumn("_sign", F.when(F.col("_what") == 1, 1).otherwise(-1))
    # an asking row's two ends; where several asking rows share keys, time and id both counts are as many times too large
    per = ends.groupBy(*keys, F.col("_id").alias(tie), F.col("_at").alias("_us")).agg(
        F.count_if(F.col("_sign") == 1).alias("_asked"),
        *[F.sum(F.col("_sign") * F.col(f"_n{i}")).alias(f"_n{i}") for i in range(len(kinds))],
        *[F.max(F.when(F.col("_sign") == 1, F.col(f"_last{i}"))).alias(f"_last{i}") for i in range(len(kinds))])
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.call_function("div", F.col(f"_n{i}"), F.col("_asked")).alias("n"),
                              F.col(f"_last{i}").alias("last")) for i, k in enumerate(kinds)])
    return (per.select(*keys, tie, F.timestamp_micros("_us").alias(ts), F.explode(F.filter(each, lambda x: x["n"] > 0)).alias("_x"))
            .select(*keys, tie, ts, F.col("_x.kind").alias(kind), F.col("_x.n").alias("n"), F.col("_x.last.id").alias("last_id"),
                    F.timestamp_micros("_x.last.us").alias("last_ts")))


def updates_before_crashes(crashes: DataFrame, updates: DataFrame, groups: list[str], within_hours: float = 48) -> DataFrame:
    """Each crash with each watched package group that was updated on its host at most `within_hours` before: the last update.

    `updates`: host, ts, id, package, grp. Result: the crash's columns, grp, update_id, update_ts, package, hours. The
    groups are a fixed list, as few as one watches; groups without an update have no row.
    """
    asked = crashes.withColumn("grp", F.explode(F.array(*[F.lit(g) for g in groups])))
    near = asof_join(asked, updates.where(F.col("grp").isin(groups)), ["host", "grp"], ["id", "package"], within_hours * 3600, prefix="_u_")
    hours: Column = (F.unix_micros("ts") - F.unix_micros("_u_ts")) / (3600.0 * MICROS)
    return (near.where(F.col("_u_ts").isNotNull()).withColumn("hours", hours)
            .withColumnsRenamed({"_u_id": "update_id", "_u_ts": "update_ts", "_u_package": "package"}))


def update_suspects(after: DataFrame, crashes: DataFrame, updates: DataFrame) -> DataFrame:
    """Per host and package group: updates, those that crashes followed, crashes, and the share of the host's crashes.

    `after` as from :func:`updates_before_crashes`. A group that crashes follow again and again is a suspect.
    """
    total = crashes.groupBy("host").agg(F.count(F.lit(1)).alias("_crashes"))
    made = updates.groupBy("host", "grp").agg(F.count(F.lit(1)).alias("updates"))
    hit = after.groupBy("host", "grp", "update_id").agg(F.count(F.lit(1)).alias("_n"), F.min("hours").alias("_first"))
    hit = hit.groupBy("host", "grp").agg(F.count(F.lit(1)).alias("followed"), F.sum("_n").alias("crashes"), F.min("_first").alias("soonest_hours"))
    return (made.join(hit, ["host", "grp"]).join(total, "host")
            .select("host", "grp", "updates", "followed", "crashes", "soonest_hours", (F.col("crashes") / F.col("_crashes")).alias("share")))
