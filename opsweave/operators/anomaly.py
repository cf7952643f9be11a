"""Events unlike what their host has seen lately: distance of an embedding from a baseline of days.

A day's vectors are reduced to a count, a vector sum and a sum of squares, which Spark combines in every task
before the shuffle; the baseline of a day is the sum of those of the days before it, one small row per host and
day. So no event meets another, however many a host has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_SECONDS = 86_400


def day_sums(events: DataFrame, width: int, vector: str = "embedding", keys: list[str] = ("host",)) -> DataFrame:
    """(keys, day, n, total, square): number, sum and sum of squares of a day's vectors; day counts from 1970 in UTC."""
    day = F.floor(F.unix_seconds("ts") / DAY_SECONDS)
    v = events.select(*keys, day.alias("day"), F.col(vector).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return v.groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(width)]).alias("total"),
                                       F.sum(square).alias("square"))


def baselines(sums: DataFrame, width: int, days: int = 7, keys: list[str] = ("host",)) -> DataFrame:
    """(keys, day, base_n, base_days, mean, spread): of the `days` whole days before each day on which there are events.

    `base_days` is how many days ago the first event of the host's history lies, `days` at most; `spread` the root
    of the mean squared distance from the mean. A day without any event before it has no mean.
    """
    own = Window.partitionBy(*keys).orderBy("day")
    before = own.rangeBetween(-days, -1)
    n = F.sum("n").over(before)
    flat = sums.select(*keys, "day", F.coalesce(n, F.lit(0)).alias("base_n"), F.sum("square").over(before).alias("_square"),
                       F.least(F.col("day") - F.min("day").over(own), F.lit(days)).alias("base_days"),
                       F.array(*[F.sum(F.get("total", F.lit(i))).over(before) for i in range(width)]).alias("_total"))
    mean = F.when(F.col("base_n") > 0, F.transform("_total", lambda x: x / F.col("base_n")))
    length = F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x)
    return (flat.withColumn("mean", mean)
            .withColumn("spread", F.sqrt(F.greatest(F.col("_square") / F.col("base_n") - length, F.lit(0.0))))
            .select(*keys, "day", "base_n", "base_days", "mean", "spread"))


def embedding_anomalies(events: DataFrame, days: int = 7, limit: float = 1.2, cold_limit: float = 1.5, least: int = 5,
                        vector: str = "embedding", keys: list[str] = ("host",)) -> DataFrame:
    """Events (host, ts, id, `vector`) with their distance from the host's mean of the `days` days before, as `distance`
    and `ratio` to the spread, `cold` and `anomaly`.

    An event is an anomaly if its ratio is above `limit`; while the host's history is shorter than `days`, it is `cold`, and
    the limit is `cold_limit`. With fewer than `least` events in the baseline nothing is judged: distance, ratio and anomaly
    are null. A spread of zero makes any other vector's ratio infinite, and an equal one's zero. Events without a time or
    a usable vector (null, or null, NaN or infinite components, or of another width than the first one) are left out; all columns stay.
    """
    inf = float("inf")
    names = [f"k{i}" for i in range(len(keys))]
    rows = events.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(events.columns)]).alias("row"),
                         *[F.col(k).alias(n) for k, n in zip(keys, names)], "ts", F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("ts").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x) < inf, F.lit(False))))
    first = rows.orderBy("ts", "v").select(F.size("v").alias("n")).first()
    width = first["n"] if first else 0
    rows = rows.where(F.size("v") == width).withColumn("on", F.floor(F.unix_seconds("ts") / DAY_SECONDS))
    base = baselines(day_sums(rows, width, "v", names), width, days, names).withColumnsRenamed({n: f"its_{n}" for n in names})
    same = F.col("on") == F.col("day")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"its_{n}"))
    far = F.sqrt(F.aggregate(F.zip_with("v", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    judged = F.col("base_n") >= least
    ratio = F.when(F.col("spread") > 0, F.col("distance") / F.col("spread")).otherwise(F.when(F.col("distance") > 0, F.lit(inf)).when(judged, 0.0))
    out = rows.join(base, same).withColumn("distance", F.when(judged, far)).withColumn("ratio", ratio).withColumn("cold", F.col("base_days") < days)
    limits = F.when(F.col("cold"), cold_limit).otherwise(limit)
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(events.columns)], "base_n", "base_days", "cold", "distance", "ratio",
                      (F.col("ratio") > limits).alias("anomaly"))
