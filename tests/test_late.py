import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from opsweave.config import DedupParams, TrendParams
from opsweave.operators.series import trend_alerts
from opsweave.operators.status import status_timeline
from opsweave.operators.throttle import dedup_rate_limited
from opsweave.streaming import late
from opsweave.streaming.dedup import use_rocksdb
from opsweave.streaming.feeds import read_files

START = dt.datetime(2024, 1, 1)
DELAY = 600


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def streamed(spark, tmp_path, batches, schema, make):
    """Rows that `make` puts out for a stream of these micro-batches."""
    use_rocksdb(spark)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = make(read_files(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, max_files=1))
    (out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out")


def sorted_out(batches, time):
    """(late rows, rows in time that the watermark has passed at the end): by the rule, on whole milliseconds."""
    mark, late_rows, held = 0, [], []
    for rows in batches:
        for r in rows:
            (late_rows if int((time(r) - START).total_seconds() * 1000) < mark else held).append(r)
        top = max([int((time(r) - START).total_seconds() * 1000) for r in rows], default=mark)
        mark = max(mark, top - DELAY * 1000)
    return late_rows, [r for r in held if int((time(r) - START).total_seconds() * 1000) < mark], at(mark / 1000)


def arriving(rows, time, seed, parts=5):
    """Rows in order of arrival: up to `DELAY` late, some much later; in parts."""
    rng = random.Random(seed)
    came = sorted(rows, key=lambda r: time(r) + dt.timedelta(seconds=rng.uniform(0, DELAY * 0.9) + (4000 if rng.random() < 0.08 else 0)))
    size = -(-len(came) // parts)
    return [came[i:i + size] for i in range(0, len(came), size)]


def test_rate_limited_in_any_order_is_as_in_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "h", rng.choice(["a", "b"]), rng.choice("xyz"), at(rng.randrange(0, 20000) + rng.choice([0, 0.25])))
            for i in range(500)]
    rows += [(600, "h", "a", "x", rows[0][4]), (601, "h", "a", "x", rows[0][4])]  # ties go by id
    schema, params = "id long, host string, source string, fingerprint string, ts timestamp", DedupParams(600, 900, 3, 600)
    batches = arriving(rows, lambda r: r[4], 1)
    got = streamed(spark, tmp_path, batches, schema, lambda s: late.dedup_rate_limited_late_stream(s, params, f"{DELAY} seconds"))
    late_rows, due, _ = sorted_out(batches, lambda r: r[4])
    assert late_rows and len(due) > 400
    want = dedup_rate_limited(spark.createDataFrame(due, schema), params).where("action = 'emit'")
    assert (sorted((r["id"], r["suppressed_count"]) for r in got.where("not late").collect())
            == sorted((r["id"], r["suppressed_count"]) for r in want.collect()))
    assert sorted(r["id"] for r in got.where("late").collect()) == sorted(r[0] for r in late_rows)
    assert got.where("late and suppressed_count is not null").count() == 0 and got.where("late and ts is null").count() == 0


def test_trends_in_any_order_are_as_in_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [("h", f"m{i % 2}", at(i * 20), float(i % 90) + rng.random()) for i in range(600)] + [("h", "m0", None, 1.0), ("h", "m1", at(7), None)]
    schema, params = "host string, metric string, ts timestamp, value double", TrendParams(0.2, 8, 300)
    usable = [r for r in rows if r[2] is not None and r[3] is not None]
    batches = arriving(usable, lambda r: r[2], 2)
    got = streamed(spark, tmp_path, [*batches[:-1], batches[-1] + rows[-2:]], schema,
                   lambda s: late.trend_late_stream(s, params, 5.0, f"{DELAY} seconds"))
    late_rows, due, _ = sorted_out(batches, lambda r: r[2])
    want = trend_alerts(spark.createDataFrame(due, schema), params, explicit=5.0)
    assert want.count() > 10
    assert (sorted((r["metric"], r["ts"], round(r["slope"], 6)) for r in got.where("not late").collect())
            == sorted((r["metric"], r["ts"], round(r["slope"], 6)) for r in want.collect()))
    assert got.where("late").count() == len(late_rows)


def test_a_silent_host_falls_back_by_itself(spark, tmp_path):
    schema = "id long, host string, ts timestamp, severity string"
    batches = [[(1, "quiet", at(0), "critical"), (2, "quiet", at(1200), "warning"), (3, "loud", at(10), "warning")],
               [(4, "loud", at(1500), "critical"), (5, "loud", at(1500), "warning"), (6, "quiet", at(900), "info")],
               [(7, "loud", at(9000), "warning")], [(8, "loud", at(30000), "critical"), (9, "quiet", at(100), "critical")]]
    got = streamed(spark, tmp_path, batches, schema, lambda s: late.status_expiry_stream(s, 3600, f"{DELAY} seconds"))
    seen = sorted((r["host"], (r["ts"] - START).total_seconds(), r["old"], r["new"], r["id"]) for r in got.where("not late").collect())
    assert seen == [("loud", 10, "healthy", "degraded", 3), ("loud", 1500, "degraded", "critical", 5),
                    ("loud", 5100, "critical", "healthy", None), ("loud", 9000, "healthy", "degraded", 7),
                    ("loud", 12600, "degraded", "healthy", None),
                    ("quiet", 0, "healthy", "critical", 1), ("quiet", 3600, "critical", "degraded", None),
                    ("quiet", 4800, "degraded", "healthy", None)]
    assert [(r["id"], r["severity"]) for r in got.where("late").collect()] == [(9, "critical")]


def test_statuses_in_any_order_are_the_timeline(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, f"h{rng.randrange(3)}", at(rng.randrange(40000)), rng.choice(["info", "warning", "critical"])) for i in range(120)]
    schema = "id long, host string, ts timestamp, severity string"
    batches = arriving(rows, lambda r: r[2], 4, parts=4)
    got = streamed(spark, tmp_path, batches, schema, lambda s: late.status_expiry_stream(s, 1800, f"{DELAY} seconds"))
    _, due, mark = sorted_out([[r for r in b if r[3] != "info"] for b in batches], lambda r: r[2])
    want = status_timeline(spark.createDataFrame(due, schema), 1800).where(F.col("start_ts") < F.lit(mark))
    assert (sorted((r["host"], r["ts"], r["new"]) for r in got.where("not late").collect())
            == sorted((r["host"], r["start_ts"], r["status"]) for r in want.collect()))
