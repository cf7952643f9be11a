import os

import pytest

from opsweave.sources import tail


def new_lines(spark, folder, tmp_path, **options):
    """(file, offset, line) that a run of the stream adds to what earlier runs read."""
    out = f"{tmp_path}/out-{len(os.listdir(tmp_path))}"
    (tail.tail_files(spark, str(folder), **options).select("host", "offset", "line").writeStream.format("parquet")
     .option("path", out).option("checkpointLocation", f"{tmp_path}/progress-{os.path.basename(folder)}").trigger(availableNow=True)
     .foreachBatch(lambda batch, i: batch.write.mode("append").parquet(out)).start().awaitTermination())
    return sorted(map(tuple, spark.read.parquet(out).collect())) if os.path.isdir(out) else []


def put(path, text, mode="ab"):
    with open(path, mode) as file:
        file.write(text.encode() if isinstance(text, str) else text)


def test_growth_truncation_and_rotation(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    put(logs / "a.log", "one\ntwo\npar")
    assert new_lines(spark, logs, tmp_path) == [("a", 0, "one"), ("a", 4, "two")]  # the last line is not whole
    put(logs / "a.log", "tial\r\n\n  \nthree\n")
    put(logs / "b.log", b"bad \xff byte\n")
    assert new_lines(spark, logs, tmp_path) == [("a", 8, "partial"), ("a", 21, "three"), ("b", 0, "bad � byte")]
    put(logs / "a.log", "new\n", "wb")  # shorter than before
    assert new_lines(spark, logs, tmp_path) == [("a", 0, "new")]
    os.rename(logs / "a.log", tmp_path / "old")
    put(logs / "a.log", "fresh file that is longer\nthan the one before\n")
    assert new_lines(spark, logs, tmp_path) == [("a", 0, "fresh file that is longer"), ("a", 26, "than the one before")]
    assert new_lines(spark, logs, tmp_path) == []


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_ranges_hold_each_line_once(tmp_path, monkeypatch, size):
    monkeypatch.setattr(tail, "STEP", 5)
    lines = ["", "x", "a longer line with ünïcode", "y" * 50, "", "end"]
    path = tmp_path / "f"
    put(path, "\n".join(lines) + "\nrest")
    reader = tail.TailReader({"path": str(path), "rangeBytes": str(size)})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    found = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [r["line"] for r in found] == lines
    text = path.read_bytes()
    assert all(text[r["offset"]:].startswith(r["line"].encode()) for r in found)


def test_missing_and_empty_files(tmp_path):
    reader = tail.TailReader({"path": str(tmp_path / "none")})
    assert reader.latestOffset() == {"files": {}}
    put(tmp_path / "empty", "")
    put(tmp_path / "open", "no end")
    reader = tail.TailReader({"path": str(tmp_path)})
    assert reader.partitions(reader.initialOffset(), reader.latestOffset()) == []


def test_many_short_ranges_become_longer(tmp_path):
    for name in "abc":
        put(tmp_path / f"{name}.log", "".join(f"{name} line {i}\n" for i in range(1000)))
    reader = tail.TailReader({"path": str(tmp_path), "rangeBytes": "10"})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(parts) <= tail.RANGES + 3  # not one per 10 bytes
    found = [r["line"] for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert found == [f"{name} line {i}" for name in "abc" for i in range(1000)]
