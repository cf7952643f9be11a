"""Growing text files as a stream: each trigger reads the bytes that were added since the last one.

The offset of the stream tells, per file, how many bytes were read and a checksum of the file's first bytes.
A file that has become shorter, or whose first bytes changed, was truncated or rotated: it is read from its
beginning. A last line without its end is left for a later trigger. New bytes are cut into ranges, so one large
file is read by many tasks; where there are many, the ranges are longer, so that tasks do not outgrow the work in them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from opsweave.functions.text import strip

#: Bytes of the longest range that one task reads, bytes at a file's beginning that tell it from another, and lines of a batch.
RANGE, HEAD, LINES = 64 << 20, 256, 10_000
STEP = 1 << 16
#: Ranges of a trigger above which they become longer than asked for, up to RANGE: a task's start costs as much as some MB.
RANGES = 32


@dataclass
class Bytes(InputPartition):
    """Lines that begin in [start, stop) of a file; `at_line` if one begins at `start`."""

    path: str
    start: int
    stop: int
    end: int
    at_line: bool


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def last_line_end(store: fs.FileSystem, path: str, start: int, size: int) -> int:
    """The place after the last line end in [start, size), or `start` where there is none; read from the end backwards."""
    with store.open_input_file(path) as file:
        high = size
        while high > start:
            low = max(start, high - STEP)
            found = file.read_at(high - low, low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            high = low
    return start


def head(store: fs.FileSystem, path: str, size: int) -> int:
    with store.open_input_file(path) as file:
        return zlib.crc32(file.read_at(min(size, HEAD), 0))


class TailReader(DataSourceStreamReader):
    """Offsets are {path: [bytes read, bytes of the checksum, checksum]}."""

    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.range = int(options.get("rangeBytes", RANGE))

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _files(self) -> list[fs.FileInfo]:
        self.store, place = filesystem(self.path)
        info = self.store.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            return []
        every = [info] if info.type == fs.FileType.File else self.store.get_file_info(fs.FileSelector(place))
        return sorted((f for f in every if f.type == fs.FileType.File and f.path.endswith(self.suffix)
                       and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)

    def latestOffset(self) -> dict:
        files = {}
        for file in self._files():
            end = last_line_end(self.store, file.path, 0, file.size)
            size = min(end, HEAD)
            files[file.path] = [end, size, head(self.store, file.path, size)]
        return {"files": files}

    def partitions(self, start: dict, end: dict) -> list[Bytes]:
        self.store, _ = filesystem(self.path)
        new = []
        for path, (stop, size, check) in sorted(end["files"].items()):
            read, seen, known = start["files"].get(path, (0, 0, 0))
            # the same file, grown: it is as long, and begins with what it began with
            grown = stop >= read and size >= seen and head(self.store, path, seen) == known if seen else stop >= read
            new.append((path, read if grown else 0, stop))
        longer = min(RANGE, sum(stop - first for _, first, stop in new) // RANGES)
        width = max(self.range, longer)
        return [Bytes(path, low, min(stop, low + width), stop, low == first)
                for path, first, stop in new for low in range(first, stop, width)]

    def read(self, partition: Bytes) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.path)
        with store.open_input_file(partition.path) as raw:
            raw.seek(partition.start if partition.at_line else partition.start - 1)
            at, held = raw.tell(), b""
            skip = not partition.at_line  # up to the line end before the first line that begins here
            rows: list[tuple[int, str]] = []
            while at < partition.stop or held:
                block = raw.read(min(STEP, partition.end - at - len(held)))
                if not block:
                    break
                *lines, held = (held + block).split(b"\n")
                for line in lines:
                    if skip:
                        skip = False
                    elif at < partition.stop:
                        rows.append((at, line.rstrip(b"\r").decode("utf-8", "replace")))
                    at += len(line) + 1
                if len(rows) >= LINES:
                    yield self._batch(partition.path, rows)
                    rows = []
                if at >= partition.stop:
                    break
            if rows:
                yield self._batch(partition.path, rows)

    def _batch(self, path: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([path] * len(rows), pa.string()), pa.array([o for o, _ in rows], pa.int64()),
                                pa.array([x for _, x in rows], pa.string())], names=["path", "offset", "line"])

    def commit(self, end: dict) -> None:
        pass


class Tail(DataSource):
    """Format `tail`: options path (a file or a folder), suffix, rangeBytes. Columns path, offset, line."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, offset long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_files(spark: SparkSession, path: str, suffix: str = "", range_bytes: int = RANGE) -> DataFrame:
    """Lines (host, captured_at, path, offset, line) added to a file, or to the files of a folder, as a stream.

    `host` is the file's name up to its first dot, `offset` where the line begins. Lines are as they stand, blank ones
    left out; bytes that are no UTF-8 read as replacement characters. What a file held when it was truncated or
    replaced before it was read is lost, as with any tail. The files must be in reach of driver and tasks alike.
    """
    spark.dataSource.register(Tail)
    lines = spark.readStream.format("tail").options(path=path, suffix=suffix, rangeBytes=range_bytes).load()
    return (lines.where(strip(F.col("line")) != "")
            .select(F.regexp_extract("path", r"([^/.]*)[^/]*$", 1).alias("host"), F.current_timestamp().alias("captured_at"),
                    "path", "offset", "line"))
