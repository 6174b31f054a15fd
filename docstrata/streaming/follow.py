"""Following log files that grow and rotate, as a stream with an offset in each file.

Spark's file streams read a file once, so lines that are appended later are lost.  This source keeps, for each file, how
many bytes have been read; a micro-batch is the complete lines between two such states.  A file is known by its first line
and not by its name, so a file that is renamed when logs rotate goes on where it was, and a new or emptied file of the old
name starts at its beginning.  Offsets are in the query's checkpoint: a restart reads on from there, and a batch that is
tried again reads the same bytes, under whatever name the file has by then.

The folder must be mounted where the driver and the executors read it.  A line that is not complete yet waits; of two
files with one first line only the longer is followed; a file that is removed while its lines are due raises.
"""

from __future__ import annotations

import glob
import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.scan import parse_log

SPLIT = 64 << 20  # bytes of a file that one task reads
TAIL = 1 << 16


def _identity(path: str) -> str | None:
    """The digest of a file's first line; none before that is complete."""
    with open(path, "rb") as f:
        line = f.readline()
    return hashlib.sha256(line).hexdigest() if line.endswith(b"\n") else None


def _complete(path: str) -> int:
    """How many bytes of a file are complete lines."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            start = max(0, at - TAIL)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return 0


def _files(pattern: str) -> dict[str, tuple[str, int]]:
    """(path, complete bytes) of each file by its identity."""
    found: dict[str, tuple[str, int]] = {}
    for path in sorted(glob.glob(pattern)):
        try:
            name, size = _identity(path), _complete(path)
        except FileNotFoundError:  # renamed or removed meanwhile; a renamed one is found next time
            continue
        if name and size > found.get(name, ("", 0))[1]:
            found[name] = (path, size)
    return found


class _Range(InputPartition):
    def __init__(self, name: str, start: int, stop: int):
        self.name, self.start, self.stop = name, start, stop


class _Reader(DataSourceStreamReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {name: size for name, (_, size) in _files(self.pattern).items()}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return [_Range(n, a, min(a + SPLIT, stop)) for n, stop in end.items() for a in range(start.get(n, 0), stop, SPLIT)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        """The lines that begin in a range; the last of them may end behind it."""
        where = _files(self.pattern).get(partition.name)
        if where is None:
            raise FileNotFoundError("a log file was removed before it was read")
        with open(where[0], "rb") as f:
            at = partition.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # the rest of a line that began before
            while at < partition.stop and (line := f.readline()):
                yield os.path.basename(where[0]), partition.name, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class LogFollow(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_follow"

    def schema(self) -> str:
        return "file string, log string, offset long, value string"

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def follow_log(spark: SparkSession, pattern: str) -> DataFrame:
    """A stream of log records of the files of a glob: file, log (the file's identity), offset, and the line as a record or, if
    it is not JSON, raw."""
    spark.dataSource.register(LogFollow)
    lines = spark.readStream.format("log_follow").load(pattern)
    return parse_log(lines.filter(F.col("value") != ""))
