"""Plain text training logs as a Spark data source, in batch and as a stream.

A log is a file of lines to which a run appends; the run is named by the file's path. The stream
keeps one position per file and reads whole lines only, so a line that is still being written
comes with the batch in which it ends.
"""

from __future__ import annotations

import datetime as dt
import re
import sys
import time
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "training_logs"
#: ``seq`` is the byte at which the line begins, so it grows within a run and needs no counting.
TEXT_LOG_SCHEMA = "run_id string, seq bigint, ts timestamp, line string"
#: Bytes of a file that one partition reads.
SPLIT = 64 << 20
_STEP = 1 << 16


class LogPart(InputPartition):
    """Bytes [start, end) of a file; lines belong to the part in which they begin."""

    def __init__(self, path: str, run: str, first: int, start: int, end: int, stop: int, seen: float) -> None:
        super().__init__(None)
        self.path, self.run, self.first, self.start, self.end, self.stop, self.seen = path, run, first, start, end, stop, seen


class _Log(NamedTuple):
    path: str
    run: str
    size: int
    changed: float


class _Logs:
    """The files of a folder and how they are read; `run` is a pattern whose group names the run."""

    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.files = re.compile(options.get("files", r".*\.(log|txt)"))
        self.run = re.compile(options.get("run", r"([^/]*)\.[^./]*$"))
        self.split = int(options.get("split", SPLIT))

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def listed(self) -> list[_Log]:
        system, place = self._system()
        found = system.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
        logs = []
        for file in found:
            named = self.run.search(file.path)
            if file.type == fs.FileType.File and self.files.fullmatch(file.base_name) and named:
                logs.append(_Log(file.path, unquote(named.group(1)), file.size, file.mtime_ns / 1e9))
        return sorted(logs)

    def last_break(self, path: str, low: int, size: int) -> int:
        """One past the last line break before `size`, or `low` if there is none after it."""
        with self._system()[0].open_input_file(path) as file:
            end = size
            while end > low:
                start = max(low, end - _STEP)
                at = file.read_at(end - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return low

    def parts(self, log: tuple[str, str], first: int, stop: int, seen: float) -> list[LogPart]:
        path, run = log
        return [LogPart(path, run, first, k, min(stop, k + self.split), stop, seen) for k in range(first, stop, self.split)]

    def read(self, part: LogPart | None) -> Iterator[tuple]:
        if part is None:  # what Spark hands out where there is nothing to read
            return
        seen = dt.datetime.fromtimestamp(part.seen, dt.timezone.utc)
        with self._system()[0].open_input_file(part.path) as file:
            # A part that does not open the range begins behind the first line break from the byte before it.
            at = part.start if part.start == part.first else part.start - 1
            skip = part.start != part.first
            held = b""
            begin = at
            while begin < part.end or skip:
                block = file.read_at(min(_STEP, part.stop - at), at) if at < part.stop else b""
                at += len(block)
                held += block
                lines = held.split(b"\n")
                held = lines.pop()
                if not block and held:
                    lines.append(held)  # the last line of a finished file may lack its break
                for line in lines:
                    if skip:
                        skip = False
                    elif begin < part.end:
                        yield part.run, begin, seen, line.removesuffix(b"\r").decode("utf-8", "replace")
                    begin += len(line) + 1
                if not block:
                    break


class LogReader(DataSourceReader):
    """All lines that the files have now; ``ts`` is the time of a file's last change."""

    def __init__(self, options: dict) -> None:
        self.logs = _Logs(options)

    def partitions(self) -> list[LogPart]:
        return [p for log in self.logs.listed() for p in self.logs.parts((log.path, log.run), 0, log.size, log.changed)]

    def read(self, partition: LogPart) -> Iterator[tuple]:
        return self.logs.read(partition)


class LogStreamReader(DataSourceStreamReader):
    """Whole lines as they are appended; ``ts`` is the time at which the batch found them.

    Positions and that time are in the offset, so a batch that is run again gives the same rows. A
    file that became shorter is not read again below its position.
    """

    def __init__(self, options: dict) -> None:
        self.logs = _Logs(options)
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {"files": {}, "seen": 0.0}

    def latestOffset(self) -> dict:
        files = {}
        for log in self.logs.listed():
            size, end = self.known.get(log.path, (0, 0))
            if log.size > size:
                end = self.logs.last_break(log.path, end, log.size)
            self.known[log.path] = max(size, log.size), end
            files[log.path] = [log.run, end]
        changed = files != getattr(self, "_files", None)
        if changed:
            self._files, self._seen = files, time.time()
        return {"files": files, "seen": self._seen}

    def partitions(self, start: dict, end: dict) -> list[LogPart]:
        found = []
        for path, (run, stop) in end["files"].items():
            first = start["files"].get(path, [run, 0])[1]
            if stop > first:
                found += self.logs.parts((path, run), first, stop, end["seen"])
        return found

    def read(self, partition: LogPart) -> Iterator[tuple]:
        return self.logs.read(partition)


class TrainingLogs(DataSource):
    """Options: ``path``, a folder; ``files``, a pattern of file names; ``run``, a pattern whose group in
    the path names the run (the file's name, if not given); ``split``, the bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return TEXT_LOG_SCHEMA

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(dict(self.options))

    def streamReader(self, schema: StructType) -> LogStreamReader:
        return LogStreamReader(dict(self.options))


def read_text_logs(spark: SparkSession, folder: str, **options) -> DataFrame:
    """(run_id, seq, ts, line) of all lines of the logs in a folder."""
    spark.dataSource.register(TrainingLogs)
    return spark.read.format(NAME).options(path=folder, **options).load()


def stream_text_logs(spark: SparkSession, folder: str, **options) -> DataFrame:
    """(run_id, seq, ts, line) of the lines appended to the logs in a folder."""
    spark.dataSource.register(TrainingLogs)
    return spark.readStream.format(NAME).options(path=folder, **options).load()
