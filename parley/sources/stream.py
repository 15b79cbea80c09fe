"""A streaming source of log files that are new or have changed: the format "parley_logs".

    register(spark)
    spark.readStream.format("parley_logs").option("path", folder).load()

The built-in file source reads a file once and never again when it grows. Here an offset is a time and the paths of that
very time, so a batch has the files whose time is after its start's, or is the same and whose path is not among the
start's. A batch is a function of its two offsets, so one that is run again after a restart reads the same files; a file
that has changed once more since then is left to the batch of its new time.

Options: path (of any file system that pyarrow opens), pattern (*.jsonl), recursive (true), what ("files": path, folder,
modified, size; "lines": path, modified, line_no, line, the latter null where it is no UTF-8), bytes (of the files that
one task reads, 32 MiB). A file that goes or can't be read has no lines. Files that are moved in with a time before
the last offset's are not seen by the stream; an index run finds them.
"""

from __future__ import annotations

import datetime
import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from parley.shipping import by_value

SCHEMAS = {
    "files": "path string, folder string, modified timestamp, size bigint",
    "lines": "path string, modified timestamp, line_no bigint, line string",
}


@dataclass
class LogFile:
    path: str
    nanoseconds: int
    size: int

    @property
    def modified(self) -> datetime.datetime:
        """In whole milliseconds, as the listing of an index run has it."""
        return datetime.datetime.fromtimestamp(self.nanoseconds // 1_000_000 / 1e3, datetime.UTC)


@dataclass
class Files(InputPartition):
    files: list[LogFile]


def opened(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(folder: str, pattern: str, recursive: bool) -> list[LogFile]:
    """The matching files below a folder, whose paths keep its prefix."""
    from pyarrow import fs

    system, inner = opened(folder)
    prefix = folder[: len(folder) - len(inner)] if folder.endswith(inner) else ""
    found = system.get_file_info(fs.FileSelector(inner, recursive=recursive, allow_not_found=True))
    return [LogFile(prefix + f.path, f.mtime_ns, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)]


def between(files: list[LogFile], start: dict, end: dict) -> list[LogFile]:
    """Those that a batch from one offset to another has."""
    seen, last = set(start["paths"]), set(end["paths"])

    def mine(f: LogFile) -> bool:
        after = f.nanoseconds > start["time"] or f.nanoseconds == start["time"] and f.path not in seen
        return after and (f.nanoseconds < end["time"] or f.nanoseconds == end["time"] and f.path in last)

    return sorted((f for f in files if mine(f)), key=lambda f: (f.nanoseconds, f.path))


def dealt(files: list[LogFile], size: int) -> list[Files]:
    """Files in groups of about so many bytes; a larger one is alone."""
    groups: list[Files] = []
    room = 0
    for f in files:
        if not groups or f.size > room:
            groups.append(Files([]))
            room = size
        groups[-1].files.append(f)
        room -= f.size
    return groups


def lines_of(path: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The lines of a file as it is read."""
    system, inner = opened(path)
    rest = b""
    with system.open_input_stream(inner) as stream:
        while part := stream.read(chunk):
            *whole, rest = (rest + part).split(b"\n")
            yield from whole
    if rest:
        yield rest


class ChangedLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parley_logs"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "files")]

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """spark with the format."""
    with by_value(__name__):
        spark.dataSource.register(ChangedLogs)
    return spark


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.what, self.size = options.get("what", "files"), int(options.get("bytes", 32 << 20))
        self.where = options["path"].rstrip("/"), options.get("pattern", "*.jsonl"), options.get("recursive", "true") == "true"

    def initialOffset(self) -> dict:
        return {"time": -1, "paths": []}

    def latestOffset(self) -> dict:
        files = listed(*self.where)
        if not files:
            return self.initialOffset()
        time = max(f.nanoseconds for f in files)
        return {"time": time, "paths": sorted(f.path for f in files if f.nanoseconds == time)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return dealt(between(listed(*self.where), start, end), self.size)

    def read(self, partition: Files) -> Iterator[tuple]:
        for f in partition.files:
            if self.what == "files":
                yield f.path, f.path.rpartition("/")[0], f.modified, f.size
                continue
            try:
                for n, line in enumerate(lines_of(f.path)):
                    yield f.path, f.modified, n, _text(line)
            except OSError:
                continue


def _text(line: bytes) -> str | None:
    try:
        return line.removesuffix(b"\r").decode()
    except UnicodeDecodeError:
        return None
