"""An append-only log as a streaming data source: one growing file, read once from line to line (§2.11).

An offset is the place behind the last whole line, so a line that is still being written waits for its end. What is new is cut
into byte ranges of ``split`` bytes, a task each; a line belongs to the range in which it begins. Offsets are
Spark's to keep: a stream that is stopped goes on from its checkpoint, and a batch that is run again reads the same bytes.

    spark.dataSource.register(AppendLog)
    spark.readStream.format("append_log").option("path", "/logs/ledger.jsonl").load()      # line, at

``path`` is a local file that all machines see, or the address of one in a store that pyarrow opens; with the option ``parts`` it is a
folder whose ``part-*`` files, in order of their names, are one log: places go on from file to file, each file ends with a line feed
and only the last grows. Empty lines are lines;
a line feed ends each; bytes that are not UTF-8 are replaced. A file that has become shorter is an error, and one that isn't there yet is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 1 << 20


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _open(path: str):
    store, place = _store(path)
    return store.open_input_file(place)


def _parts(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of a folder's parts that hold something, in order."""
    from pyarrow import fs

    store, place = _store(path)
    files = store.get_file_info(fs.FileSelector(place, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in files if f.base_name.startswith("part-") and f.size)


class ByteRange(InputPartition):
    def __init__(self, begin: int, end: int, first: int, name: str = "", base: int = 0):
        self.begin, self.end, self.first = begin, end, first  # ``first``: where a line is known to begin
        self.name, self.base = name, base  # the part of the log, and its place in it


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", 64 << 20))
        self.in_parts = str(options.get("parts", "false")).lower() == "true"

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        if not self.in_parts:
            return {"at": self._whole(self.path)}
        parts = _parts(self.path)
        return {"at": sum(n for _, n in parts[:-1]) + (self._whole(f"{self.path}/{parts[-1][0]}") if parts else 0)}

    def _whole(self, path: str) -> int:
        """The place behind the file's last line feed."""
        try:
            with _open(path) as f:
                end = f.size()
                while end > 0:
                    begin = max(0, end - BLOCK)
                    found = f.read_at(end - begin, begin).rfind(b"\n")
                    if found >= 0:
                        return begin + found + 1
                    end = begin
        except FileNotFoundError:
            pass
        return 0

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        a, b = start["at"], end["at"]
        if b < a:
            raise ValueError(f"{self.path} has become shorter: {b} of {a} bytes are left")
        if not self.in_parts:
            return [ByteRange(i, min(i + self.split, b), a) for i in range(a, b, self.split)]
        out, base = [], 0
        for name, size in _parts(self.path):
            first, last = max(a - base, 0), min(b - base, size)
            out += [ByteRange(i, min(i + self.split, last), first, name, base) for i in range(first, last, self.split)]
            base += size
        return out

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the range: from behind the first line feed at or after ``begin - 1``, unless a line begins there."""
        with _open(f"{self.path}/{part.name}" if part.name else self.path) as f:
            f.seek(part.begin if part.begin == part.first else part.begin - 1)
            at, rest, skip = f.tell(), b"", part.begin != part.first
            while at < part.end:
                block = f.read(BLOCK)
                if not block:
                    return
                lines = (rest + block).split(b"\n")
                rest = lines.pop()
                if skip and lines:
                    at += len(lines.pop(0)) + 1
                    skip = False
                elif skip:
                    at, rest = at + len(rest), b""  # a line of an earlier range goes on
                    continue
                texts, places = [], []
                for line in lines:
                    if at >= part.end:
                        break
                    texts.append(line.decode("utf-8", "replace"))
                    places.append(part.base + at)
                    at += len(line) + 1
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(places, pa.int64())], ["line", "at"])

    def commit(self, end: dict) -> None:
        """Nothing to release: the log is never cut."""


class AppendLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "append_log"

    def schema(self) -> str:
        return "line string, at long"

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)
