"""Growing log files as a stream: a data source that follows bytes, not files.

The offset of the stream holds, for every file, its identity (device and inode), the
number of bytes read and a mark of the bytes just before that place. A micro-batch is the
difference of two such offsets:

* bytes appended to a known file are read from where the last batch ended;
* a renamed file keeps its identity, so rotation neither repeats nor loses its lines, and
  the file that takes the old name starts at its beginning;
* a file that was truncated, or replaced under the same inode, no longer has the mark
  before its place and is read from its beginning.

Only complete lines are taken; the rest of a line waits for its end. The offset is in the
stream's checkpoint, so a restart goes on where the last committed batch ended and a batch
that is run again reads the same bytes. Large growth is cut into byte ranges that are read
by different tasks. The folder must be mounted on the driver and on all executors.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "emberwatch_tail"
SCHEMA = "value string, file string, line_id string, read_offset long"
#: Bytes one task reads, and bytes before an offset that identify what was read.
SPLIT_BYTES, MARK_BYTES = 64 << 20, 256
_BLOCK = 1 << 16


@dataclass
class Span(InputPartition):
    """Lines of a file that start in ``[start, stop)``; ``head`` where ``start`` is known to begin a line."""

    path: str
    identity: str
    start: int
    stop: int
    end: int
    head: bool


def identity(path: str) -> str:
    s = os.stat(path)
    return f"{s.st_dev}-{s.st_ino}"


def mark(f, offset: int) -> str:
    """Digest of the bytes before ``offset``; empty at the beginning and where the file is shorter."""
    if not offset:
        return ""
    start = max(0, offset - MARK_BYTES)
    f.seek(start)
    got = f.read(offset - start)
    return hashlib.md5(got).hexdigest() if len(got) == offset - start else "short"


def end_of_lines(f, size: int) -> int:
    """Offset behind the last line end among the first ``size`` bytes."""
    end = size
    while end:
        start = max(0, end - _BLOCK)
        f.seek(start)
        at = f.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


def found_files(folder: str, pattern: str) -> dict[str, str]:
    """Identity to path of the files in a folder; of two names of one file the first by name."""
    out: dict[str, str] = {}
    for name in sorted(os.listdir(folder), reverse=True):
        path = os.path.join(folder, name)
        if fnmatch.fnmatch(name, pattern) and os.path.isfile(path):
            try:
                out[identity(path)] = path
            except FileNotFoundError:  # rotated away in between; the next batch sees its new name
                continue
    return out


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str, split_bytes: int, settle: float | None):
        self.folder, self.pattern, self.split_bytes, self.settle = folder, pattern, split_bytes, settle

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for key, path in found_files(self.folder, self.pattern).items():
            try:
                with open(path, "rb") as f:
                    s = os.fstat(f.fileno())
                    if f"{s.st_dev}-{s.st_ino}" != key:
                        continue
                    end = end_of_lines(f, s.st_size)
                    if self.settle is not None and end < s.st_size and time.time() - s.st_mtime >= self.settle:
                        end = s.st_size  # nobody has written for a while: the last line has no line end
                    out[key] = {"bytes": end, "mark": mark(f, end), "name": os.path.basename(path)}
            except FileNotFoundError:
                continue
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        paths, out = found_files(self.folder, self.pattern), []
        for key, now in sorted(end.items()):
            path, before = paths.get(key), start.get(key)
            if path is None or before == now:
                continue
            with open(path, "rb") as f:
                if mark(f, now["bytes"]) != now["mark"]:
                    continue  # truncated since the batch was planned: its bytes are gone
                goes_on = before is not None and before["bytes"] <= now["bytes"] and mark(f, before["bytes"]) == before["mark"]
            first = before["bytes"] if goes_on else 0
            out += [Span(path, key, a, min(a + self.split_bytes, now["bytes"]), now["bytes"], a == first)
                    for a in range(first, now["bytes"], self.split_bytes)]
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        p = partition
        path = p.path
        try:
            if identity(path) != p.identity:
                path = found_files(self.folder, self.pattern)[p.identity]  # renamed since the batch was planned
        except (FileNotFoundError, KeyError):
            path = found_files(self.folder, self.pattern).get(p.identity)
            if path is None:
                return
        name = os.path.basename(p.path)
        with open(path, "rb") as f:
            at = p.start
            if not p.head:
                # the line that begins before this range belongs to the one in front
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < p.stop:
                line = f.readline(p.end - at)
                if not line:
                    return
                yield line.rstrip(b"\r\n").decode("utf-8", "replace"), name, f"{p.identity}-{at}", at
                at += len(line)

    def commit(self, end: dict) -> None:
        """Nothing to release: the files stay."""


class TailSource(DataSource):
    """Options: ``path``; ``pattern`` of file names (default ``*``); ``splitBytes``; ``settleSeconds``, after which a last line without end is taken."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        o = self.options
        settle = o.get("settleseconds", o.get("settleSeconds"))
        split = o.get("splitbytes", o.get("splitBytes", SPLIT_BYTES))
        return TailReader(o["path"], o.get("pattern", "*"), int(split), float(settle) if settle is not None else None)


def follow(spark: SparkSession, folder: str, pattern: str = "*", split_bytes: int = SPLIT_BYTES, settle_seconds: float | None = None) -> DataFrame:
    """Lines appended to the files of ``folder``: ``value, file, line_id, read_offset``.

    ``line_id`` (file identity and byte offset) tells equal lines apart and stays the same
    when a batch is run again. ``file`` is the name at the time the batch was planned. Bytes
    that are no UTF-8 become replacement signs. Files that are deleted, or truncated before
    they were read, take their unread lines along.
    """
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format(NAME).option("path", folder).option("pattern", pattern).option("splitBytes", split_bytes)
    if settle_seconds is not None:
        reader = reader.option("settleSeconds", settle_seconds)
    return reader.load()


def offsets(text: str) -> dict:
    """Bytes read per file name out of an offset as the checkpoint writes it."""
    return {v["name"]: v["bytes"] for v in json.loads(text).values()}
