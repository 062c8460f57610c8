"""Files of lines as a data source of Spark: splits, growing files as a stream, and a sink that commits.

What Spark's own text source cannot: a stream of files that producers append to.
Its offset is the number of bytes of each file that end with a line break, so a
line that is still being written waits, and a restart goes on where it stopped.

The sink writes what a task makes to a hidden folder and sends the file's name
to the driver, which puts only the named files in place.  So no line of a failed
attempt is ever seen; what a task leaves hidden that still ran when its job was
given up goes with a commit after STALE days.  A stream's batch that was put in place is not put there again;
one that was broken off while it was put there is replaced.

Lines end with a line feed and are UTF-8; other bytes become U+FFFD.  Blank lines
are lines.  Files and folders whose names begin with a dot or an underscore are
hidden.  A file that became shorter is read from its start again; one that is gone
when its part is to be read is an error.  Values to be written that are null or
hold a line feed are an error.
"""

from __future__ import annotations

import datetime
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "file string, at long, value string"
SPLIT, BLOCK, LINES, STALE = 64 << 20, 1 << 20, 4096, 7


@dataclass
class Part(InputPartition):
    """The lines of a file that begin at these bytes."""

    file: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    """A file of a task, below the hidden folder."""

    file: str


def _place(path: str) -> tuple[fs.FileSystem, str]:
    system, place = fs.FileSystem.from_uri(path)
    return system, place.rstrip("/")


def _files(path: str) -> dict[str, int]:
    """Name below the path and size of each file that is not hidden."""
    system, base = _place(path)
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
    names = {i.path[len(base) + 1 :]: i.size for i in found if i.type == fs.FileType.File}
    return {n: size for n, size in sorted(names.items()) if not any(p.startswith((".", "_")) for p in n.split("/"))}


def _parts(file: str, start: int, end: int, split: int) -> list[Part]:
    return [Part(file, at, min(at + split, end)) for at in range(start, end, split)]


def _lines(path: str, part: Part) -> Iterator[pa.RecordBatch]:
    """The lines of a part, in batches of a few megabytes."""
    system, base = _place(path)
    with system.open_input_file(f"{base}/{part.file}") as raw, io.BufferedReader(raw, BLOCK) as f:
        at = max(0, part.start - 1)
        f.seek(at)
        if part.start:
            # a line that began before the part is of the part before
            at += len(f.readline())
        places, values, size = [], [], 0
        while at < part.end and (line := f.readline()):
            places.append(at)
            values.append(line.removesuffix(b"\n").decode("utf-8", "replace"))
            at, size = at + len(line), size + len(line)
            if size >= 4 * BLOCK or len(values) >= LINES:
                yield _batch(part.file, places, values)
                places, values, size = [], [], 0
        if values:
            yield _batch(part.file, places, values)


def _batch(file: str, places: list[int], values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(values)), pa.array(places, pa.int64()), pa.array(values, pa.string())], names=["file", "at", "value"])


class LinesReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Part]:
        return [p for file, size in _files(self.path).items() for p in _parts(file, 0, size, self.split)]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else _lines(self.path, partition)


class LinesStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split
        #: file: (size, bytes of it that are whole lines), so that only files that grew are looked into
        self._seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _whole(self, file: str, size: int) -> int:
        """The bytes up to the last line break: blocks are read from the end."""
        system, base = _place(self.path)
        with system.open_input_file(f"{base}/{file}") as f:
            at = size
            while at > 0:
                low = max(0, at - BLOCK)
                found = f.read_at(at - low, low).rfind(b"\n")
                if found >= 0:
                    return low + found + 1
                at = low
        return 0

    def latestOffset(self) -> dict:
        now = {}
        for file, size in _files(self.path).items():
            known = self._seen.get(file)
            now[file] = known if known is not None and known[0] == size else (size, self._whole(file, size))
        self._seen = now
        return {"files": {file: whole for file, (_, whole) in now.items() if whole}}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for file, until in end["files"].items():
            since = start["files"].get(file, 0)
            out += _parts(file, since if since <= until else 0, until, self.split)
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _lines(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class _Staged:
    """Tasks write to a hidden folder of this job; the driver puts the named files in place."""

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def _stage(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, base = _place(self.path)
        folder, name = f"{base}/_staged/{self.job}", f"{uuid.uuid4().hex}.jsonl"
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{name}") as out:
            for batch in batches:
                values = batch.column("value")
                if values.null_count or pc.any(pc.match_substring(values, "\n")).as_py():
                    raise ValueError("a line to be written is null or holds a line feed")
                if len(values):
                    out.write(("\n".join(values.to_pylist()) + "\n").encode())
        return Written(f"{self.job}/{name}")

    def _put(self, messages: list[Written | None], prefix: str) -> None:
        system, base = _place(self.path)
        for n, m in enumerate(m for m in messages if m is not None):
            system.move(f"{base}/_staged/{m.file}", f"{base}/{prefix}-{n:06d}.jsonl")
        stale = datetime.datetime.now(datetime.UTC) - datetime.timedelta(days=STALE)
        for info in system.get_file_info(fs.FileSelector(f"{base}/_staged", allow_not_found=True)):
            if info.type == fs.FileType.Directory and info.mtime is not None and info.mtime < stale:
                system.delete_dir(info.path)

    def _drop(self, folder: str) -> None:
        system, base = _place(self.path)
        if system.get_file_info(f"{base}/{folder}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{folder}")

    def _remove(self, names: list[str]) -> None:
        system, base = _place(self.path)
        for n in names:
            system.delete_file(f"{base}/{n}")


class LinesWriter(_Staged, DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        super().__init__(path)
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self._stage(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        before = list(_files(self.path)) if self.overwrite else []
        self._put(messages, f"part-{self.job}")
        self._remove(before)
        self._drop(f"_staged/{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(f"_staged/{self.job}")


class LinesStreamWriter(_Staged, DataSourceStreamArrowWriter):
    """`name` tells the stream's batches from those of other streams into the folder.

    The driver's object is not the one that the tasks have, so the hidden folders
    of a batch are known by its messages.
    """

    def __init__(self, path: str, name: str):
        super().__init__(path)
        self.name = name

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self._stage(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        system, base = _place(self.path)
        mark, prefix = f"{base}/_done/{self.name}-{batchId}", f"batch-{self.name}-{batchId}"
        if system.get_file_info(mark).type == fs.FileType.NotFound:
            # files of a commit that was broken off
            self._remove([n for n in _files(self.path) if n.startswith(f"{prefix}-")])
            self._put(messages, prefix)
            system.create_dir(f"{base}/_done", recursive=True)
            system.open_output_stream(mark).close()
        self._clear(messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._clear(messages)

    def _clear(self, messages: list[Written | None]) -> None:
        for job in {m.file.split("/")[0] for m in messages if m is not None}:
            self._drop(f"_staged/{job}")


class LinesSource(DataSource):
    """Format `lines`; options path, split_bytes, and name for a stream's sink."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return SCHEMA

    def _split(self) -> int:
        return max(1, int(self.options.get("split_bytes", SPLIT)))

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options["path"], self._split())

    def streamReader(self, schema) -> LinesStreamReader:
        return LinesStreamReader(self.options["path"], self._split())

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        return LinesWriter(self.options["path"], overwrite)

    def streamWriter(self, schema, overwrite: bool) -> LinesStreamWriter:
        if not self.options.get("name"):
            raise ValueError("the stream's sink needs the option name")
        return LinesStreamWriter(self.options["path"], self.options["name"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LinesSource)
