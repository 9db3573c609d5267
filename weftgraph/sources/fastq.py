"""FASTQ as a data source: plain and bzip2 files in byte ranges, gzip files whole; any number of files or patterns.

spark.dataSource.register(FastqSource); spark.read.format("fastq").load("dir/*.fastq")
Columns: name, seq, qual; paths are what pyarrow's file systems open.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .bzip import BlockStream

#: Bytes of a plain file for each partition, and of a bzip2 file, which has some five times as many inside; how much is read at once.
SPLIT, PACKED_SPLIT, CHUNK = 64 << 20, 16 << 20, 8 << 20
SCHEMA = "name string, seq string, qual string"


class Split(InputPartition):
    def __init__(self, path: str, start: int, stop: int | None):
        super().__init__((path, start, stop))


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(paths: list[str]) -> list[tuple[str, int]]:
    """(path, size) of all files that the paths, directories or patterns name; a missing one is an error."""
    out = []
    for path in paths:
        where, root = _open(path)
        head = path[: len(path) - len(root)]
        if any(c in root for c in "*?["):
            parent = root.rsplit("/", 1)[0]
            found = [f for f in where.get_file_info(fs.FileSelector(parent)) if f.is_file and fnmatch.fnmatch(f.path, root)]
        else:
            info = where.get_file_info(root)
            found = [f for f in where.get_file_info(fs.FileSelector(root)) if f.is_file] if info.type == fs.FileType.Directory else [info] if info.is_file else []
        if not found:
            raise FileNotFoundError(path)
        out += [(head + f.path, f.size) for f in sorted(found, key=lambda f: f.path)]
    return out


def _codec(path: str) -> str | None:
    return {"gz": "gzip", "bz2": "bz2"}.get(path.rsplit(".", 1)[-1])


def _is_record(lines: list[bytes]) -> bool:
    """Whether four lines are a record: a name line, and a + line that is bare or repeats the name."""
    if len(lines) < 4 or not lines[0].startswith(b"@") or not lines[2].startswith(b"+"):
        return False
    return len(lines[1]) == len(lines[3]) and (len(lines[2]) == 1 or lines[2][1:] == lines[0][1:])


class _Lines:
    """Lines without their ends, with the byte where each begins."""

    def __init__(self, stream, at: int):
        self.stream, self.at, self.rest = stream, at, b""

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while True:
            chunk = self.stream.read(CHUNK)
            lines = (self.rest + chunk).split(b"\n")
            self.rest = lines.pop() if chunk else b""
            for line in lines:
                yield self.at, line.rstrip(b"\r")
                self.at += len(line) + 1
            if not chunk:
                return


def records(path: str, start: int = 0, stop: int | None = None) -> Iterator[tuple[str, str, str]]:
    """(name, seq, qual) of the records that begin in [start, stop).

    Of a bzip2 file, these are compressed bytes, and a record belongs to the range that has the block with the line end before
    it. Its places are counted from the first block of the range, so there a record begins behind place 0.
    """
    where, root = _open(path)
    codec = _codec(path)
    raw = where.open_input_stream(root, compression=codec) if codec == "gzip" else where.open_input_file(root)
    with raw:
        if codec == "bz2":
            stream = BlockStream(raw, start, stop)
            yield from _records(stream, 0, bool(start), lambda at: stream.limit is not None and at > stream.limit)
        else:
            if start:
                raw.seek(start - 1)
            yield from _records(raw, start - 1 if start else 0, bool(start), lambda at: stop is not None and at >= stop)


def _records(stream, first: int, inside: bool, past: Callable[[int], bool]) -> Iterator[tuple[str, str, str]]:
    """Records of a stream from place `first` until one begins `past` its end. inside: the line there may have begun before,
    as may the record."""
    lines = iter(_Lines(stream, first))
    held: list[tuple[int, bytes]] = []
    if inside:
        next(lines, None)  # the rest of the line that holds the byte before the range
    synced = not inside
    for at, line in lines:
        if synced and not held and not line:
            continue
        held.append((at, line))
        if not synced and len(held) < 8:
            continue
        if not synced:
            for i in range(4):
                if _is_record([x for _, x in held[i : i + 4]]):
                    held = held[i:]
                    synced = True
                    break
            else:
                if any(x.startswith(b"@") for _, x in held[:4]):
                    held = held[1:]
                else:
                    held = held[4:]
                continue
        while len(held) >= 4:
            if past(held[0][0]):
                return
            four, held = held[:4], held[4:]
            yield tuple(x.decode("latin-1") for x in (four[0][1][1:], four[1][1], four[3][1]))  # type: ignore[misc]
    if not synced:
        for i in range(len(held)):
            if _is_record([x for _, x in held[i : i + 4]]):
                held = held[i:]
                break
        else:
            return
    while len(held) >= 4 and not past(held[0][0]):
        four, held = held[:4], held[4:]
        yield tuple(x.decode("latin-1") for x in (four[0][1][1:], four[1][1], four[3][1]))  # type: ignore[misc]


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.split = int(options.get("split", SPLIT))
        self.packed_split = int(options.get("packed_split", PACKED_SPLIT))

    def partitions(self) -> list[Split]:
        out = []
        for path, size in files(self.paths):
            each = {"gzip": max(size, 1), "bz2": self.packed_split}.get(_codec(path), self.split)
            out += [Split(path, a, min(size, a + each) if _codec(path) != "gzip" else None) for a in range(0, max(size, 1), each)]
        return out

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str, str]] = []
        size = 0
        for row in records(*partition.value):
            rows.append(row)
            size += len(row[1])
            if size > CHUNK:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["name", "seq", "qual"])


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def read_fastq(spark: SparkSession, *paths: str, split: int = SPLIT, packed_split: int = PACKED_SPLIT) -> DataFrame:
    """reads(name, seq, qual) of all files, directories or patterns."""
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("split", split).option("packed_split", packed_split).load(",".join(paths))
