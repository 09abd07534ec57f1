"""Lines of files by ranges of bytes: a splittable source of which each task reads its own range, from any byte on.

``line_ranges`` takes a manifest, a Parquet folder of ``(path, start, length)``, and deals the bytes from ``start`` to
``length`` of all its files over tasks in ranges of ``rangeBytes``. A line belongs to the range in which it begins; the
task that reads it follows it past the range's end. Three modes: ``lines`` gives the lines, ``counts`` how many each range
has, and ``chunks`` digests of pieces of ``chunkBytes`` that are cut at whole multiples of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillhouse.sources.staging import table

#: Bytes of a range; of a piece of which a digest is kept; read at a time; and of lines that are handed on together.
RANGE_BYTES, CHUNK_BYTES, READ_BYTES, BATCH_BYTES = 64 << 20, 8 << 20, 4 << 20, 8 << 20
_SCHEMAS = {
    "lines": pa.schema([("path", pa.string()), ("range_start", pa.int64()), ("line_number", pa.int64()), ("start_offset", pa.int64()), ("end_offset", pa.int64()), ("raw", pa.binary())]),
    "counts": pa.schema([("path", pa.string()), ("range_start", pa.int64()), ("n_lines", pa.int64())]),
    "chunks": pa.schema([("path", pa.string()), ("chunk", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("sha", pa.string()), ("line_ends", pa.int64())]),
}
_DDL = {
    "lines": "path string, range_start long, line_number long, start_offset long, end_offset long, raw binary",
    "counts": "path string, range_start long, n_lines long",
    "chunks": "path string, chunk long, start long, size long, sha string, line_ends long",
}


def file_system(path: str) -> tuple[object, str]:
    """The file system of a path or URI, and the path in it: the local one, or that which a URI names."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def open_file(path: str) -> pa.NativeFile:
    """A file to read from any place."""
    where, name = file_system(path)
    return where.open_input_file(name)


@dataclass
class Ranges(InputPartition):
    """What one task reads: ``(path, start, stop, first, length)``, bytes ``start`` to ``stop`` of a file read from ``first`` to ``length``.

    ``numbers`` holds the number of each part's first line.
    """

    parts: list[tuple[str, int, int, int, int]] = field(default_factory=list)
    numbers: list[int] = field(default_factory=list)


def dealt(files: list[tuple[str, int, int]], range_bytes: int, align: int = 1) -> list[Ranges]:
    """Ranges of files ``(path, start, length)``, small files together and large ones cut, at whole multiples of ``align``."""
    out, size = [Ranges()], 0
    for path, first, length in sorted(files):
        at = first
        while at < length:
            stop = length if length - at + size <= range_bytes else max(at + 1, at + range_bytes - size)
            if stop < length:
                stop = min(length, -(-stop // align) * align)
            out[-1].parts.append((path, at, stop, first, length))
            size += stop - at
            at = stop
            if size >= range_bytes:
                out.append(Ranges())
                size = 0
    return [r for r in out if r.parts]


class _Lines:
    """The lines of a range of an open file, with their offsets. No more than a line and one read are held."""

    def __init__(self, f: pa.NativeFile, start: int, stop: int, first: int, length: int) -> None:
        self.f, self.stop, self.length, self.at = f, stop, length, start
        f.seek(start)
        if start > first:
            # The line that the byte before belongs to is the range's before, unless it ends there.
            f.seek(start - 1)
            if f.read(1) != b"\n":
                self._skip()

    def _skip(self) -> None:
        while self.at < self.length:
            got = self.f.read(min(READ_BYTES, self.length - self.at))
            if not got:
                self.at = self.length
                return
            end = got.find(b"\n")
            if end >= 0:
                self.at += end + 1
                self.f.seek(self.at)
                return
            self.at += len(got)

    def __iter__(self) -> Iterator[tuple[int, list[bytes]]]:
        """``(offset, lines)``, some at a time."""
        held: list[bytes] = []  # a line of which no end has been read yet
        size = 0
        while self.at < self.stop:
            got = self.f.read(min(READ_BYTES, self.length - self.at - size))
            if not got:
                if held:
                    yield self.at, [b"".join(held)]
                return
            cut = got.rfind(b"\n") + 1
            if not cut:
                held.append(got)
                size += len(got)
                continue
            whole = b"".join([*held, got[:cut]])
            held, size = [got[cut:]] if cut < len(got) else [], len(got) - cut
            keep, end = [], self.at
            for x in whole.split(b"\n")[:-1]:
                if end >= self.stop:
                    break
                keep.append(x + b"\n")
                end += len(x) + 1
            yield self.at, keep
            self.at += len(whole)


def _columns(folder: str, *names: str) -> list[tuple]:
    """The rows of a table that Spark wrote."""
    import pyarrow.parquet as pq

    where, path = file_system(folder)
    got = pq.read_table(path, filesystem=where, columns=list(names))
    return list(zip(*(got.column(c).to_pylist() for c in names), strict=True))


class LineRangesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.manifest, self.mode = options["manifest"], options.get("mode", "lines")
        self.numbers = options.get("numbers")
        self.range_bytes, self.chunk = int(options.get("rangebytes", RANGE_BYTES)), int(options.get("chunkbytes", CHUNK_BYTES))

    def partitions(self) -> list[Ranges]:
        out = dealt(_columns(self.manifest, "path", "start", "length"), self.range_bytes, self.chunk if self.mode == "chunks" else 1)
        if self.numbers:
            first = {(path, start): n for path, start, n in _columns(self.numbers, "path", "range_start", "before")}
            for r in out:
                r.numbers = [first[p[0], p[1]] for p in r.parts]
        return out

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # without any range Spark asks once for nothing
            return
        for part, number in zip(partition.parts, partition.numbers or [0] * len(partition.parts), strict=True):
            if self.mode == "counts" and not self._opens(part[0]):
                yield pa.RecordBatch.from_arrays([pa.array([part[0]]), pa.array([part[1]], pa.int64()), pa.nulls(1, pa.int64())], schema=_SCHEMAS["counts"])
                continue
            with open_file(part[0]) as f:
                yield from self._lines(f, *part, number) if self.mode == "lines" else getattr(self, f"_{self.mode}")(f, *part)

    @staticmethod
    def _opens(path: str) -> bool:
        try:
            with open_file(path) as f:
                f.read(1)
        except OSError:
            return False
        return True

    def _lines(self, f: pa.NativeFile, path: str, start: int, stop: int, first: int, length: int, number: int = 0) -> Iterator[pa.RecordBatch]:
        for at, lines in _Lines(f, start, stop, first, length):
            lo = 0
            while lo < len(lines):
                hi, size = lo, 0
                while hi < len(lines) and (hi == lo or size + len(lines[hi]) <= BATCH_BYTES):
                    size += len(lines[hi])
                    hi += 1
                ends = [at := at + len(x) for x in lines[lo:hi]]
                begins = [e - len(x) for e, x in zip(ends, lines[lo:hi], strict=True)]
                n = hi - lo
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([start] * n, pa.int64()), pa.array(range(number, number + n), pa.int64()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), pa.array(lines[lo:hi], pa.binary())], schema=_SCHEMAS["lines"])
                number += n
                lo = hi

    def _counts(self, f: pa.NativeFile, path: str, start: int, stop: int, first: int, length: int) -> Iterator[pa.RecordBatch]:
        n = sum(len(lines) for _, lines in _Lines(f, start, stop, first, length))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start], pa.int64()), pa.array([n], pa.int64())], schema=_SCHEMAS["counts"])

    def _chunks(self, f: pa.NativeFile, path: str, start: int, stop: int, first: int, length: int) -> Iterator[pa.RecordBatch]:
        f.seek(start)
        while start < stop:
            end = min(stop, (start // self.chunk + 1) * self.chunk)
            got = f.read(end - start)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start // self.chunk], pa.int64()), pa.array([start], pa.int64()), pa.array([len(got)], pa.int64()), pa.array([hashlib.sha256(got).hexdigest()]), pa.array([got.count(b"\n")], pa.int64())], schema=_SCHEMAS["chunks"])
            start = end


class LineRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return _DDL[self.options.get("mode", "lines")]

    def reader(self, schema: object) -> LineRangesReader:
        return LineRangesReader({k.lower(): v for k, v in self.options.items()})


def _read(spark: SparkSession, manifest: str, mode: str, range_bytes: int, chunk_bytes: int, **options: str) -> DataFrame:
    spark.dataSource.register(LineRanges)
    return spark.read.format("line_ranges").options(**options).option("manifest", manifest).option("mode", mode).option("rangeBytes", str(range_bytes)).option("chunkBytes", str(chunk_bytes)).load()


def _manifest(files: DataFrame, stop: str) -> str:
    """The folder of a table of ``(path, start, length)`` for the files that have something to read."""
    wanted = files.select("path", F.coalesce(F.col("start"), F.lit(0)).cast("long").alias("start"), F.col(stop).cast("long").alias("length")).where("start < length")
    return _folder(wanted, "manifest")


def _folder(df: DataFrame, name: str) -> str:
    """The folder that a table of few columns was written to; the driver reads it where it plans a scan."""
    return table(df.coalesce(1), name).inputFiles()[0].rsplit("/", 1)[0]


def line_counts(files: DataFrame, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, range_start, n_lines)`` of ``files`` (``path, start, length``) as a table; ``n_lines`` is null where a file cannot be opened."""
    return table(_read(files.sparkSession, _manifest(files, "length"), "counts", range_bytes, CHUNK_BYTES), "counts")


def range_lines(files: DataFrame, counts: DataFrame | None = None, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, line_number, start_offset, end_offset, raw)`` of the lines of ``files`` (``path, start, length``) from ``start`` to ``length``, byte for byte.

    ``start`` (null: 0) must be where a line begins; no byte before it is read. Numbers go on from 0 at ``start``. What is
    appended to a file beyond ``length`` is not seen; a last line without its end is a line, to be held back by
    ``complete``. Files are read in ranges, so a large one by many tasks, of which each numbers its own lines; the numbers
    of a range's first lines come from ``counts``, a pass before. An empty file has no line. Files that ``counts``, where
    it is given, could not open are left out; without it they are an error.
    """
    if counts is None:
        counts = line_counts(files, range_bytes=range_bytes)
    else:
        files = files.join(counts.where("n_lines is null").select("path").distinct(), "path", "left_anti")
    before = F.coalesce(F.sum("n_lines").over(Window.partitionBy("path").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = _folder(counts.where("n_lines is not null").select("path", "range_start", before.alias("before")), "numbers")
    lines = _read(files.sparkSession, _manifest(files, "length"), "lines", range_bytes, CHUNK_BYTES, numbers=firsts)
    return lines.select("path", "line_number", "start_offset", "end_offset", "raw")


def chunk_digests(files: DataFrame, stop: str = "length", *, range_bytes: int = RANGE_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(path, chunk, start, size, sha, line_ends)`` of the bytes of ``files`` from ``start`` (null: 0) to the column ``stop``, in pieces cut at multiples of ``chunk_bytes``."""
    return _read(files.sparkSession, _manifest(files, stop), "chunks", range_bytes, chunk_bytes)


def tree_digest(chunks: DataFrame) -> DataFrame:
    """``(path, prefix_sha, prefix_lines, prefix_bytes)``: one digest of all digests of a file's chunks, in order, and what they sum up to."""
    return chunks.groupBy("path").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "sha"))), lambda x: x["sha"]), ""), 256).alias("prefix_sha"),
        F.sum("line_ends").alias("prefix_lines"), F.sum("size").alias("prefix_bytes"),
    )
