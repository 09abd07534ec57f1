"""Byte-faithful export of captured transcripts."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillhouse.sources import ranges

#: Bytes of a chunk, and line numbers whose lines are summed in one window.
CHUNK_BYTES, RUN_LINES = 4 << 20, 4096


def choose_file(files: DataFrame) -> DataFrame:
    """The file of each transcript to export: the primary one, else that with most records, the newest generation, the last key."""
    w = Window.partitionBy("transcript").orderBy(F.desc("is_primary"), F.desc("n_records"), F.desc("generation"), F.desc("file"))
    return files.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def record_counts(files: DataFrame, lines: DataFrame) -> DataFrame:
    """``files`` with their number of lines, none included."""
    return files.join(lines.groupBy("file").agg(F.count("*").alias("n_records")), "file", "left").fillna({"n_records": 0})


def as_bytes(lines: DataFrame, key: str = "transcript") -> DataFrame:
    """Each transcript's bytes in one cell: its lines put together in order, nothing added. ``as_chunks`` has no bound of 2 GB."""
    return lines.groupBy(key).agg(F.expr("listagg(raw, X'') within group (order by line_number)").alias("content"), F.sum(F.octet_length("raw")).alias("n_bytes"))


def as_chunks(lines: DataFrame, key: str = "transcript", limit: int = CHUNK_BYTES) -> DataFrame:
    """Each transcript's bytes as ordered chunks ``(key, chunk, start, content, n_bytes, sha)``; put together they are ``as_bytes``.

    A line goes whole to the chunk its first byte falls in, so a chunk has ``limit`` bytes and the rest of one line at most.
    Offsets are sums within runs of line numbers plus the sums of the runs before, so no task gets a whole transcript.
    ``sha`` is the digest of the chunk. Lines of equal number stand in the order of their bytes, null numbers first.
    """
    rows = _with_start(lines, key).withColumn("chunk", F.floor(F.col("start") / limit))
    out = rows.groupBy(key, "chunk").agg(F.min("start").alias("start"), F.expr("listagg(raw, X'') within group (order by start)").alias("content"), F.sum("_size").alias("n_bytes"))
    return out.withColumn("sha", F.sha2("content", 256))


def pieces(lines: DataFrame, key: str = "transcript", limit: int = CHUNK_BYTES) -> DataFrame:
    """``(key, block, sha, n_bytes)``: digests of each transcript's bytes cut every ``limit`` bytes, however it is split into lines.

    Lines that have a ``start_offset`` lie where it says; others are added up.
    """
    if "start_offset" in lines.columns:
        rows = lines.select(key, "raw", F.col("start_offset").cast("long").alias("start"), F.octet_length("raw").cast("long").alias("_size"))
    else:
        rows = _with_start(lines, key)
    rows = rows.where("_size > 0")
    last = F.floor((F.col("start") + F.col("_size") - 1) / limit)
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / limit), last)))
    first = F.greatest(F.lit(0), F.col("block") * limit - F.col("start"))
    stop = F.least(F.col("_size"), (F.col("block") + 1) * limit - F.col("start"))
    rows = rows.withColumn("raw", F.substring("raw", (first + 1).cast("int"), (stop - first).cast("int")))
    out = rows.groupBy(key, "block").agg(F.expr("listagg(raw, X'') within group (order by start)").alias("_bytes"))
    return out.select(key, "block", F.sha2("_bytes", 256).alias("sha"), F.octet_length("_bytes").cast("long").alias("n_bytes"))


def _with_start(lines: DataFrame, key: str) -> DataFrame:
    """Lines with ``start``, the offset of their first byte in the transcript, and ``_size``."""
    k, run = F.col(key), F.floor(F.col("line_number") / RUN_LINES)
    # Never null, so that the window and the join are dealt alike and the bytes move once for both.
    name = F.concat(F.coalesce(run.cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.concat(F.lit("k"), k.cast("string")), F.lit("")))
    rows = lines.select(k, "line_number", "raw", run.alias("_run"), name.alias("_id"), F.octet_length("raw").cast("long").alias("_size"))
    runs = rows.groupBy(key, "_run", "_id").agg(F.sum("_size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_id", F.coalesce(before, F.lit(0)).alias("_base"))
    within = F.sum("_size").over(Window.partitionBy("_id").orderBy("line_number", "raw").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_within", F.coalesce(within, F.lit(0))).join(runs, "_id")
    return rows.withColumn("start", F.col("_base") + F.col("_within"))


def digests(chunks: DataFrame, key: str = "transcript") -> DataFrame:
    """``(key, sha, n_bytes)`` of whole transcripts from their chunks.

    SHA-256 runs from the first byte to the last, so one task reads the chunks of a transcript, in order; it holds a few at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        name, state, size, begun = None, hashlib.sha256(), 0, False
        for batch in batches:
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if begun and k != name:
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([state.hexdigest()]), pa.array([size], pa.int64())], [key, "sha", "n_bytes"])
                    state, size = hashlib.sha256(), 0
                name, begun = k, True
                state.update(content.as_buffer())
                size += len(content.as_buffer())
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([state.hexdigest()]), pa.array([size], pa.int64())], [key, "sha", "n_bytes"])

    ordered = chunks.repartition(key).sortWithinPartitions(key, "chunk").select(F.col(key).cast("string").alias(key), "content")
    return ordered.mapInArrow(run, f"{key} string, sha string, n_bytes long")


def write_files(lines: DataFrame, folder: str, key: str = "transcript") -> DataFrame:
    """Writes each transcript to a file below ``folder`` that all tasks see; existing files stay. Returns ``(key, path, n_bytes)``.

    A task writes to a name of its own and renames it when done, so a task that is lost or run again leaves no half file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        name, out, size, temp, done = None, None, 0, "", []

        def close() -> None:
            if out is not None:
                out.close()
                path = os.path.join(folder, name.replace("/", "_") + ".jsonl")
                if os.path.exists(path):
                    os.remove(temp)
                else:
                    os.rename(temp, path)
                done.append((name, path, size))

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != name:
                    close()
                    name, size, temp = k, 0, os.path.join(folder, f".{uuid.uuid4().hex}.part")
                    out = open(temp, "wb")  # noqa: SIM115
                out.write(raw)
                size += len(raw)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], [key, "path", "n_bytes"])

    ordered = lines.repartition(key).sortWithinPartitions(key, "line_number").select(key, "raw")
    return ordered.mapInArrow(run, f"{key} string, path string, n_bytes long")


def write_parts(lines: DataFrame, folder: str, keep: Callable[[DataFrame, str], DataFrame], key: str = "transcript", limit: int = CHUNK_BYTES) -> DataFrame:
    """Writes each transcript as a folder ``<transcript>.jsonl`` of parts below ``folder``, a path or URI; returns ``(key, path, n_parts, n_bytes)``.

    Parts are named by the offset of their first byte, so that, read in the order of their names, they are the
    transcript's bytes. They are written by ranges of offsets, a long transcript by many tasks, into a folder of this run;
    a transcript's folder is moved to its place when all its parts are there. What a lost task left goes with the run's
    folder. A transcript that is there already stays as it is. ``keep`` writes a table and reads it. Null transcripts are
    left out; a transcript without bytes has no folder.
    """
    import uuid

    run = f"{folder.rstrip('/')}/.{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = ranges.file_system(run)
        for batch in batches:
            sizes = []
            for name, start, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                place = f"{base}/{_file_name(name)}"
                where.create_dir(place, recursive=True)
                temp = f"{base}/part-{uuid.uuid4().hex}"
                with where.open_output_stream(temp) as out:
                    out.write(content.as_buffer())
                where.move(temp, f"{place}/{start:020d}")
                sizes.append(len(content.as_buffer()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], [key, "start", "n_bytes"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        (where, base), (_, to) = ranges.file_system(run), ranges.file_system(folder.rstrip("/"))
        for batch in batches:
            paths = []
            for name in batch.column(0).to_pylist():
                old, new = f"{base}/{_file_name(name)}", f"{to}/{_file_name(name)}"
                # Run again after a loss, it finds the folder moved.
                if where.get_file_info(new).type == fs.FileType.NotFound:
                    where.move(old, new)
                paths.append(f"{folder.rstrip('/')}/{_file_name(name)}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths), batch.column(1), batch.column(2)], [key, "path", "n_parts", "n_bytes"])

    chunks = as_chunks(lines.where(F.col(key).isNotNull()), key, limit).where("n_bytes > 0").select(F.col(key).cast("string").alias(key), "start", "content")
    parts = keep(chunks.mapInArrow(write, f"{key} string, start long, n_bytes long"), "parts")
    each = parts.groupBy(key).agg(F.count("*").alias("n_parts"), F.sum("n_bytes").alias("n_bytes"))
    out = keep(each.mapInArrow(move, f"{key} string, path string, n_parts long, n_bytes long"), "moved")
    from pyarrow import fs

    where, base = ranges.file_system(run)
    if where.get_file_info(base).type == fs.FileType.Directory:
        where.delete_dir(base)
    return out


def _file_name(transcript: str) -> str:
    return transcript.replace("/", "_") + ".jsonl"


def missing(transcripts: DataFrame, listed: DataFrame, key: str = "transcript") -> DataFrame:
    """Transcripts without a live file: what a restore has to write."""
    return transcripts.join(listed.select(key).distinct(), key, "left_anti")
