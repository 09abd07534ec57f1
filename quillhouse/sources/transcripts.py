"""Reading transcript trees: paths, walls, sidecars, byte-exact lines, reassembled records, incremental tails, duplicates, source states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillhouse.functions.text import whole_json
from quillhouse.sources import ranges, reassembly
from quillhouse.sources.staging import table

#: Path shapes below the root.
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
MAIN = rf"/([^/]+)/({UUID})\.jsonl$"
BACKUP = rf"/([^/]+)/({UUID})\.jsonl\.bak-[0-9]+$"
SUBAGENT = rf"/([^/]+)/({UUID})/subagents/agent-([0-9a-f]+)\.jsonl$"
SIDECAR = rf"/([^/]+)/({UUID})/subagents/agent-([0-9a-f]+)\.meta\.json$"
#: Entries of a wall, at most.
MOST_WALLS = 100_000
#: Lines that a task hands on together.
SPLIT_ROWS = 8192


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length, modificationTime)`` of all files below a root; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")


def classify_paths(paths: DataFrame) -> DataFrame:
    """Transcript files among ``paths``: ``project_slug, session_uuid, kind, agent_hex, is_backup``; other files are ignored."""
    p = F.col("path")

    def part(i: int) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract(p, shape, i), F.lit("")) for shape in (SUBAGENT, MAIN, BACKUP)])

    out = paths.where(p.rlike(MAIN) | p.rlike(BACKUP) | p.rlike(SUBAGENT))
    return out.withColumns({
        "project_slug": part(1), "session_uuid": part(2), "agent_hex": F.coalesce(F.nullif(F.regexp_extract(p, SUBAGENT, 3), F.lit("")), F.lit("")),
        "kind": F.when(p.rlike(SUBAGENT), "subagent").otherwise("main"), "is_backup": p.rlike(BACKUP),
    })


def behind_walls(files: DataFrame, projects: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """Files of neither an excluded project nor an excluded session; a wall that is not given shuts nothing out."""
    if projects is not None:
        files = files.join(projects.select("project_slug").distinct(), "project_slug", "left_anti")
    if sessions is not None:
        files = files.join(sessions.select("session_uuid").distinct(), "session_uuid", "left_anti")
    return files


def _let_in(projects: DataFrame | None, sessions: DataFrame | None) -> Column:
    """Which files may be opened, by their path alone: the source leaves the others shut.

    Walls are lists that people write; one of more than ``MOST_WALLS`` entries is refused.
    """
    path, out = F.col("_metadata.file_path"), F.lit(True)
    for wall, name, group in ((projects, "project_slug", 1), (sessions, "session_uuid", 2)):
        if wall is not None:
            shut = [r[0] for r in wall.select(name).where(F.col(name).isNotNull()).distinct().limit(MOST_WALLS + 1).collect()]
            if len(shut) > MOST_WALLS:
                raise ValueError(f"more than {MOST_WALLS} entries in a wall")
            if shut:
                out = out & ~F.coalesce(*[F.nullif(F.regexp_extract(path, shape, group), F.lit("")) for shape in (SUBAGENT, MAIN, BACKUP, SIDECAR)], F.lit("")).isin(*shut)
    return out


def sidecar_rows(found: DataFrame) -> DataFrame:
    """``(session_uuid, agent_hex, agent_type, description, tool_use_id)`` of sidecars ``(path, value)``; broken ones give nulls."""
    v = F.from_json("value", "agentType string, description string, toolUseId string")
    meta = found.select(F.regexp_extract("path", SIDECAR, 2).alias("session_uuid"), F.regexp_extract("path", SIDECAR, 3).alias("agent_hex"), v["agentType"].alias("agent_type"), v["description"].alias("description"), v["toolUseId"].alias("tool_use_id"))
    return meta.groupBy("session_uuid", "agent_hex").agg(F.min(F.struct("agent_type", "description", "tool_use_id")).alias("m")).select("session_uuid", "agent_hex", "m.*")


def sidecars(spark: SparkSession, root: str, files: DataFrame, *, projects: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """Subagent files with their sidecar's ``agent_type, description, tool_use_id``; null where it is missing or broken. Walls shut sidecars too."""
    found = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.meta.json").where(_let_in(projects, sessions))
    return files.join(sidecar_rows(found.select(F.col("_metadata.file_path").alias("path"), "value")), ["session_uuid", "agent_hex"], "left")


def contents(spark: SparkSession, root: str, files: DataFrame, *, projects: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """``files`` with their bytes, null where a file cannot be read. Files behind a wall are not opened."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl*").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    return files.join(raw.where(_let_in(projects, sessions)).select("path", "content"), "path", "left")


def readable(loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with bytes, and an anomaly for each without: one bad file stops no run."""
    failed = loaded.where("content is null").select("path", F.lit("error").alias("severity"), F.lit("file_ingest_failure").alias("kind"), F.col("path").alias("detail"))
    return loaded.where("content is not null"), failed


def split_lines(files: DataFrame, content_col: str = "content") -> DataFrame:
    """Each file's lines, byte for byte, with ``line_number, start_offset, end_offset, raw``; the line end belongs to the line.

    The task that has a file cuts it; nothing is shuffled.
    """
    others = [c for c in files.columns if c != content_col]
    kinds = StructType([*files.select(*others).schema, *StructType.fromDDL("line_number int, raw binary, start_offset long, end_offset long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = batch.column(len(others)).cast(pa.binary())
            file_ends = np.frombuffer(content.buffers()[1], np.int32)[content.offset :][: len(content) + 1].astype(np.int64)
            data = np.frombuffer(content.buffers()[2] or b"", np.uint8)
            # Each file's bytes lie behind those of the one before: a line ends behind a line feed or where its file does.
            base = file_ends[0]
            ends = np.union1d(np.flatnonzero(data[base : file_ends[-1]] == 0x0A) + base + 1, file_ends[1:])
            ends = ends[ends > base]
            starts = np.concatenate(([base], ends[:-1]))
            file = np.searchsorted(file_ends, starts, "right") - 1
            number = np.arange(len(ends)) - np.searchsorted(starts, file_ends[file])
            for lo in range(0, len(ends), SPLIT_ROWS):
                some = slice(lo, lo + SPLIT_ROWS)
                at, first = file[some], file_ends[file[some]]
                edges = np.append(starts[some], ends[some][-1])
                raw = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((edges - edges[0]).astype(np.int32)), pa.py_buffer(data[edges[0] : edges[-1]])])
                kept = [c.take(pa.array(at)) for c in batch.columns[: len(others)]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(number[some].astype(np.int32)), raw, pa.array(starts[some] - first), pa.array(ends[some] - first)], names)

    names = [x.name for x in kinds]
    return files.where(F.col(content_col).isNotNull()).select(*others, F.col(content_col).cast("binary").alias("_content")).mapInArrow(run, kinds)


def reassembled(lines: DataFrame) -> DataFrame:
    """``lines`` with records that were printed over several lines joined again, by bounded blocks of lines (see ``reassembly``)."""
    return reassembly.reassembled(lines, table)


def complete(lines: DataFrame) -> DataFrame:
    """Lines that have ended, and a last one without a line end if it is whole JSON; another last one waits."""
    ended = F.decode("raw", "ISO-8859-1").endswith("\n")
    return lines.where(ended | whole_json(F.try_validate_utf8(F.col("raw").cast("string"))).isNotNull())


def prefix_digest(files: DataFrame, checkpoint: str = "checkpoint") -> DataFrame:
    """``files`` (with ``content``) with the digest and number of line ends of the first ``checkpoint`` bytes."""
    head = F.expr(f"substring(content, 1, cast({checkpoint} as int))")
    return files.withColumns({"prefix_sha": F.sha2(head, 256), "prefix_lines": F.length(F.regexp_replace(F.decode(head, "ISO-8859-1"), "[^\n]+", ""))})


def new_tails(files: DataFrame, known: DataFrame) -> DataFrame:
    """What to read of each file: ``files`` (``path, length, content``) against ``known`` (``path, checkpoint, sha, generation``).

    ``action`` is ``new``, ``same``, ``grown`` or ``diverged`` (shorter than the checkpoint, or other bytes before it, which
    opens the next generation from the first byte); ``content`` is what follows the checkpoint, ``first_line`` its line number.
    """
    both = files.join(known.select("path", "checkpoint", "sha", "generation"), "path", "left")
    both = prefix_digest(both.withColumn("checkpoint", F.coalesce("checkpoint", F.lit(0))))
    kept = (F.col("length") >= F.col("checkpoint")) & (F.col("prefix_sha") == F.col("sha"))
    action = F.when(F.col("generation").isNull(), "new").when(~kept, "diverged").when(F.col("length") == F.col("checkpoint"), "same").otherwise("grown")
    both = both.withColumn("action", action).where("action <> 'same'")
    tail = F.expr("substring(content, cast(checkpoint as int) + 1)")
    return both.withColumns({
        "content": F.when(F.col("action") == "grown", tail).otherwise(F.col("content")),
        "first_line": F.when(F.col("action") == "grown", F.col("prefix_lines")).otherwise(F.lit(0)),
        "generation": F.when(F.col("action") == "diverged", F.col("generation") + 1).otherwise(F.coalesce("generation", F.lit(0))),
    }).drop("sha", "prefix_sha", "prefix_lines")


def mark_duplicates(lines: DataFrame, order: list[str]) -> DataFrame:
    """``lines`` (``transcript, uuid, sha, file, line_number``) with ``is_duplicate`` and ``is_conflict``; every line stays.

    A line is a duplicate if an equal one came first from another file: equal by transcript, id and bytes, or for lines
    without id by transcript, bytes and line number. The first line with other bytes for a known id is a conflict.
    """
    o = [F.col(c) for c in order]
    same = ["transcript", F.coalesce("uuid", F.concat(F.lit("#"), F.col("line_number").cast("string"))), "sha"]
    first = F.first("file").over(Window.partitionBy(*same).orderBy(*o))
    rank_bytes = F.row_number().over(Window.partitionBy(*same).orderBy(*o))
    rank_uuid = F.row_number().over(Window.partitionBy("transcript", "uuid").orderBy(*o))
    return lines.withColumns({"is_duplicate": F.col("file") != first, "is_conflict": F.col("uuid").isNotNull() & (rank_bytes == 1) & (rank_uuid > 1)})


def source_states(before: DataFrame, now: DataFrame) -> DataFrame:
    """Known sources against a listing: ``active``, ``gone``, ``reappeared`` or ``new`` for each key, as the next state.

    ``before`` has ``key, state, sha``, ``now`` has ``key, sha``. A source that comes back with other bytes is ``diverged``.
    """
    both = before.select("key", F.col("state").alias("old"), F.col("sha").alias("old_sha")).join(now.select("key", "sha"), "key", "full")
    state = (
        F.when(F.col("old").isNull(), "new")
        .when(F.col("sha").isNull(), "gone")
        .when((F.col("old") == "gone") & (F.col("sha") == F.col("old_sha")), "reappeared")
        .when(F.col("sha") != F.col("old_sha"), "diverged")
        .otherwise("active")
    )
    return both.select("key", state.alias("state"), F.coalesce("sha", "old_sha").alias("sha"))


def elect_primary(files: DataFrame) -> DataFrame:
    """The file of each transcript that is interpreted: the first seen that is no backup and still active."""
    w = Window.partitionBy("transcript").orderBy("first_seen", "path")
    live = files.where("not is_backup and state = 'active'").withColumn("_rn", F.row_number().over(w))
    return live.where("_rn = 1").drop("_rn")


def newest_generation(files: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """The row of the newest generation of each path; ``ties`` order rows of one generation."""
    w = Window.partitionBy("path").orderBy(F.desc("generation"), *ties)
    return files.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def newest_by_uuid(lines: DataFrame) -> DataFrame:
    """The newest raw line of each record id, ``(uuid, line_number, sha)``; lines of older generations stay in the archive."""
    return lines.where("uuid is not null").groupBy("uuid").agg(F.max("line_number").alias("line_number"), F.max_by("sha", "line_number").alias("sha"))


#: What the archive holds of each line; the last line of a file in a run also says what the file was like.
_STATE = ("prefix_sha", "file_length", "file_time")
_CHUNKS = "path string, generation int, chunk long, start long, size long, sha string, line_ends long"


def _found(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that an earlier run wrote, or nothing: the first run finds none."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _known(spark: SparkSession, archive: str) -> DataFrame:
    """State of each file in an archive: checkpoint, digest of the bytes before it, length and time at its last capture."""
    old = _found(spark, archive)
    if old is None:
        return spark.createDataFrame([], "path string, checkpoint long, sha string, generation int, file_length long, file_time timestamp")
    ends = old.where("prefix_sha is not null").groupBy("path", "generation").agg(F.max("end_offset").alias("checkpoint"), F.max_by(F.struct(*_STATE), "end_offset").alias("s"))
    return newest_generation(ends).select("path", "checkpoint", F.col("s.prefix_sha").alias("sha"), "generation", "s.file_length", "s.file_time")


def _known_chunks(spark: SparkSession, archive: str, known: DataFrame) -> DataFrame:
    """The digests of the chunks before each file's checkpoint, the longest of each; chunks of a run whose lines never came reach past it or fail the tree's digest."""
    old = _found(spark, f"{archive}-chunks")
    if old is None:
        return spark.createDataFrame([], _CHUNKS)
    here = old.join(known.select("path", "generation", "checkpoint"), ["path", "generation"]).where(F.col("start") + F.col("size") <= F.col("checkpoint"))
    best = here.groupBy("path", "generation", "chunk").agg(F.max_by(F.struct("start", "size", "sha", "line_ends"), F.struct("size", "run_id")).alias("c"))
    return best.select("path", "generation", "chunk", "c.*")


def diverged(changed: DataFrame, stored: DataFrame, verify: str = "all") -> DataFrame:
    """``(path, chunk)``: files whose bytes before the checkpoint are not what they were, and the first chunk that differs.

    ``verify`` is ``all``, or ``last``: only the last chunk before each checkpoint is read again, for stores in which files
    can only grow. A file that is shorter than its checkpoint is not read; its chunk is null.
    """
    if verify not in ("all", "last"):
        raise ValueError(f"unknown verify {verify}")
    asked = stored.join(changed.where("length >= checkpoint").select("path", "checkpoint"), "path")
    if verify == "last":
        asked = newest_generation(asked.withColumn("generation", F.col("chunk")))
    asked = table(asked.select("path", "checkpoint", "chunk", "start", F.col("sha").alias("old")), "asked")
    now = ranges.chunk_digests(asked.groupBy("path").agg(F.min("start").alias("start"), F.max("checkpoint").alias("length")))
    other = asked.join(now.select("path", "chunk", "sha"), ["path", "chunk"], "left").where(F.col("sha").isNull() | (F.col("sha") != F.col("old")))
    short = changed.where("length < checkpoint").select("path", F.lit(None).cast("long").alias("chunk"))
    return other.groupBy("path").agg(F.min("chunk").alias("chunk")).unionByName(short)


def capture(spark: SparkSession, root: str, archive: str, run_id: str, *, projects: DataFrame | None = None, sessions: DataFrame | None = None, verify: str = "all", range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """One incremental run: reads what is new below ``root`` and appends it to ``archive`` as Parquet under ``run_id=``.

    Only files whose length or time has changed are read, and none behind a wall. Files are read by ranges of bytes: lines
    from the checkpoint on, and what is before it only as digests of chunks, to see that it is what it was (``verify``).
    The state of each file is in its own rows (the last of a run holds the digest over all chunks up to its end), so rows
    and state cannot get out of step, and a run over unchanged files adds nothing. The chunks' digests are in
    ``<archive>-chunks``, written before the lines. Files that cannot be read are noted in ``<archive>-anomalies``, and
    those that diverged, with the first chunk that differs.
    """
    known = table(_known(spark, archive), "known")
    files = behind_walls(classify_paths(listing(spark, root)), projects, sessions)
    same = known.select("path", F.col("file_length").alias("length"), F.col("file_time").alias("modificationTime"))
    changed = files.join(same, ["path", "length", "modificationTime"], "left_anti")
    changed = table(changed.join(known.select("path", "checkpoint", "generation"), "path", "left"), "changed")
    stored = table(_known_chunks(spark, archive, known), "stored")
    other = table(diverged(changed, stored, verify), "diverged")
    lines_before = stored.groupBy("path").agg(F.sum("line_ends").alias("lines_before"))
    state = changed.join(other.withColumn("moved", F.lit(True)), "path", "left").join(lines_before, "path", "left")
    action = F.when(F.col("checkpoint").isNull(), "new").when(F.col("moved"), "diverged").when(F.col("length") == F.col("checkpoint"), "same").otherwise("grown")
    grown = F.col("action") == "grown"
    state = table(state.withColumn("action", action).where("action <> 'same'").withColumns({
        "start": F.when(grown, F.col("checkpoint")).otherwise(F.lit(0)), "first_line": F.when(grown, F.col("lines_before")).otherwise(F.lit(0)),
        "generation": (F.coalesce("generation", F.lit(0)) + F.when(F.col("action") == "diverged", 1).otherwise(0)).cast("int"),
    }), "state")
    counts = ranges.line_counts(state, range_bytes=range_bytes)
    new = ranges.range_lines(state, counts, range_bytes=range_bytes).join(state.drop("start"), "path")
    lines = complete(reassembled(table(new, "lines")))
    out = lines.select(
        "path", "project_slug", "session_uuid", "kind", "agent_hex", "is_backup", "generation", "action", (F.col("line_number") + F.col("first_line")).alias("line_number"),
        "start_offset", "end_offset", F.sha2("raw", 256).alias("sha"), "raw", F.col("length").alias("file_length"), F.col("modificationTime").alias("file_time"),
    )
    out = table(out, "captured")
    ends = out.groupBy("path").agg(F.max("end_offset").alias("end_offset"), F.first("generation").alias("generation"))
    # Whole chunks before the checkpoint stay; the one that it cuts is read again.
    whole = F.when(grown, F.floor(F.col("checkpoint") / ranges.CHUNK_BYTES) * ranges.CHUNK_BYTES).otherwise(F.lit(0)).cast("long")
    due = table(ends.join(state.select("path", whole.alias("start")), "path"), "due")
    fresh = table(ranges.chunk_digests(due, "end_offset"), "fresh")
    kept = stored.join(due.select("path", F.col("start").alias("_from")), "path").where("start < _from").select(*fresh.columns)
    trees = ranges.tree_digest(kept.unionByName(fresh)).join(ends, "path").select("path", "end_offset", "prefix_sha")
    fresh.join(ends.select("path", "generation"), "path").write.mode("append").parquet(f"{archive}-chunks/run_id={run_id}")
    out.join(trees, ["path", "end_offset"], "left").write.mode("append").parquet(f"{archive}/run_id={run_id}")
    shut = counts.where("n_lines is null").select("path", F.lit("file_ingest_failure").alias("kind"), F.col("path").alias("detail"))
    moved = other.select("path", F.lit("source_diverged").alias("kind"), F.coalesce(F.concat(F.lit("chunk "), F.col("chunk").cast("string")), F.lit("shorter")).alias("detail"))
    shut.distinct().unionByName(moved).select("path", F.lit("error").alias("severity"), "kind", "detail").write.mode("append").parquet(f"{archive}-anomalies/run_id={run_id}")
    return spark.read.schema(out.join(trees, ["path", "end_offset"], "left").schema).parquet(f"{archive}/run_id={run_id}")

