"""Overlays as change logs, walls, cascading deletion with a ledger, rebuilds and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillhouse.sources.export import pieces

#: Anomalies of the capture phase, which a rebuild keeps; all others it finds again. Fixed values.
KEPT_ANOMALIES = ("uuid_content_conflict", "source_diverged", "source_reappeared", "file_ingest_failure")


def current(log: DataFrame, key: str = "session_uuid", order: tuple[str, ...] = ("at",)) -> DataFrame:
    """The state after a change log (``key, op, value`` and an order): last change wins, removed keys are absent.

    Favourites, titles, archive marks and walls are such logs; repeating a change changes nothing.
    """
    last = log.groupBy(key).agg(F.max_by(F.struct("op", "value"), F.struct(*order)).alias("l"))
    return last.where("l.op = 'set'").select(key, F.col("l.value").alias("value"))


def title_log(edits: DataFrame) -> DataFrame:
    """Title edits as changes: blank ones remove, too long ones are refused."""
    from quillhouse.functions.text import title_action

    out = edits.withColumn("action", title_action(F.col("value"))).where("action <> 'reject'")
    return out.withColumn("op", F.when(F.col("action") == "delete", "remove").otherwise("set")).drop("action")


def walls(projects: DataFrame, sessions: DataFrame) -> DataFrame:
    """Both walls in one list, sorted."""
    a = projects.select(F.lit("project").alias("wall"), F.col("project_slug").alias("target"))
    return a.unionByName(sessions.select(F.lit("session").alias("wall"), F.col("session_uuid").alias("target"))).orderBy("wall", "target")


def exclusion_changes(log: DataFrame, sessions: DataFrame) -> DataFrame:
    """What each change of a wall did: ``log`` with ``changed`` and ``prior_sessions``.

    ``log`` has ``kind`` (``project`` or ``session``), ``target, op`` (``add`` or ``remove``), ``reason`` and ``at``, an
    order without ties for a target; ``sessions`` has ``session_uuid, project_slug``. Adding what is excluded already or
    removing what is not changes nothing. Excluding a project does not touch the sessions that it has by now;
    ``prior_sessions`` says how many stay, 0 for other changes.
    """
    before = F.lag("op").over(Window.partitionBy("kind", "target").orderBy("at"))
    changed = F.when(F.col("op") == "add", F.coalesce(before != "add", F.lit(True))).otherwise(F.coalesce(before == "add", F.lit(False)))
    held = sessions.select("session_uuid", F.col("project_slug").alias("target")).distinct().groupBy("target").agg(F.count("*").alias("n"))
    out = log.withColumn("changed", changed).join(held.withColumn("kind", F.lit("project")), ["kind", "target"], "left")
    return out.withColumn("prior_sessions", F.when(F.col("changed") & (F.col("op") == "add"), F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long")).drop("n")


def exclusions(log: DataFrame) -> DataFrame:
    """``(kind, target, reason, at)`` of what is excluded after all changes of ``log``: of repeated additions the first counts, with its reason."""
    w = Window.partitionBy("kind", "target").orderBy("at")
    took = log.withColumn("_new", F.coalesce(F.lag("op").over(w) != "add", F.lit(True)))
    last = took.groupBy("kind", "target").agg(F.max_by("op", "at").alias("op"), F.max_by(F.struct("reason", "at"), F.when((F.col("op") == "add") & F.col("_new"), F.col("at"))).alias("a"))
    return last.where("op = 'add'").select("kind", "target", "a.reason", "a.at")


def first_encounters(seen: DataFrame, known: DataFrame) -> DataFrame:
    """Schema versions that are not recorded yet."""
    return seen.select("schema_version").distinct().join(known.select("schema_version"), "schema_version", "left_anti")


def scope(rows: DataFrame, doomed: DataFrame, key: str = "session_uuid") -> DataFrame:
    """The rows of one table that a deletion covers."""
    return rows.join(doomed.select(key).distinct(), key, "left_semi")


def cascade(tables: dict[str, DataFrame], doomed: DataFrame, key: str = "session_uuid") -> dict[str, DataFrame]:
    """Every table without the doomed sessions' rows."""
    gone = doomed.select(key).distinct()
    return {name: rows.join(gone, key, "left_anti") for name, rows in tables.items()}


def scrub(snapshots: dict[str, dict[str, DataFrame]], doomed: DataFrame, key: str = "session_uuid") -> tuple[dict[str, dict[str, DataFrame]], DataFrame]:
    """The cascade in every snapshot: its tables without the doomed rows, and ``(snapshot, was_present)``, whether it had any."""
    left = {name: cascade(tables, doomed, key) for name, tables in snapshots.items()}
    report = None
    for name, tables in snapshots.items():
        held = None
        for rows in tables.values():
            n = scope(rows, doomed, key).agg((F.count("*") > 0).alias("was_present"))
            held = n if held is None else held.unionByName(n)
        one = held.agg(F.bool_or("was_present").alias("was_present")).select(F.lit(name).alias("snapshot"), "was_present")
        report = one if report is None else report.unionByName(one)
    return left, report


def run_counters(records: DataFrame, anomalies: DataFrame) -> DataFrame:
    """``(run_id, files_seen, records_added, records_skipped_duplicate, anomalies, status)`` of each run.

    ``records`` has ``run_id, file, is_duplicate``, ``anomalies`` has ``run_id, severity``. A run with an error among its
    anomalies has the status ``errors``, else ``ok``; a run that only has anomalies saw no file.
    """
    taken = records.groupBy("run_id").agg(F.countDistinct("file").alias("files_seen"), F.count_if(~F.col("is_duplicate")).alias("records_added"), F.count_if("is_duplicate").alias("records_skipped_duplicate"))
    noted = anomalies.groupBy("run_id").agg(F.count("*").alias("anomalies"), F.bool_or(F.col("severity") == "error").alias("_bad"))
    both = taken.join(noted, "run_id", "full").fillna(0, ["files_seen", "records_added", "records_skipped_duplicate", "anomalies"])
    return both.withColumn("status", F.when(F.coalesce("_bad", F.lit(False)), "errors").otherwise("ok")).drop("_bad")


def recapture_counters(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """``(key, records_before, records_after, anomalies_before, anomalies_after, reconciled)`` of files that are split anew.

    Both have ``key, line_number, raw, is_anomaly``, and ``start_offset`` if it is known. A file whose bytes would change is refused: its counters stay as before.
    """
    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.count("*").alias(f"records_{name}"), F.count_if("is_anomaly").alias(f"anomalies_{name}"))

    both = counted(before, "before").join(counted(after, "after"), key, "left").join(same_bytes(before, after, key).select(key, "may_swap"), key, "left")
    swap = F.coalesce("may_swap", F.lit(False))
    kept = [F.when(swap, F.col(f"{x}_after")).otherwise(F.col(f"{x}_before")).alias(f"{x}_after") for x in ("records", "anomalies")]
    return both.select(key, "records_before", "anomalies_before", *kept, swap.alias("reconciled"))


def preview(tables: dict[str, DataFrame], doomed: DataFrame, key: str = "session_uuid") -> DataFrame:
    """How many rows of each table a deletion would take."""
    counts = [scope(rows, doomed, key).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows") for name, rows in tables.items()]
    out = counts[0]
    for x in counts[1:]:
        out = out.unionByName(x)
    return out


def deletion_preview(targets: DataFrame, records: DataFrame, sources: DataFrame, on_disk: DataFrame) -> DataFrame:
    """``(kind, target, label, sessions, records, paths_on_disk)``: what a deletion of each target would take, and how many of its source files are still there to be captured again.

    ``targets`` has ``kind, target, label, session_uuid``, a row for each session of a target (null for a project without
    any); ``records`` and ``sources`` (with ``path``) have ``session_uuid``; ``on_disk`` is a listing. Records are counted
    by session before they meet targets, so no session's rows are copied for several targets.
    """
    counted = records.groupBy("session_uuid").agg(F.count("*").alias("n_records"))
    live = sources.join(on_disk.select("path").distinct(), "path", "left_semi").groupBy("session_uuid").agg(F.countDistinct("path").alias("n_paths"))
    each = targets.join(counted, "session_uuid", "left").join(live, "session_uuid", "left")
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("n_records", "records"), ("n_paths", "paths_on_disk"))]
    return each.groupBy("kind", "target", "label").agg(F.countDistinct("session_uuid").alias("sessions"), *total)


def paths_present(targets: DataFrame, sources: DataFrame, on_disk: DataFrame) -> DataFrame:
    """``(kind, target, path)``: those source files, by name."""
    live = sources.join(on_disk.select("path").distinct(), "path", "left_semi").select("session_uuid", "path").distinct()
    return targets.select("kind", "target", "session_uuid").join(live, "session_uuid").select("kind", "target", "path").distinct()


def scrub_snapshots(tables: dict[str, DataFrame], doomed: DataFrame, reason: str, records: str = "records", by: str = "snapshot", key: str = "session_uuid") -> tuple[dict[str, DataFrame], DataFrame]:
    """The whole cascade in every snapshot, with a ledger in each: all ``tables`` have a column ``by``, and one pass over each serves all snapshots.

    Returns the tables without the doomed sessions' rows, and ``(by, label_sha, reason, n_records)`` of the sessions that
    a snapshot had. A session that a snapshot does not know leaves no tombstone there.
    """
    gone = doomed.select(key).distinct()
    had = None
    for name, rows in tables.items():
        found = rows.join(gone, key, "left_semi").groupBy(by, key).agg((F.count("*") if name == records else F.lit(0).cast("long")).alias("n_records"))
        had = found if had is None else had.unionByName(found)
    tombstones = had.groupBy(by, key).agg(F.sum("n_records").alias("n_records")).select(by, F.sha2(key, 256).alias("label_sha"), F.lit(reason).alias("reason"), "n_records")
    return cascade(tables, doomed, key), tombstones


def ledger(doomed: DataFrame, records: DataFrame, reason: str, key: str = "session_uuid") -> DataFrame:
    """Tombstones: that something was deleted, why and how much, never what."""
    counted = scope(records, doomed, key).groupBy(key).agg(F.count("*").alias("n_records"))
    return doomed.select(key).distinct().join(counted, key, "left").select(F.sha2(key, 256).alias("label_sha"), F.lit(reason).alias("reason"), F.coalesce("n_records", F.lit(0)).alias("n_records"))


def rebuilt_anomalies(old: DataFrame, new: DataFrame) -> DataFrame:
    """The anomalies after a rebuild: capture-phase ones stay, the rest is what the new parse found."""
    return old.where(F.col("kind").isin(*KEPT_ANOMALIES)).unionByName(new.where(~F.col("kind").isin(*KEPT_ANOMALIES)))


def same_bytes(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """Which files keep their exact bytes when split again; only those may be swapped.

    Both are cut into chunks of bounded size, and the chunks' digests are compared in order; no cell holds a whole file.
    """

    def digest(lines: DataFrame, name: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct("block", "sha")))
        return pieces(lines, key).groupBy(key).agg(F.sha2(F.array_join(F.transform(items, lambda x: x["sha"]), ""), 256).alias(name), F.sum("n_bytes").alias(f"n_{name}"))

    return digest(before, "old").join(digest(after, "new"), key).withColumn("may_swap", (F.col("old") == F.col("new")) & (F.col("n_old") == F.col("n_new")))


def double_primaries(files: DataFrame) -> DataFrame:
    """Transcripts with more than one primary file: there should be none."""
    return files.where("is_primary").groupBy("transcript").agg(F.count("*").alias("n")).where("n > 1")
