"""Session folds and listings: bounds, titles, counts, overlays, unified match, windows of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillhouse.operators.authorship import CHAT_KINDS

PAGE, MOST = 50, 200
#: Line numbers whose records are numbered in one window.
RUN_LINES = 4096
LEGACY_TYPES = ("user", "assistant", "attachment")


def bounds(messages: DataFrame) -> DataFrame:
    """First and last activity of each session over all its transcripts; unknown times do not count."""
    return messages.groupBy("session_uuid").agg(F.min("seconds").alias("first_seconds"), F.max("seconds").alias("last_seconds"))


def latest_title(events: DataFrame, kind: str, title_col: str, order: list[str]) -> DataFrame:
    """The last title of a kind in record order, even if that is null."""
    return events.where(F.col("event_kind") == kind).groupBy("session_uuid").agg(F.max_by(title_col, F.struct(*order)).alias("title"))


def working_dir(messages: DataFrame, order: list[str]) -> DataFrame:
    """The first working directory seen in each project."""
    return messages.where("cwd <> ''").groupBy("project_slug").agg(F.min_by("cwd", F.struct(*order)).alias("cwd"))


def message_counts(messages: DataFrame) -> DataFrame:
    """Messages of each session's main transcript."""
    return messages.where("kind = 'main'").groupBy("session_uuid").agg(F.count("*").alias("n_messages"))


def without(rows: DataFrame, wall: DataFrame, key: str) -> DataFrame:
    """``rows`` without those whose key stands in ``wall``: archived sessions, excluded projects or sessions."""
    return rows.join(wall.select(key).distinct(), key, "left_anti")


def project_counts(projects: DataFrame, sessions: DataFrame, archived: DataFrame) -> DataFrame:
    """Visible sessions of each project, projects without any included."""
    visible = without(sessions, archived, "session_uuid")
    return projects.join(visible.select("project_slug", "session_uuid"), "project_slug", "left").groupBy("project_slug").agg(F.count("session_uuid").alias("n_sessions"))


def visible_content(block_rows: DataFrame) -> DataFrame:
    """Messages that show something: text that is not empty, an image or a block of unknown kind."""
    shows = ((F.col("kind") == "text") & (F.coalesce("text", F.lit("")) != "")) | ~F.col("kind").isin("text", "thinking", "tool_use", "tool_result", "fallback")
    return block_rows.where(shows).select("transcript", "line_number").distinct()


def view_filter(view: str, classified: DataFrame, shown: DataFrame, dispatchers: DataFrame | None = None) -> DataFrame:
    """The rows of a reading view: ``all``, ``chat`` or ``chat-harness``. An unknown view is an error.

    ``shown`` holds messages with visible content; ``dispatchers`` those that sent off a captured subagent, which count
    as visible too.
    """
    if view == "all":
        return classified
    seen = shown if dispatchers is None else shown.unionByName(dispatchers).distinct()
    if view == "chat":
        kind = F.col("author").isin(*CHAT_KINDS) | (F.col("author").isNull() & F.col("rtype").isin(*LEGACY_TYPES))
    elif view == "chat-harness":
        kind = (F.col("author").isNull() | (F.col("author") != "tool_result")) & F.col("rtype").isin(*LEGACY_TYPES)
    else:
        raise ValueError(f"unknown view {view!r}")
    return classified.where(kind).join(seen, ["transcript", "line_number"], "left_semi")


def substring_match(query: str, *columns: str) -> Column:
    """Whether any column holds the query, letter case aside; wildcard characters stand for themselves."""
    return F.greatest(*[F.coalesce(F.contains(F.lower(F.col(c)), F.lit(query.lower())), F.lit(False)) for c in columns]) if len(columns) > 1 else F.coalesce(F.contains(F.lower(F.col(columns[0])), F.lit(query.lower())), F.lit(False))


def project_list(text: str | None) -> list[str] | None:
    """A comma-separated list, trimmed, without empty entries; none at all means no filter."""
    names = [x.strip() for x in (text or "").split(",") if x.strip()]
    return names or None


def in_projects(rows: DataFrame, projects: list[str] | None) -> DataFrame:
    """``None`` leaves all rows, an empty list none."""
    return rows if projects is None else rows.where(F.col("project_slug").isin(*projects) if projects else F.lit(False))


def page(rows: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page in a total order: at most ``MOST`` rows, ``PAGE`` by default."""
    n = min(MOST, max(1, limit if limit is not None else PAGE))
    return rows.orderBy(*order).offset(max(0, offset)).limit(n)


def session_order() -> list[Column]:
    """Newest activity first, unknown last, ties by id."""
    return [F.desc_nulls_last("last_seconds"), F.asc("session_uuid")]


def unified_match(sessions: DataFrame, query: str, content: DataFrame) -> DataFrame:
    """Sessions whose id, a title or content matches: one row each, ``by_name`` and ``by_content`` telling why."""
    found = sessions.join(content.select("session_uuid").distinct().withColumn("_hit", F.lit(True)), "session_uuid", "left")
    found = found.withColumns({"by_name": substring_match(query, "session_uuid", "user_title", "custom_title", "ai_title"), "by_content": F.coalesce("_hit", F.lit(False))}).drop("_hit")
    return found.where("by_name or by_content")


def in_places(view: DataFrame, place: str) -> DataFrame:
    """``view`` with ``place``, each record's number from 0 in its transcript, and the lines before and after it there.

    Records are numbered inside runs of ``RUN_LINES`` line numbers; what the runs before hold is added up by run. So a
    transcript, however many records it has, is numbered by many tasks, and only its runs meet in one.
    """
    rows = view.withColumn("_run", F.floor(F.col("line_number") / RUN_LINES))
    runs = rows.groupBy("transcript", "_run").agg(F.count("*").alias("_n"), F.min("line_number").alias("_low"), F.max("line_number").alias("_high"))
    by_run = Window.partitionBy("transcript").orderBy("_run")
    base = F.coalesce(F.sum("_n").over(by_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("transcript", "_run", base.alias("_base"), F.lag("_high").over(by_run).alias("_before"), F.lead("_low").over(by_run).alias("_after"))
    w = Window.partitionBy("transcript", "_run").orderBy("line_number")
    inside = rows.withColumns({"_at": F.row_number().over(w) - 1, "_last": F.lag("line_number").over(w), "_next": F.lead("line_number").over(w)})
    both = inside.join(runs, ["transcript", "_run"])
    both = both.withColumns({place: F.col("_base") + F.col("_at"), "previous_line": F.coalesce("_last", "_before"), "next_line": F.coalesce("_next", "_after")})
    return both.select(*view.columns, place, "previous_line", "next_line")


def around(view: DataFrame, targets: DataFrame, limit: int = PAGE) -> DataFrame:
    """For each target message the page of the view that centres it; targets that the view filters out have none.

    ``targets`` has ``transcript, target``; the page starts ``limit // 2`` before the target's ordinal, at 0 at least.
    Every place of a page is a key of its own, so a target meets ``limit`` messages and not the whole transcript.
    """
    numbered = in_places(view, "ordinal").drop("previous_line", "next_line")
    at = numbered.select("transcript", F.col("line_number").alias("target"), F.col("ordinal").alias("at")).join(targets, ["transcript", "target"])
    first = F.greatest(F.lit(0), F.col("at") - limit // 2)
    pages = at.withColumn("first_ordinal", first).withColumn("ordinal", F.explode(F.sequence(first, first + limit - 1))).drop("at")
    return numbered.join(pages, ["transcript", "ordinal"])


def message_page(messages: DataFrame, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """A page of each transcript's messages in their order."""
    first = max(0, offset)
    return in_places(messages, "_place").where((F.col("_place") >= first) & (F.col("_place") < first + min(MOST, max(1, limit)))).drop("_place", "previous_line", "next_line")


def transcript_list(transcripts: DataFrame) -> DataFrame:
    """Each session's transcripts in one array, the main one first, then by name."""
    item = F.struct("kind", "transcript", "agent_hex")
    return transcripts.groupBy("session_uuid").agg(F.array_sort(F.collect_list(item)).alias("transcripts"))


def project_options(projects: DataFrame, text: str, selected: DataFrame) -> DataFrame:
    """Projects whose name holds a text, letter case aside, without those selected already, by name."""
    left = projects.select("project_slug").distinct().join(selected.select("project_slug").distinct(), "project_slug", "left_anti")
    return left.where(substring_match(text.strip(), "project_slug")).orderBy("project_slug")


def run_list(runs: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Import runs, newest first."""
    return page(runs, [F.desc("run_id")], limit, offset)


def neighbours(view: DataFrame) -> DataFrame:
    """The record before and after each one in the filtered view."""
    return in_places(view, "_place").drop("_place")


def nested_messages(records: DataFrame, block_rows: DataFrame) -> DataFrame:
    """Each message with its blocks in order, as one row."""
    nested = block_rows.groupBy("transcript", "line_number").agg(F.array_sort(F.collect_list(F.struct("block_index", "kind", "text"))).alias("blocks"))
    return records.join(nested, ["transcript", "line_number"], "left")


def project_tree(sessions: DataFrame) -> DataFrame:
    """Projects by label, each with its sessions newest first."""
    item = F.struct((-F.coalesce("last_seconds", F.lit(-1))).alias("rank"), F.col("session_uuid"))
    return sessions.groupBy("project_slug", "label").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["session_uuid"]).alias("sessions")).orderBy("label", "project_slug")
