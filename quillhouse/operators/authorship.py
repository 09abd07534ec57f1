"""Who authored a message: sixteen ordered rules for user records, the first that holds wins; a tool lookup by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillhouse.operators.records import once

#: Fixed value: the first version whose prompts say where they come from.
MARKED_SINCE = "2.1.168"
#: Origins that are no reason for alarm; authors that the chat view shows; those of the dialogue between a person and the assistant, which search takes for chat.
KNOWN_ORIGINS = ("human", "task-notification", "coordinator")
CHAT_KINDS = ("human_typed", "human_queued", "human_inferred", "claude", "attachment_queued_human", "interrupt_marker", "dispatch", "coordinator")
DIALOGUE_KINDS = ("human_typed", "human_queued", "human_inferred", "attachment_queued_human", "interrupt_marker", "claude")
#: What each decision rests on, and whether that is a recorded fact or a guess.
BASIS = {
    "summary": "verified — isCompactSummary",
    "result": "verified — tool_result block",
    "skill": "verified — sourceToolUseID → Skill",
    "tool": "verified — sourceToolUseID",
    "notification": "verified — origin/promptSource",
    "coordinator": "verified — origin.kind coordinator",
    "typed": "verified — promptSource: typed",
    "queued": "verified — promptSource: queued",
    "sdk": "verified — promptSource: sdk",
    "command": "heuristic — <command-name> prefix",
    "output": "heuristic — <local-command-stdout> prefix",
    "meta": "heuristic — isMeta",
    "interrupt": "heuristic — interrupt marker text",
    "sidechain": "verified — sidechain transcript",
    "source": "verified — unrecognized promptSource",
    "origin": "verified — unrecognized origin.kind",
    "version": "heuristic — pre-2.1.168 record, main transcript, no harness markers",
    "none": "heuristic — no rule matched",
    "assistant": "verified — record type assistant",
    "system": "verified — record type system",
    "attachment": "verified — rescued human queued_command",
    "furniture": "verified — zero-block attachment",
    "unregistered": "heuristic — unregistered record type",
    "unparsed": "heuristic — unparseable record",
}


def version_tuple(text: Column) -> Column:
    """A dotted version as numbers, null if any part is none. Arrays compare part by part."""
    parts = F.transform(F.split(text, r"\."), lambda x: x.try_cast("int"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), parts)


def tag_body(text: Column, tag: str) -> Column:
    """What stands between ``<tag>`` and ``</tag>``, trimmed; null without both."""
    return F.nullif(F.btrim(F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))


def tool_calls(block_rows: DataFrame) -> DataFrame:
    """Tool uses by transcript and id; an id that repeats counts as its last use."""
    last = F.max_by(F.struct("tool_name", "skill", "line_number"), F.struct("line_number", "block_index")).alias("t")
    return block_rows.where("kind = 'tool_use' and tool_id is not null").groupBy("transcript", "tool_id").agg(last).select("transcript", "tool_id", "t.*")


def classify(records: DataFrame, calls: DataFrame) -> DataFrame:
    """``records`` (with envelope and blocks) with ``author, basis, detail``.

    ``calls`` is ``tool_calls`` of the same transcripts; it is joined twice on transcript and id, for the tool whose
    result a record carries and for the tool a record was injected by.
    """
    first_text = F.get(F.filter("blocks", lambda b: b["kind"] == "text"), F.lit(0))["text"]
    result_id = F.get(F.filter("blocks", lambda b: b["kind"] == "tool_result"), F.lit(0))["tool_id"]
    base = once(records, {"first_text": first_text, "result_id": result_id})
    by_result = calls.select(F.col("transcript"), F.col("tool_id").alias("result_id"), F.col("tool_name").alias("result_tool"))
    by_source = calls.select(F.col("transcript"), F.col("tool_id").alias("source_tool"), F.col("tool_name").alias("source_name"), F.col("skill").alias("source_skill"))
    base = base.join(by_result, ["transcript", "result_id"], "left").join(by_source, ["transcript", "source_tool"], "left")
    c = F.col
    starts = lambda p: F.coalesce(c("first_text").startswith(p), F.lit(False))
    version = version_tuple(c("version"))
    old = F.coalesce(version < F.array(*[F.lit(int(x)) for x in MARKED_SINCE.split(".")]), F.lit(False))
    # An empty text counts as well: it is the block that matters.
    typed = F.exists("blocks", lambda b: b["kind"].isin("text", "image"))
    none = F.lit(None).cast("string")

    def out(author: str, basis: str, detail: Column = none) -> Column:
        return F.struct(F.lit(author).alias("author"), F.lit(BASIS[basis]).alias("basis"), detail.alias("detail"))

    interrupted = "[Request interrupted by user"
    user = (
        F.when(c("is_compact"), out("compact_summary", "summary"))
        .when(c("result_id").isNotNull() | c("has_tool_result"), out("tool_result", "result", c("result_tool")))
        .when(c("source_tool").isNotNull() & (c("source_name") == "Skill"), out("skill_injection", "skill", c("source_skill")))
        .when(c("source_tool").isNotNull(), out("tool_injection", "tool", c("source_name")))
        .when((c("origin") == "task-notification") | (c("prompt_source") == "system"), out("task_notification", "notification"))
        .when(c("origin") == "coordinator", out("coordinator", "coordinator"))
        .when(c("prompt_source") == "typed", out("human_typed", "typed"))
        .when(c("prompt_source") == "queued", out("human_queued", "queued"))
        .when(c("prompt_source") == "sdk", out("sdk_automation", "sdk"))
        .when(starts("<command-name>"), out("command_expansion", "command", tag_body(c("first_text"), "command-name")))
        .when(starts("<local-command-stdout>"), out("command_output", "output"))
        .when(c("is_meta"), out("harness_meta", "meta", F.when(starts("<system-reminder>"), F.lit("reminder")).when(starts("<local-command-caveat>"), F.lit("caveat"))))
        .when(starts(interrupted), out("interrupt_marker", "interrupt", F.when(starts(interrupted + " for tool use"), F.lit("tool"))))
        .when(c("is_sidechain") | (c("kind") == "subagent"), out("dispatch", "sidechain"))
        .when(c("prompt_source").isNotNull(), out("unclassified", "source", c("prompt_source")))
        .when(c("origin").isNotNull() & ~c("origin").isin(*KNOWN_ORIGINS), out("unclassified", "origin", c("origin")))
        .when(old & typed, out("human_inferred", "version"))
        .otherwise(out("unclassified", "none"))
    )
    found = (
        F.when(c("rtype") == "user", user)
        .when(c("rtype") == "assistant", out("claude", "assistant"))
        .when(c("rtype") == "system", out("system", "system", c("subtype")))
        .when((c("rtype") == "attachment") & (F.size("blocks") > 0), out("attachment_queued_human", "attachment"))
        .when(c("rtype") == "attachment", out("attachment_furniture", "furniture"))
        .when(c("rtype").isNull(), out("unclassified", "unparsed"))
        .otherwise(out("unclassified", "unregistered"))
    )
    return once(base, {"_a": found}).select("*", "_a.*").drop("_a", "first_text", "result_id", "result_tool", "source_name", "source_skill")


def census(classified: DataFrame) -> DataFrame:
    """Messages by author; ``alarm`` marks unclassified ones."""
    return classified.groupBy("author").agg(F.count("*").alias("n")).withColumn("alarm", (F.col("author") == "unclassified") & (F.col("n") > 0))
