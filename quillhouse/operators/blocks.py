"""Content blocks, token usage and session events of parsed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillhouse.operators.records import THIN, field, kind_of, once

BLOCK = "struct<kind:string,text:string,tool_id:string,tool_name:string,skill:string,raw:string>"


def _block(kind: Column, text: Column, tool_id: Column | None = None, name: Column | None = None, skill: Column | None = None, raw: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(kind.alias("kind"), text.alias("text"), (none if tool_id is None else tool_id).alias("tool_id"), (none if name is None else name).alias("tool_name"), (none if skill is None else skill).alias("skill"), (none if raw is None else raw).alias("raw"))


def result_text(content: Column) -> Column:
    """A tool result's text: a string, or the strings and text blocks of a list joined by line feeds; empty is null."""
    items = F.try_variant_get(content, "$", "array<variant>")
    parts = F.filter(F.transform(items, lambda b: F.coalesce(F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string")), F.when(F.try_variant_get(b, "$.type", "string") == "text", F.try_variant_get(b, "$.text", "string")))), lambda x: x.isNotNull())
    return F.nullif(F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(F.array_join(parts, "\n")), F.lit(""))


def queued_prompt() -> Column:
    """The prompt of a queued command typed by a human, else null."""
    right = (field("attachment.type") == "queued_command") & (field("attachment.commandMode") == "prompt") & (field("attachment.origin.kind") == "human")
    return F.when((F.col("rtype") == "attachment") & right & (F.coalesce(field("attachment.prompt"), F.lit("")) != ""), field("attachment.prompt"))


def with_blocks(parsed: DataFrame) -> DataFrame:
    """``parsed`` with ``blocks``: a string content as one text block, a list as typed blocks, a queued prompt as a text block.

    Records with errors have none. Unknown kinds keep their JSON in ``raw``.
    """

    def one(b: Column) -> Column:
        kind = F.try_variant_get(b, "$.type", "string")
        text = (
            F.when(kind == "text", F.try_variant_get(b, "$.text", "string"))
            .when(kind == "thinking", F.try_variant_get(b, "$.thinking", "string"))
            .when(kind == "tool_result", result_text(F.try_variant_get(b, "$.content", "variant")))
        )
        tool = F.when(kind == "tool_use", F.try_variant_get(b, "$.id", "string")).when(kind == "tool_result", F.try_variant_get(b, "$.tool_use_id", "string"))
        known = kind.isin("text", "thinking", "tool_use", "tool_result")
        return _block(kind, text, tool, F.when(kind == "tool_use", F.try_variant_get(b, "$.name", "string")), F.when(kind == "tool_use", F.try_variant_get(b, "$.input.skill", "string")), F.when(~known, F.to_json(b)))

    talks = F.col("rtype").isin("user", "assistant")
    content = F.try_variant_get("v", "$.message.content", "variant")
    listed = F.transform(F.try_variant_get("v", "$.message.content", "array<variant>"), one)
    none = F.array().cast(f"array<{BLOCK}>")
    said = F.when(kind_of("message.content") == "STRING", F.array(_block(F.lit("text"), F.try_variant_get(content, "$", "string")))).otherwise(listed)
    queued = F.array(_block(F.lit("text"), queued_prompt()))
    return once(parsed, {"blocks": F.coalesce(F.when(F.col("status") == "anomaly", none).when(talks, said).when(queued_prompt().isNotNull(), queued), none).cast(f"array<{BLOCK}>")})


def block_rows(records: DataFrame) -> DataFrame:
    """One row for each block: ``transcript, line_number, block_index`` and the block's fields."""
    return records.select("transcript", "session_uuid", "line_number", F.posexplode("blocks").alias("block_index", "b")).select("transcript", "session_uuid", "line_number", "block_index", "b.*")


def call_result_pairs(calls: DataFrame, rows: DataFrame) -> DataFrame:
    """Each tool call with the lines that hold its results."""
    results = rows.where("kind = 'tool_result'").select("transcript", "tool_id", F.col("line_number").alias("result_line"))
    return calls.select("transcript", "tool_id", "tool_name", F.col("line_number").alias("call_line")).join(results, ["transcript", "tool_id"])


def parent_links(messages: DataFrame) -> DataFrame:
    """Each message with the line of the one it answers, one hop."""
    parent = messages.select("transcript", F.col("uuid").alias("parent_uuid"), F.col("line_number").alias("parent_line"))
    return messages.join(parent, ["transcript", "parent_uuid"]).select("transcript", "line_number", "parent_line")


def dispatches(rows: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Tool uses that sent off a captured subagent: ``sidecars`` has ``session_uuid, agent_hex, tool_use_id``."""
    agents = sidecars.where("tool_use_id is not null").select(F.col("session_uuid").alias("_session"), "agent_hex", F.col("tool_use_id").alias("tool_id"))
    return rows.where("kind = 'tool_use'").join(agents, "tool_id").drop("_session")


def usage_rows(parsed: DataFrame) -> DataFrame:
    """Token counters of assistant records that report any."""
    names = ["input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"]
    has = (F.col("rtype") == "assistant") & (F.col("status") != "anomaly") & kind_of("message.usage").startswith("OBJECT")
    return parsed.where(has).select("transcript", "session_uuid", "line_number", *[field(f"message.usage.{n}", "long").alias(n) for n in names])


def event_rows(parsed: DataFrame) -> DataFrame:
    """Thin records as session events: kind and payload, without bulky snapshots."""
    payload = F.map_filter(F.from_json("text", "map<string,string>"), lambda k, _: ~k.isin("type", "sessionId", "snapshot"))
    return parsed.where(F.col("rtype").isin(*THIN) & (F.col("status") != "anomaly")).select("transcript", "session_uuid", "line_number", F.col("rtype").alias("event_kind"), F.to_json(payload).alias("payload"))
