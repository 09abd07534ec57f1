"""Record parsing: tolerant JSON typing, envelope, structural checks, drift. Bytes are kept whatever the outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillhouse.functions.text import whole_json

#: The fields that the conversational types share, those that each type declares besides, and all fields of thin records.
ENVELOPE = (
    "type", "uuid", "parentUuid", "sessionId", "timestamp", "cwd", "version", "gitBranch", "isSidechain", "userType", "entrypoint", "agentId", "slug",
    "isMeta", "session_id",
)
OWN = {
    "user": (
        "message", "permissionMode", "promptId", "promptSource", "sourceToolAssistantUUID", "sourceToolUseID", "origin", "toolUseResult", "toolEndsTurn",
        "interruptedMessageId", "toolDenialKind", "classifierMetaLines", "interruptedByShutdown", "source", "userFeedback", "logicalParentUuid",
        "compactMetadata", "isVisibleInTranscriptOnly", "isCompactSummary",
    ),
    "assistant": (
        "message", "requestId", "attributionAgent", "attributionSkill", "attributionPlugin", "attributionMcpServer", "attributionMcpTool", "error", "effort",
        "isApiErrorMessage", "apiErrorStatus", "supersedesUuids", "isAbortedMidStream", "pendingWorkflowCount",
    ),
    "system": (
        "subtype", "level", "content", "durationMs", "messageCount", "pendingBackgroundAgentCount", "pendingWorkflowCount", "hookCount", "hookInfos",
        "hookErrors", "hookAdditionalContext", "preventedContinuation", "stopReason", "hasOutput", "toolUseID", "error", "cause", "retryInMs",
        "retryAttempt", "maxRetries", "trigger", "direction", "originalModel", "fallbackModel", "requestId", "apiRefusalCategory", "apiRefusalExplanation",
        "retractedMessageUuids", "refusedUserMessageUuid", "logicalParentUuid", "compactMetadata",
    ),
    "attachment": (
        "attachment",
    ),
}
THIN = {
    "ai-title": (
        "type", "sessionId", "aiTitle",
    ),
    "custom-title": (
        "type", "sessionId", "customTitle",
    ),
    "mode": (
        "type", "sessionId", "mode",
    ),
    "permission-mode": (
        "type", "sessionId", "permissionMode",
    ),
    "last-prompt": (
        "type", "sessionId", "leafUuid", "lastPrompt",
    ),
    "queue-operation": (
        "type", "sessionId", "operation", "content", "timestamp",
    ),
    "agent-name": (
        "type", "sessionId", "agentName",
    ),
    "agent-color": (
        "type", "sessionId", "agentColor",
    ),
    "file-history-snapshot": (
        "type", "sessionId", "messageId", "snapshot", "isSnapshotUpdate",
    ),
    "file-history-delta": (
        "type", "sessionId", "messageId", "snapshotMessageId", "trackingPath", "backup", "timestamp",
    ),
}
DECLARED = {k: ENVELOPE + v for k, v in OWN.items()} | THIN
#: The fields of a message, of its usage, and of each kind of content block; other kinds are kept as they are.
MESSAGE = {
    "user": (
        "role", "content",
    ),
    "assistant": (
        "role", "type", "id", "model", "content", "usage", "stop_reason", "stop_sequence", "stop_details", "diagnostics", "container", "context_management",
    ),
}
USAGE = (
    "input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "cache_creation", "server_tool_use", "service_tier",
    "speed", "iterations", "inference_geo",
)
BLOCKS = {
    "text": (
        "type", "text",
    ),
    "thinking": (
        "type", "thinking", "signature",
    ),
    "tool_use": (
        "type", "id", "name", "input", "caller",
    ),
    "tool_result": (
        "type", "tool_use_id", "content", "is_error",
    ),
    "fallback": (
        "type", "from", "to",
    ),
    "document": (
        "type", "source",
    ),
}


def field(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", f"$.{path}", kind)


def kind_of(path: str) -> Column:
    """The variant kind at a path: OBJECT, ARRAY<..>, STRING, BIGINT ... or null where there is none."""
    return F.schema_of_variant(F.try_variant_get("v", f"$.{path}", "variant"))


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` with computed columns that are not computed again by whatever uses them.

    A one-row generator stands in for a projection: the optimizer copies projected expressions into every filter and
    column above them, which multiplies deep ones.
    """
    return rows.drop(*columns).select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))) if not set(columns) & set(rows.columns) else _over(rows, columns)


def _over(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    fresh = rows.select("*", F.inline(F.array(F.struct(*[c.alias(f"__{name}") for name, c in columns.items()])))).drop(*columns)
    return fresh.withColumnsRenamed({f"__{name}": name for name in columns})


def _fields(table: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*[x for k, names in table.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in names]))])


def parse(lines: DataFrame, raw_col: str = "raw") -> DataFrame:
    """``lines`` with ``text, v, rtype, status, anomalies``.

    ``status`` is ``anomaly`` after an error (bad JSON, bad shape), ``partial`` after a warning or a note (unknown type,
    unknown field, white space only), else ``ok``; fields are looked at in the record, its message, usage and blocks; ``anomalies`` lists ``(severity, kind, detail)``. Nothing raises: bytes
    that are no UTF-8 or no JSON leave ``v`` null. Each line is parsed once.
    """
    text = F.try_validate_utf8(F.col(raw_col).cast("string"))
    out = once(lines, {"text": text})
    out = once(out, {"blank": F.coalesce(F.btrim("text", F.lit(" \t\r\n")) == "", F.lit(False)), "v": whole_json(F.col("text"))})
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    out = once(out, {"is_object": ~F.col("blank") & is_object}).withColumn("v", F.when(~F.col("blank"), F.col("v")))
    out = once(out, {"rtype": F.when(F.col("is_object"), field("type"))})
    is_object = F.col("is_object")
    keys = F.when(is_object, F.json_object_keys("text"))
    allowed = F.element_at(_fields(DECLARED), F.col("rtype"))
    talks = F.col("rtype").isin("user", "assistant")
    message_keys = F.when(talks, F.json_object_keys(F.get_json_object("text", "$.message")))
    usage_keys = F.when(F.col("rtype") == "assistant", F.json_object_keys(F.get_json_object("text", "$.message.usage")))
    kinds = _fields(BLOCKS)

    def of_block(b: Column) -> Column:
        return F.array_except(F.json_object_keys(F.to_json(b)), F.try_element_at(kinds, F.try_variant_get(b, "$.type", "string")))

    empty = F.array().cast("array<string>")
    levels = [
        F.array_except(keys, allowed), F.array_except(message_keys, F.element_at(_fields(MESSAGE), F.col("rtype"))), F.array_except(usage_keys, F.array(*[F.lit(n) for n in USAGE])),
        F.flatten(F.filter(F.transform(F.when(talks, F.try_variant_get("v", "$.message.content", "array<variant>")), of_block), lambda x: x.isNotNull())),
    ]
    out = once(out, {"unknown_fields": F.array_distinct(F.concat(*[F.coalesce(x, empty) for x in levels])), "bad_paths": bad_paths()})
    known = F.coalesce(F.col("rtype").isin(*DECLARED), F.lit(False))

    def note(severity: str, kind: str, detail: Column) -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))

    none = F.array().cast("array<struct<severity:string,kind:string,detail:string>>")
    notes = (
        F.when(F.col("blank"), F.array(note("info", "whitespace_line", F.lit(None))))
        .when(~is_object, F.array(note("error", "invalid_json", F.lit(None))))
        .when(~known, F.array(note("warn", "unknown_record_type", F.col("rtype"))))
        .when(F.size("bad_paths") > 0, F.array(note("error", "validation_error", F.array_join("bad_paths", ","))))
        .when(F.size("unknown_fields") > 0, F.array(note("info", "unknown_field", F.array_join(F.array_sort("unknown_fields"), ","))))
        .otherwise(none)
    )
    out = once(out, {"anomalies": notes})
    status = F.when(F.exists("anomalies", lambda a: a["severity"] == "error"), "anomaly").when(F.size("anomalies") > 0, "partial").otherwise("ok")
    return out.withColumn("status", status).drop("blank", "is_object")


#: What fields may hold other than text or null. ``!`` stands behind what may not be null, ``!!`` behind what may not be missing either.
KINDS = {
    "": {"isSidechain": "bool", "isMeta": "bool"},
    "user": {
        "message": "dict!!", "origin": "any", "toolUseResult": "any", "userFeedback": "any", "compactMetadata": "any", "toolEndsTurn": "bool",
        "interruptedByShutdown": "bool", "isVisibleInTranscriptOnly": "bool", "isCompactSummary": "bool",
    },
    "assistant": {
        "message": "dict!!", "isApiErrorMessage": "bool", "isAbortedMidStream": "bool", "apiErrorStatus": "int", "pendingWorkflowCount": "int",
        "supersedesUuids": "any",
    },
    "system": {
        "durationMs": "int", "messageCount": "int", "pendingBackgroundAgentCount": "int", "pendingWorkflowCount": "int", "hookCount": "int",
        "retryAttempt": "int", "maxRetries": "int", "retryInMs": "float", "preventedContinuation": "bool", "hasOutput": "bool", "hookInfos": "any",
        "hookErrors": "any", "hookAdditionalContext": "any", "error": "any", "cause": "any", "retractedMessageUuids": "any", "compactMetadata": "any",
    },
    "attachment": {"attachment": "any"},
    "file-history-snapshot": {"snapshot": "any", "isSnapshotUpdate": "bool"},
    "file-history-delta": {"backup": "any"},
    "user.message": {"content": "text or list!!"},
    "assistant.message": {
        "content": "list!!", "usage": "dict", "stop_details": "any", "diagnostics": "any", "container": "any", "context_management": "any",
    },
    "usage": {
        "input_tokens": "int", "output_tokens": "int", "cache_creation_input_tokens": "int", "cache_read_input_tokens": "int", "cache_creation": "any",
        "server_tool_use": "any", "iterations": "any",
    },
    "block.text": {"text": "text!!"},
    "block.thinking": {"thinking": "text!"},
    "block.tool_use": {"id": "text!!", "name": "text!!", "input": "dict!", "caller": "any"},
    "block.tool_result": {"content": "text or list", "is_error": "bool"},
    "block.fallback": {"from": "any", "to": "any"},
    "block.document": {"source": "any"},
    "block": {"type": "text!!"},
}
#: Texts that count as a truth value, letter case aside.
TRUTHS = ("0", "1", "true", "false", "t", "f", "yes", "no", "y", "n", "on", "off")


def schema() -> dict[str, dict[str, str]]:
    """Every declared field's kind, by the place that declares it: a record type, a message, ``usage``, a kind of block."""
    places = {k: DECLARED[k] for k in DECLARED} | {f"{k}.message": v for k, v in MESSAGE.items()} | {"usage": USAGE} | {f"block.{k}": v for k, v in BLOCKS.items()} | {"block": ("type",)}
    common = {k: KINDS[""] for k in OWN}
    return {place: {f: {**common.get(place, {}), **KINDS.get(place, {})}.get(f, "text") for f in fields} for place, fields in places.items()}


def _right(kind: Column, found: Column, value: Column) -> Column:
    """Whether a value of the variant kind ``found`` is one that a field of ``kind`` may hold; texts and numbers that stand for others count as these."""
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    is_text, is_number, is_bool = found == "STRING", found.rlike("^(BIGINT|DECIMAL|DOUBLE)"), found == "BOOLEAN"
    right = (
        F.when(kind == "text", is_text)
        .when(kind == "bool", is_bool | (is_number & number.isin(0.0, 1.0)) | (is_text & F.lower(text).isin(*TRUTHS)))
        .when(kind == "int", is_bool | (is_number & (number == F.floor(number))) | (is_text & text.rlike(r"^\s*[+-]?[0-9]+(\.0*)?\s*$")))
        .when(kind == "float", is_bool | is_number | (is_text & F.btrim(text).try_cast("double").isNotNull()))
        .when(kind == "dict", found.startswith("OBJECT"))
        .when(kind == "list", found.startswith("ARRAY"))
        .when(kind == "text or list", is_text | found.startswith("ARRAY"))
        .otherwise(F.lit(True))
    )
    return F.coalesce(right, F.lit(False))


def _broken(place: Column, value: Column, prefix: str) -> Column:
    """Paths of an object's fields that break the rules of its place; null if there is no object."""
    table = schema()
    rules = {(p, f): k for p, fields in table.items() for f, k in fields.items() if not k.startswith("any")}
    kinds = F.create_map(*[x for (p, f), k in rules.items() for x in (F.lit(f"{p}/{f}"), F.lit(k))])
    needed = F.create_map(*[x for p, fields in table.items() if any(k.endswith("!!") for k in fields.values()) for x in (F.lit(p), F.array(*[F.lit(f) for f, k in fields.items() if k.endswith("!!")]))])
    held = F.try_variant_get(value, "$", "map<string,variant>")

    def breaks(e: Column) -> Column:
        kind, found = F.try_element_at(kinds, F.concat(place, F.lit("/"), e["key"])), F.schema_of_variant(e["value"])
        bare = F.rtrim(kind, F.lit("!"))
        return F.when(kind.isNull(), F.lit(False)).when(found == "VOID", kind.endswith("!")).otherwise(~_right(bare, found, e["value"]))

    wrong = F.transform(F.filter(F.map_entries(held), breaks), lambda e: e["key"])
    missing = F.array_except(F.coalesce(F.try_element_at(needed, place), F.array().cast("array<string>")), F.map_keys(held))
    return F.transform(F.concat(wrong, missing), lambda f: F.concat(F.lit(prefix), f))


def bad_paths() -> Column:
    """Paths that break the declared schema, in the record, its message, usage and blocks. A place that is no object has no rules of its own."""
    v, rtype = F.col("v"), F.col("rtype")
    talks = rtype.isin("user", "assistant")
    message = F.when(talks, F.try_variant_get(v, "$.message", "variant"))
    usage = F.when(rtype == "assistant", F.try_variant_get(v, "$.message.usage", "variant"))
    kind = lambda b: F.try_variant_get(b, "$.type", "string")

    def of_block(b: Column) -> Column:
        name = F.when(F.schema_of_variant(F.try_variant_get(b, "$.type", "variant")) == "STRING", kind(b))
        place = F.when(name.isin(*BLOCKS), F.concat(F.lit("block."), name)).otherwise("block")
        return F.coalesce(_broken(place, b, "message.content[]."), F.array(F.lit("message.content[]")))

    blocks = F.flatten(F.transform(F.when(talks, F.try_variant_get(v, "$.message.content", "array<variant>")), of_block))
    levels = [_broken(rtype, v, ""), _broken(F.concat(rtype, F.lit(".message")), message, "message."), _broken(F.lit("usage"), usage, "message.usage."), blocks]
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in levels]))


def timestamp(text: Column) -> Column:
    """An ISO-8601 text as a timestamp, null where it is none; without a zone it counts as UTC (the session's zone)."""
    return text.try_cast("timestamp")


def envelope(parsed: DataFrame) -> DataFrame:
    """The envelope fields of parsed records as columns; ``seconds`` is the timestamp since 1970."""
    names = {"uuid": "uuid", "parentUuid": "parent_uuid", "sessionId": "session_id", "cwd": "cwd", "version": "version", "promptSource": "prompt_source", "sourceToolUseID": "source_tool", "subtype": "subtype"}
    columns = {new: field(old) for old, new in names.items()}
    columns |= {new: F.coalesce(field(old, "boolean"), F.lit(False)) for old, new in {"isSidechain": "is_sidechain", "isMeta": "is_meta", "isCompactSummary": "is_compact"}.items()}
    result = kind_of("toolUseResult")
    columns |= {"seconds": F.unix_timestamp(timestamp(field("timestamp"))), "origin": field("origin.kind"), "has_tool_result": F.coalesce(result != "VOID", F.lit(False))}
    return once(parsed, columns)


def primary_only(parsed: DataFrame, primary: DataFrame) -> DataFrame:
    """What is interpreted: rows without errors of the file that was elected for their transcript (``transcript, file``)."""
    return parsed.where("status <> 'anomaly'").join(primary.select("transcript", "file"), ["transcript", "file"], "left_semi")


def unswept(lines: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Captured lines that were never interpreted: without a stamp, and without a failure of their own, which would only fail again."""
    failed = anomalies.where("kind = 'interpret_failure'").select("transcript", "line_number")
    return lines.where("schema_version is null").join(failed, ["transcript", "line_number"], "left_anti")


def anomaly_rows(parsed: DataFrame) -> DataFrame:
    """One row for each anomaly, with the line it belongs to."""
    return parsed.select("transcript", "line_number", F.explode("anomalies").alias("a")).select("transcript", "line_number", "a.*")
