"""Queries on record lines: parsing, blocks, events, authorship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillhouse.operators import authorship, blocks, records
from quillhouse.plans import feed, lake
from quillhouse.plans.registry import query
from quillhouse.sources import transcripts

#: Turns that parse, in the oracle; messages among them.
GOOD = "g as (select * from turns where not is_blank and not is_torn and not (is_misshapen and rtype in ('user', 'assistant')))"
TALK = "rtype in ('user', 'assistant', 'system', 'attachment')"
#: Author and basis of a record ``g`` with the tool that it names (``st``) or answers (``rt``).
AUTHOR = """case
  when rtype = 'assistant' then 'claude|assistant' when rtype = 'system' then 'system|system'
  when rtype = 'attachment' then case when is_queued and text <> '' then 'attachment_queued_human|attachment' else 'attachment_furniture|furniture' end
  when is_compact then 'compact_summary|summary' when result_of is not null then 'tool_result|result'
  when source_tool is not null then case when st.tool_name = 'Skill' then 'skill_injection|skill' else 'tool_injection|tool' end
  when origin = 'task-notification' or prompt_source = 'system' then 'task_notification|notification' when origin = 'coordinator' then 'coordinator|coordinator'
  when prompt_source = 'typed' then 'human_typed|typed' when prompt_source = 'queued' then 'human_queued|queued' when prompt_source = 'sdk' then 'sdk_automation|sdk'
  when starts_with(body, '<command-name>') then 'command_expansion|command' when starts_with(body, '<local-command-stdout>') then 'command_output|output'
  when is_meta then 'harness_meta|meta' when starts_with(body, '[Request interrupted by user') then 'interrupt_marker|interrupt'
  when kind = 'subagent' then 'dispatch|sidechain' when prompt_source is not null then 'unclassified|source' when origin not in ('human', 'task-notification', 'coordinator') then 'unclassified|origin'
  when version = '2.1.100' then 'human_inferred|version' else 'unclassified|none' end"""
DETAIL = """case split_part(ab, '|', 2) when 'system' then 'note' when 'result' then rt_name when 'skill' then st_skill when 'tool' then st_name when 'command' then '/run' || (conv_id % 3)::varchar
  when 'meta' then case when starts_with(body, '<local-command-caveat>') then 'caveat' end when 'interrupt' then 'tool' when 'source' then prompt_source when 'origin' then origin end"""
BASES = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in authorship.BASIS.items()) + "}"
CALLS = "calls as (select transcript, tool_id, tool_name, skill, turn from g where rtype = 'assistant' and tool_id is not null)"
CLASSIFIED = f"""{GOOD}, {CALLS}, j as (select g.*, {AUTHOR} as ab, st.tool_name as st_name, st.skill as st_skill, rt.tool_name as rt_name from g
  left join calls st on st.transcript = g.transcript and st.tool_id = g.source_tool left join calls rt on rt.transcript = g.transcript and rt.tool_id = g.result_of where {TALK}),
  m as (select *, split_part(ab, '|', 1) as author, {BASES}[split_part(ab, '|', 2)] as basis, {DETAIL} as detail from j)"""


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parse(feed.lines(spark, sf_dir))


def interpreted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with envelope and blocks: each line parsed once, the result written."""

    def build() -> DataFrame:
        base = blocks.with_blocks(records.envelope(parsed(spark, sf_dir))).where("status <> 'anomaly' and rtype in ('user', 'assistant', 'system', 'attachment')")
        return base.drop("v", "text", "raw", "unknown_fields", "bad_paths", "anomalies")

    return lake.table(spark, sf_dir, "conversations", "interpreted", build)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpreted messages, classified."""

    def build() -> DataFrame:
        base = interpreted(spark, sf_dir)
        return authorship.classify(base, authorship.tool_calls(blocks.block_rows(base)))

    return lake.table(spark, sf_dir, "conversations", "messages", build)


def oracle(ctes: str, body: str) -> str:
    return feed.oracle(f", {ctes} {body}" if ctes else body)


@query("prj1_parse_status", oracle("", f"select {feed.STATUS} as status, count(*) as n from turns group by 1"))
def parse_status(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("prj2_envelope", oracle(GOOD, f"select transcript, turn as line_number, uuid, parent_uuid, session_uuid as session_id, cwd, version, coalesce(is_meta, false) as is_meta, kind = 'subagent' as is_sidechain, ts as seconds from g where {TALK}"))
def envelope(spark: SparkSession, d: str) -> DataFrame:
    out = records.envelope(parsed(spark, d).where("status <> 'anomaly' and rtype in ('user', 'assistant', 'system', 'attachment')"))
    return out.select("transcript", "line_number", "uuid", "parent_uuid", "session_id", "cwd", "version", "is_meta", "is_sidechain", "seconds")


@query("prj3_validation_errors", oracle("", "select transcript, turn as line_number, 'error' as severity, 'validation_error' as kind, 'message.content' as detail from turns where not is_blank and not is_torn and is_misshapen and rtype in ('user', 'assistant')"))
def validation(spark: SparkSession, d: str) -> DataFrame:
    return records.anomaly_rows(parsed(spark, d)).where("kind = 'validation_error'")


#: Values that a field may be given, and which kinds they are right for: null, texts, truth values, numbers, lists and objects.
VALUES = {
    "null": "text bool int float dict list", '"x"': "text", '"12"': "text int float", '" 1 "': "text int float", '"2.50"': "text float", '"Yes"': "text bool", "true": "bool int float", "0": "bool int float",
    "7": "int float", "2.5": "float", "1.0": "bool int float", '{"a":1}': "dict", "{}": "dict", "[]": "list", "[1]": "list",
}


def _around(place: str, field: str) -> tuple[str, str, str, str]:
    """The path of a field, the text before and after its value, and a record without it."""
    def rest(others: dict[str, str]) -> str:
        return "".join(f',"{k}":{v}' for k, v in others.items() if k != field)

    if place == "usage":
        head, tail, path = '{"type":"assistant","message":{"content":[],"usage":{"zz":1', "}}}", "message.usage."
    elif place.endswith(".message"):
        head, tail, path = '{"type":"' + place.removesuffix(".message") + '","message":{"zz":1' + rest({"content": "[]"}), "}}", "message."
    elif place.startswith("block"):
        kind = {"block": ""}.get(place, '"type":"' + place.removeprefix("block.") + '",')
        needed = {"block.text": {"text": '"x"'}, "block.tool_use": {"id": '"x"', "name": '"x"'}}.get(place, {})
        head, tail, path = '{"type":"user","message":{"content":[{' + kind + '"zz":1' + rest(needed), "}]}}", "message.content[]."
    else:
        needed = {"user": {"message": '{"content":""}'}, "assistant": {"message": '{"content":[]}'}}.get(place, {})
        head, tail, path = '{"type":"' + place + '"' + rest(needed), "}", ""
    return path + field, f'{head},"{field}":', tail, head + tail


def _cases() -> list[tuple]:
    """``(path, before, after, without, value, is_right)`` of every declared field with every value, and without the field."""
    out = []
    for place, fields in records.schema().items():
        for name, kind in fields.items():
            if name == "type" and place != "block":
                continue
            path, before, after, without = _around(place, name)
            bare = kind.rstrip("!")
            for value, right in VALUES.items():
                if value == "null":
                    fine = bare == "any" or not kind.endswith("!")
                else:
                    fine = bare == "any" or any(k in right.split() for k in ("text", "list")) if bare == "text or list" else bare == "any" or bare in right.split()
                # A block of a known kind has rules of its own, and a list may hold what is no block.
                if (place, name, value) == ("block", "type", '"x"') or (name == "content" and place.endswith(".message") and value == "[1]"):
                    out.append((path + ("[]" if value == "[1]" else ""), before, after, without, value, value != "[1]"))
                elif name == "message" and value in ("{}", '{"a":1}'):
                    out.append(("message.content", before, after, without, value, False))
                else:
                    out.append((path, before, after, without, value, fine))
            out.append((path, before, after, without, None, not kind.endswith("!!")))
    return out


CASES = _cases()


def _quoted(x: object) -> str:
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else "'" + str(x) + "'"


CASE_SQL = "cases(k, path, is_right) as (values " + ", ".join(f"({i}, {_quoted(c[0])}, {_quoted(c[5])})" for i, c in enumerate(CASES)) + ")"


@query("prj3_all_types", f"with {CASE_SQL} select event_id, case when is_right then '' else path end as detail from events join cases on k = event_id % {len(CASES)}")
def all_types(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a record with one declared field that holds one of many values, or lacks it: the paths that break the schema."""
    cases = spark.createDataFrame([(i, (c[1] + c[4] + c[2]) if c[4] is not None else c[3]) for i, c in enumerate(CASES)], "k int, raw string")
    lines = feed.read(spark, d, "events").select("event_id", (F.col("event_id") % len(CASES)).cast("int").alias("k")).join(F.broadcast(cases), "k").select("event_id", F.col("raw").cast("binary").alias("raw"))
    return records.parse(lines).select("event_id", F.array_join("bad_paths", ",").alias("detail"))


@query("prj4_field_drift", oracle(GOOD, "select transcript, turn as line_number, case when is_drifted and is_deep then 'odd_usage,zzz' when is_deep then 'odd_usage' else 'zzz' end as detail from g where (is_drifted or is_deep) and rtype <> 'mystery'"))
def drift(spark: SparkSession, d: str) -> DataFrame:
    return records.anomaly_rows(parsed(spark, d)).where("kind = 'unknown_field'").select("transcript", "line_number", "detail")


@query("prj4_event_props_drift", "select event_type, count(*) as n, sum(case when json_keys(props) <> ['k'] then 1 else 0 end)::bigint as drifted from events group by event_type")
def props_drift(spark: SparkSession, d: str) -> DataFrame:
    extra = F.array_except(F.json_object_keys("props"), F.array(F.lit("k")))
    return feed.read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.when(F.size(extra) > 0, 1).otherwise(0)).alias("drifted"))


@query("prj5_blocks", oracle(GOOD, """
select transcript, turn as line_number, 0::bigint as block_index, case when bare then 'tool_use' when rtype = 'user' and result_of is not null then 'tool_result' else 'text' end as kind,
  case when bare then null when rtype = 'user' and result_of is not null then nullif(text, '') when rtype = 'attachment' then text else body end as text, case when bare then tool_id when rtype = 'user' then result_of end as tool_id, case when bare then tool_name end as tool_name
from g where rtype in ('user', 'assistant') or (rtype = 'attachment' and is_queued and text <> '')
union all select transcript, turn, 1::bigint, 'tool_use', null, tool_id, tool_name from g where rtype = 'assistant' and tool_id is not null and not bare"""))
def block_rows(spark: SparkSession, d: str) -> DataFrame:
    out = blocks.block_rows(blocks.with_blocks(parsed(spark, d)))
    return out.select("transcript", "line_number", F.col("block_index").cast("long").alias("block_index"), "kind", "text", "tool_id", "tool_name")


@query("prj6_tool_result_text", oracle(GOOD, "select transcript, turn as line_number, nullif(text, '') as text from g where rtype = 'user' and result_of is not null"))
def result_text(spark: SparkSession, d: str) -> DataFrame:
    return blocks.block_rows(blocks.with_blocks(parsed(spark, d))).where("kind = 'tool_result'").select("transcript", "line_number", "text")


@query("prj7_queued_prompts", oracle(GOOD, "select transcript, turn as line_number, text as prompt from g where rtype = 'attachment' and is_queued and text <> ''"))
def queued(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).where("status <> 'anomaly'").withColumn("prompt", blocks.queued_prompt()).where("prompt is not null").select("transcript", "line_number", "prompt")


@query("prj8_token_usage", oracle(GOOD, "select transcript, turn as line_number, input_tokens, output_tokens, 0::bigint as cache_creation_input_tokens, 1::bigint as cache_read_input_tokens from g where rtype = 'assistant' and input_tokens is not null"))
def usage(spark: SparkSession, d: str) -> DataFrame:
    return blocks.usage_rows(parsed(spark, d)).drop("session_uuid")


@query("agg15_token_totals", oracle(GOOD, "select session_uuid, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, count(*) as n from g where rtype = 'assistant' and input_tokens is not null group by session_uuid"))
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return blocks.usage_rows(parsed(spark, d)).groupBy("session_uuid").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("n"))


@query("prj9_session_events", oracle(GOOD, "select transcript, turn as line_number, rtype as event_kind, text as title from g where rtype in ('ai-title', 'custom-title')"))
def events(spark: SparkSession, d: str) -> DataFrame:
    out = blocks.event_rows(parsed(spark, d))
    return out.select("transcript", "line_number", "event_kind", F.coalesce(F.get_json_object("payload", "$.aiTitle"), F.get_json_object("payload", "$.customTitle")).alias("title"))


@query("prj10_anomalies_by_kind", oracle("", """
select severity, kind, count(*) as n from (select case when is_blank then 'info' when is_torn then 'error' when rtype = 'mystery' then 'warn' when is_misshapen and rtype in ('user', 'assistant') then 'error' when is_drifted or is_deep then 'info' end as severity,
  case when is_blank then 'whitespace_line' when is_torn then 'invalid_json' when rtype = 'mystery' then 'unknown_record_type' when is_misshapen and rtype in ('user', 'assistant') then 'validation_error' when is_drifted or is_deep then 'unknown_field' end as kind from turns) a
where kind is not null group by 1, 2"""))
def anomalies(spark: SparkSession, d: str) -> DataFrame:
    return records.anomaly_rows(parsed(spark, d)).groupBy("severity", "kind").agg(F.count("*").alias("n"))


@query("flt11_errors_newest_first", oracle("", "select transcript, turn as line_number, case when is_torn then 'invalid_json' else 'validation_error' end as kind from turns where not is_blank and (is_torn or (is_misshapen and rtype in ('user', 'assistant'))) order by transcript desc, turn desc limit 50"))
def errors(spark: SparkSession, d: str) -> DataFrame:
    return records.anomaly_rows(parsed(spark, d)).where("severity = 'error'").orderBy(F.desc("transcript"), F.desc("line_number")).limit(50).select("transcript", "line_number", "kind")


@query("prj11_authorship", oracle(CLASSIFIED, "select transcript, turn as line_number, author, basis, detail from m"))
def author(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("transcript", "line_number", "author", "basis", "detail")


PRIMARY = f"{GOOD}, fl as (select transcript, case when turn % 4 = 3 then transcript || '.bak' else transcript end as file, min(turn) as first_seen from turns group by 1, 2), el as (select transcript, file from fl where not ends_with(file, '.bak') qualify row_number() over (partition by transcript order by first_seen, file) = 1)"


@query("prj12_primary_only", oracle(PRIMARY, f"select g.rtype, count(*) as n from g join el on el.transcript = g.transcript and el.file = case when g.turn % 4 = 3 then g.transcript || '.bak' else g.transcript end where {TALK} group by 1"))
def primary_only(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a main file and of a backup beside it: those of the backup are not interpreted."""
    rows = interpreted(spark, d)
    file = F.when(F.col("line_number") % 4 == 3, F.concat("transcript", F.lit(".bak"))).otherwise(F.col("transcript"))
    files = feed.turns(spark, d).withColumnRenamed("turn", "line_number").groupBy("transcript", file.alias("file")).agg(F.min("line_number").alias("first_seen"))
    files = files.select("transcript", "file", F.col("file").alias("path"), "first_seen", F.lit("active").alias("state"), F.endswith("file", F.lit(".bak")).alias("is_backup"))
    return records.primary_only(rows.withColumn("file", file), transcripts.elect_primary(files)).groupBy("rtype").agg(F.count("*").alias("n"))


STALE = "stale as (select *, turn % 5 = 0 or transcript like '%/1%' as unstamped, (conv_id + turn) % 7 = 0 as failed from turns)"


@query("str5_swept_records", oracle(STALE, f"select {feed.STATUS} as status, count(*) as n from stale where unstamped and not failed group by 1"))
def swept(spark: SparkSession, d: str) -> DataFrame:
    """Records without a stamp of the schema they were read with, but for those that failed before, are read again."""
    marks = feed.turns(spark, d).select("transcript", F.col("turn").alias("line_number"), ((F.col("turn") % 5 == 0) | F.col("transcript").like("%/1%")).alias("unstamped"), ((F.col("conv_id") + F.col("turn")) % 7 == 0).alias("failed"))
    lines = feed.lines(spark, d).join(marks.select("transcript", "line_number", F.when(~F.col("unstamped"), F.lit("1")).alias("schema_version")), ["transcript", "line_number"])
    failures = marks.where("failed").select("transcript", "line_number", F.lit("interpret_failure").alias("kind"))
    return records.parse(records.unswept(lines, failures)).groupBy("status").agg(F.count("*").alias("n"))


@query("agg6_author_census", oracle(CLASSIFIED, "select author, count(*) as n, author = 'unclassified' as alarm from m group by author"))
def census(spark: SparkSession, d: str) -> DataFrame:
    return authorship.census(messages(spark, d))


@query("jn7_tool_lookup", oracle(f"{GOOD}, {CALLS}", "select g.transcript, g.turn as line_number, c.tool_name, c.skill from g left join calls c on c.transcript = g.transcript and c.tool_id = g.source_tool where g.rtype = 'user' and g.source_tool is not null"))
def tool_lookup(spark: SparkSession, d: str) -> DataFrame:
    base = blocks.with_blocks(records.envelope(parsed(spark, d))).where("status <> 'anomaly'")
    calls = authorship.tool_calls(blocks.block_rows(base)).select("transcript", F.col("tool_id").alias("source_tool"), "tool_name", "skill")
    return base.where("rtype = 'user' and source_tool is not null").join(calls, ["transcript", "source_tool"], "left").select("transcript", "line_number", "tool_name", "skill")


@query("jn11_call_result_pairs", oracle(f"{GOOD}, {CALLS}", "select c.transcript, c.tool_id, c.tool_name, c.turn as call_line, g.turn as result_line from calls c join g on g.transcript = c.transcript and g.result_of = c.tool_id and g.rtype = 'user'"))
def pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks.block_rows(interpreted(spark, d))
    return blocks.call_result_pairs(authorship.tool_calls(rows), rows)


@query("jn12_parent_links", oracle(GOOD, f"select a.transcript, a.turn as line_number, b.turn as parent_line from g a join g b on a.transcript = b.transcript and a.parent_uuid = b.uuid where a.{TALK} and b.{TALK}"))
def parents(spark: SparkSession, d: str) -> DataFrame:
    return blocks.parent_links(interpreted(spark, d))


@query("fn12_line_hash", "select doc_id, sha256(coalesce(text, '')) as sha from documents")
def line_hash(spark: SparkSession, d: str) -> DataFrame:
    return feed.read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))


@query("fn14_version_compare", oracle("", "select transcript, turn as line_number, version = '2.1.100' as is_old, version = '2.x' as is_broken from turns"))
def versions(spark: SparkSession, d: str) -> DataFrame:
    v = authorship.version_tuple(F.col("version"))
    old = F.coalesce(v < F.array(F.lit(2), F.lit(1), F.lit(168)), F.lit(False))
    return feed.turns(spark, d).select("transcript", F.col("turn").alias("line_number"), old.alias("is_old"), v.isNull().alias("is_broken"))


@query("fn13_command_tags", oracle(CLASSIFIED, "select transcript, turn as line_number, detail from m where author = 'command_expansion'"))
def commands(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).where("author = 'command_expansion'").select("transcript", "line_number", "detail")


@query("fn3_timestamps", oracle("", "select uuid, ts as seconds from turns"))
def times(spark: SparkSession, d: str) -> DataFrame:
    t = feed.turns(spark, d)
    text = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return t.select("uuid", F.unix_timestamp(records.timestamp(F.coalesce(text, F.lit("no time")))).alias("seconds"))
