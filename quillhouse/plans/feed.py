"""Record lines from the driver's tables: one rule for Spark and for the oracle, in SQL that both accept.

``conversations`` becomes transcripts. Shapes follow from ``conv_id`` and ``turn`` by arithmetic, so that every record
type, authorship rule and anomaly occurs in a known share of the rows. Spark builds JSON lines from these columns and
parses them again; the oracle computes what should come out from the columns themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillhouse.operators.records import THIN, once

TURNS = """
select conv_id, turn, role, s, text, session_uuid, project_slug, kind, agent_hex, session_uuid || '/' || kind || '/' || agent_hex as transcript,
  case when mystery then 'mystery' when role = 'user' and x = 0 then 'attachment' when role = 'assistant' and x = 0 then 'ai-title' when role = 'assistant' and x = 1 then 'custom-title' else role end as rtype,
  'u' || cast(conv_id as string) || '-' || cast(turn as string) as uuid,
  case when turn > 0 then 'u' || cast(conv_id as string) || '-' || cast(turn - 1 as string) end as parent_uuid,
  case when (conv_id + turn) % 13 = 0 then null else 1767225600 + conv_id * 86400 + turn * 60 end as ts,
  '/Users/x/p' || cast(conv_id % 7 as string) as cwd,
  case turn % 3 when 0 then '2.1.100' when 1 then '2.1.170' else '2.x' end as version,
  case when role = 'user' and x <> 0 then case s when 1 then true end end as is_compact,
  case when role = 'user' and s in (11, 17) then true end as is_meta,
  case when role = 'user' and x <> 0 then case s when 5 then 'system' when 7 then 'typed' when 8 then 'queued' when 9 then 'sdk' when 14 then 'robot' end end as prompt_source,
  case when role = 'user' and x <> 0 then case s when 4 then 'task-notification' when 6 then 'coordinator' when 15 then 'odd' when 16 then 'human' end end as origin,
  case when role = 'user' and x <> 0 and s in (2, 3) then 't' || cast(conv_id as string) || '-' || cast(turn - 1 as string) end as source_tool,
  case when role = 'user' and s = 0 then 't' || cast(conv_id as string) || '-' || cast(turn - 1 as string) end as result_of,
  case when role = 'assistant' and (conv_id + turn) % 2 = 1 then 't' || cast(conv_id as string) || '-' || cast(turn as string) end as tool_id,
  case when role = 'assistant' and (conv_id + turn) % 2 = 1 then case conv_id % 3 when 0 then 'Bash' when 1 then 'Skill' else 'Read' end end as tool_name,
  case when role = 'assistant' and (conv_id + turn) % 2 = 1 and conv_id % 3 = 1 then 'skill' || cast(conv_id % 4 as string) end as skill,
  case when role = 'user' and s = 18 then '' else case when role = 'user' then case s when 10 then '<command-name> /run' || cast(conv_id % 3 as string) || ' </command-name>' when 12 then '<local-command-stdout>' when 13 then '[Request interrupted by user for tool use]' when 17 then '<local-command-caveat>' else '' end else '' end || text end as body,
  role = 'assistant' and (conv_id + turn) % 2 = 1 and turn = 1 as bare,
  case when role = 'user' and x = 0 and (conv_id + turn) % 2 = 0 then true else false end as is_queued,
  case when role = 'assistant' and (conv_id + turn) % 5 <> 0 then conv_id % 100 + turn end as input_tokens,
  case when role = 'assistant' and (conv_id + turn) % 5 <> 0 then turn * 3 end as output_tokens,
  (conv_id * 13 + turn) % 29 = 0 as is_torn, (conv_id * 5 + turn) % 31 = 5 as is_blank, (conv_id + turn * 3) % 17 = 2 as is_drifted,
  role = 'assistant' and x > 1 and not mystery and (conv_id + turn) % 5 <> 0 and (conv_id + turn * 5) % 19 = 4 as is_deep, (conv_id * 3 + turn) % 23 = 7 as is_misshapen
from (
  select conv_id, turn, role, coalesce(text, '') as text, (conv_id * 7 + turn) % 19 as s, (conv_id * 31 + turn) % 11 as x, (conv_id + turn) % 37 = 3 as mystery,
    's' || lpad(cast(case when conv_id % 5 = 4 then conv_id - 1 else conv_id end as string), 8, '0') as session_uuid,
    '-Users-x-p' || cast(case when conv_id % 5 = 4 then conv_id - 1 else conv_id end % 7 as string) as project_slug,
    case when conv_id % 5 = 4 then 'subagent' else 'main' end as kind,
    case when conv_id % 5 = 4 then lpad(cast(conv_id as string), 8, '0') else '' end as agent_hex
  from {conversations} where conv_id is not null and turn is not null) c
"""

#: Which lines end up with which outcome; the same text in both engines.
STATUS = "case when is_blank then 'partial' when is_torn or (is_misshapen and rtype in ('user', 'assistant')) then 'anomaly' when rtype = 'mystery' or is_drifted or is_deep then 'partial' else 'ok' end"
OVERLAYS = """
select session_uuid, min(conv_id) as n, min(conv_id) % 3 = 0 as favorite, min(conv_id) % 9 = 4 as archived,
  case when min(conv_id) % 4 = 1 then 'My title ' || cast(min(conv_id) as string) when min(conv_id) % 4 = 2 then '  ' end as user_title
from turns group by session_uuid
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TURNS, conversations=read(spark, sf_dir, "conversations"))


def overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OVERLAYS.replace("from turns", "from {turns}"), turns=turns(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns as raw JSON lines: ``transcript, session_uuid, project_slug, kind, agent_hex, line_number, raw``."""
    c = F.col
    thin = c("rtype").isin(*THIN)

    def full(value: F.Column) -> F.Column:
        """What records with an envelope carry and thin ones do not."""
        return F.when(~thin, value)

    t = once(turns(spark, sf_dir), {
        "text_json": F.to_json(F.array(F.struct(F.lit("text").alias("type"), c("body").alias("text")))),
        "result_json": F.to_json(F.array(F.struct(F.lit("tool_result").alias("type"), c("result_of").alias("tool_use_id"), F.array(F.struct(F.lit("text").alias("type"), c("text").alias("text"))).alias("content")))),
        "tool_json": F.to_json(F.struct(F.lit("tool_use").alias("type"), c("tool_id").alias("id"), c("tool_name").alias("name"), F.struct(c("skill").alias("skill")).alias("input"))),
        "plain_json": F.to_json(F.array(c("body"))),
        "usage_json": F.to_json(F.struct(c("input_tokens").alias("input_tokens"), c("output_tokens").alias("output_tokens"), F.lit(0).alias("cache_creation_input_tokens"), F.lit(1).alias("cache_read_input_tokens"), F.when(c("is_deep"), F.lit(1)).alias("odd_usage"))),
        "head": F.to_json(F.struct(
            c("rtype").alias("type"), full(c("uuid")).alias("uuid"), full(c("parent_uuid")).alias("parentUuid"), c("session_uuid").alias("sessionId"),
            F.when(c("ts").isNotNull() & ~thin, F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"), full(c("cwd")).alias("cwd"), full(c("version")).alias("version"), full(c("kind") == "subagent").alias("isSidechain"),
            c("is_meta").alias("isMeta"), c("is_compact").alias("isCompactSummary"), c("prompt_source").alias("promptSource"), F.when(c("origin").isNotNull(), F.struct(c("origin").alias("kind"))).alias("origin"),
            c("source_tool").alias("sourceToolUseID"), F.when(c("is_drifted"), F.lit(1)).alias("zzz"),
            F.when(c("rtype") == "ai-title", c("text")).alias("aiTitle"), F.when(c("rtype") == "custom-title", c("text")).alias("customTitle"),
            F.when(c("rtype") == "system", F.lit("note")).alias("subtype"), F.when(c("rtype") == "system", c("text")).alias("content"),
            F.when(c("rtype") == "attachment", F.struct(F.lit("queued_command").alias("type"), F.when(c("is_queued"), F.lit("prompt")).otherwise(F.lit("bash")).alias("commandMode"), F.struct(F.lit("human").alias("kind")).alias("origin"), c("text").alias("prompt"))).alias("attachment"),
        )),
    })

    def inside(name: str) -> F.Column:
        """A JSON text without its first and last character."""
        return F.expr(f"substring({name}, 2, length({name}) - 2)")

    said = F.when(c("result_of").isNotNull(), c("result_json")).otherwise(inside("plain_json"))
    used = F.when(c("bare"), F.concat(F.lit("["), c("tool_json"), F.lit("]"))).when(c("tool_id").isNotNull(), F.concat(F.lit("["), inside("text_json"), F.lit(","), c("tool_json"), F.lit("]"))).otherwise(c("text_json"))
    t = once(t, {"content_json": F.when(c("is_misshapen"), F.lit("17")).when(c("role") == "user", said).otherwise(used)})
    usage = F.when(c("input_tokens").isNotNull(), F.concat(F.lit(',"usage":'), c("usage_json"))).otherwise(F.lit(""))
    message = F.concat(F.lit(',"message":{"role":"'), c("role"), F.lit('","content":'), c("content_json"), usage, F.lit("}}"))
    t = once(t, {"full": F.when(c("rtype").isin("user", "assistant"), F.concat(F.expr("substring(head, 1, length(head) - 1)"), message)).otherwise(c("head"))})
    raw = F.when(c("is_blank"), F.lit("   ")).when(c("is_torn"), F.expr("substring(full, 1, length(full) - 1)")).otherwise(c("full"))
    return once(t, {"raw": F.concat(raw, F.lit("\n")).cast("binary")}).select("transcript", "session_uuid", "project_slug", "kind", "agent_hex", c("turn").alias("line_number"), "raw")


def sidecar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sidecar of each subagent transcript, ``(path, value)``: it names the tool use that sent the agent off, in the second record of its main transcript."""
    t = turns(spark, sf_dir).where("kind = 'subagent'").select("conv_id", "project_slug", "agent_hex").distinct()
    uuid = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad((F.col("conv_id") - 1).cast("string"), 12, "0"))
    path = F.concat(F.lit("/root/"), F.col("project_slug"), F.lit("/"), uuid, F.lit("/subagents/agent-"), F.col("agent_hex"), F.lit(".meta.json"))
    tool = F.concat(F.lit("t"), (F.col("conv_id") - 1).cast("string"), F.lit("-1"))
    return t.select(path.alias("path"), F.to_json(F.struct(F.lit("helper").alias("agentType"), tool.alias("toolUseId"))).alias("value"))


def oracle(body: str) -> str:
    """DuckDB SQL over ``turns`` and ``overlays``."""
    return f"with turns as ({TURNS.format(conversations='conversations')}), overlays as ({OVERLAYS}) {body}"
