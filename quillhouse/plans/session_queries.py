"""Queries on sessions, reading views, overlays and governance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillhouse.functions import text as fn
from quillhouse.operators import blocks, governance, search, sessions
from quillhouse.plans import feed
from quillhouse.plans.capture_queries import PATHS, paths
from quillhouse.plans.record_queries import CLASSIFIED, GOOD, TALK, messages, oracle, parsed
from quillhouse.plans.registry import query
from quillhouse.plans.search_queries import BLOCKS, chat_blocks, found, index
from quillhouse.sources import export, transcripts

SHOWN = "shown as (select distinct transcript, turn from m where (rtype in ('user', 'assistant') and result_of is null and not bare and body <> '') or (rtype = 'attachment' and is_queued and text <> ''))"
CHAT = "('human_typed', 'human_queued', 'human_inferred', 'claude', 'attachment_queued_human', 'interrupt_marker', 'dispatch', 'coordinator')"
#: Tool uses that a subagent's sidecar names; what a view shows is content or such a dispatch.
SENT = "sent as (select distinct g.transcript, g.turn from g where g.rtype = 'assistant' and g.tool_id in (select 't' || (conv_id - 1)::varchar || '-1' from turns where kind = 'subagent'))"
SEEN = f"{CLASSIFIED}, {SHOWN}, {SENT}, seen as (select * from shown union select * from sent)"
CHAT_VIEW = f"{SEEN}, chat as (select m.* from m where author in {CHAT} and exists (select 1 from seen s where s.transcript = m.transcript and s.turn = m.turn))"
SESSION = f"""{GOOD}, b as (select session_uuid, min(ts) as first_seconds, max(ts) as last_seconds from g where {TALK} group by session_uuid),
  titles as (select session_uuid, arg_max(text, (transcript, turn)) filter (where rtype = 'ai-title') as ai_title, arg_max(text, (transcript, turn)) filter (where rtype = 'custom-title') as custom_title from g group by session_uuid),
  s as (select o.session_uuid, o.favorite, o.archived, o.user_title, p.project_slug, b.first_seconds, b.last_seconds, t.ai_title, t.custom_title
    from overlays o join (select distinct session_uuid, project_slug from turns) p using (session_uuid) left join b using (session_uuid) left join titles t using (session_uuid))"""


def session_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row for each session: project, bounds, titles, overlays."""
    p = parsed(spark, d)
    talk = p.where("status <> 'anomaly' and rtype in ('user', 'assistant', 'system', 'attachment')").withColumn("seconds", F.unix_timestamp(F.try_variant_get("v", "$.timestamp", "string").try_cast("timestamp")))
    events = blocks.event_rows(p).withColumn("title", F.coalesce(F.get_json_object("payload", "$.aiTitle"), F.get_json_object("payload", "$.customTitle")))
    out = feed.overlays(spark, d).join(feed.turns(spark, d).select("session_uuid", "project_slug").distinct(), "session_uuid").join(sessions.bounds(talk), "session_uuid", "left")
    for kind, name in (("ai-title", "ai_title"), ("custom-title", "custom_title")):
        out = out.join(sessions.latest_title(events, kind, "title", ["transcript", "line_number"]).withColumnRenamed("title", name), "session_uuid", "left")
    return out


def shown(m: DataFrame) -> DataFrame:
    return sessions.visible_content(blocks.block_rows(m))


def agents(spark: SparkSession, d: str) -> DataFrame:
    """Subagents by their sidecars."""
    return transcripts.sidecar_rows(feed.sidecar_files(spark, d))


def sent_off(spark: SparkSession, d: str, m: DataFrame) -> DataFrame:
    """Messages that sent off a captured subagent."""
    return blocks.dispatches(blocks.block_rows(m), agents(spark, d)).select("transcript", "line_number").distinct()


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    m = messages(spark, d)
    return sessions.view_filter(name, m, shown(m), sent_off(spark, d, m))


@query("agg3_session_bounds", oracle(SESSION, "select * from b"))
def bounds(spark: SparkSession, d: str) -> DataFrame:
    return sessions.bounds(messages(spark, d).select("session_uuid", "seconds"))


@query("agg4_latest_titles", oracle(SESSION, "select session_uuid, ai_title, custom_title from s where ai_title is not null or custom_title is not null"))
def titles(spark: SparkSession, d: str) -> DataFrame:
    return session_rows(spark, d).where("ai_title is not null or custom_title is not null").select("session_uuid", "ai_title", "custom_title")


@query("agg5_working_dirs", oracle("", "select project_slug, arg_min(cwd, (transcript, turn)) as cwd from turns group by project_slug"))
def dirs(spark: SparkSession, d: str) -> DataFrame:
    return sessions.working_dir(feed.turns(spark, d), ["transcript", "turn"])


@query("agg2_message_counts", oracle(GOOD, f"select session_uuid, count(*) as n_messages from g where {TALK} and kind = 'main' group by session_uuid"))
def counts(spark: SparkSession, d: str) -> DataFrame:
    return sessions.message_counts(messages(spark, d))


@query("agg1_sessions_per_project", oracle("", "select p.project_slug, count(distinct o.session_uuid) as n_sessions from (select distinct project_slug from turns) p left join (select distinct t.session_uuid, t.project_slug from turns t join overlays o using (session_uuid) where not o.archived) o using (project_slug) group by p.project_slug"))
def per_project(spark: SparkSession, d: str) -> DataFrame:
    t = feed.turns(spark, d).select("project_slug", "session_uuid").distinct()
    return sessions.project_counts(t.select("project_slug").distinct(), t, feed.overlays(spark, d).where("archived"))


@query("agg7_archive_status", oracle("", f"""select count(distinct session_uuid) as sessions, (select count(*) from overlays where archived) as archived, count(distinct transcript) as transcripts, count(*) as records, sum(case when {feed.STATUS} = 'anomaly' then 1 else 0 end)::bigint as errors,
  count(*) filter (where not is_blank and not is_torn and rtype = 'mystery') as warnings, count(*) filter (where is_blank or (not is_torn and rtype <> 'mystery' and not (is_misshapen and rtype in ('user', 'assistant')) and (is_drifted or is_deep))) as notes from turns"""))
def status(spark: SparkSession, d: str) -> DataFrame:
    p = parsed(spark, d)
    one = p.agg(F.countDistinct("session_uuid").alias("sessions"), F.countDistinct("transcript").alias("transcripts"), F.count("*").alias("records"), *[F.count_if(F.exists("anomalies", lambda a: a["severity"] == severity)).alias(name) for severity, name in (("error", "errors"), ("warn", "warnings"), ("info", "notes"))])
    archived = feed.overlays(spark, d).agg(F.count_if("archived").alias("archived"))
    return one.join(archived, F.lit(True)).select("sessions", "archived", "transcripts", "records", "errors", "warnings", "notes")


@query("agg13_records_per_file", "select source as file, count(*) as n_records from documents group by source")
def per_file(spark: SparkSession, d: str) -> DataFrame:
    lines = feed.read(spark, d, "documents").select(F.col("source").alias("file"))
    return export.record_counts(lines.distinct(), lines)


@query("srt1_session_list", oracle(SESSION, "select session_uuid, project_slug, last_seconds from s where not archived order by last_seconds desc nulls last, session_uuid limit 50"))
def session_list(spark: SparkSession, d: str) -> DataFrame:
    return sessions.page(session_rows(spark, d).where("not archived"), sessions.session_order()).select("session_uuid", "project_slug", "last_seconds")


@query("fn4_display_titles", oracle(SESSION, "select session_uuid, coalesce(case when trim(user_title) <> '' then user_title end, case when trim(ai_title) <> '' then ai_title end, case when trim(custom_title) <> '' then custom_title end, session_uuid[1:8]) as title, coalesce(ai_title, custom_title, session_uuid[1:8]) as archive_title from s"))
def display(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return session_rows(spark, d).select("session_uuid", fn.display_title(c("user_title"), c("custom_title"), c("ai_title"), c("session_uuid")).alias("title"), fn.archive_title(c("custom_title"), c("ai_title"), c("session_uuid")).alias("archive_title"))


@query("fn5_title_prefills", oracle(SESSION, "select session_uuid, coalesce(user_title, ai_title, custom_title, '') as prefill from s"))
def prefills(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return session_rows(spark, d).select("session_uuid", fn.prefill_title(c("user_title"), c("custom_title"), c("ai_title")).alias("prefill"))


def matched(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that match ``the`` by name or, in the index, by content; with the best hit."""
    hits = search.best_per_session(found(spark, d).where("query_id = 6"))
    return sessions.unified_match(session_rows(spark, d), "the", hits).join(hits.select("session_uuid", "block_key"), "session_uuid", "left")


NAMED = "(contains(lower(s.session_uuid), 'the') or contains(lower(coalesce(user_title, '')), 'the') or contains(lower(coalesce(ai_title, '')), 'the') or contains(lower(coalesce(custom_title, '')), 'the'))"
HIT = f"{BLOCKS}, hit as (select session_uuid, arg_min(block_key, (rank, block_key)) as block_key from h where query_id = 6 group by 1), {SESSION.removeprefix(GOOD + ',')}"


@query("set1_unified_match", oracle(HIT, f"select s.session_uuid, {NAMED} as by_name, hit.session_uuid is not null as by_content from s left join hit using (session_uuid) where by_name or by_content"))
def unified(spark: SparkSession, d: str) -> DataFrame:
    return matched(spark, d).select("session_uuid", "by_name", "by_content")


@query("set2_content_only_matches", oracle(HIT, f"select s.session_uuid, hit.block_key from s join hit using (session_uuid) where not {NAMED}"))
def content_only(spark: SparkSession, d: str) -> DataFrame:
    return matched(spark, d).where("by_content and not by_name").select("session_uuid", "block_key")


@query("jn2_left_projects", oracle("", "select p.project_slug, count(o.session_uuid) as n_sessions from (select distinct project_slug from turns) p left join (select distinct t.session_uuid, t.project_slug from turns t join overlays o using (session_uuid) where o.favorite) o using (project_slug) group by 1"))
def left_projects(spark: SparkSession, d: str) -> DataFrame:
    t = feed.turns(spark, d).select("project_slug", "session_uuid").distinct()
    return sessions.project_counts(t.select("project_slug").distinct(), t, feed.overlays(spark, d).where("not favorite"))


@query("srt4_transcripts_main_first", oracle("", "select session_uuid, string_agg(transcript, ',' order by kind, transcript) as transcripts from (select distinct session_uuid, transcript, kind from turns) t group by 1"))
def main_first(spark: SparkSession, d: str) -> DataFrame:
    t = feed.turns(spark, d).select("session_uuid", "transcript", "kind", "agent_hex").distinct()
    return sessions.transcript_list(t).select("session_uuid", F.array_join("transcripts.transcript", ",").alias("transcripts"))


@query("flt12_project_options", oracle("", "select distinct project_slug from turns where contains(lower(project_slug), 'x-p') and project_slug not in (select t.project_slug from turns t join overlays o using (session_uuid) where o.n % 70 = 1)"))
def options(spark: SparkSession, d: str) -> DataFrame:
    t = feed.turns(spark, d)
    chosen = t.join(feed.overlays(spark, d).where("n % 70 = 1"), "session_uuid").select("project_slug")
    return sessions.project_options(t, " X-P ", chosen)


@query("flt5_literal_substring", "select doc_id from documents where contains(lower(text), lower('100%')) or contains(lower(text), lower('A_b')) or contains(lower(text), 'token =')")
def literal(spark: SparkSession, d: str) -> DataFrame:
    return feed.read(spark, d, "documents").where(sessions.substring_match("100%", "text") | sessions.substring_match("A_b", "text") | sessions.substring_match("token =", "text")).select("doc_id")


@query("flt7_favorites", oracle("", "select t.session_uuid, count(*) as n from turns t join overlays o using (session_uuid) where o.favorite group by 1"))
def favorites(spark: SparkSession, d: str) -> DataFrame:
    return feed.turns(spark, d).join(feed.overlays(spark, d).where("favorite").select("session_uuid"), "session_uuid", "left_semi").groupBy("session_uuid").agg(F.count("*").alias("n"))


@query("flt6_without_archived", oracle("", "select t.transcript, count(*) as n from turns t join overlays o using (session_uuid) where not o.archived group by 1"))
def not_archived(spark: SparkSession, d: str) -> DataFrame:
    return sessions.without(feed.turns(spark, d), feed.overlays(spark, d).where("archived"), "session_uuid").groupBy("transcript").agg(F.count("*").alias("n"))


@query("flt8_project_filter", oracle("", "select project_slug, count(*) as n from turns where project_slug in ('-Users-x-p1', '-Users-x-p3') group by 1"))
def project_filter(spark: SparkSession, d: str) -> DataFrame:
    return sessions.in_projects(feed.turns(spark, d), sessions.project_list(" -Users-x-p1,, -Users-x-p3 ")).groupBy("project_slug").agg(F.count("*").alias("n"))


@query("flt1_chat_view", oracle(CHAT_VIEW, "select transcript, turn as line_number, author from chat"))
def chat(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "chat").select("transcript", "line_number", "author")


@query("flt2_chat_harness_view", oracle(SEEN, "select m.transcript, m.turn as line_number, author from m join seen s on s.transcript = m.transcript and s.turn = m.turn where author <> 'tool_result' and rtype in ('user', 'assistant', 'attachment')"))
def harness(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "chat-harness").select("transcript", "line_number", "author")


@query("flt3_all_view", oracle(CLASSIFIED, "select author, count(*) as n from m group by 1"))
def all_view(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "all").groupBy("author").agg(F.count("*").alias("n"))


@query("jn4_visible_messages", oracle(f"{CLASSIFIED}, {SHOWN}", "select transcript, count(*) as n from shown group by 1"))
def visible(spark: SparkSession, d: str) -> DataFrame:
    return shown(messages(spark, d)).groupBy("transcript").agg(F.count("*").alias("n"))


@query("jn8_dispatch_links", oracle(GOOD, "select a.agent_hex, g.transcript, g.tool_id, g.turn as line_number from (select distinct conv_id, agent_hex from turns where kind = 'subagent') a join g on g.rtype = 'assistant' and g.tool_id = 't' || (a.conv_id - 1)::varchar || '-1'"))
def dispatch(spark: SparkSession, d: str) -> DataFrame:
    return blocks.dispatches(blocks.block_rows(messages(spark, d)), agents(spark, d)).select("agent_hex", "transcript", "tool_id", "line_number")


@query("jn5_dispatching_messages", oracle(f"{GOOD}, {SENT}", "select transcript, turn as line_number from sent"))
def dispatchers(spark: SparkSession, d: str) -> DataFrame:
    return sent_off(spark, d, messages(spark, d))


@query("win2_around_page", oracle(CHAT_VIEW, """
, v as (select transcript, turn, row_number() over (partition by transcript order by turn) - 1 as ordinal from chat),
a as (select transcript, turn as target, ordinal as at from v)
select v.transcript, a.target, v.turn as line_number, v.ordinal, greatest(0, a.at - 2) as first_ordinal from v join a using (transcript) where v.ordinal >= greatest(0, a.at - 2) and v.ordinal < greatest(0, a.at - 2) + 5"""))
def around(spark: SparkSession, d: str) -> DataFrame:
    chat_rows = view(spark, d, "chat").select("transcript", "line_number")
    out = sessions.around(chat_rows, messages(spark, d).select("transcript", F.col("line_number").alias("target")), 5)
    return out.select("transcript", "target", "line_number", F.col("ordinal").cast("long").alias("ordinal"), F.col("first_ordinal").cast("long").alias("first_ordinal"))


@query("win7_neighbours", oracle(CHAT_VIEW, "select transcript, turn as line_number, lag(turn) over w as previous_line, lead(turn) over w as next_line from chat window w as (partition by transcript order by turn)"))
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return sessions.neighbours(view(spark, d, "chat").select("transcript", "line_number"))


@query("srt3_message_page", oracle(GOOD, f"select transcript, turn as line_number, rtype from (select *, row_number() over (partition by transcript order by turn) as k from g where {TALK}) x where k > 2 and k <= 6"))
def message_page(spark: SparkSession, d: str) -> DataFrame:
    return sessions.message_page(messages(spark, d), 4, 2).select("transcript", "line_number", "rtype")


@query("ins3_nested_messages", oracle(f"{CLASSIFIED}", "select transcript, turn as line_number, (case when rtype = 'system' or (rtype = 'attachment' and not (is_queued and text <> '')) then 0 when rtype = 'assistant' and tool_id is not null and not bare then 2 else 1 end)::bigint as n_blocks from m"))
def nested(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    out = sessions.nested_messages(m.select("transcript", "line_number"), blocks.block_rows(m))
    return out.select("transcript", "line_number", F.greatest(F.size(F.coalesce("blocks", F.array())), F.lit(0)).cast("long").alias("n_blocks"))


@query("srt7_project_tree", oracle(SESSION, "select project_slug, 'p' || project_slug[11:] as label, string_agg(session_uuid, ',' order by last_seconds desc nulls last, session_uuid) as sessions from s group by 1"))
def tree(spark: SparkSession, d: str) -> DataFrame:
    rows = session_rows(spark, d).withColumn("label", fn.project_label(F.concat(F.lit("/Users/x/p"), F.substring_index("project_slug", "-p", -1)), F.col("project_slug")))
    return sessions.project_tree(rows).select("project_slug", "label", F.array_join("sessions", ",").alias("sessions"))


@query("fn1_project_slugs", oracle("", "select distinct cwd, regexp_replace(cwd, '[^A-Za-z0-9-]', '-', 'g') as slug, 'p' || cwd[11:] as label from turns"))
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return feed.turns(spark, d).select("cwd").distinct().select("cwd", fn.slug(F.col("cwd")).alias("slug"), fn.project_label(F.col("cwd"), F.lit("-Users-x")).alias("label"))


@query("fn2_targets", oracle("", "select distinct cwd as target, regexp_replace(cwd, '[^A-Za-z0-9-]', '-', 'g') as slug, false as is_uuid from turns union select distinct project_slug, project_slug, false from turns union select '00000000-0000-0000-0000-' || lpad(conv_id::varchar, 12, '0'), '00000000-0000-0000-0000-' || lpad(conv_id::varchar, 12, '0'), true from turns"))
def targets(spark: SparkSession, d: str) -> DataFrame:
    t = feed.turns(spark, d)
    uuids = t.select(F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("conv_id").cast("string"), 12, "0")))
    both = t.select(F.col("cwd").alias("target")).union(t.select("project_slug")).union(uuids).distinct()
    return both.select("target", fn.target_slug(F.col("target")).alias("slug"), fn.is_uuid(F.col("target")).alias("is_uuid"))


@query("fn11_day_slices", oracle(SESSION, "select session_uuid, round(case when first_seconds is not null then case when last_seconds - first_seconds >= 86400 then 0.0 else (first_seconds % 86400) / 86400.0 end end, 6)::double as start, round(case when first_seconds is not null then case when last_seconds - first_seconds >= 86400 then 1.0 else greatest(1.0 / 48, (last_seconds - first_seconds) / 86400.0) end end, 6)::double as length from s"))
def slices(spark: SparkSession, d: str) -> DataFrame:
    s = session_rows(spark, d).withColumn("day", fn.day_slice(F.timestamp_seconds("first_seconds"), F.timestamp_seconds("last_seconds")))
    return s.select("session_uuid", F.round("day.start", 6).cast("double").alias("start"), F.round("day.length", 6).cast("double").alias("length"))


@query("fn15_title_actions", "select doc_id, case when trim(coalesce(text, '')) = '' then 'delete' when length(text) > 200 then 'reject' else 'set' end as action from documents")
def title_actions(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts offered as titles: most are too long."""
    return feed.read(spark, d, "documents").select("doc_id", fn.title_action(F.col("text")).alias("action"))


def log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a change log: an even event sets, an odd one removes."""
    e = feed.read(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("session_uuid"), F.when(F.col("event_id") % 3 == 0, "remove").otherwise("set").alias("op"), F.col("event_type").alias("value"), F.col("event_id").alias("at"))


LOG = "log as (select user_id::varchar as session_uuid, case when event_id % 3 = 0 then 'remove' else 'set' end as op, event_type as value, event_id as seq from events)"


@query("ups1_overlay_state", f"with {LOG} select session_uuid, arg_max(value, seq) as value from log group by 1 having arg_max(op, seq) = 'set'")
def overlay_state(spark: SparkSession, d: str) -> DataFrame:
    return governance.current(log(spark, d))


@query("ups2_user_titles", "with t as (select user_id::varchar as session_uuid, case when event_id % 5 = 0 then '  ' else event_type end as value, event_id as seq from events) select session_uuid, arg_max(value, seq) as value from t group by 1 having trim(arg_max(value, seq)) <> ''")
def user_titles(spark: SparkSession, d: str) -> DataFrame:
    edits = log(spark, d).withColumn("value", F.when(F.col("at") % 5 == 0, "  ").otherwise(F.col("value"))).drop("op")
    return governance.current(governance.title_log(edits))


@query("ups4_exclusions", oracle("", "select o.project_slug, count(distinct o.session_uuid) as prior_sessions from turns o where o.project_slug in ('-Users-x-p2', '-Users-x-p5') group by 1"))
def exclusions(spark: SparkSession, d: str) -> DataFrame:
    wall = feed.turns(spark, d).select("project_slug").distinct().where(F.col("project_slug").isin("-Users-x-p2", "-Users-x-p5"))
    return feed.turns(spark, d).join(wall, "project_slug").groupBy("project_slug").agg(F.countDistinct("session_uuid").alias("prior_sessions"))


WALL_LOG = "select event_id as seq, case when user_id % 2 = 0 then 'project' else 'session' end as kind, case when user_id % 2 = 0 then '-Users-x-p' || cast(user_id % 9 as string) else 's' || lpad(cast(user_id as string), 8, '0') end as target, case when event_id % 3 = 0 then 'remove' else 'add' end as op, event_type as reason from {events}"
WALL_SQL = f"wl as (select *, lag(op) over (partition by kind, target order by seq) as prev from ({WALL_LOG.format(events='events')}) e)"


def wall_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as changes of the walls: projects and sessions that are excluded and let in again, for a reason."""
    return spark.sql(WALL_LOG, events=feed.read(spark, d, "events")).withColumnRenamed("seq", "at")


@query("ups4_exclusion_changes", oracle(WALL_SQL, """, ps as (select project_slug, count(distinct session_uuid) as n from turns group by 1), ch as (select *, case when op = 'add' then coalesce(prev <> 'add', true) else coalesce(prev = 'add', false) end as changed from wl)
select seq, kind, target, op, changed, (case when kind = 'project' and op = 'add' and changed then coalesce(n, 0) else 0 end)::bigint as prior_sessions from ch left join ps on project_slug = target"""))
def exclusion_changes(spark: SparkSession, d: str) -> DataFrame:
    return governance.exclusion_changes(wall_log(spark, d), feed.turns(spark, d)).select(F.col("at").alias("seq"), "kind", "target", "op", "changed", "prior_sessions")


@query("ups4_walls_with_reasons", oracle(WALL_SQL, "select kind, target, arg_max(reason, seq) filter (where op = 'add' and coalesce(prev <> 'add', true)) as reason, max(seq) filter (where op = 'add' and coalesce(prev <> 'add', true)) as seq from wl group by 1, 2 having arg_max(op, seq) = 'add'"))
def walls_with_reasons(spark: SparkSession, d: str) -> DataFrame:
    return governance.exclusions(wall_log(spark, d)).withColumnRenamed("at", "seq")


@query("ups5_schema_versions", oracle("", "select distinct version as schema_version from turns where version <> '2.1.100'"))
def versions(spark: SparkSession, d: str) -> DataFrame:
    seen = feed.turns(spark, d).select(F.col("version").alias("schema_version"))
    return governance.first_encounters(seen, seen.where("schema_version = '2.1.100'").distinct())


@query("set5_walls", oracle("", "select 'project' as wall, project_slug as target from (select distinct project_slug from turns where project_slug = '-Users-x-p2') a union all select 'session', session_uuid from overlays where n % 10 = 0"))
def walls(spark: SparkSession, d: str) -> DataFrame:
    return governance.walls(feed.turns(spark, d).where("project_slug = '-Users-x-p2'").select("project_slug").distinct(), feed.overlays(spark, d).where("n % 10 = 0"))


DOOMED = "doomed as (select session_uuid from overlays where n % 6 = 0)"


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The tables that hold something of a session."""
    m, p = messages(spark, d), parsed(spark, d)
    rows = {"records": feed.turns(spark, d), "overlays": feed.overlays(spark, d), "messages": m, "blocks": blocks.block_rows(m), "usage": blocks.usage_rows(p), "events": blocks.event_rows(p), "anomalies": p.select("session_uuid", F.explode("anomalies").alias("a"))}
    return rows | {"index": chat_blocks(spark, d), "postings": index(spark, d)[1].join(chat_blocks(spark, d).select("block_key", "session_uuid"), "block_key")}


HELD = f"""{BLOCKS}, held as (select 'records' as "table", session_uuid from turns union all select 'overlays', session_uuid from overlays union all select 'messages', session_uuid from m
  union all select 'blocks', session_uuid from (select session_uuid, unnest(range((case when rtype = 'system' or (rtype = 'attachment' and not (is_queued and text <> '')) then 0 when rtype = 'assistant' and tool_id is not null and not bare then 2 else 1 end)::bigint)) from m) b
  union all select 'usage', session_uuid from g where rtype = 'assistant' and input_tokens is not null union all select 'events', session_uuid from g where rtype in ('ai-title', 'custom-title')
  union all select 'anomalies', session_uuid from turns where {feed.STATUS} <> 'ok' union all select 'index', session_uuid from bl union all select 'postings', session_uuid from tk join bl using (block_key)), {DOOMED}"""


@query("del1_cascade", oracle(HELD, "select \"table\", count(*) as n from held where session_uuid not in (select session_uuid from doomed) group by 1"))
def cascade(spark: SparkSession, d: str) -> DataFrame:
    left = governance.cascade(tables(spark, d), feed.overlays(spark, d).where("n % 6 = 0"))
    out = None
    for name, rows in left.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


@query("agg12_deletion_preview", oracle(DOOMED, "select 'records' as \"table\", count(*) as n_rows from turns where session_uuid in (select session_uuid from doomed) union all select 'overlays', count(*) from overlays where session_uuid in (select session_uuid from doomed)"))
def preview(spark: SparkSession, d: str) -> DataFrame:
    o = feed.overlays(spark, d)
    return governance.preview({"records": feed.turns(spark, d), "overlays": o}, o.where("n % 6 = 0"))


SOURCES = f"src as (select 's' || split_part(path, '/', 4)[29:36] as session_uuid, path from ({PATHS.format(turns='turns')}) p where path not like '%.txt'), disk as (select path from src where path like '%.jsonl')"


def sources_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Source files with their sessions, and a listing without backups."""
    found = transcripts.classify_paths(paths(spark, d))
    return found.select(F.concat(F.lit("s"), F.substring("session_uuid", 29, 8)).alias("session_uuid"), "path"), found.where("not is_backup").select("path")


def deletion_targets(spark: SparkSession, d: str) -> DataFrame:
    """Every session and every project as something to delete."""
    rows = session_rows(spark, d)
    c = F.col
    one = rows.select(F.lit("session").alias("kind"), c("session_uuid").alias("target"), fn.display_title(c("user_title"), c("custom_title"), c("ai_title"), c("session_uuid")).alias("label"), "session_uuid")
    return one.unionByName(rows.select(F.lit("project").alias("kind"), c("project_slug").alias("target"), c("project_slug").alias("label"), "session_uuid"))


@query("agg12_preview_of_targets", oracle(f"{SESSION}, {SOURCES}", """, nr as (select session_uuid, count(*) as n from turns group by 1), np as (select session_uuid, count(*) as n from src join disk using (path) group by 1),
tg as (select 'session' as kind, session_uuid as target, coalesce(case when trim(user_title) <> '' then user_title end, case when trim(ai_title) <> '' then ai_title end, case when trim(custom_title) <> '' then custom_title end, session_uuid[1:8]) as label, session_uuid from s union all select 'project', project_slug, project_slug, session_uuid from s)
select kind, target, label, count(*) as sessions, sum(nr.n)::bigint as records, coalesce(sum(np.n), 0)::bigint as paths_on_disk from tg left join nr using (session_uuid) left join np using (session_uuid) group by 1, 2, 3"""))
def preview_of_targets(spark: SparkSession, d: str) -> DataFrame:
    return governance.deletion_preview(deletion_targets(spark, d), feed.turns(spark, d), *sources_of(spark, d))


@query("agg12_paths_on_disk", oracle(SOURCES, "select p.project_slug as target, path from src join disk using (path) join (select distinct session_uuid, project_slug from turns) p using (session_uuid)"))
def paths_on_disk(spark: SparkSession, d: str) -> DataFrame:
    return governance.paths_present(deletion_targets(spark, d).where("kind = 'project'"), *sources_of(spark, d)).select("target", "path")


@query("del2_ledger", oracle(DOOMED, "select sha256(session_uuid) as label_sha, 'asked for' as reason, (select count(*) from turns t where t.session_uuid = d.session_uuid) as n_records from doomed d"))
def ledger(spark: SparkSession, d: str) -> DataFrame:
    return governance.ledger(feed.overlays(spark, d).where("n % 6 = 0"), feed.turns(spark, d), "asked for")


@query("del3_forbidden_sessions", oracle(DOOMED, "select count(distinct transcript) as n from turns where session_uuid not in (select session_uuid from doomed)"))
def forbidden(spark: SparkSession, d: str) -> DataFrame:
    return sessions.without(feed.turns(spark, d), feed.overlays(spark, d).where("n % 6 = 0"), "session_uuid").agg(F.countDistinct("transcript").alias("n"))


@query("set4_cascade_scope", oracle(DOOMED, "select transcript, count(*) as n from turns where session_uuid in (select session_uuid from doomed) group by 1"))
def scope(spark: SparkSession, d: str) -> DataFrame:
    return governance.scope(feed.turns(spark, d), feed.overlays(spark, d).where("n % 6 = 0")).groupBy("transcript").agg(F.count("*").alias("n"))


LIVE = f"lp as (select distinct 's' || split_part(path, '/', 4)[29:36] as session_uuid from ({PATHS.format(turns='turns')}) p where path like '%.jsonl' and path not like '%/subagents/%')"


@query("ins2_session_detail", oracle(f"{SESSION}, {LIVE}", "select s.session_uuid, s.project_slug, string_agg(t.kind || ':' || t.agent_hex, ',' order by t.kind, t.transcript) as transcripts, count(lp.session_uuid) > 0 as on_disk from s join (select distinct session_uuid, transcript, kind, agent_hex from turns) t using (session_uuid) left join lp using (session_uuid) where not s.archived group by 1, 2"))
def detail(spark: SparkSession, d: str) -> DataFrame:
    """Visible sessions with their transcripts and whether the main file is still there."""
    t = sessions.transcript_list(feed.turns(spark, d).select("session_uuid", "transcript", "kind", "agent_hex").distinct())
    live = transcripts.classify_paths(paths(spark, d)).where("kind = 'main' and not is_backup").select(F.concat(F.lit("s"), F.substring("session_uuid", 29, 8)).alias("session_uuid")).distinct()
    rows = session_rows(spark, d).where("not archived").select("session_uuid", "project_slug").join(t, "session_uuid").join(live.withColumn("live", F.lit(True)), "session_uuid", "left")
    named = F.transform("transcripts", lambda x: F.concat_ws(":", x["kind"], x["agent_hex"]))
    return rows.select("session_uuid", "project_slug", F.array_join(named, ",").alias("transcripts"), F.coalesce("live", F.lit(False)).alias("on_disk"))


@query("ups3_archive_log", f"with {LOG} select session_uuid, seq as archived_at from (select session_uuid, arg_max(op, seq) as op, max(seq) as seq from log group by 1) x where op = 'set'")
def archive_log(spark: SparkSession, d: str) -> DataFrame:
    """Archive and unarchive as a change log: sessions archived now, with the change that did it."""
    return governance.current(log(spark, d).withColumn("value", F.col("at"))).withColumnRenamed("value", "archived_at")


@query("del4_cascade_in_snapshots", oracle(HELD, """, sn as (select *, 's' || (substr(session_uuid, 2)::bigint % 3)::varchar as snapshot from held)
select snapshot, "table", count(*) as n from sn where session_uuid not in (select session_uuid from doomed) group by 1, 2
union all select snapshot, 'ledger', count(distinct session_uuid) from sn where session_uuid in (select session_uuid from doomed) group by 1
union all select snapshot, 'records deleted', count(*) from sn where "table" = 'records' and session_uuid in (select session_uuid from doomed) group by 1"""))
def cascade_in_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The whole deletion in every snapshot: what is left in each table, and what the ledgers say."""
    name = F.concat(F.lit("s"), (F.substring("session_uuid", 2, 20).cast("long") % 3).cast("string"))
    rows = {k: t.select("session_uuid", name.alias("snapshot")) for k, t in tables(spark, d).items()}
    left, tombstones = governance.scrub_snapshots(rows, feed.overlays(spark, d).where("n % 6 = 0"), "asked for")
    out = tombstones.groupBy("snapshot").agg(F.count("*").alias("n")).select("snapshot", F.lit("ledger").alias("table"), "n")
    out = out.unionByName(tombstones.groupBy("snapshot").agg(F.sum("n_records").alias("n")).select("snapshot", F.lit("records deleted").alias("table"), "n"))
    for k, t in left.items():
        out = out.unionByName(t.groupBy("snapshot").agg(F.count("*").alias("n")).select("snapshot", F.lit(k).alias("table"), "n"))
    return out


@query("del4_scrubbed_snapshots", oracle(DOOMED, "select 's' || (conv_id % 3)::varchar as snapshot, count(*) filter (where session_uuid not in (select session_uuid from doomed)) as n_left, count(*) filter (where session_uuid in (select session_uuid from doomed)) > 0 as was_present from turns group by 1"))
def scrubbed(spark: SparkSession, d: str) -> DataFrame:
    """The same deletion in every snapshot, each with its own rows."""
    t = feed.turns(spark, d)
    snapshots = {f"s{k}": {"records": t.where(F.col("conv_id") % 3 == k)} for k in range(3)}
    left, report = governance.scrub(snapshots, feed.overlays(spark, d).where("n % 6 = 0"))
    counts = [tables["records"].agg(F.count("*").alias("n_left")).select(F.lit(name).alias("snapshot"), "n_left") for name, tables in left.items()]
    both = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return both.join(report, "snapshot").select("snapshot", "n_left", "was_present").where("n_left > 0 or was_present")
