"""Queries on sources and sinks: paths, walls, lines, tails, duplicates, states, export choice, rebuilds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillhouse.functions.text import whole_json
from quillhouse.operators import governance, records
from quillhouse.operators.sessions import run_list
from quillhouse.plans import feed, lake
from quillhouse.plans.record_queries import oracle, parsed
from quillhouse.plans.registry import query
from quillhouse.sources import export, ranges, staging, transcripts

#: Numbers of events or orders that one made-up file spans.
FILE_ROWS = 1 << 16
PATHS = """
select '/root/' || project_slug || '/00000000-0000-0000-0000-' || lpad(cast(n as string), 12, '0') || case when conv_id % 5 = 4 then '/subagents/agent-' || lpad(cast(conv_id as string), 8, '0') || '.jsonl'
  when conv_id % 7 = 3 then '.jsonl.bak-17' when conv_id % 11 = 6 then '.txt' else '.jsonl' end as path, conv_id
from (select distinct conv_id, project_slug, case when conv_id % 5 = 4 then conv_id - 1 else conv_id end as n from {turns}) c
"""
P = f"p as ({PATHS.format(turns='turns')}), k as (select *, split_part(path, '/', 3) as project_slug, split_part(path, '/', 4)[1:36] as session_uuid from p where path not like '%.txt')"


def paths(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(PATHS, turns=feed.turns(spark, d))


@query("src1_transcript_paths", oracle(P, "select path, project_slug, session_uuid, case when path like '%/subagents/%' then 'subagent' else 'main' end as kind, case when path like '%/subagents/%' then lpad(conv_id::varchar, 8, '0') else '' end as agent_hex, path like '%.bak-17' as is_backup from k"))
def classify(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.classify_paths(paths(spark, d)).select("path", "project_slug", "session_uuid", "kind", "agent_hex", "is_backup")


@query("src2_src3_walls", oracle(P, "select path from k where project_slug <> '-Users-x-p2' and session_uuid not in (select session_uuid from k where conv_id % 10 = 0)"))
def walls(spark: SparkSession, d: str) -> DataFrame:
    files = transcripts.classify_paths(paths(spark, d))
    return transcripts.behind_walls(files, files.where("project_slug = '-Users-x-p2'"), files.where("conv_id % 10 = 0")).select("path")


def document_files(spark: SparkSession, d: str) -> DataFrame:
    return feed.read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


@query("src5_win5_line_offsets", """
with l as (select doc_id as path, unnest(range(len(a))) as i, unnest(a) as x, len(a) as n from (select doc_id, string_split(text, chr(10)) as a from documents where text <> '') t),
k as (select path, i as line_number, strlen(x) + case when i < n - 1 then 1 else 0 end as size from l where i < n - 1 or x <> '')
select path, line_number, (sum(size) over (partition by path order by line_number) - size)::bigint as start_offset, (sum(size) over (partition by path order by line_number))::bigint as end_offset from k""")
def lines(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.split_lines(document_files(spark, d)).select("path", F.col("line_number").cast("long").alias("line_number"), "start_offset", "end_offset")


#: Bytes of a range in these queries: small, so that even small inputs are cut.
SMALL_RANGE = 4 << 20
LANG_LINES = "l as (select coalesce(lang, 'und') as lang, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 as n, strlen(coalesce(text, '')) + 1 as size from documents)"


def written_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files by language, as Spark's text writer leaves them: ``(path, lang, length, start)``."""

    def build() -> DataFrame:
        folder = f"{lake.shared_dir(spark)}/files-{uuid.uuid4().hex}"
        docs = feed.read(spark, d, "documents").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
        docs.write.partitionBy("lang").option("compression", "none").text(folder)
        found = transcripts.listing(spark, folder)
        return found.select("path", F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang"), "length", F.lit(0).cast("long").alias("start")).where("lang <> ''")

    return lake.table(spark, d, "documents", "written_files", build)


@query("src5_byte_ranges", f"with {LANG_LINES} select lang, sum(n)::bigint as n_lines, sum(size)::bigint as n_bytes, sum(n)::bigint as n_numbered, 0::bigint as n_gaps from l group by 1")
def byte_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Files read by ranges: their lines and bytes, the last number of each file, and lines that do not begin where the one before ends."""
    files_ = written_files(spark, d)
    lines_ = ranges.range_lines(files_, range_bytes=SMALL_RANGE).select("path", "line_number", "start_offset", "end_offset", F.octet_length("raw").alias("size"))
    # Every place but a file's ends is where one line ends and the next begins.
    edges = lines_.select("path", F.explode(F.array("start_offset", "end_offset")).alias("at")).groupBy("path", "at").count().where("count <> 2").groupBy("path").agg((F.count("*") - 2).alias("gaps"))
    per = lines_.groupBy("path").agg(F.count("*").alias("n"), F.sum("size").alias("size"), (F.max("line_number") + 1).alias("last"))
    each = per.join(edges, "path").join(files_.select("path", "lang"), "path")
    return each.groupBy("lang").agg(F.sum("n").alias("n_lines"), F.sum("size").alias("n_bytes"), F.sum("last").alias("n_numbered"), F.sum("gaps").alias("n_gaps"))


@query("agg16_chunk_digests", f"with {LANG_LINES} select lang, sum(n)::bigint as line_ends, sum(size)::bigint as n_bytes from l group by 1")
def chunk_digests(spark: SparkSession, d: str) -> DataFrame:
    """The digests of the chunks of all files, and of their prefixes, summed up."""
    files_ = written_files(spark, d)
    trees = ranges.tree_digest(ranges.chunk_digests(files_, range_bytes=SMALL_RANGE, chunk_bytes=1 << 20)).join(files_.select("path", "lang"), "path")
    return trees.groupBy("lang").agg(F.sum("prefix_lines").alias("line_ends"), F.sum("prefix_bytes").alias("n_bytes"))


def batch_of(owner: str, number: str) -> Column:
    """The path of a file that holds ``FILE_ROWS`` numbers of an owner at most, so that a busy owner has many files and not a long one."""
    return F.concat_ws("/", F.col(owner), F.floor(F.col(number) / FILE_ROWS))


#: How an event is written down: over several lines, on one, as an opener that a whole record of its own follows, or with brackets that never were JSON.
EVENT_SHAPE = "case event_id % 4 when 0 then 'pretty' when 1 then 'native' when 2 then 'swallowing' else 'broken' end"
EVENT_BODY = {"pretty": ('{\n "p":\n ', "\n}\n"), "native": ("", "\n"), "swallowing": ('{"a":[\n', "\n]}\n"), "broken": ("{\n not json ", "\n}\n")}
#: What every file ends with: a record that is still being written.
EVENT_TAIL = '{\n "open":\n'
#: Records, lines before joining, lines that are no JSON before and after, of each shape.
EVENT_COUNTS = {"pretty": (1, 4, 3, 0), "native": (1, 1, 0, 0), "swallowing": (3, 3, 2, 2), "broken": (3, 3, 3, 3)}


def event_files(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as files of several shapes of records, with an open one at the end."""
    e = feed.read(spark, d, "events").select(F.col("user_id").alias("user"), batch_of("user_id", "event_id").alias("path"), "event_id", F.expr(EVENT_SHAPE).alias("shape"), F.coalesce("props", F.lit("{}")).alias("props"))
    body = F
    for shape, (head, end) in EVENT_BODY.items():
        body = body.when(F.col("shape") == shape, F.concat(F.lit(head), F.col("props"), F.lit(end)))
    rows = e.withColumn("body", body).groupBy("user", "path").agg(F.array_sort(F.collect_list(F.struct("event_id", "body"))).alias("b"))
    return rows.select("user", "path", F.concat(F.array_join("b.body", ""), F.lit(EVENT_TAIL)).cast("binary").alias("content"))


def _of_shape(column: str, values: dict[str, int]) -> str:
    return "case shape " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + f" end {column}"


EVENT_SQL = f"ev as (select user_id as path, coalesce(props, '{{}}') as props, {EVENT_SHAPE} as shape, event_id // {FILE_ROWS} as batch from events), ec as (select path, batch, props, " + ", ".join(
    [_of_shape(name, {k: v[i] for k, v in EVENT_COUNTS.items()}) for i, name in enumerate(("n_records", "n_lines", "bad_before", "bad_after"))] + [_of_shape("extra", {k: len(a) + len(b) for k, (a, b) in EVENT_BODY.items()})]
) + " from ev)"


@query("src6_reassembled_records", f"with {EVENT_SQL} select path, sum(n_records)::bigint as n_records, sum(strlen(props) + extra)::bigint as n_bytes from ec group by 1")
def reassembled(spark: SparkSession, d: str) -> DataFrame:
    files = staging.table(event_files(spark, d), "event_files")
    out = transcripts.reassembled(transcripts.split_lines(files))
    return out.groupBy(F.col("user").alias("path")).agg(F.count("*").alias("n_records"), F.sum(F.octet_length("raw")).cast("long").alias("n_bytes"))


@query("agg11_recapture_counters", f"""with {EVENT_SQL}, open_ as (select *, path % 2 = 1 as is_open from ec)
select path || '/' || batch as path, sum(n_lines)::bigint + case when is_open then 2 else 0 end as records_before, sum(bad_before)::bigint + case when is_open then 2 else 0 end as anomalies_before,
  case when is_open then sum(n_lines)::bigint + 2 else sum(n_records)::bigint end as records_after, case when is_open then sum(bad_before)::bigint + 2 else sum(bad_after)::bigint end as anomalies_after, not is_open as reconciled
from open_ group by path, batch, is_open""")
def recaptured(spark: SparkSession, d: str) -> DataFrame:
    """Files once captured line by line and now split anew; those that end in an open record are refused."""
    files = event_files(spark, d)
    whole = F.expr(f"substring(content, 1, length(content) - {len(EVENT_TAIL)})")
    files = staging.table(files.select("path", F.when(F.col("user") % 2 == 1, F.col("content")).otherwise(whole).alias("content")), "event_files")
    bad = whole_json(F.col("raw").cast("string")).isNull().alias("is_anomaly")
    before = transcripts.split_lines(files)
    before, after = (x.select("path", "line_number", "start_offset", "raw", bad) for x in (before, transcripts.reassembled(before)))
    return governance.recapture_counters(before, staging.table(after, "recaptured"))


@query("src4_sidecars", oracle("", "select distinct agent_hex, 'helper' as agent_type, 't' || (conv_id - 1)::varchar || '-1' as tool_use_id from turns where kind = 'subagent'"))
def sidecars(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.sidecar_rows(feed.sidecar_files(spark, d)).select("agent_hex", "agent_type", "tool_use_id")


@query("str4_contained_failures", "select coalesce(sum(case when source is not null and n_chars % 7 > 0 and text <> '' then (length(text) - length(replace(text, chr(10), ''))) + case when ends_with(text, chr(10)) then 0 else 1 end end), 0)::bigint as n_lines, count(*) filter (where source is null or n_chars % 7 = 0) as n_failures from documents")
def contained(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files, of which some cannot be read: the others are split, those become anomalies."""
    docs = feed.read(spark, d, "documents").withColumn("shut", F.col("source").isNull() | (F.col("n_chars") % 7 == 0))
    loaded, failed = transcripts.readable(docs.select(F.col("doc_id").cast("string").alias("path"), F.when(~F.col("shut"), F.coalesce("text", F.lit("")).cast("binary")).alias("content")))
    lines_ = transcripts.split_lines(loaded).agg(F.count("*").alias("n_lines"))
    return lines_.join(failed.agg(F.count("*").alias("n_failures")), F.lit(True))


@query("src7_torn_tails", "select o_custkey as path, count(*) - max(case when o_custkey % 2 = 0 then 1 else 0 end) as n_lines from orders group by 1 having count(*) - max(case when o_custkey % 2 = 0 then 1 else 0 end) > 0")
def torn(spark: SparkSession, d: str) -> DataFrame:
    o = feed.read(spark, d, "orders").select(F.col("o_custkey").alias("customer"), batch_of("o_custkey", "o_orderkey").alias("path"), "o_orderkey")
    line = F.to_json(F.struct(F.col("o_orderkey").alias("k")))
    files = o.withColumn("line", line).groupBy("customer", "path").agg(F.max("o_orderkey").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\n").alias("body"))
    # The last file of every second customer breaks off inside its last record, the others only lack the line end.
    ends = files.groupBy("customer").agg(F.max("last").alias("end"))
    torn_off = (F.col("customer") % 2 == 0) & (F.col("last") == F.col("end"))
    files = files.join(ends, "customer").select("customer", "path", F.when(torn_off, F.expr("substring(body, 1, length(body) - 1)")).otherwise(F.col("body")).cast("binary").alias("content"))
    return transcripts.complete(transcripts.split_lines(files)).groupBy(F.col("customer").alias("path")).agg(F.count("*").alias("n_lines"))


@query("src8_str2_incremental_tails", """
select doc_id as path, case when doc_id % 5 = 0 then 'new' when doc_id % 5 = 1 then 'diverged' else 'grown' end as action, (case when doc_id % 5 = 1 then 1 else 0 end)::bigint as generation,
  (case when doc_id % 5 in (0, 1) then strlen(text) else strlen(text) - strlen(text) // 2 end)::bigint as n_bytes from documents where doc_id % 5 < 4 and text <> ''""")
def tails(spark: SparkSession, d: str) -> DataFrame:
    files = document_files(spark, d).where("octet_length(content) > 0").withColumn("length", F.octet_length("content").cast("long"))
    half = F.expr("case when path % 5 = 4 then length when path % 5 = 1 then cast(length / 2 as long) else length div 2 end")
    known = files.where("path % 5 <> 0").withColumn("checkpoint", half)
    known = known.withColumn("sha", F.when(F.col("path") % 5 == 1, F.lit("other bytes")).otherwise(F.sha2(F.expr("substring(content, 1, cast(checkpoint as int))"), 256))).select("path", "checkpoint", "sha", F.lit(0).alias("generation"))
    out = transcripts.new_tails(files, known)
    return out.select("path", "action", F.col("generation").cast("long").alias("generation"), F.octet_length("content").cast("long").alias("n_bytes"))


@query("src9_str1_incremental_runs", """
select doc_id as path, case when length(text) % 3 = 0 then 'new' when length(text) % 3 = 1 then 'grown' end as action, strlen(text)::bigint as end_offset from documents where text <> '' and length(text) % 3 < 2""")
def incremental(spark: SparkSession, d: str) -> DataFrame:
    """A second run over documents as files: the first had some whole, of some only the start, and some not at all."""
    files = document_files(spark, d).where("octet_length(content) > 0").withColumn("length", F.octet_length("content").cast("long"))
    shape = F.char_length(F.col("content").cast("string")) % 3
    checkpoint = F.when(shape == 1, F.floor(F.col("length") / 2)).otherwise(F.col("length"))
    known = files.where(shape > 0).withColumn("checkpoint", checkpoint).withColumn("sha", F.sha2(F.expr("substring(content, 1, cast(checkpoint as int))"), 256)).select("path", "checkpoint", "sha", F.lit(0).alias("generation"))
    tails_ = transcripts.new_tails(files, known)
    lines_ = transcripts.split_lines(tails_)
    base = F.when(F.col("action") == "grown", F.col("checkpoint")).otherwise(F.lit(0))
    return lines_.groupBy("path", "action").agg(F.max(F.col("end_offset") + base).cast("long").alias("end_offset"))


@query("agg16_prefix_digests", "select doc_id as path, sha256(encode(text)[1:0] || encode(text)) as prefix_sha, (length(text) - length(replace(text, chr(10), '')))::bigint as prefix_lines from documents where text <> ''")
def digests(spark: SparkSession, d: str) -> DataFrame:
    files = document_files(spark, d).where("octet_length(content) > 0").withColumn("checkpoint", F.octet_length("content"))
    return transcripts.prefix_digest(files).select("path", "prefix_sha", F.col("prefix_lines").cast("long").alias("prefix_lines"))


def copies(spark: SparkSession, d: str) -> DataFrame:
    """Documents as lines of files: the source is the file, the text's length stands for an id; an empty text has none."""
    docs = feed.read(spark, d, "documents")
    return docs.select(F.col("lang").alias("transcript"), F.when(F.col("text") != "", F.char_length("text").cast("string")).alias("uuid"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.col("source").alias("file"), F.col("doc_id").alias("line_number"))


@query("win6_duplicate_lines", """
with l as (select doc_id, lang as transcript, case when text <> '' then length(text)::varchar end as uuid, sha256(coalesce(text, '')) as sha, source as file from documents),
k as (select *, coalesce(uuid, '#' || doc_id::varchar) as u from l)
select doc_id as line_number, file <> first_value(file) over (partition by transcript, u, sha order by doc_id) as is_duplicate,
  uuid is not null and row_number() over (partition by transcript, u, sha order by doc_id) = 1 and row_number() over (partition by transcript, uuid order by doc_id) > 1 as is_conflict from k""")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.mark_duplicates(copies(spark, d), ["line_number"]).select("line_number", "is_duplicate", "is_conflict")


STATES = "old as (select o_custkey as key, min(o_orderkey) as first_key, max(o_orderkey) % 4 = 0 as was_gone from orders where month(o_orderdate) <= 6 group by 1), cur as (select o_custkey as key, min(o_orderkey) as first_key from orders where month(o_orderdate) > 3 group by 1)"


@query("str3_source_states", f"with {STATES} select coalesce(old.key, cur.key) as key, case when old.key is null then 'new' when cur.key is null then 'gone' when was_gone and old.first_key = cur.first_key then 'reappeared' when old.first_key <> cur.first_key then 'diverged' else 'active' end as state from old full join cur on old.key = cur.key")
def states(spark: SparkSession, d: str) -> DataFrame:
    o = feed.read(spark, d, "orders").withColumn("m", F.month("o_orderdate"))
    key = F.col("o_custkey").alias("key")
    before = o.where("m <= 6").groupBy(key).agg(F.when(F.max("o_orderkey") % 4 == 0, "gone").otherwise("active").alias("state"), F.min("o_orderkey").alias("sha"))
    now = o.where("m > 3").groupBy(key).agg(F.min("o_orderkey").alias("sha"))
    return transcripts.source_states(before, now).select("key", "state")


@query("jn10_gone_sources", f"with {STATES} select old.key from old left join cur on old.key = cur.key where cur.key is null")
def gone(spark: SparkSession, d: str) -> DataFrame:
    return states(spark, d).where("state = 'gone'").select("key")


FILES = "f as (select source as file, lang as transcript, count(*) as n_records, (min(doc_id) % 3)::bigint as generation, min(doc_id) % 7 = 0 as is_primary, min(doc_id) as first_seen, min(doc_id) % 4 = 1 as is_backup from documents group by 1, 2)"


def files(spark: SparkSession, d: str) -> DataFrame:
    out = feed.read(spark, d, "documents").groupBy(F.col("source").alias("file"), F.col("lang").alias("transcript")).agg(F.count("*").alias("n_records"), F.min("doc_id").alias("first_seen"))
    c = F.col("first_seen")
    return out.withColumns({"generation": c % 3, "is_primary": c % 7 == 0, "is_backup": c % 4 == 1, "state": F.when(c % 5 == 2, "gone").otherwise("active"), "path": F.col("file")})


@query("snk3_export_choice", f"with {FILES} select transcript, file from f qualify row_number() over (partition by transcript order by is_primary desc, n_records desc, generation desc, file desc) = 1")
def choice(spark: SparkSession, d: str) -> DataFrame:
    return export.choose_file(files(spark, d)).select("transcript", "file")


@query("win10_primary_election", f"with {FILES} select transcript, file from f where not is_backup and first_seen % 5 <> 2 qualify row_number() over (partition by transcript order by first_seen, file) = 1")
def primary(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.elect_primary(files(spark, d)).select("transcript", "file")


@query("agg14_double_primaries", f"with {FILES} select transcript, count(*) as n from f where is_primary group by 1 having count(*) > 1")
def doubles(spark: SparkSession, d: str) -> DataFrame:
    return governance.double_primaries(files(spark, d))


@query("win8_newest_generations", f"with {FILES} select file as path, transcript, generation from f qualify row_number() over (partition by file order by generation desc, transcript) = 1")
def newest(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.newest_generation(files(spark, d), ("transcript",)).select("path", "transcript", "generation")


@query("win9_ins1_raw_by_uuid", "select length(text)::varchar as uuid, max(doc_id) as line_number, arg_max(sha256(text), doc_id) as sha from documents where text <> '' group by 1")
def raw_by_uuid(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.newest_by_uuid(copies(spark, d))


RUNS = """with l as (select doc_id, lang as transcript, coalesce(case when text <> '' then length(text)::varchar end, '#' || doc_id::varchar) as u, sha256(coalesce(text, '')) as sha, source as file, text from documents),
k as (select *, 'r' || lpad((doc_id // 300)::varchar, 6, '0') as run_id, file <> first_value(file) over (partition by transcript, u, sha order by doc_id) as is_duplicate from l),
a as (select run_id, case when text is null or text = '' then 'error' when contains(text, '|') then 'info' end as severity from k),
r as (select run_id, count(distinct file) as files_seen, count(*) filter (where not is_duplicate) as records_added, count(*) filter (where is_duplicate) as records_skipped_duplicate from k group by 1),
n as (select run_id, count(*) as anomalies, bool_or(severity = 'error') as bad from a where severity is not null group by 1),
runs as (select run_id, files_seen, records_added, records_skipped_duplicate, coalesce(anomalies, 0) as anomalies, case when coalesce(bad, false) then 'errors' else 'ok' end as status from r left join n using (run_id))"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as lines captured in runs of 300 ids."""
    run = F.concat(F.lit("r"), F.lpad(F.floor(F.col("doc_id") / 300).cast("string"), 6, "0")).alias("run_id")
    marked = transcripts.mark_duplicates(copies(spark, d).withColumn("doc_id", F.col("line_number")), ["line_number"]).select(run, "file", "is_duplicate")
    severity = F.when(F.coalesce("text", F.lit("")) == "", "error").when(F.contains("text", F.lit("|")), "info").alias("severity")
    return governance.run_counters(marked, feed.read(spark, d, "documents").select(run, severity).where("severity is not null"))


@query("agg10_run_counters", f"{RUNS} select * from runs")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d)


@query("srt5_newest_runs", f"{RUNS} select run_id, status from runs order by run_id desc limit 20 offset 1")
def newest_runs(spark: SparkSession, d: str) -> DataFrame:
    return run_list(runs(spark, d), 20, 1).select("run_id", "status")


@query("snk1_export_bytes", "select source as transcript, sha256(string_agg(coalesce(text, '') || chr(10), '' order by doc_id)) as sha, sum(strlen(coalesce(text, '')) + 1)::bigint as n_bytes from documents group by 1")
def export_bytes(spark: SparkSession, d: str) -> DataFrame:
    rows = feed.read(spark, d, "documents").select(F.col("source").alias("transcript"), F.col("doc_id").alias("line_number"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary").alias("raw"))
    return export.digests(export.as_chunks(rows))


@query("snk4_missing_files", "with f as (select source || '/' || (length(coalesce(text, '')) // 50)::varchar as transcript, lang from documents) select distinct transcript from f where transcript not in (select transcript from f where lang = 'en' and transcript is not null)")
def missing(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts are the documents of a source of about one length; those with an English one have a file."""
    name = F.concat("source", F.lit("/"), F.floor(F.char_length(F.coalesce("text", F.lit(""))) / 50).cast("string")).alias("transcript")
    docs = feed.read(spark, d, "documents").select(name, "lang")
    return export.missing(docs.select("transcript").distinct(), docs.where("lang = 'en'"))


@query("snk2_written_bytes", oracle("", "select session_uuid as transcript, sum(octet_length(encode(text)) + 1)::bigint as n_bytes from turns group by 1"))
def written(spark: SparkSession, d: str) -> DataFrame:
    """Every session's text written to a file of its own."""
    rows = feed.turns(spark, d).select(F.col("session_uuid").alias("transcript"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("line_number"), F.concat("text", F.lit("\n")).cast("binary").alias("raw"))
    folder = f"{lake.shared_dir(spark)}/export-{uuid.uuid4().hex}"
    return export.write_files(rows, folder).select("transcript", "n_bytes")


@query("snk2_written_parts", "select source as transcript, sum(strlen(coalesce(text, '')) + 1)::bigint as n_bytes, sum(strlen(coalesce(text, '')) + 1)::bigint as bytes_there from documents where source is not null group by 1")
def written_parts(spark: SparkSession, d: str) -> DataFrame:
    """Every source's documents written as a folder of parts, and what a listing finds there."""
    rows = feed.read(spark, d, "documents").select(F.col("source").alias("transcript"), F.col("doc_id").alias("line_number"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary").alias("raw"))
    folder = f"{lake.shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    out = export.write_parts(rows, folder, staging.table)
    there = transcripts.listing(spark, folder).groupBy(F.regexp_extract("path", "/([^/]+)[.]jsonl/[0-9]+$", 1).alias("transcript")).agg(F.sum("length").alias("bytes_there"))
    return out.join(there, "transcript").select("transcript", "n_bytes", "bytes_there")


@query("rbd1_rebuilt_anomalies", oracle("", """
select kind, count(*) as n from (select 'source_diverged' as kind from turns where turn = 0
  union all select case when is_blank then 'whitespace_line' when is_torn then 'invalid_json' when rtype = 'mystery' then 'unknown_record_type' when is_misshapen and rtype in ('user', 'assistant') then 'validation_error' when is_drifted or is_deep then 'unknown_field' end from turns) a
where kind is not null group by 1"""))
def rebuilt(spark: SparkSession, d: str) -> DataFrame:
    new = records.anomaly_rows(parsed(spark, d))
    first = feed.turns(spark, d).where("turn = 0")
    old = first.select("transcript", F.col("turn").alias("line_number"), F.lit("error").alias("severity"), F.lit("source_diverged").alias("kind"), F.lit(None).cast("string").alias("detail"))
    stale = old.withColumn("kind", F.lit("invalid_json"))
    return governance.rebuilt_anomalies(old.unionByName(stale), new).groupBy("kind").agg(F.count("*").alias("n"))


@query("rbd2_same_bytes", "select doc_id as path, text not like '%a%' or text = '' as may_swap from documents where text <> ''")
def same(spark: SparkSession, d: str) -> DataFrame:
    before = transcripts.split_lines(document_files(spark, d).where("octet_length(content) > 0"))
    changed = document_files(spark, d).where("octet_length(content) > 0").withColumn("content", F.replace(F.col("content").cast("string"), F.lit("a"), F.lit("A")).cast("binary"))
    return governance.same_bytes(before, transcripts.split_lines(changed)).select("path", "may_swap")


@query("jn3_anomaly_paths", oracle(P, "select a.kind, count(*) as n, count(p.path) as with_path from (select conv_id, case when is_torn then 'invalid_json' else 'whitespace_line' end as kind from turns where is_blank or is_torn) a left join k p using (conv_id) group by 1").replace("case when is_torn then 'invalid_json' else 'whitespace_line' end", "case when is_blank then 'whitespace_line' else 'invalid_json' end"))
def anomaly_paths(spark: SparkSession, d: str) -> DataFrame:
    a = records.anomaly_rows(parsed(spark, d)).where("kind in ('invalid_json', 'whitespace_line')").join(feed.turns(spark, d).select("transcript", F.col("turn").alias("line_number"), "conv_id"), ["transcript", "line_number"])
    p = transcripts.classify_paths(paths(spark, d)).select("conv_id", "path")
    return a.join(p, "conv_id", "left").groupBy("kind").agg(F.count("*").alias("n"), F.count("path").alias("with_path"))
