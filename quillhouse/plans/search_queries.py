"""Full-text queries: over the transcripts' blocks, and over ``documents`` as a larger index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillhouse.functions import text as fn
from quillhouse.functions import stems
from quillhouse.operators import search, search_index
from quillhouse.plans import feed, lake
from quillhouse.plans.record_queries import CLASSIFIED, messages, oracle
from quillhouse.plans.registry import query
from quillhouse.sources import staging

ASKED = [(1, "and the"), (2, '"of the"'), (3, "tion"), (4, '"'), (5, "the_of"), (6, "the"), (7, "worthless idiots")]


def asked(spark: SparkSession, rows: list[tuple[int, str]] = ASKED) -> DataFrame:
    return spark.createDataFrame(rows, "query_id int, query string").select("query_id", fn.query_terms(F.col("query")).alias("phrases"))


def chat_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Indexed blocks with their message's session and source."""

    def build() -> DataFrame:
        m = messages(spark, d)
        info = ("session_uuid", "project_slug", "agent_hex", "uuid")
        rows = m.select("transcript", "line_number", *info, search.source_bucket(F.col("author"), F.col("kind")).alias("source"), F.posexplode("blocks").alias("block_index", "b"))
        rows = search.indexed(rows.select("transcript", "line_number", *info, "source", "block_index", F.col("b.kind").alias("kind"), F.col("b.text").alias("text")))
        return rows.withColumn("block_key", F.concat_ws("#", "transcript", F.col("line_number").cast("string"), F.col("block_index").cast("string")))

    return lake.table(spark, d, "conversations", "index", build)


def index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    """Blocks, postings, vocabulary with stems, and statistics of the transcripts' index."""
    b = chat_blocks(spark, d)
    posts = lake.table(spark, d, "conversations", "postings", lambda: search.postings(b))
    words = lake.table(spark, d, "conversations", "vocabulary", lambda: search.vocabulary(posts))
    lengths, df, total = search.statistics(posts, b)
    lengths = lake.table(spark, d, "conversations", "lengths", lambda: lengths)
    return b, posts, words, (lengths, df, lake.table(spark, d, "conversations", "totals", lambda: total))


def found(spark: SparkSession, d: str, rows: list[tuple[int, str]] = ASKED) -> DataFrame:
    """Hits of queries over the stemmed index, with the place of each block."""
    b, posts, words, stats = index(spark, d)
    hits = search.search(asked(spark, rows), posts, b, stats, words=words)
    return hits.join(b.select("block_key", "session_uuid", "project_slug", "source", "agent_hex", "uuid"), "block_key")


BLOCKS = f"""{CLASSIFIED}, bl as (select transcript || '#' || turn::varchar || '#0' as block_key, session_uuid, project_slug, case when kind = 'subagent' then 'agents' when author in
  ('human_typed', 'human_queued', 'human_inferred', 'attachment_queued_human', 'interrupt_marker', 'claude') then 'chat' else 'system' end as source, agent_hex, uuid,
  case when rtype = 'attachment' then text else body end as txt from m where (rtype in ('user', 'assistant') and not (rtype = 'user' and result_of is not null) and not bare and body <> '') or (rtype = 'attachment' and is_queued and text <> '')),
  tk as (select block_key, unnest(range(len(w))) as pos, unnest(w) as term from (select block_key, regexp_extract_all(lower(txt), '[\\p{{L}}\\p{{N}}]+') as w from bl)),
  ln as (select block_key, count(*) as length from tk group by 1),
  tot as (select count(*) as n, coalesce(sum(length), 0) / count(*) as avg_length from bl left join ln using (block_key)),
  vo as (select term, {stems.stem_sql('term')} as stem from (select distinct term from tk)),
  asked(query_id, phrase, width, place, word) as (values (1, 0, 1, 0, 'and'), (1, 1, 1, 0, 'the'), (2, 0, 2, 0, 'of'), (2, 0, 2, 1, 'the'), (3, 0, 1, 0, 'tion'), (5, 0, 2, 0, 'the'), (5, 0, 2, 1, 'of'), (6, 0, 1, 0, 'the'), (7, 0, 1, 0, 'worthless'), (7, 1, 1, 0, 'idiot')),
  ask as (select query_id, phrase, width, place, term from asked join vo on vo.stem = word),
  st as (select query_id, phrase, width, block_key, pos - place as start from tk join ask using (term) group by all having count(distinct place) = width),
  tf as (select query_id, phrase, block_key, count(*) as tf from st group by all),
  pd as (select query_id, phrase, count(*) as df from tf group by all),
  need as (select query_id, count(distinct phrase) as need from asked group by 1),
  hits as (select query_id, block_key, round(-sum(case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * length / avg_length))), 4) as rank
    from tf join pd using (query_id, phrase) join ln using (block_key), tot group by query_id, block_key having count(*) = (select need from need where need.query_id = tf.query_id)),
  h as (select * from hits join bl using (block_key))"""


@query("fts1_postings", "select doc_id, term, count(*) as tf, min(pos)::bigint as first_pos from (select doc_id, unnest(range(len(w))) as pos, unnest(w) as term from (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text <> '')) t group by 1, 2")
def postings(spark: SparkSession, d: str) -> DataFrame:
    docs = feed.read(spark, d, "documents").where("text <> ''").select("doc_id", "text")
    return search.term_counts(docs, once(search.repeated(docs, "doc_id"), "repeated", None, []), "doc_id")


@query("fts2_index_statistics", "with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from documents where text <> '') select term, count(distinct doc_id) as df from t group by 1")
def statistics(spark: SparkSession, d: str) -> DataFrame:
    docs = feed.read(spark, d, "documents").where("text <> ''")
    return search.statistics(search.postings(docs, "doc_id"), docs, "doc_id")[1]


@query("fts3_deindex", "select count(*) as n from (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from documents where text <> '' and lang <> 'de') t")
def deindex(spark: SparkSession, d: str) -> DataFrame:
    docs = feed.read(spark, d, "documents").where("text <> ''")
    return search.deindex(search.postings(docs, "doc_id"), docs.where("lang = 'de'"), "doc_id").agg(F.count("*").alias("n"))


@query("fts4_ranked_search", oracle(BLOCKS, "select query_id, block_key, rank from hits"))
def ranked(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d).select("query_id", "block_key", "rank")


#: Words and stems of documents, by which queries over them are held against SQL.
STEMMED = f"""tk as (select doc_id, unnest(range(len(w))) as pos, unnest(w) as term from (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from documents where text <> '')),
  vo as (select term, {stems.stem_sql('term')} as stem from (select distinct term from tk)), ts as (select doc_id, pos, stem from tk join vo using (term)),
  ln as (select doc_id, count(*) as length from tk group by 1), tot as (select count(*) as n, coalesce(sum(length), 0) / count(*) as a from (select doc_id from documents where text <> '') d left join ln using (doc_id))"""
BM25 = "case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * length / a))"


def document_index(spark: SparkSession, d: str) -> search_index.Index:
    """All documents as an index laid out for search."""
    docs = feed.read(spark, d, "documents").where("text <> ''").select(F.col("doc_id").alias("key"), "text")

    def keep(df: DataFrame, name: str, by: str | None, order: list[str]) -> DataFrame:
        return lake.table(spark, d, "documents", f"documents_{name}", lambda: df, by, order)

    return search_index.of_texts(docs, keep, "key")


def once(df: DataFrame, name: str, by: str | None, order: list[str]) -> DataFrame:
    """A table for one query alone."""
    return staging.table(df, name)


#: Phrases as they are asked for, and as stems.
PHRASES = [(1, '"of the"', ("of", "the")), (2, '"worthless idiots"', ("worthless", "idiot")), (3, '"the worthless ideas"', ("the", "worthless", "idea")), (4, '"permissions are hereby granted"', ("permiss", "ar", "herebi", "grant"))]
PLACES = ", ".join(f"({q}, {len(w)}, {i}, '{x}')" for q, _, w in PHRASES for i, x in enumerate(w))


PHRASE_SQL = f"with {STEMMED}, ask(query_id, width, place, stem) as (values {PLACES}), st as (select query_id, width, doc_id, pos - place as start from ts join ask using (stem) group by all having count(distinct place) = width) select query_id, doc_id, count(*) as tf from st group by 1, 2"


def document_postings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents, their postings as they come from the texts, and the vocabulary with stems."""
    docs = feed.read(spark, d, "documents").where("text <> ''")
    posts = search.postings(docs, "doc_id")
    return docs, posts, lake.table(spark, d, "documents", "documents_words", lambda: search.vocabulary(posts))


@query("fts5_phrases", PHRASE_SQL)
def phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of inflected words in texts without an index: the query is widened to all words of its stems."""
    _, posts, words = document_postings(spark, d)
    return search.phrase_hits(posts, asked(spark, [(q, text) for q, text, _ in PHRASES]), "doc_id", words).groupBy("query_id", "doc_id").agg(F.sum("tf").alias("tf"))


@query("fts5_pair_phrases", PHRASE_SQL)
def pair_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The same by the pairs of their stems, from the laid out index."""
    wanted = once(search_index.asked_stems(asked(spark, [(q, text) for q, text, _ in PHRASES])), "asked", None, [])
    return search_index.phrase_hits(document_index(spark, d), wanted).select("query_id", F.col("key").alias("doc_id"), "tf")


@query("fts6_stemmed_vocabulary", f"select term, {stems.stem_sql('term')} as stem from (select distinct unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as term from documents where text <> '') t")
def stemmed(spark: SparkSession, d: str) -> DataFrame:
    return search.vocabulary(search.postings(feed.read(spark, d, "documents").where("text <> ''"), "doc_id"))


@query("fts7_snippets", oracle(BLOCKS, """
, w as (select block_key, list_filter(regexp_split_to_array(txt, '\\s+'), lambda x: x <> '') as w from bl where list_contains(regexp_extract_all(lower(txt), '[\\p{L}\\p{N}]+'), 'the')),
n as (select block_key, w, list_transform(w, lambda x: regexp_replace(lower(x), '[^\\p{L}\\p{N}]', '', 'g')) as low from w),
p as (select *, coalesce(list_min(list_transform(list_filter(range(len(low)), lambda i: low[i + 1] in ('the', 'of')), lambda i: (2 - len(list_distinct(list_filter(low[i + 1 : i + 12], lambda x: x in ('the', 'of'))))) * 10000000 + i)), 20000000) % 10000000 as first from n)
select block_key, case when first > 0 then '…' else '' end || array_to_string(list_transform(range(first, least(first + 12, len(w))), lambda i: case when low[i + 1] in ('the', 'of') then '<mark>' || w[i + 1] || '</mark>' else w[i + 1] end), ' ') || case when len(w) > first + 12 then '…' else '' end as snippet from p"""))
def snippets(spark: SparkSession, d: str) -> DataFrame:
    b = chat_blocks(spark, d).where(F.array_contains(search.tokens(F.col("text")), "the"))
    return b.select("block_key", search.snippet(F.col("text"), F.array(F.lit("the"), F.lit("of"))).alias("snippet"))


@query("flt10_indexed_blocks", oracle(BLOCKS, "select block_key, length(txt)::bigint as n_chars from bl"))
def indexed(spark: SparkSession, d: str) -> DataFrame:
    return chat_blocks(spark, d).select("block_key", F.char_length("text").cast("long").alias("n_chars"))


@query("jn1_block_chain", oracle(BLOCKS, "select block_key, session_uuid, project_slug, source, uuid from bl"))
def chain(spark: SparkSession, d: str) -> DataFrame:
    return chat_blocks(spark, d).select("block_key", "session_uuid", "project_slug", "source", "uuid")


@query("set3_source_sets", oracle(BLOCKS, "select query_id, source, count(*) as n from h where source in ('agents', 'chat') group by 1, 2"))
def source_sets(spark: SparkSession, d: str) -> DataFrame:
    return search.in_sources(found(spark, d), ["chat", "agents"]).groupBy("query_id", "source").agg(F.count("*").alias("n"))


@query("agg8_page_and_total", oracle(BLOCKS, "select query_id, block_key, place, total from (select *, row_number() over (partition by query_id order by rank, block_key) as place, count(*) over (partition by query_id) as total from hits) x where place <= 3"))
def page_and_total(spark: SparkSession, d: str) -> DataFrame:
    hits = found(spark, d)
    return search.top(hits, 3).join(search.totals(hits), "query_id").select("query_id", "block_key", F.col("place").cast("long").alias("place"), "total")


@query("win4_best_of_page", oracle(BLOCKS, """
, p as (select * from (select *, row_number() over (partition by query_id order by rank, block_key) as place from h) x where place <= 25)
select query_id, session_uuid, block_key, place from p qualify row_number() over (partition by query_id, session_uuid order by place) = 1"""))
def best_of_page(spark: SparkSession, d: str) -> DataFrame:
    return search.best_of_page(found(spark, d), 25).select("query_id", "session_uuid", "block_key", F.col("place").cast("long").alias("place"))


QUERY_TEXT = "case doc_id % 4 when 0 then text when 1 then '\"' || text when 2 then replace(text, ' ', '_') else '' end"


@query("fn9_sanitised_queries", f"""
with q as (select doc_id, {QUERY_TEXT} as q from documents where text is not null), p as (select doc_id, string_split(q, '\"') as parts from q),
k as (select doc_id, unnest(range(len(parts))) as i, unnest(parts) as x, len(parts) % 2 = 1 as balanced from p),
f as (select doc_id, case when balanced and i % 2 = 1 then (len(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}]+')) > 0)::int else len(list_filter(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}]'))) end as n, len(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}]+')) as tokens from k)
select doc_id, sum(n)::bigint as phrases, sum(tokens)::bigint as tokens from f group by 1""")
def sanitised(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as queries, with quotation marks that do not pair up and words joined by underscores among them."""
    docs = feed.read(spark, d, "documents").where("text is not null").select("doc_id", F.expr(QUERY_TEXT).alias("q"))
    asked_ = docs.select("doc_id", fn.query_terms(F.col("q")).alias("p"))
    return asked_.select("doc_id", F.size("p").cast("long").alias("phrases"), F.aggregate("p", F.lit(0), lambda s, x: s + F.size(x)).cast("long").alias("tokens"))


@query("fts8_best_per_session", oracle(BLOCKS, "select query_id, session_uuid, arg_min(block_key, (rank, block_key)) as block_key, min(rank) as rank, nullif(arg_min(agent_hex, (rank, block_key)), '') as agent_hex, arg_min(uuid, (rank, block_key)) as uuid from h group by 1, 2"))
def best(spark: SparkSession, d: str) -> DataFrame:
    return search.best_per_session(found(spark, d)).select("query_id", "session_uuid", "block_key", "rank", F.nullif("agent_hex", F.lit("")).alias("agent_hex"), "uuid")


@query("fts9_matching_sessions", oracle(BLOCKS, "select distinct query_id, session_uuid from h"))
def matching(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d).select("query_id", "session_uuid").distinct()


@query("agg9_session_totals", oracle(BLOCKS, "select query_id, count(*) as hits, count(distinct session_uuid) as sessions from h group by 1"))
def totals(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d).groupBy("query_id").agg(F.count("*").alias("hits"), F.countDistinct("session_uuid").alias("sessions"))


@query("srt2_search_page", oracle(BLOCKS, "select query_id, block_key, rank, place from (select *, row_number() over (partition by query_id order by rank, block_key) as place from hits) x where place > 2 and place <= 12"))
def search_page(spark: SparkSession, d: str) -> DataFrame:
    return search.top(found(spark, d), 10, 2).select("query_id", "block_key", "rank", F.col("place").cast("long").alias("place"))


@query("win3_grouped_hits", oracle(BLOCKS, """
, p as (select * from (select *, row_number() over (partition by query_id order by rank, block_key) as place from h) x where place <= 50)
select query_id, session_uuid, block_key, place, in_group, group_hits > 5 as has_more from (select *, row_number() over (partition by query_id, session_uuid order by place) as in_group, count(*) over (partition by query_id, session_uuid) as group_hits from p) y where in_group <= 5"""))
def grouped(spark: SparkSession, d: str) -> DataFrame:
    return search.grouped_page(found(spark, d), 50).select("query_id", "session_uuid", "block_key", F.col("place").cast("long").alias("place"), F.col("in_group").cast("long").alias("in_group"), "has_more")


@query("flt9_source_buckets", oracle(BLOCKS, "select source, count(*) as n from bl group by 1"))
def buckets(spark: SparkSession, d: str) -> DataFrame:
    return chat_blocks(spark, d).groupBy("source").agg(F.count("*").alias("n"))


@query("fts10_chat_search", oracle(BLOCKS, "select query_id, block_key, rank from h where source = 'chat' and project_slug in ('-Users-x-p1', '-Users-x-p2')"))
def chat_search(spark: SparkSession, d: str) -> DataFrame:
    from quillhouse.operators.sessions import in_projects

    return in_projects(search.in_sources(found(spark, d), ["chat"]), ["-Users-x-p1", "-Users-x-p2"]).select("query_id", "block_key", "rank")


@query("fts_search_sessions", oracle(BLOCKS, "select query_id, session_uuid, arg_min(block_key, (rank, block_key)) as block_key, min(rank) as rank from h where source = 'chat' group by 1, 2"))
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Ranked session search over the chat bucket: parse, classify, index, rank, best hit of each session."""
    return search.best_per_session(search.in_sources(found(spark, d), ["chat"])).select("query_id", "session_uuid", "block_key", "rank")


DOCUMENT_HITS = f"""with {STEMMED}, ask(query_id, stem) as (values (1, 'licens'), (2, 'worthless'), (3, 'idiot'), (3, 'the'), (4, 'the'), (4, 'of')),
  tf as (select query_id, stem, doc_id, count(*) as tf from ts join ask using (stem) group by all), pd as (select query_id, stem, count(*) as df from tf group by all),
  s as (select query_id, doc_id, round(-sum({BM25}), 4) + 0.0::double as rank, count(*) as got from tf join pd using (query_id, stem) join ln using (doc_id), tot group by query_id, doc_id),
  hits as (select query_id, doc_id, rank from s where got = (select count(*) from ask where ask.query_id = s.query_id))"""
IN_DOCUMENTS = [(1, "licenses"), (2, "worthless"), (3, "idiots the"), (4, "the of")]


@query("fts11_document_search", f"{DOCUMENT_HITS} select query_id, doc_id, rank from hits")
def documents(spark: SparkSession, d: str) -> DataFrame:
    """All hits of a few queries in texts without an index."""
    docs, posts, words = document_postings(spark, d)
    hits = search.search(asked(spark, IN_DOCUMENTS), posts, docs, search.statistics(posts, docs, "doc_id"), "doc_id", words)
    return hits.select("query_id", "doc_id", (F.col("rank") + F.lit(0.0)).alias("rank"))


@query("fts11_index_search", f"{DOCUMENT_HITS} select query_id, doc_id, rank from hits")
def index_search(spark: SparkSession, d: str) -> DataFrame:
    """The same from the laid out index: a scan reads the buckets of their stems."""
    return search_index.search_all(document_index(spark, d), asked(spark, IN_DOCUMENTS), once).select("query_id", F.col("key").alias("doc_id"), "rank")


@query("fts4_top_pages", f"{DOCUMENT_HITS} select query_id, doc_id, rank, row_number() over (partition by query_id order by rank, doc_id) as place from hits qualify place <= 10")
def top_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first page of the same queries, without reading cells that cannot reach it."""
    top = search_index.search_top(document_index(spark, d), asked(spark, IN_DOCUMENTS), 10, once)
    return top.select("query_id", F.col("key").alias("doc_id"), "rank", F.col("place").cast("long").alias("place"))


#: Characters of a long word.
LONG = 8


@query("fts11_query_batch", f"""with {STEMMED},
  tw as (select distinct doc_id, term from tk), pick as (select doc_id, term from tw qualify row_number() over (partition by doc_id order by length(term) desc, encode(term)) <= 2),
  ask as (select distinct p.doc_id as query_id, p.term as word, stem from pick p join vo using (term)),
  need as (select query_id, list_sort(list(word)) as words, count(*) as need from ask group by 1), sets as (select words, min(query_id) as set_id, any_value(need) as need from need group by 1),
  one as (select set_id, word, stem from ask join sets on ask.query_id = sets.set_id),
  pt as (select stem, doc_id, count(*) as tf from ts where stem in (select stem from one) group by all), pd as (select stem, count(*) as df from pt group by 1),
  s as (select set_id, doc_id, round(-sum({BM25}), 4) + 0.0::double as rank, count(*) as got from one join pt using (stem) join pd using (stem) join ln using (doc_id), tot group by 1, 2),
  best as (select s.set_id, count(*) as hits, min(rank) as rank from s join sets using (set_id) where got = need group by 1)
select query_id, hits, rank from need join sets using (words) join best using (set_id)""")
def query_batch(spark: SparkSession, d: str) -> DataFrame:
    """A query for each document, its two longest words: how many documents have both, and the best rank. Documents that ask for the same are answered once."""
    docs = feed.read(spark, d, "documents").where("text <> ''")
    longest = F.expr("transform(slice(sort_array(transform(w, x -> struct(-char_length(x) as n, x as x))), 1, 2), y -> y.x)")
    words = docs.select("doc_id", search.tokens(F.col("text")).alias("w"))
    # Most texts have two words that are so long that the others need no sorting.
    words = words.select("doc_id", "w", F.array_distinct(F.filter("w", lambda x: F.char_length(x) >= LONG)).alias("long"))
    words = words.select("doc_id", F.when(F.size("long") > 1, F.col("long")).otherwise(F.array_distinct("w")).alias("w"))
    words = words.select(F.col("doc_id").alias("asker"), F.array_sort(longest).alias("words"))
    asked_ = once(words, "askers", None, []).where(F.size("words") > 0)
    sets = asked_.groupBy("words").agg(F.min("asker").alias("query_id"))
    best = search_index.best_of_batch(document_index(spark, d), sets.select("query_id", F.transform("words", lambda x: F.array(x)).alias("phrases")), once)
    return asked_.join(sets.join(best, "query_id"), "words").select(F.col("asker").alias("query_id"), "hits", "rank")


@query("fn8_snippet_segments", oracle("", "select uuid, len(list_filter(string_split(replace(text, 'the', '<mark>the<mark>'), '<mark>'), lambda x: x <> ''))::bigint as n_parts from turns where contains(text, 'the')"))
def segments(spark: SparkSession, d: str) -> DataFrame:
    t = feed.turns(spark, d).where(F.contains("text", F.lit("the")))
    marked = F.regexp_replace("text", "the", "<mark>the</mark>")
    return t.select("uuid", F.size(fn.snippet_segments(marked)).cast("long").alias("n_parts"))


@query("fn7_clean_snippets", oracle("", r"select uuid, trim(regexp_replace(text, '\s+', ' ', 'g')) as snippet from turns"))
def clean(spark: SparkSession, d: str) -> DataFrame:
    return feed.turns(spark, d).select("uuid", fn.clean_snippet(F.concat(F.lit("<mark>"), F.col("text"), F.lit("</mark>"))).alias("snippet"))
