"""Full-text search: postings with positions, BM25 over the whole index, phrases, snippets, grouping by session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillhouse.functions.stems import stem
from quillhouse.operators import word_lists
from quillhouse.operators.authorship import DIALOGUE_KINDS

#: Fixed values of the ranking function; the idf of a term in more than half of all blocks.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Rows of queries, or of their words, that are broadcast.
MOST_BROADCAST = 100_000
SNIPPET_TOKENS, GROUP_HITS = 12, 5
SOURCES = ("chat", "agents", "system")
_TOKEN = r"([\p{L}\p{N}]+)"


def indexed(blocks: DataFrame) -> DataFrame:
    """What the index holds: text blocks that are not empty."""
    return blocks.where("kind = 'text' and text is not null and text <> ''")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(1))


def postings(blocks: DataFrame, key: str = "block_key") -> DataFrame:
    """``(key, term, pos)`` of every token. A rebuild and adding new blocks' postings give the same rows."""
    return blocks.select(key, F.posexplode(tokens(F.col("text"))).alias("pos", "term"))


def repeated(blocks: DataFrame, key: str = "block_key") -> DataFrame:
    """The keys of several rows; only keys are dealt out for it."""
    return blocks.groupBy(key).count().where("count > 1").select(key)


def term_counts(blocks: DataFrame, again: DataFrame, key: str = "block_key") -> DataFrame:
    """``(key, term, tf, first_pos)``, counted where a text is read; only keys of several rows, ``again`` (``repeated``), are summed up after it."""
    each = word_lists.lists(blocks.select(key, tokens(F.col("text")).alias("words")), "term")
    if again.isEmpty():
        return each
    here = F.broadcast(again) if again.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else again
    same = each[key].eqNullSafe(here[key])
    summed = each.join(here, same, "left_semi").groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.min("first_pos").alias("first_pos"))
    return each.join(here, same, "left_anti").unionByName(summed)


def statistics(posts: DataFrame, blocks: DataFrame, key: str = "block_key") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Document lengths, document frequencies and totals of the whole index, whatever is searched later."""
    lengths = posts.groupBy(key).agg(F.count("*").alias("length"))
    df = posts.groupBy("term").agg(F.countDistinct(key).alias("df"))
    total = blocks.select(key).join(lengths, key, "left").agg(F.count("*").alias("n"), (F.coalesce(F.sum("length"), F.lit(0)) / F.count("*")).alias("avg_length"))
    return lengths, df, total


def deindex(posts: DataFrame, gone: DataFrame, key: str = "block_key") -> DataFrame:
    return posts.join(gone.select(key).distinct(), key, "left_anti")


def vocabulary(posts: DataFrame) -> DataFrame:
    """``(term, stem)`` of the index: the work follows the number of different terms and not the corpus."""
    return posts.select("term").distinct().withColumn("stem", stem(F.col("term")))


def sized(rows: DataFrame, most: int | None = None) -> DataFrame:
    """``rows`` to be broadcast if there are at most ``most``, which is counted; else to be joined as they are."""
    most = MOST_BROADCAST if most is None else most
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def phrase_hits(posts: DataFrame, queries: DataFrame, key: str = "block_key", words: DataFrame | None = None) -> DataFrame:
    """``(query_id, phrase, key, tf)``: how often each phrase of each query stands in a block, its tokens side by side.

    ``queries`` has ``query_id`` and ``phrases``, an array of arrays of terms; where its terms are few, which is counted,
    postings are cut down to them before anything is shuffled. A phrase's tokens meet where position less place in
    the phrase agree. With ``words``, the index's ``vocabulary``, a term stands for all words of its stem: the query is
    widened to them, so postings stay as they are and none is joined with the vocabulary.
    """
    asked = queries.select("query_id", F.posexplode("phrases").alias("phrase", "terms")).select("query_id", "phrase", F.size("terms").alias("width"), F.posexplode("terms").alias("place", "term"))
    if words is not None:
        asked = words.join(sized(asked.withColumn("stem", stem(F.col("term"))).drop("term")), "stem").drop("stem")
    met = posts.join(sized(asked), "term").groupBy("query_id", "phrase", "width", key, (F.col("pos") - F.col("place")).alias("start")).agg(F.countDistinct("place").alias("got"))
    return met.where("got = width").groupBy("query_id", "phrase", key).agg(F.count("*").alias("tf"))


def search(queries: DataFrame, posts: DataFrame, blocks: DataFrame, stats: tuple[DataFrame, DataFrame, DataFrame], key: str = "block_key", words: DataFrame | None = None) -> DataFrame:
    """``(query_id, key, rank)`` of blocks that hold every phrase of a query; the lower the rank, the better.

    Rank is BM25 negated, each phrase counting as one term with its own document frequency over the whole index; sums
    are rounded to four places. A query that asks for nothing has no hits. With ``words`` it is words of one stem that meet.
    """
    lengths, _, total = stats
    hits = phrase_hits(posts, queries, key, words)
    phrase_df = hits.groupBy("query_id", "phrase").agg(F.count("*").alias("df"))
    n, avg = F.col("n").cast("double"), F.col("avg_length").cast("double")
    idf = F.log((n - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    weight = idf * F.col("tf") * F.lit(K1 + 1.0) / (F.col("tf") + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("length") / avg))
    few = queries.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    scored = hits.join(F.broadcast(phrase_df) if few else phrase_df, ["query_id", "phrase"]).join(lengths, key).crossJoin(F.broadcast(total)).withColumn("w", weight)
    summed = scored.groupBy("query_id", key).agg(F.round(-F.sum("w"), 4).alias("rank"), F.count("*").alias("got"))
    need = queries.select("query_id", F.size("phrases").alias("need"))
    return summed.join(F.broadcast(need) if few else need, "query_id").where("got = need and need > 0").select("query_id", key, "rank")


def top(hits: DataFrame, limit: int, offset: int = 0, key: str = "block_key") -> DataFrame:
    """A page of each query's hits by rank, ties by key, numbered from 1."""
    w = Window.partitionBy("query_id").orderBy("rank", key)
    return hits.withColumn("place", F.row_number().over(w)).where((F.col("place") > offset) & (F.col("place") <= offset + limit))


def best_of_page(hits: DataFrame, limit: int, offset: int = 0, key: str = "block_key") -> DataFrame:
    """One row for each session among a page of hits, its best hit of the page, in the order of the page."""
    paged = top(hits, limit, offset, key)
    w = Window.partitionBy("query_id", "session_uuid").orderBy("place")
    return paged.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def totals(hits: DataFrame) -> DataFrame:
    """``(query_id, total, sessions)`` of all hits of a query, whatever page is shown."""
    return hits.groupBy("query_id").agg(F.count("*").alias("total"), F.countDistinct("session_uuid").alias("sessions"))


def best_per_session(hits: DataFrame, key: str = "block_key") -> DataFrame:
    """The best hit of each session for each query."""
    w = Window.partitionBy("query_id", "session_uuid").orderBy("rank", key)
    return hits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def grouped_page(hits: DataFrame, limit: int, offset: int = 0, cap: int = GROUP_HITS, key: str = "block_key") -> DataFrame:
    """A page of hits by session: groups in order of their first hit, at most ``cap`` hits each, ``has_more`` beyond."""
    paged = top(hits, limit, offset, key)
    group = Window.partitionBy("query_id", "session_uuid")
    out = paged.withColumns({"in_group": F.row_number().over(group.orderBy("place")), "group_place": F.min("place").over(group), "group_hits": F.count("*").over(group)})
    return out.where(F.col("in_group") <= cap).withColumn("has_more", F.col("group_hits") > cap)


def source_bucket(author: Column, kind: Column) -> Column:
    """Which of three sources a block belongs to: ``agents`` for subagent transcripts, ``chat`` for the dialogue of a person and the assistant, else ``system``."""
    return F.when(kind == "subagent", "agents").when(author.isin(*DIALOGUE_KINDS), "chat").otherwise("system")


def in_sources(rows: DataFrame, sources: list[str] | None) -> DataFrame:
    """Rows of the given sources; none given leaves all, an empty list none; an unknown one is an error."""
    if sources is None:
        return rows
    if set(sources) - set(SOURCES):
        raise ValueError(f"unknown sources {sorted(set(sources) - set(SOURCES))}")
    return rows.where(F.col("source").isin(*sources) if sources else F.lit(False))


def snippet(text: Column, terms: Column, width: int = SNIPPET_TOKENS) -> Column:
    """The earliest window of ``width`` words with the most different terms, hits in ``<mark>``, ``…`` where it is cut.

    ``terms`` are words as they stand in the index, all forms of a stem among them.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def within(words_: Column) -> Column:
        norm = F.transform(words_, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", ""))
        return F.get(F.transform(F.array(norm), lambda low: chosen(words_, low)), F.lit(0))

    def chosen(words_: Column, low: Column) -> Column:
        places = F.filter(F.transform(low, lambda w, i: F.when(F.array_contains(terms, w), i)), lambda i: i.isNotNull())
        starts = F.transform(places, lambda i: F.struct((-F.size(F.array_intersect(F.slice(low, i + 1, width), terms))).alias("n"), i.alias("i")))
        at = F.coalesce(F.array_min(starts)["i"], F.lit(0))
        shown = F.transform(F.slice(words_, at + 1, width), lambda w: F.when(F.array_contains(terms, F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "")), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w))
        return F.concat(F.when(at > 0, F.lit("…")).otherwise(""), F.array_join(shown, " "), F.when(F.size(words_) > at + width, F.lit("…")).otherwise(""))

    return F.get(F.transform(F.array(words), within), F.lit(0))
