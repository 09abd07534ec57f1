"""Words grouped where texts are read, against plain grouping; the index made of texts, with repeated keys."""

import pytest
from pyspark.sql import functions as F

from quillhouse.functions.stems import stem, stem_of
from quillhouse.operators import search, search_index, word_lists
from quillhouse.sources import staging

TEXTS = [(1, "The cats, the CAT's idea"), (2, ""), (3, "running runs ran a a a a"), (4, "漢字 x1 Zoë zoe, of the ideas"), (5, None), (6, "one")]


def keep(df, name, by, order):
    return staging.table(df, name)


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_lists(spark, monkeypatch, most):
    docs = spark.createDataFrame(TEXTS, "key int, text string").coalesce(1)
    words = docs.select("key", search.tokens(F.col("text")).alias("words"))
    monkeypatch.setattr(word_lists, "MOST_WORDS", most)
    got = {of: {tuple(map(str, r)) for r in word_lists.lists(words, of).collect()} for of in ("term", "stem", "both")}
    posts = search.postings(docs, "key")
    assert got["term"] == {tuple(map(str, r)) for r in posts.groupBy("key", "term").agg(F.count("*"), F.min("pos")).collect()}
    tokens = {}
    for r in posts.orderBy("key", "pos").collect():
        tokens.setdefault(r.key, []).append(stem_of(r.term))
    for of, names in (("stem", tokens), ("both", {k: [f"{a} {b}" for a, b in zip(x, x[1:])] for k, x in tokens.items()})):
        assert got[of] == {(str(k), n, str(len(tokens[k])), str([i for i, m in enumerate(x) if m == n])) for k, x in names.items() for n in x}


def test_stems_of_words(spark):
    words = ["yes", "ying", "zoë", "1st", "a" * 65, "relational", "agreed", "hopping", "ß", "controll", "adoption", "skies"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w"))).collect()
    assert {w: stem_of(w) for w in words} == dict(map(tuple, got))


def test_index_of_texts(spark):
    """Nothing is dealt out for the postings and pairs, which are laid out when they are asked for; rows of one key are put together."""
    docs = staging.table(spark.createDataFrame([*TEXTS, (3, "runs the"), (None, "the cats")], "key int, text string").where("text <> ''"), "docs")
    asked = search_index.asked_stems(spark.createDataFrame([(1, [["the"]]), (2, [["run"]]), (3, [["the", "cat"]])], "query_id int, phrases array<array<string>>"))
    made = []

    def noted(df, name, by, order):
        made.append(name)
        return keep(df, name, by, order)

    index = search_index.of_texts(docs, noted, "key")
    got = {tuple(r) for r in search_index.phrase_hits(index, asked.where("width > 1")).select("query_id", "key", "tf").collect()}
    assert got == {(3, 1, 2)} and made == ["repeated_keys", "stem_pairs"] and index.n == 6
    assert {tuple(r) for r in search_index.phrase_hits(index, asked.where("width = 1")).select("query_id", "key", "tf", "length").collect()} == {(1, 1, 2, 6), (1, 3, 1, 9), (1, 4, 1, 7), (2, 3, 3, 9)}
    for of in ("stem", "both"):
        plan = search_index.of_texts(docs.where("key <> 3"), keep, "key")._lists(of)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan


def test_term_counts(spark):
    """Counted where a text is read: only keys of several rows are dealt out."""
    docs = staging.table(spark.createDataFrame([*TEXTS, (3, "runs the"), (None, "a"), (None, "a b")], "doc_id int, text string").where("text <> ''"), "docs")
    again = staging.table(search.repeated(docs, "doc_id"), "again")
    want = sorted(map(str, search.postings(docs, "doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.min("pos").cast("long").alias("first_pos")).collect()))
    assert sorted(map(str, search.term_counts(docs, again, "doc_id").collect())) == want
    plan = search.term_counts(docs, again.limit(0), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
