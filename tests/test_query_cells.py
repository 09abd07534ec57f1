"""Batches of queries matched in cells, against the search for a few queries: small groups, packs and slices, repeated keys, phrases."""

import random

import pytest
from pyspark.sql import functions as F

from quillhouse.operators import query_cells, search_index, word_lists
from quillhouse.sources import staging

WORDS = ["the", "of", "cat", "cats", "running", "ran", "idea", "ideas", "Zoë", "hereby", "granted", "x1", "漢字"]


def keep(df, name, by, order):
    return staging.table(df, name)


@pytest.fixture(scope="module")
def blocks(spark):
    r = random.Random(4)
    texts = [(r.randrange(90), " ".join(r.choice(WORDS[: r.choice([2, 5, 13])]) for _ in range(r.choice([1, 2, 5, 30])))) for _ in range(120)]
    return staging.table(spark.createDataFrame([*texts, (None, "the cat"), (200, "…")], "key long, text string").repartition(3), "blocks")


@pytest.fixture(scope="module")
def queries(spark):
    r = random.Random(5)
    asked = {tuple(tuple(r.choice([*WORDS, "nowhere"]).lower() for _ in range(r.choice([1, 1, 1, 2]))) for _ in range(r.choice([0, 1, 2, 2, 3]))) for _ in range(60)}
    rows = [(f"q{i}", [list(p) for p in q]) for i, q in enumerate(sorted(asked))]
    return staging.table(spark.createDataFrame(rows, "query_id string, phrases array<array<string>>"), "queries")


def answers(df):
    return {(r.query_id, r.key): r["rank"] + 0.0 for r in df.collect()}


def best(hits):
    out = {}
    for (q, _), rank in hits.items():
        n, low = out.get(q, (0, 0.0))
        out[q] = (n + 1, min(low, rank) if n else rank)
    return out


@pytest.mark.parametrize(("group", "pack", "candidates", "most"), [(1 << 22, 1 << 12, 1 << 21, 1 << 20), (7, 2, 1, 1), (20, 20, 5, 30)])
def test_cells_of_any_size(spark, monkeypatch, blocks, queries, group, pack, candidates, most):
    want = answers(search_index.search_all(search_index.of_texts(blocks, keep, "key"), queries, keep))
    for name, value in (("GROUP", group), ("PACK", pack), ("CANDIDATES", candidates), ("SHARE_WORDS", 200)):
        monkeypatch.setattr(query_cells, name, value)
    monkeypatch.setattr(word_lists, "MOST_WORDS", most)
    index = search_index.of_texts(blocks, keep, "key")
    assert len(want) > 300 and len(best(want)) > 20
    assert answers(search_index.search_batch(index, queries, keep)) == want
    assert {r.query_id: (r.hits, r["rank"] + 0.0) for r in search_index.best_of_batch(index, queries, keep).collect()} == best(want)


def test_only_queries_and_texts_are_dealt(blocks, queries):
    """No list is joined with another or dealt by word: the rows of the rarest lists grow faster than the texts."""
    single = queries.where(F.expr("forall(phrases, p -> size(p) = 1)"))
    made = []

    def noted(df, name, by, order):
        made.append(name)
        return keep(df, name, by, order)

    index = search_index.of_texts(blocks.where("key is not null").dropDuplicates(["key"]), noted, "key")
    plan = search_index.search_batch(index, single, noted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and "Join" not in plan and "Window" not in plan
    assert "stem_postings" not in made and "stem_rows" in made


def test_no_queries_and_no_texts(blocks, queries):
    none = search_index.of_texts(blocks, keep, "key")
    assert search_index.best_of_batch(none, queries.limit(0), keep).count() == 0 and search_index.search_batch(none, queries.limit(0), keep).count() == 0
    empty = search_index.of_texts(blocks.limit(0), keep, "key")
    assert search_index.best_of_batch(empty, queries, keep).count() == 0


def test_rows_of_texts(spark):
    """A row for each text that has words, made where the text is read; rows of one key are put together."""
    texts = [(1, "The cats, the CAT's idea"), (2, ""), (3, "running runs ran"), (4, "漢字"), (5, "one one"), (3, "runs the")]
    docs = staging.table(spark.createDataFrame(texts, "key int, text string").where("text <> ''"), "docs")
    index = search_index.of_texts(docs, keep, "key")
    got = {r.key: (r.length, dict(zip(r.names.split("\n"), r.tf))) for r in index.rows.collect()}
    assert got == {1: (6, {"the": 2, "cat": 2, "s": 1, "idea": 1}), 3: (5, {"run": 3, "ran": 1, "the": 1}), 4: (1, {"漢字": 1}), 5: (2, {"on": 2})}
    assert index.n_postings == 14 and {tuple(r) for r in index.terms.where("df > 1").collect()} == {("the", 2)} and "postings" not in index.__dict__
    plan = word_lists.rows(index.texts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
