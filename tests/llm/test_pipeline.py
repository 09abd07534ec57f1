"""The stages one after the other on a small corpus, each against what its predecessor kept."""

import random

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n)).capitalize() + "."


def test_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    r = random.Random(1)
    clean = {i: "\n".join(sentence(r, 14) for _ in range(8)) for i in range(40)}
    passage = " ".join(sentence(r, 20) for _ in range(3))
    docs = dict(clean)
    docs[100] = clean[3]  # exact copy
    near = clean[4].replace("\n", " ").split(" ")
    docs[40] = " ".join(near)
    docs[101] = " ".join([*near[:50], "changed", *near[51:]])  # near copy of 40; as single lines both are new
    docs[102] = sentence(r, 60) + " " + passage + " " + sentence(r, 60)
    docs[103] = sentence(r, 60) + " " + passage + " " + sentence(r, 60)
    docs[104] = "too short"
    docs[105] = "\n".join(x.upper().replace(" ", "!! ") for x in (sentence(r, 14) for _ in range(8)))
    docs[106] = None
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {x.doc_id: x for x in now.collect()}
        if k < 4:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"] and now.where(F.char_length("text") != F.col("n_chars")).count() == 0
        assert set(clean) <= set(seen[name]) or name == "best_fit_packing"
    assert not {104, 105, 106} & set(seen["quality_rules"])
    assert 100 in seen["quality_rules"] and 100 not in seen["line_dedup"]
    assert {40, 101} <= set(seen["line_dedup"]) and not {40, 101} & set(seen["ngram_jaccard_join"])  # both follow 4, in other lines
    texts = {d: x.text for d, x in seen["suffix_array_dedup"].items()}
    assert passage in texts[102] and passage[20:-20] not in texts[103] and all(texts[d] == clean[d] for d in clean if d != 4)
    packed = now.collect()
    assert {x.doc_id for x in packed} == set(texts)
    total = sum(x.length for x in packed)
    assert len({x.sequence_id for x in packed}) <= -(-total // pipeline.SEQUENCE_TOKENS) + 1
    assert sorted(map(tuple, pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length").collect())) == sorted((x.doc_id, x.piece, x.start, x.length) for x in packed)


def test_each_stage_on_odd_tables(spark, tmp_path):
    """Empty tables, nulls, ids that repeat with other texts, and columns that the operators use themselves."""
    import corpus_pipeline as pipeline

    r = random.Random(2)
    whole = ["\n".join(sentence(r, 14) for _ in range(8)) for _ in range(4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, quality string, key int, kept string, sides int, lines string"
    extra = (0, "q", 1, "k", 2, "l")
    rows = [(1, whole[0], "en", "s", *extra), (1, whole[1], "de", "s", *extra), (2, whole[2], "en", None, *extra), (2, whole[0], "fr", "t", *extra), (3, whole[3], None, "s", *extra), (3, whole[3], None, "s", *extra), (4, None, "en", "s", *extra), (5, "", "en", "s", *extra), (None, whole[3], "en", "s", *extra)]
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
        got = stage(spark, docs if name == "quality_rules" else docs.where("doc_id is not null"), str(tmp_path))
        if name == "best_fit_packing":
            assert {x.doc_id for x in got.collect()} == {1, 2, 3, 4, 5}
            continue
        assert got.columns == pipeline.COLUMNS
        seen = sorted((x.doc_id, x.text, x.lang, x.source) for x in got.collect() if x.doc_id < 3)
        first = [(1, whole[0], "en", "s"), (1, whole[1], "de", "s")]
        second = [(2, whole[0], "fr", "t"), (2, whole[2], "en", None)]
        # Of the second id, lines and long strings that the first one has go; the join takes an id for one document, which is linked with the first.
        left = {"quality_rules": second, "ngram_jaccard_join": []}.get(name, second[1:])
        assert seen == sorted(first + left, key=lambda x: x[:2]), name
        assert sum(x.doc_id == 3 for x in got.collect()) == 2
