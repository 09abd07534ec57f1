"""Very long texts, repeated rows, empty tables and clashing columns, where the tests beside the operators leave them out."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillhouse.llm import grid_join, licenses, quality, toxicity, warc


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_warc_of_a_long_page_and_clashing_columns(spark):
    paragraphs = [prose(i, 12) for i in range(30_000)]
    page = "<html><!-- " + "x " * 100_000 + "--><script>" + "if (a < b) {}\n" * 50_000 + "</script><body>" + "".join(f"<p class='q'>{p} &amp; more</p>\n" for p in paragraphs) + "</body></html>"
    assert len(page) > 3 << 20
    names = ["page_id long", "url string", "html string", "kind string", "record_id int", "text string", "digest int", "block int", "r int"]
    rows = [(1, "http://a/", page, "k", 1, "t", 2, 3, 4), (1, "http://a/", page, "k", 1, "t", 2, 3, 4), (2, "http://b/", "<script>never closed " + "y" * (1 << 20), None, None, None, None, None, None)]
    source = warc.responses(spark.createDataFrame(rows, ", ".join(names)))
    out = warc.render(warc.derive(source.withColumns({c: F.lit("other") for c in ("kind", "block", "r", "text", "digest", "warc")}))).collect()
    texts = {(r.source_id, r.block) for r in out if r.kind == "conversion"}
    assert len(out) == 6 and texts == {(1, "\n".join(f"{p} & more" for p in paragraphs)), (2, "")}
    assert all(r.content_length == len(r.block.encode()) and r.warc.endswith(r.block + "\r\n\r\n") for r in out)


def test_licenses_in_long_repeated_and_clashing_rows(spark):
    before, mit = prose(3, 200_000), licenses.TEMPLATES["MIT-text"]
    assert len(before) > 1 << 20
    text = f"{before}\n{mit}\n{prose(4, 100_000)}"
    rows = [(1, text, 7, "x", "y"), (1, text, 7, "x", "y"), (2, before, None, None, None), (None, mit, 0, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, coverage int, license string, found string")
    got = licenses.scan(docs)
    assert got.columns == ["doc_id", "license", "coverage", "first_word", "last_word", "found"]
    out = got.collect()
    ones = [r for r in out if r.doc_id == 1]
    n, size = len(licenses.words_of(before)), len(licenses.words_of(mit))
    assert len(out) == 4 and len(ones) == 2 and ones[0] == ones[1]
    assert (ones[0].license, ones[0].coverage) == ("MIT-text", 1.0) and ones[0].first_word == n and ones[0].last_word - n in (size - 1, size)
    assert {r.doc_id: r.license for r in out} == {1: "MIT-text", 2: None, None: "MIT-text"}
    none = licenses.scan(docs.where(F.lit(False)))
    assert none.columns == got.columns and none.count() == 0


def test_toxicity_of_repeated_long_and_clashing_rows(spark):
    r = random.Random(9)
    filler = prose(1, 300).split()
    rows = [(i, " ".join(r.choice(filler) for _ in range(50)) + (" scumbag and wretch " if i % 3 == 0 else ""), 0.5) for i in range(600)]
    docs = spark.createDataFrame(rows + rows[:90], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _, _ in rows] * 2, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    long = " ".join(r.choice(filler) for _ in range(250_000))
    assert len(long) > 1 << 20
    asked = spark.createDataFrame([*rows, *rows[:90], (7000, long, 1.0), (7001, long + " scumbag and wretch" * 3, 0.0)], "doc_id long, text string, score double")
    scored = toxicity.score(asked, model)
    out = scored.collect()
    by = {}
    for x in out:
        by.setdefault(x.doc_id, []).append((x.score, x.predicted))
    assert scored.columns == ["doc_id", "score", "predicted"] and len(out) == 692
    assert all(len(by[i]) == 2 and by[i][0] == by[i][1] for i in range(90))
    assert sum(by[i][0][1] == int(i % 3 == 0) for i in range(600)) > 570
    assert by[7000][0][1] == 0 and by[7001][0][0] > by[7000][0][0]
    assert toxicity.score(asked.where(F.lit(False)), model).count() == 0


def test_vectors_beside_clashing_columns(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(3, 16))
    rows = [(i, (base[i % 3] + 0.02 * r.normal(size=16)).tolist(), "a", 9, -1, True, "v", [1.0]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, n_links int, component_id long, kept boolean, v string, vector array<double>")
    got = grid_join.near_vectors(vectors)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == [(i, 9, i % 3, i < 3) for i in range(30)]


def test_quality_counts_of_a_long_text(spark):
    r = random.Random(4)
    lines = [prose(i % 900, 15) + r.choice([".", " #", " <b> $5", "", "\t\r"]) for i in range(14_000)]
    text = "\n".join(lines + ["", " ", ""])
    assert len(text) > 1 << 20
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for i in range(len(w) - 2) if windows[(w[i], w[i + 1], w[i + 2])] > 1 for k in (i, i + 1, i + 2)}
    seen = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    docs = spark.createDataFrame([(1, text, 3), (1, text, 4), (2, "#*$%&|<>!", None)], "doc_id long, text string, n_words int")
    out = quality.line_first(docs).collect()
    for q in (x.quality for x in out if x.doc_id == 1):
        assert (q.n_words, q.word_chars, q.n_dup_lines, q.n_repeat_words) == (len(w), sum(map(len, w)), len(seen) - len(set(seen)), len(covered))
        assert q.n_symbols == len(re.findall(r"[#*$%&|<>]", text)) and q.base_failed == (2 * len(covered) > len(w))
    assert [x.quality.n_symbols for x in out if x.doc_id == 2] == [8] and sorted(x.n_words for x in out if x.doc_id == 1) == [3, 4]
