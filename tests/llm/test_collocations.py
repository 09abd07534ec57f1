"""Operator 11 against a plain count of all phrases, and the graph's flows and paths against its texts."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quillhouse.llm import collocations
from quillhouse.llm.collocations import EDGE, NODE, WORD

SCHEMA = "doc_id long, text string, lang string, n int, phrase string, a string, score long, kind string"


def pieces(text):
    for p in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
        yield [w for w in re.split("[ \t]+", p) if w]


def counted(docs):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        for w in pieces(text):
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def plain(docs, least=10, inside=50, top=2000):
    f, n = counted(docs)
    out = []
    for lang, c in f.items():
        held = Counter()
        for p, k in c.items():
            if len(p) == 3 and k >= least:
                for q in (p[:2], p[1:]):
                    held[q] = max(held[q], k)
        rows = []
        for p, a in c.items():
            if len(p) > 1 and a >= least and not (len(p) == 2 and 100 * held[p] >= inside * a):
                cuts = [(1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(seed, n=120):
    r = random.Random(seed)
    few = ["of", "The", "the", "a", "b", "é", "漢", "\x00", "\x85", "\xa0", "x\xff", "\U0001f642", "\x1c"]
    rare = [f"w{i}" for i in range(60)]
    passages = [" ".join(r.choice(rare) for _ in range(k)) for k in (2, 3, 4, 7, 25)]
    out = []
    for i in range(n):
        parts = [r.choice(few if r.random() < 0.8 else rare) if r.random() < 0.9 else r.choice(passages) for _ in range(r.choice([0, 1, 2, 3, 40, 90]))]
        out.append(("".join(p + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r", " ; "]) for p in parts), r.choice(["en", "en", "de", None, "und"])))
    return [*out, (None, "en"), ("", "en"), (" \t . , ", "fr"), ("a a a a a a a a a a a a a a", "fr"), ("long word " * 100_000, "es"), *out[:6]]


@pytest.mark.parametrize(("least", "inside", "top", "flush"), [(10, 50, 2000, 2_000_000), (3, 90, 40, 300), (1, 50, 10_000, 5)])
def test_as_the_plain_version(spark, least, inside, top, flush, monkeypatch):
    monkeypatch.setattr(collocations, "FLUSH", flush)
    docs = corpus(1) if flush > 5 else corpus(2, 30)[:-10]
    rows = [(None if i % 9 == 0 else i % 40, t, lang, 1, "p", "a", 5, "k") for i, (t, lang) in enumerate(docs)]
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least=least, inside=inside, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = plain(docs, least, inside, top)
    assert sorted(map(tuple, got.collect())) == expected and expected


def test_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, "en", 1, "p", "a", 5, "k"), (2, " . ", None, 1, "p", "a", 5, "k")], SCHEMA)).count() == 0


def test_counts_come_from_flow(spark):
    docs = corpus(3, 60)[:-8]
    f, _ = counted(docs)
    rows = collocations.graph(spark.createDataFrame([(t, lang) for t, lang in docs], "text string, lang string").repartition(2), least=2, cells=5).collect()
    words = defaultdict(Counter)
    for r in rows:
        c = f[r.lang]
        if r.kind == WORD:
            words[r.lang][r.first,] += r.f
        elif r.kind == NODE:
            assert r.f == c[r.first, r.second]
        else:
            assert r.f == c[r.first, r.second, r.third] and r.node_f == c[r.first, r.second]
    for lang, c in f.items():
        assert words[lang] == Counter({p: k for p, k in c.items() if len(p) == 1})
        for kind, size in ((NODE, 2), (EDGE, 3)):
            assert sum(r.kind == kind and r.lang == lang for r in rows) == sum(len(p) == size and k >= 2 for p, k in c.items())


def test_paths(spark):
    line = [f"p{i}" for i in range(20)]
    edges = [("en", *line[i : i + 3], 12, 12, 12) for i in range(18)] + [("en", "x", "y", "z", 12, 14, 12), ("de", "p0", "p1", "p2", 12, 12, 12)]
    got = collocations.compact(spark.createDataFrame(edges, "lang string, first string, second string, third string, f long, node_f long, to_f long")).collect()
    assert sorted((r.lang, r.first, r.place) for r in got) == sorted([("en", line[i], i) for i in range(18)] + [("de", "p0", 0)])
    assert len({r.path for r in got if r.lang == "en"}) == 1 and len({r.path for r in got}) == 2
    assert collocations.compact(spark.createDataFrame([], "lang string, first string, second string, third string, f long, node_f long, to_f long")).count() == 0
