"""Each operator against a brute-force version, on texts with nulls, empty and long ones, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillhouse.llm import bpe, grid_join, licenses, lines, ngram_join, packing, quality, suffix, toxicity, warc
from quillhouse.llm.components import components
from quillhouse.llm.hashing import PerfectHash

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, bytes string, sequence_id string, low int, a int, b int"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) + r.choice(["", "", "", ".", ",\n", "\n"]) for _ in range(n))


def corpus():
    base, other = words(1, 300), words(2, 200)
    texts = [base, base, base.replace("a", "b", 1), other, None, "", " \n\t ", "one", "one", other + "\n" + base[200:420], words(3, 6000), "x" * 3000, "x" * 3000 + " y", "A Line Of Text\nshort\n  a line of text \n", "a line of text\nshort\n\n"]
    edited = base.split(" ")
    for i in range(12):
        new = edited[:]
        for k in range(i):
            new[7 * k + 3] = f"w{i}{k}"
        texts.append(" ".join(new))
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", "s", 0, "q", "b", "s", 1, 2, 3) for d, t in corpus()] + [(None, "no id", "en", "s", 0, "q", "b", "s", 1, 2, 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


TEXTS = dict(corpus())


def test_suffix(docs, nothing):
    expected = suffix.brute_force({d: (t or "").encode() for d, t in TEXTS.items()})
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix.remove_repeats(docs).collect()}
    assert got == expected and sum(x[1] for x in got.values()) > 0
    assert suffix.remove_repeats(nothing).count() == 0
    long = suffix.brute_force({d: (t or "").encode() for d, t in TEXTS.items()}, 120)
    assert {r.doc_id: r.n_removed for r in suffix.remove_repeats(docs, length=120, as_text=True).collect()} == {d: x[1] for d, x in long.items()}


def test_suffix_hot_passage(spark, monkeypatch):
    # A passage that all share with different surroundings goes on to round 2 at once; results do not depend on the way.
    hot = words(9, 12)
    rows = [(i, words(100 + i, 6) + hot + words(500 + i, 6)) for i in range(150)]
    monkeypatch.setattr(suffix, "HOT", 3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == suffix.brute_force({d: t.encode() for d, t in rows})


def test_suffix_repeated_ids(spark):
    # Both rows of an id are one document; each loses what an earlier document has in its own places.
    one, two, three = (words(k, 60) for k in (31, 32, 33))
    rows = [(1, one), (1, one), (2, "x" + two + one), (2, two), (2, three + one + three), (3, two + three)]
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    size = [len(x.encode()) for x in (one, two, three)]
    assert sorted(got) == sorted([(1, size[0], 0), (1, size[0], 0), (2, 1 + size[0] + size[1], size[0]), (2, size[1], 0), (2, size[0] + 2 * size[2], size[0]), (3, size[1] + size[2], size[1] + size[2])])


def test_lines_repeated_ids(spark):
    rows = [(1, "a common line\nshort\nanother common line"), (2, "another common line\nx"), (2, "y\nanother common line\nyet one more line"), (2, "y\nanother common line\nyet one more line")]
    got = sorted((r.doc_id, r.n_dropped, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0, "a common line\nshort\nanother common line"), (2, 1, "x"), (2, 1, "y\nyet one more line"), (2, 1, "y\nyet one more line")]


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("n", "num", "side"), [(3, 90, 256), (1, 50, 256), (3, 30, 256), (5, 80, 3)])
def test_ngram_join(docs, nothing, n, num, side, monkeypatch):
    # With small sides, large groups are dealt twice and then compared in full as far as they do not hang together; fragments are counted apart.
    monkeypatch.setattr(ngram_join, "SIDE", side)
    if side < 256:
        monkeypatch.setattr(ngram_join, "CROWD", side)
        monkeypatch.setattr(ngram_join, "FRAGMENT", 60)
    sets = {d: shingle_set(t, n) for d, t in TEXTS.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, words=n, num=num, den=100).collect()}
    assert got == {d: (len(s), find(d)) for d, s in sets.items()}
    assert ngram_join.near_duplicates(nothing).count() == 0


def test_words_of_one_length_differ():
    # Thue-Morse words and their complements: polynomials modulo a power of two cannot tell them apart.
    ends = ["".join("ab"[(i.bit_count() + k) % 2] for i in range(n)) for n in (8, 9, 200, 1024, 4096) for k in (0, 1)]
    buf = np.frombuffer(" ".join(ends).encode(), np.uint8)
    sets = ngram_join.shingles(buf, np.array([0]), np.array([len(buf)]), 1)
    assert len(sets[0]) == len(ends)
    pad = ngram_join.shingles(np.frombuffer(b"abc abc\0 abc\0\0", np.uint8), np.array([0]), np.array([14]), 1)
    assert len(pad[0]) == 3


@pytest.mark.parametrize("num", [30, 50, 80])
def test_sketches_of_any_width_tie(num):
    r = np.random.default_rng(num)
    large = [r.integers(0, 2**63, int(n), dtype=np.uint64) for n in r.integers(100, 900, 30)]
    small = [x[: max(1, int(len(x) * r.uniform(num / 100 - 0.05, 1)))] for x in large]
    for x, y in zip(large, small, strict=True):
        sides = [(np.array([k]), np.array([len(h)]), [ngram_join.sketch(h)]) for k, h in enumerate((x, y))]
        for left, right in (sides, sides[::-1]):
            if 100 * len(y) >= num * len(x):
                assert len(ngram_join.near_ties(left, right, num, 100)[0])


def test_signatures_meet_at_the_threshold():
    r = np.random.default_rng(3)
    for num in (90, 80):
        schemes = ngram_join._Schemes(num, 100)
        for _ in range(400):
            n = int(r.integers(1, 120))
            a = set(r.integers(0, 2**63, n).tolist())
            b = set(a)
            for x in r.permutation(list(a))[: int(r.integers(0, 1 + n // 5))]:
                b.discard(int(x))
            b |= set(r.integers(0, 2**63, int(r.integers(0, 1 + n // 8))).tolist())
            if b and 100 * len(a & b) >= num * len(a | b):
                x, y = (ngram_join.signatures(np.array(sorted(s), np.uint64), schemes) for s in (a, b))
                assert len(np.intersect1d(x, y)), (num, n, len(a & b), len(a | b))


def test_lines(docs, nothing):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    holders = defaultdict(set)
    for d, t in TEXTS.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(d)
    expected = {}
    for d, t in TEXTS.items():
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (len(holders[key(x)]) >= 2 and min(holders[key(x)]) < d)]
        expected[d] = (len(all_lines), len(all_lines) - len(kept), "\n".join(kept))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(docs).collect()}
    assert got == expected and sum(x[1] for x in got.values()) > 0
    assert lines.dedup_lines(nothing).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    table = PerfectHash.load(PerfectHash.build(keys).dump())
    assert sorted(table.find(keys).tolist()) == list(range(len(keys)))
    assert len(PerfectHash.build(keys[:0]).find(keys[:3])) == 3


def test_lines_whose_first_hashes_agree():
    h1, h2 = np.array([3, 5, 5, 9], np.uint64), np.array([1, 2, 7, 4], np.uint64)
    index = lines.Index(h1, h2, np.array([10, 11, 12, 13]), np.array([2, 3, 4, 5]))
    again = lines.Index.load(index.hash.dump(), index.prints.tobytes(), index.firsts.tobytes(), index.twins.tobytes())
    ask = (np.array([3, 5, 5, 5, 9, 8], np.uint64), np.array([1, 2, 7, 8, 4, 4], np.uint64))
    assert again.earlier(*ask, np.full(6, 99), 0).tolist() == [True, True, True, False, True, False]
    assert again.earlier(*ask, np.full(6, 12), 0).tolist() == [True, True, False, False, False, False]
    assert not len(lines.Index(h1[:0], h2[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)).earlier(*(x[:0] for x in ask), np.zeros(0, np.int64), 0))


def test_bpe(docs, nothing):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    out = bpe.decode(bpe.encode(docs, path, P.PATTERN, chunk=700, overlap=60), path).where("doc_id is not null").collect()
    assert len(out) == len(TEXTS)
    for r in out:
        text = TEXTS[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == encoding.encode_ordinary(text) and r.n_tokens == len(r.ids) // 4
        assert bytes(r.bytes) == text.encode()
    assert bpe.encode(nothing, path, P.PATTERN).count() == 0


def test_bpe_odd_characters(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    r = random.Random(7)
    alphabet = "ab'sre \n\t 　 \x1c\x85é漢字1２.!😀́"
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 900)))) for i in range(60)] + [(60, "漢" * 2500), (60, "漢" * 2500), (61, " " * 2500 + "a")]
    out = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path, P.PATTERN, chunk=200, overlap=40).collect()
    assert Counter((x.doc_id, bytes(x.ids)) for x in out) == Counter((d, np.array(encoding.encode_ordinary(t), "<u4").tobytes()) for d, t in rows)


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = TEXTS | {1001: "a <|endoftext|> b", 1002: "foo<|startoftext|>bar.<|endoftext|>", 1003: "<|ENDOFTEXT|> É<|endoftext|>É"}
    docs = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(d, x) for d, x in texts.items() if d > 1000], "doc_id long, text string"))
    for limit in ({}, {"max_docs": 3}, {"max_cost": 2.0 * 256**2 / 3}):
        capacity = 256 if not limit.get("max_cost") else 200
        out = packing.pack(packing.pieces(docs, path, capacity=capacity, keep_ids=True), capacity=capacity, **limit).where("doc_id is not null").collect()
        by, bins = defaultdict(list), defaultdict(list)
        for r in out:
            by[r.doc_id].append(r)
            bins[r.sequence_id].append(r)
        for d, text in texts.items():
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
            found = sorted(by[d], key=lambda r: r.piece)
            assert [x for r in found for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
            assert all(r.start == r.piece * capacity and r.ids_crc32 == zlib.crc32(r.ids) for r in found)
        for rows in bins.values():
            assert len(rows) <= limit.get("max_docs", capacity) and sum(r.length**2 for r in rows) <= limit.get("max_cost", capacity**2)
    assert packing.pack(packing.pieces(nothing, path)).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_plan(rule):
    r = random.Random(4)
    counts = Counter(r.randint(1, 60) for _ in range(2000))
    steps = packing.plan(counts, 64, 9, 2500.0, rule=rule) if max(counts) ** 2 <= 2500 else packing.plan({k: v for k, v in counts.items() if k <= 50}, 64, 9, 2500.0, rule=rule)
    used, placed = defaultdict(list), Counter()
    for length, lo, hi, first, per, offset in steps:
        for k in range(hi - lo):
            used[first + k // per].append((offset + k % per * length, length))
        placed[length] += hi - lo
    assert placed == Counter({k: v for k, v in counts.items() if k <= 50})
    for items in used.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64 and len(items) <= 9 and sum(x * x for _, x in items) <= 2500
    full = packing.plan(counts, 2048, 2048, 2048.0**2, rule=rule)
    assert max(s[3] + -(-(s[2] - s[1]) // s[4]) for s in full) == -(-sum(k * v for k, v in counts.items()) // 2048)


def test_quality(docs, nothing):
    got = {r.doc_id: r.quality for r in quality.line_first(docs).where("doc_id is not null").collect()}
    for d, t in TEXTS.items():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        with_words = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for i in range(len(w) - 2):
            if seen[(w[i], w[i + 1], w[i + 2])] > 1:
                covered |= {i, i + 1, i + 2}
        q = got[d]
        assert (q.n_words, q.word_chars, q.n_dup_lines, q.n_repeat_words) == (len(w), sum(map(len, w)), len(with_words) - len(set(with_words)), len(covered))
        assert q.base_failed == (len(w) < 50 or 2 * len(covered) > len(w)) and not (q.base_failed and q.kept)
    assert quality.line_first(nothing).count() == 0


def test_quality_lines(spark):
    clean = words(11, 80).replace("\n", " ") + "."
    rows = [(1, clean), (2, clean + "\nHome\nclick here now"), (3, "\n".join(x.upper() + "!!" for x in words(12, 90).replace("\n", " ").split(". "))), (4, " | ".join(words(13, 90).split()))]
    out = {r.doc_id: r for r in quality.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(out) == [1, 2] and out[2].text == clean


@pytest.mark.parametrize("run", [8192, 7])
def test_grid_join(spark, run, monkeypatch):
    # Short intervals: many of one label meet.
    monkeypatch.setattr(grid_join, "RUN", run)
    monkeypatch.setattr(grid_join, "LEAF", min(run, 64))
    r = np.random.default_rng(5)
    centre = r.normal(size=(6, 24))
    rows = [(int(i) + 1, (centre[i % 6] + 0.16 * r.normal(size=24)).tolist(), int(i % 3) if i % 17 else None) for i in range(240)]
    rows += [(1001, None, 1), (1002, [], 1), (1003, [0.0] * 24, 1), (1004, [float("nan")] + [1.0] * 23, 1), (1005, [None] + [1.0] * 23, 1), (1006, [1.0] * 7, 1), (1007, [1.0] * 7, 1), (1008, rows[1][1], rows[1][2]), (1008, rows[1][1], rows[1][2]), (1009, [1e30] * 24, 2), (1010, [1e30] * 24, 2)]
    out = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in grid_join.near_vectors(spark.createDataFrame([*rows, (None, [1.0] * 7, 1)], "vec_id long, embedding array<float>, label int")).collect()}
    good = {i: (np.array(v, np.float32).astype(float), k) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, (v, _) in good.items()}
    links = {i: {j for j in good if j != i and good[i][1] == good[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93} for i in good}
    for i in {x[0] for x in rows}:
        seen, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert out[i] == (len(links.get(i, ())), min(seen), min(seen) == i), i
    assert sum(len(x) for x in links.values()) > 50
    assert grid_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3), (101, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_automaton_against_distances():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    terms = ["idiot", "worthless", "abc", "stem*"]
    automaton = toxicity.Automaton(terms)
    r = random.Random(2)
    for _ in range(3000):
        base = list(r.choice(["idiot", "worthless", "abc", "stem", "stemming"]))
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(base) + 1)
            base[k : k + r.randint(0, 1)] = r.choice(["", "x", "t", "e"])
        word = "".join(base)
        best = min([(distance(word, t), -len(t), t) for t in terms if not t.endswith("*") and distance(word, t) <= toxicity.edits(t)] + ([(0, -5, "stem*")] if word.startswith("stem") else []), default=None)
        assert automaton.match(word) == (None if best is None else (best[2], best[0])), word


def test_toxicity_held_out(spark):
    r = random.Random(6)
    filler = [words(i, 1).strip(".,\n") or "w" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(filler) for _ in range(60)]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(60), r.choice(["scumbag", "wretch", "dimwits"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame([*rows, (None, None), (5000, None), (5001, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and sum(got[i].predicted == int(i % 4 == 0) for i in held) / len(held) > 0.95
    assert 0 <= got[5000].score < 0.5 and got[5000].score == got[5001].score and len(got) == 903


def test_licenses(spark):
    rows = [(1, words(1, 400) + "\n" + licenses.TEMPLATES["MIT-text"].upper() + "\n" + words(2, 300)), (2, "see the license version general public"), (3, None), (4, ""), (5, "Licensed under the Apache License, Version 2.0."), (None, licenses.TEMPLATES["ISC"].replace("hereby ", "")), (6, words(5, 50) + "\nReleased under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.")]
    got = {r.doc_id: (r.license, {f.license for f in r.found}) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] == "MIT-text" and got[2] == (None, set()) and got[3] == got[4] == (None, set())
    assert got[5][0] == "Apache-2.0" and got[None][0] == "ISC" and got[6][1] == {"MIT", "GPL-3.0"}


def test_licenses_name_themselves():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    first = lambda x: next((f[0] for f in scanner.find(x)), None)
    cases = {
        "released under the new license": None, "Released under the Apache License.": None, "GNU General Public License, version 2": None, "Licensed under CC BY 4.0.": "CC-BY-4.0-short", "CC BY-SA 4.0.": None,
        "licensed under CC BY-SA 4.0": "CC-BY-SA-4.0-short", "Licensed under the Apache License, Version 1.1": None, "// SPDX-License-Identifier: Apache-2.0 OR MIT": "Apache-2.0", "The MIT License": "MIT-title",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0", "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "a license, mit or not": None,
    }
    assert {x: first(x) for x in cases} == cases
    for name, text in licenses.TEMPLATES.items():
        assert first(f"before it {text} after it") == name, name


def test_longest_increasing_run():
    r = random.Random(9)
    for _ in range(300):
        n = r.randint(0, 9)
        pairs = list(zip(range(n), r.sample(range(20), n), strict=True))
        best = max((bin(k).count("1") for k in range(1 << n) if (lambda s: all(x[1] < y[1] for x, y in zip(s[:-1], s[1:], strict=True)))([p for i, p in enumerate(pairs) if k >> i & 1])), default=0)
        got = licenses._increasing(pairs)
        assert len(got) == best and set(got) <= set(pairs) and got == sorted(got, key=lambda p: p[1])


def test_warc_entities_and_code(spark):
    html = "a &#233;&#xE9;&eacute; &mdash; &#x1F600; &amp;lt; &#38;gt; &nope; &#0; &#xD800; <scripture>kept</scripture><script>gone</script><p>end<script src=x>never closed <b>x"
    rows = spark.createDataFrame([(1, "u", html, "w", "m")], "page_id long, url string, html string, kind string, block string")
    out = {r.kind: r.block for r in warc.derive(warc.responses(rows)).collect()}
    assert out["conversion"] == "a ééé — 😀 &lt; &gt; &nope; kept\nend"


def test_toxicity_of_nothing_and_long_abuse(spark):
    import time

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "you idiot", 3, "t"), (2, None, 3, "t"), (None, "x", 3, "t")], "doc_id long, text string, score int, toxic string")
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0
    model = toxicity.Model(["idiot", "scumbag"], {}, 0.5)
    text = "you scumbag, he said \"idiot\" and idoit " * 20_000
    began = time.time()
    f = model.features(text)
    assert time.time() - began < 10 and f[5] == 1.0
    small = model.features("he said \"idiot\" today")
    assert small[1] == 0 and small[2] == np.log1p(1) and small[4] == 1.0
    words_ = toxicity.tokens(text[:4000])
    hits = [i for i, w in enumerate(words_) if (m := model.automaton.match(w)) and not m[1]]
    assert model.features(text[:4000])[4] == max(sum(abs(i - j) <= toxicity.WINDOW for j in hits) for i in hits)


def test_patience_alignment_is_increasing():
    r = random.Random(8)
    for _ in range(200):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randint(0, 14))] for _ in range(2))
        m = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m[:-1], m[1:], strict=True))


def test_warc(spark):
    html = "<html><title> A  title</title><script>x<p>y</script><body><p>One &amp; two<br>three <b>four</b></p><!-- gone --><div>five &lt;six&gt;</div></body></html>"
    pages = spark.createDataFrame([(1, "http://a/", html), (1, "http://a/", html), (2, None, None), (None, "u", "")], "page_id long, url string, html string")
    source = warc.responses(pages)
    out = warc.render(warc.derive(source)).collect()
    assert Counter(r.kind for r in out) == {"metadata": 4, "conversion": 4}
    ids = {r.source_id: r.record_id for r in source.collect()}
    one = next(r for r in out if r.source_id == 1 and r.kind == "conversion")
    assert one.block == "A title\nOne & two\nthree four\nfive <six>" and one.refers_to == ids[1]
    assert one.block_digest == "sha256:" + hashlib.sha256(one.block.encode()).hexdigest() and one.content_length == len(one.block.encode())
    assert one.source_payload_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    meta = next(r for r in out if r.source_id == 1 and r.kind == "metadata")
    assert "HTTP/1.1 200 OK\r\n" in meta.block and "title: A title\r\n" in meta.block and f"WARC-Refers-To: {ids[1]}\r\n" in meta.warc
    assert meta.record_id != one.record_id and meta.warc.endswith(meta.block + "\r\n\r\n")
    assert warc.derive(warc.responses(pages.where(F.lit(False)))).count() == 0
