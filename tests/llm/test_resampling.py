"""Operator 13 against a plain version, its checksums against zlib, and brackets that must be widened."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillhouse.llm import entries, resampling

SCHEMA = "doc_id long, text string, rank string, weight string, n_words int, v int, bucket string"


def feature_list(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return w, [zlib.crc32(x.encode()) % 10_000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def plain(docs, target):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(feature_list(x)[1])
    for x in target:
        t.update(feature_list(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for d, x in docs:
        w, f = feature_list(x)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in f]
        weight = sum(gains) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0], r[1]))
    rank = {id(r): i + 1 for i, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted((*r[:4], rank.get(id(r), 0)) for r in rows)


def texts(n, seed):
    r = random.Random(seed)
    names = ["".join(r.choice("abcdeXYZéß漢09") for _ in range(r.randint(1, 9))) for _ in range(300)]
    out = []
    for _ in range(n):
        out.append("".join(r.choice(names) + r.choice([" ", "  ", "\n", "-", "_", "\x00", "\x7f", ".", "'"]) for _ in range(r.choice([0, 1, 5, 19, 20, 21, 40, 200]))))
    return [*out, None, "", " \n", "x" * 5000 + " " + "é" * 700 + " a", " ".join(f"w{i}" for i in range(60_000)), "A a A a " * 12, "A a A a " * 12]


def write(spark, folder, docs, target):
    spark.createDataFrame([(d, t, "q", "z", 1, 2, "b") for d, t in docs], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_as_the_plain_version(spark, tmp_path, monkeypatch):
    docs = [(i - 3, t) for i, t in enumerate(texts(300, 1))]
    docs += docs[:5] + [(docs[10][0], docs[11][1]), (2**63 - 1, docs[12][1]), (-(2**63), docs[13][1])]
    target = texts(30, 2)
    write(spark, tmp_path, docs, target)
    expected = plain(docs, target)
    got = entries.op13_importance_resampling(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(tuple(x or 0 for x in r) for r in got.collect()) == expected and sum(x[4] > 0 for x in expected) > 20
    # Brackets even for few rows.
    gain = resampling.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    again = resampling.resample(spark.read.parquet(f"{tmp_path}/documents.parquet"), gain, find=lambda *a: resampling.kth_smallest(*a, error=0.05, few=1))
    assert sorted(tuple(x or 0 for x in r) for r in again.collect()) == expected


@pytest.mark.parametrize("docs", [[], [(1, None), (None, "a b " * 30)], [(5, "a b " * 30)] * 9])
def test_small_tables(spark, tmp_path, docs):
    for name, target in (("some", ["a b", None]), ("none", [])):
        write(spark, tmp_path / name, docs, target)
        # Rows without an id are left out of the result, and count in the corpus.
        got = entries.op13_importance_resampling(spark, str(tmp_path / name)).collect()
        assert [x[0] for x in got] == [d for d, _ in docs if d is not None]
        assert sum(x.rank is not None for x in got) == (2 if len(docs) == 9 else 0)


def test_checksums():
    r = random.Random(3)
    raw = [bytes(r.randrange(256) for _ in range(n)) for n in (1, 2, 3, 7, 46, 47, 48, 49, 300)]
    buf, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw])
    assert resampling.crc32_of(buf, np.cumsum(sizes) - sizes, sizes).tolist() == [zlib.crc32(x) for x in raw]
    some = [*texts(20, 4)]
    data = [(t or "").encode() for t in some]
    ends = np.cumsum([len(x) for x in data])
    text, bucket, n = resampling.features(np.frombuffer(b"".join(data), np.uint8), ends - [len(x) for x in data], ends, 10_000)
    for i, t in enumerate(some):
        w, f = feature_list(t)
        assert n[i] == len(w) and sorted(bucket[text == i].tolist()) == sorted(f)


@pytest.mark.parametrize(("kind", "few"), [("id % 7", 1), ("id * 31 % 1009", 50), ("id - 500", 1), ("cast(5 as long)", 1), ("id % 900", 10_000)])
def test_places(spark, kind, few):
    rows = spark.range(2000).selectExpr(f"cast({kind} as long) as x").repartition(4)
    values = sorted(r.x for r in rows.collect())
    for k in (1, 999, 2000):
        got = resampling.kth_smallest(rows, "x", k, error=0.05, few=few)
        assert got.value == values[k - 1] and got.below == sum(v < got.value for v in values)


def test_a_sketch_that_is_off(spark, monkeypatch):
    real = F.percentile_approx
    calls = []

    def off(column, shares, accuracy):
        calls.append(1)
        return F.array(F.lit(0).cast("long"), F.lit(3).cast("long")) if len(calls) == 1 else real(column, shares, accuracy)

    monkeypatch.setattr(resampling.F, "percentile_approx", lambda *a: F.first(off(*a)) if len(calls) == 0 else off(*a))
    got = resampling.kth_smallest(spark.range(2000).selectExpr("id as x"), "x", 1200, error=0.01, few=100)
    assert got.value == 1199 and got.below == 1199 and got.tries > 1
