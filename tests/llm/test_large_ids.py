"""Ids near both ends of 64 bits, with and without repeats: who is the earlier document must not depend on how keys are packed."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillhouse.llm import lines, suffix
from quillhouse.llm.common import numbered, with_keys

TOP, LOW = 2**63 - 1, -(2**63)
IDS = {"large": [5, 2**62 + 1, 2**62 + 3], "ends": [LOW, LOW + 1, -7, 0, 5, 2**62 + 1, 5 + 2**61, TOP - 1, TOP], "small": [-3, -2, 1, 4]}


def sentence(r, n=12):
    return " ".join("".join(r.choice("abcdefghijkl") for _ in range(r.randint(3, 8))) for _ in range(n))


def rows_of(ids, repeated, seed):
    r = random.Random(seed)
    shared = [sentence(r) for _ in range(4)]
    rows = [(i, "\n".join([sentence(r), *r.sample(shared, 3), sentence(r)])) for i in ids]
    if repeated:
        rows += [(ids[1], rows[1][1]), (7, sentence(r) + "\n" + shared[0]), (7, sentence(r)), (7, sentence(r) + "\n" + shared[1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("which", sorted(IDS))
def test_lines(spark, which, repeated):
    rows = rows_of(IDS[which], repeated, 1)
    first = {}
    for d, t in sorted(rows):
        for x in t.split("\n"):
            first.setdefault(x, d)
    expected = sorted((d, "\n".join(x for x in t.split("\n") if first[x] >= d)) for d, t in rows)
    got = sorted((x.doc_id, x.text) for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == expected


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("which", sorted(IDS))
def test_suffix(spark, which, repeated):
    rows = rows_of(IDS[which], repeated, 2)
    first = {}
    for d, t in sorted(rows):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    expected = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        expected.append((d, sum(gone), hashlib.sha256("".join(x for x, g in zip(t, gone, strict=True) if not g).encode()).hexdigest()))
    got = [(x.doc_id, x.n_removed, hashlib.sha256(x.kept).hexdigest()) for x in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got) == sorted(expected) and any(x[1] for x in expected)


def test_twins_of_negative_ids():
    import numpy as np

    one, two, docs = np.array([9, 9], np.uint64), np.array([1, 2], np.uint64), np.array([-5, 3])
    index = lines.Index(one, two, docs, np.array([2, 2]))
    assert index.earlier(one, two, np.array([-4, 3]), 0).tolist() == [True, False]


def test_keys(spark):
    rows = [(5, "a"), (2**62 + 1, "b"), (7, "c"), (7, "d"), (7, "d"), (LOW, "e"), (TOP, "f")]
    got = with_keys(spark.createDataFrame(rows, "doc_id long, text string"))
    keys = sorted((x.doc_id, x.key >> got.shift, x.text) for x in got.rows.collect())
    assert [k for _, k, _ in keys] == [0, 1, 2, 2, 2, 3, 4]
    assert numbered(spark.range(1000).repartition(7), [F.col("id").desc()], "n", "place").where("place <> 999 - id").count() == 0
