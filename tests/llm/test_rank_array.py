"""Operator 12 against the tokenizers library, and its arrays against a plain loop."""

import hashlib
import random

import numpy as np
import pytest

from quillhouse.llm import entries, rank_array

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, ids string, n_tokens string, tokens int"
ALPHABET = [*"abcdeABC    \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 　'''stremvld0123.,;!?é漢字🙂ß́\x00", "<|endoftext|>", "<|endof", "'re"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out.no_truncation()
    out.no_padding()
    return out


def texts():
    r = random.Random(5)
    odd = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 80))) for _ in range(400)]
    letters = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (1, 2, 255, 256, 257, 900, 5000)]
    return [None, "", " ", "\n\n", "<|endoftext|>", " <|endoftext|><|endoftext|> a", "x" * 3000, "=" * 700, "é漢" * 300, *odd, *letters, "word " * 300_000, *odd[:5]]


def test_as_the_library(spark, library, tmp_path):
    rows = [(i % 50 if i % 7 else None, t, "q", "n", 3) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        expected.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = entries.op12_rank_array_bpe(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert entries.op12_rank_array_bpe(spark, f"{tmp_path}/none").count() == 0


def test_arrays_and_heap_agree():
    v, r = rank_array.Vocabulary(P.path("byte_bpe_50k.json")), random.Random(6)

    def plain(word):
        parts = [int(v.of_byte[b]) for b in word]
        while True:
            found = [(v.pairs[k][0], i) for i in range(len(parts) - 1) if (k := parts[i] * v.size + parts[i + 1]) in v.pairs]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [v.pairs[parts[i] * v.size + parts[i + 1]][1]]

    for n in (1, 2, 3, 9, 60):
        words = ["".join(r.choice("abcdeinorst =-") for _ in range(n)).encode() for _ in range(40)] + [b"a" * n, b"=" * n]
        expected = [np.array(plain(w), "<i4").tobytes() for w in words]
        assert v.short_words(np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)) == expected
        assert [v.long_word(w) for w in words] == expected


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(rank_array, "CACHE", 10)
    monkeypatch.setattr(rank_array, "CACHE_CHARS", 4)
    encoder = rank_array.Encoder(P.path("byte_bpe_50k.json"), rank_array.PATTERN)
    some = [t for t in texts() if t][:200]
    for lo in range(0, 200, 20):
        got = [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(some[lo : lo + 20])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in some[lo : lo + 20]]


def test_decode_of_parts(spark):
    v = rank_array.Vocabulary(P.path("byte_bpe_50k.json"))
    broken = [int(v.of_byte[b]) for b in "é".encode()[:1] + b"a"]
    rows = [(1, None, "x"), (2, [], "y"), (3, broken, "z"), (4, [50256], "z")]
    got = rank_array.decode(spark.createDataFrame(rows, "k int, ids array<int>, text string"), P.path("byte_bpe_50k.json"))
    assert got.columns == ["k", "ids", "text"] and {x.k: x.text for x in got.collect()} == {1: None, 2: "", 3: "�a", 4: "<|endoftext|>"}
