"""Operator 12, BPE over contiguous rank arrays: the parts of a short word and the ranks of neighbouring parts lie side by side; the least rank is looked for again and again, its boundary goes, and the ranks beside it are refreshed."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillhouse.llm.common import blocks

#: Words of more bytes hold their pairs in a heap, since each scan of an array is as long as the word.
SHORT = 256
#: Parts, over all words, that are merged at a time.
CELLS = 1 << 18
#: Words whose ids a worker remembers, and the longest that it keeps beyond a block.
CACHE, CACHE_CHARS = 300_000, 40
#: Fixed value: the pre-tokens of the byte-level scheme.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.iinfo(np.int32).max


def byte_characters() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: itself where it can be seen, else one from U+0100 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in seen else next(others)) for b in range(256)]


class Vocabulary:
    """Merges, bytes and added tokens of a byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
        byte = {c: b for b, c in enumerate(byte_characters())}
        ids: dict[str, int] = got["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in got["added_tokens"]}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in got["added_tokens"]):
            raise ValueError("added tokens that take their surroundings are not supported")
        self.size = max([*ids.values(), *self.added.values()]) + 1
        self.bytes = [b""] * self.size
        for token, i in ids.items():
            self.bytes[i] = bytes(byte[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.array([ids[c] for c in byte_characters()], np.int32)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in got["model"]["merges"]]
        left, right, new = (np.array(x, np.int64) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in pairs), strict=True))
        keys, self.rank = np.unique(left * self.size + right, return_index=True)
        self.keys, self.new = np.append(keys, np.iinfo(np.int64).max), np.append(new[self.rank], 0).astype(np.int32)
        self.rank = np.append(self.rank, _NONE).astype(np.int32)
        self.pairs = dict(zip(keys.tolist(), zip(self.rank.tolist(), self.new.tolist())))
        # Longer tokens win where two begin at one place.
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbours, ``_NONE`` where they never merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.new[np.searchsorted(self.keys, left.astype(np.int64) * self.size + right)]

    def short_words(self, words: np.ndarray) -> list[bytes]:
        """Ids of words of one length, given as a matrix of bytes with a row for each.

        Every row is one array of parts beside one of the ranks of neighbours. In a round each row that still has a pair
        finds its least rank, the leftmost of equal ones, joins these two parts, closes the gap, and looks up the pairs
        to the left and to the right of the new part.
        """
        n, width = words.shape
        parts = self.of_byte[words]
        ranks = np.full((n, width), _NONE, np.int32)
        ranks[:, :-1] = self.ranks(parts[:, :-1], parts[:, 1:]).reshape(n, width - 1)
        rows, size, out = np.arange(n), width, [b""] * n
        while len(rows):
            at = ranks[:, :size].argmin(1) if size else np.zeros(0, np.int64)
            k = np.arange(len(rows))
            over = ranks[k, at] == _NONE
            raw, each = parts[over, :size].astype("<i4").tobytes(), 4 * size
            for i, row in enumerate(rows[over].tolist()):
                out[row] = raw[i * each : (i + 1) * each]
            rows, parts, ranks, at = rows[~over], parts[~over, :size], ranks[~over, :size], at[~over]
            if not len(rows):
                break
            k = np.arange(len(rows))
            new = self.merged(parts[k, at], parts[k, at + 1])
            size -= 1
            places = np.arange(size)
            take = places + (places > at[:, None])
            parts = np.take_along_axis(parts, take, 1)
            parts[k, at] = new
            ranks = np.take_along_axis(ranks, take, 1)
            last = at == size - 1
            ranks[k[last], at[last]] = _NONE
            right, left = ~last, at > 0
            ranks[k[right], at[right]] = self.ranks(new[right], parts[k[right], at[right] + 1])
            ranks[k[left], at[left] - 1] = self.ranks(parts[k[left], at[left] - 1], new[left])
        return out

    def long_word(self, word: bytes) -> bytes:
        """The same for a long word: pairs wait in a heap by rank and place, parts know their neighbours."""
        parts = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def add(i: int, j: int) -> None:
            got = self.pairs.get(parts[i] * self.size + parts[j])
            if got:
                heap.append((got[0], i, parts[i], parts[j]))

        for i in range(n - 1):
            add(i, i + 1)
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = self.pairs[a * self.size + b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (got := self.pairs.get(parts[x] * self.size + parts[y])):
                    heapq.heappush(heap, (got[0], x, parts[x], parts[y]))
        return np.array([p for p in parts if p >= 0], "<i4").tobytes()

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit integers; words of one length go through their rounds together."""
        out = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        for size, same in by_size.items():
            step = max(1, CELLS // size)
            for lo in range(0, len(same), step):
                some = same[lo : lo + step]
                raw = [words[i] for i in some]
                got = self.short_words(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, size)) if size <= SHORT else map(self.long_word, raw)
                for i, ids in zip(some, got, strict=True):
                    out[i] = ids
        return out


class Encoder:
    """Ids, as little-endian 32-bit integers, of texts; words met before are remembered."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.vocabulary, self.pattern = Vocabulary(path), regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Added tokens are cut out first; what stands between two of them is split by itself."""
        split = self.vocabulary.split
        cut = [split.split(t) if split and split.search(t) else [t] for t in texts]
        words = [[self.pattern.findall(x) for x in parts[::2]] for parts in cut]
        met = {w for parts in words for x in parts for w in x}
        new = [w for w in met if w not in self.known]
        self.known.update(zip(new, self.vocabulary.words([w.encode() for w in new]), strict=True))
        get, out = self.known.__getitem__, []
        for parts, own in zip(cut, words, strict=True):
            ids = [b"".join(map(get, own[0]))]
            for token, x in zip(parts[1::2], own[1:], strict=True):
                ids += [self.vocabulary.added[token].to_bytes(4, "little"), b"".join(map(get, x))]
            out.append(b"".join(ids))
        if len(self.known) > CACHE:  # what this block has stays
            self.known = {w: self.known[w] for w in met if len(w) <= CACHE_CHARS}
        return out


@lru_cache(2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@lru_cache(2)
def _bytes(path: str) -> list[bytes]:
    return Vocabulary(path).bytes


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` for every row: ``ids`` is an array of integers, as the tokenizers library gives them without special tokens of its own.

    ``path`` is a byte-level BPE file. Its added tokens are recognised where a text holds them. Texts are encoded where
    they are read, whole; nothing is shuffled. Null and empty texts have no ids; ids of documents may be null or repeat,
    every row has its own result; other columns are dropped; an empty table gives none. A word of up to ``SHORT`` bytes
    is merged as a contiguous array; in longer ones a heap finds the least rank, with the same result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for part, *_ in blocks(batches, 2 << 20):
            ids = encoder.encode(part.column(1).to_pylist())
            n = np.array([len(x) // 4 for x in ids], np.int64)
            offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "n_tokens", "ids"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``text``: the bytes of its ids put together and read as UTF-8, broken characters replaced.

    A null ``ids`` gives null, an empty one an empty text; an id outside the vocabulary raises. A column called ``text`` is replaced.
    """
    kept = encoded.drop("text")
    place = kept.columns.index(ids_col)
    schema = StructType([*kept.schema.fields, StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bytes(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                out = [None if x.values is None else b"".join(map(table.__getitem__, x.values.to_numpy(zero_copy_only=False).tolist())).decode("utf-8", "replace") for x in part.column(place)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*part.schema.names, "text"])

    return kept.mapInArrow(run, schema)
