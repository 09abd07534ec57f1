"""Operator 9, vector best-fit packing: pieces of documents into sequences under token, document-count and attention-cost capacities."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillhouse.llm.common import blocks, partitions, table

#: Letter runs whose ids a worker remembers, about 200 bytes each, and the longest word that is taken apart.
CACHE_RUNS, CACHE_BYTES = 1_000_000, 40
#: ASCII punctuation, letters of ASCII and Latin-1, ASCII punctuation: the pre-tokeniser splits such a word just there.
_PLAIN = re.compile(rb"([!-&(-/:-@\[-`{-~]*)((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")


class _Words:
    """Ids, as little-endian 32-bit integers, of words met so far.

    The tokenizer drops white space and lets no token reach over it, so a text's ids are its words' ids. A run of letters
    is one pre-token and has the ids of the same run in lower case: it goes to the merges directly, as the characters
    that stand for its bytes. A word that holds an added token, such as an end mark, goes to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(re.escape(x) for x in added).encode() or rb"(?!)", re.IGNORECASE).search
        self.merge = self.tokenizer.model.tokenize
        self.raw = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        # Byte-level tokenizers write a printable byte of Latin-1 as itself, the others as what follows U+0100.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.parts: dict[bytes, bytes] = {b"": b""}

    def _encode(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4")

    def _part(self, part: bytes) -> bytes:
        if part not in self.parts:
            self.parts[part] = self._encode(part).tobytes()
        return self.parts[part]

    def _letters(self, core: bytes) -> bytes:
        text = core.decode() if core.isascii() else "".join([self.chars[b] for b in core])
        out = self.parts[core] = b"".join([self.raw[t.id] for t in self.merge(text)])
        return out

    def of(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of each word of a block."""
        if len(self.parts) > CACHE_RUNS:
            self.parts = {b"": b""}
        parts, match = self.parts, _PLAIN.fullmatch
        out = {w: p for w in words if (p := parts.get(w)) is not None}
        for w in words - out.keys():
            m = match(w) if len(w) <= CACHE_BYTES and not self.added(w) else None
            if m is None:
                out[w] = self._encode(w).tobytes()
                continue
            lead, core, tail = m.groups()
            core = core.lower() if core.isascii() else core.decode().lower().encode()
            ids = parts.get(core) or self._letters(core)
            out[w] = self._part(lead) + ids + self._part(tail) if lead or tail else ids
        return out


@lru_cache(2)
def _words(path: str) -> _Words:
    return _Words(path)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each text's ids and ``end_id`` after them, cut every ``capacity`` ids.

    For tokenizers that drop ASCII white space, of which no added token has any; added tokens in a text count as such.
    Only texts with more ids are cut. A null or empty text is the single
    ``end_id``. Rows are encoded where they are read; a row with a null id keeps it; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, step = _words(tokenizer_path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for part, buf, starts, ends in blocks(batches, 1 << 22):
            out: tuple[list, ...] = ([], [], [], [], [], [])
            texts = [buf[a:b].tobytes().split() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            ids_of = words.of(set().union(*texts)).__getitem__
            for doc, text in zip(part.column(0).to_pylist(), texts, strict=True):
                ids = b"".join(map(ids_of, text)) + end
                for n, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at : at + step]
                    for column, value in zip(out, (doc, n, at // 4, len(cut) // 4, zlib.crc32(cut), cut), strict=True):
                        column.append(value)
            columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns if keep_ids else columns[:-1], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def plan(counts: dict[int, int], capacity: int, max_docs: int, max_cost: float, weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6), rule: str = "norm") -> list[tuple[int, int, int, int, int, int]]:
    """Vector best fit, longest first, over how many items each length has: rows ``(length, item_from, item_to, bin_from, per_bin, offset)``.

    Items of ``length`` numbered ``item_from`` to ``item_to`` (exclusive) go ``per_bin`` to a bin, from bin ``bin_from``
    on, the first at ``offset``. Bins of equal residual capacities are handled together, so the work depends on how many
    lengths there are and not on how many items. A length's cost is its square. Of the bins that hold one more item
    under all three capacities, ``norm`` takes the one whose weighted residual vector is shortest afterwards, ``dot`` the
    one whose residual has the largest weighted dot product with the item.
    """
    w, out, n_bins = np.array(weights), [], 0
    scale = np.array([capacity, max_docs, max_cost], float)
    states: dict[tuple[int, int, float], list[tuple[int, int]]] = {}
    for length in sorted(counts, reverse=True):
        left, item, cost = counts[length], 0, float(length) ** 2
        if length > capacity or cost > max_cost or max_docs < 1:
            raise ValueError(f"an item of {length} fits no bin")
        need = np.array([length, 1, cost])
        keys = list(states)
        if keys:
            free = np.array(keys, float)
            fits = np.flatnonzero((free >= need).all(1))
            after = (free[fits] - need) / scale
            score = (w * after**2).sum(1) if rule == "norm" else -(w * (free[fits] / scale) * (need / scale)).sum(1)
            order = fits[np.argsort(score, kind="stable")]
        else:
            order = []
        for i in [*order, None]:
            if left <= 0:
                break
            state = keys[i] if i is not None else (capacity, max_docs, float(max_cost))
            k = int(min(state[0] // length, state[1], state[2] // cost))
            spans = states.pop(state) if i is not None else [(n_bins, n_bins + -(-left // k))]
            if i is None:
                n_bins = spans[0][1]
            rest = []
            for lo, hi in spans:
                for per in (k, left % k):  # full ones, then the one that takes what is over
                    m = min(hi - lo, left // per if per == k else 1) if per and left > 0 else 0
                    if m > 0 and (per == k or left < k):
                        out.append((length, item, item + m * per, lo, per, capacity - state[0]))
                        states.setdefault((state[0] - per * length, state[1] - per, state[2] - per * cost), []).append((lo, lo + m))
                        item, left, lo = item + m * per, left - m * per, lo + m
                if lo < hi:
                    rest.append((lo, hi))
            if rest:
                states.setdefault(state, []).extend(rest)
    return out


def pack(items: DataFrame, *, capacity: int = 2048, max_docs: int | None = None, max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6), rule: str = "norm") -> DataFrame:
    """``items`` (with ``doc_id``, ``piece``, ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Only how many items each length has comes to the driver: at most ``capacity`` numbers, whatever the input. The plan
    that comes back has a few rows for each length and is broadcast; its size, too, depends on ``capacity`` alone. An
    item's number among those of its length is its number in its bucket after those of the buckets before, so a length
    that a third of the items share is still numbered by many tasks. Without limits on documents and cost, both default
    to values that no full sequence exceeds. Columns of these names are replaced; an empty input stays empty.
    """
    spark = items.sparkSession
    given = items.drop("sequence_id", "offset")
    n = max(2, partitions(spark))
    base = table(given.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int")), "pieces")
    by = base.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    counts = {r[0]: r[1] for r in by.groupBy("length").agg(F.sum("_n")).collect()}
    steps = plan(counts, capacity, max_docs or capacity, max_cost or float(capacity) ** 2, weights, rule)
    if not steps:
        return base.drop("_bucket").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    before = by.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).select("length", "_bucket", "_before")
    numbered = base.withColumn("_k", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")) - 1)
    numbered = numbered.join(before, ["length", "_bucket"]).withColumn("_k", F.col("_k") + F.col("_before"))
    plans = spark.createDataFrame(steps, "_length long, _from long, _to long, _bin long, _per long, _offset long")
    on = (F.col("length") == F.col("_length")) & (F.col("_k") >= F.col("_from")) & (F.col("_k") < F.col("_to"))
    placed = numbered.join(F.broadcast(plans), on)
    step = F.col("_k") - F.col("_from")
    return placed.select(
        *given.columns,
        (F.col("_bin") + F.floor(step / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(step, F.col("_per")) * F.col("length")).cast("long").alias("offset"),
    )
