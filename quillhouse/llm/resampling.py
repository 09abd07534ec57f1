"""Operator 13, importance resampling towards a target: hashed word runs are scored by an array of gains; a quantile sketch brackets the cutoff, exact counts outside validate or widen the bracket, and only the bracket is sorted."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillhouse.llm.common import blocks, numbered, table

#: Gains are kept in thousandths.
SCALE = 1000
#: How far the sketch may be off, as a share of all rows, at first, and rows of a bracket that may be sorted in any case.
ERROR, FEW = 0.002, 10_000
#: Words up to so many bytes have tables by which their checksum is set behind another's.
TABLED = 48
_POLYNOMIAL = 0xEDB88320


@lru_cache(1)
def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, np.uint32(_POLYNOMIAL) ^ (out >> 1), out >> 1).astype(np.uint32)
    return out


@lru_cache(1)
def _shift_tables() -> np.ndarray:
    """``[n, k, b]``: what byte ``k`` of a register with the value ``b`` becomes after ``n`` zero bytes."""
    step = _crc_table()
    out = np.zeros((TABLED + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)
    for n in range(1, TABLED + 1):
        out[n] = step[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


def crc32_of(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, register: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of many spans of ``buf`` at once, a byte of each in a step; ``register`` continues other checksums."""
    step = _crc_table()
    order = np.argsort(-sizes, kind="stable")
    at, size = starts[order], sizes[order]
    crc = (np.full(len(order), 0xFFFFFFFF, np.uint32) if register is None else register[order] ^ np.uint32(0xFFFFFFFF)).astype(np.uint32)
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    for k, n in enumerate(live.tolist()):
        head = crc[:n]
        crc[:n] = step[(head ^ buf[at[:n] + k]) & 255] ^ (head >> 8)
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _after(first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings one behind the other, of both checksums and the second one's size."""
    tables = _shift_tables()
    out = second.copy()
    for k in range(4):
        out ^= tables[sizes, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _bytes_of_words() -> np.ndarray:
    """What each byte counts as: itself in a word, in lower case, and 0 between words."""
    out = np.zeros(256, np.uint8)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        out[b] = b
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    return out


_WORD = _bytes_of_words()


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, bucket, n_words)``: the bucket of each word and of each two words of texts in ``buf``, in no order, and how many words each text has."""
    low = _WORD[buf]
    on = low > 0
    begins = on.copy()
    begins[1:] &= ~on[:-1]
    heads = starts[(starts < len(buf)) & (ends > starts)]
    begins[heads] = on[heads]
    stops = on.copy()
    stops[:-1] &= ~on[1:]
    tails = ends[ends > starts] - 1
    stops[tails] = on[tails]
    at, size = np.flatnonzero(begins), np.flatnonzero(stops) - np.flatnonzero(begins) + 1
    text = np.searchsorted(ends, at, "right")
    one = crc32_of(low, at, size)
    pair = np.flatnonzero(text[1:] == text[:-1])
    two = np.empty(len(pair), np.uint32)
    short = size[pair + 1] <= TABLED - 1
    space = crc32_of(np.full(1, 0x20, np.uint8), np.zeros(1, np.int64), np.ones(1, np.int64))[0]
    p = pair[short]
    n = size[p + 1]
    # A space and the second word, then the first word before them.
    spaced = _after(np.full(len(p), space, np.uint32), one[p + 1], n)
    two[short] = _after(one[p], spaced, n + 1)
    p = pair[~short]
    if len(p):
        begun = _after(one[p], np.full(len(p), space, np.uint32), np.ones(len(p), np.int64))
        two[~short] = crc32_of(low, at[p + 1], size[p + 1], begun)
    bucket = np.concatenate((one, two)) % np.uint32(buckets)
    return np.concatenate((text, text[pair])), bucket.astype(np.int64), np.bincount(text, minlength=len(starts))


def bucket_counts(docs: DataFrame, text_col: str = "text", *, buckets: int = 10_000) -> DataFrame:
    """``(bucket, n)``: features of all texts by bucket. A task sums its own texts first, so what is shuffled is tasks times buckets at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, buf, starts, ends in blocks(batches, column=0):
            total += np.bincount(features(buf, starts, ends, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the logarithm of each bucket's share in the target over its share in the source, one added to each count."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(SCALE * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def fit(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", *, buckets: int = 10_000) -> np.ndarray:
    """The gain of each bucket, from all texts of both tables; ``buckets`` numbers of each reach the driver."""
    counts = []
    for df, col in ((docs, text_col), (target, target_col)):
        out = np.zeros(buckets, np.int64)
        for bucket, n in bucket_counts(df, col, buckets=buckets).collect():
            out[bucket] = n
        counts.append(out)
    return gains(*counts)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_features, weight)``: the floored mean gain of each text's features, 0 without any."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, starts, ends in blocks(batches):
            text, bucket, words = features(buf, starts, ends, len(gain))
            n = np.bincount(text, minlength=len(words))
            # Sums of integers below 2**53 are exact in doubles.
            total = np.bincount(text, gain[bucket], len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Floored thousandths of a Gumbel variate, from the first 32 bits of the SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    u = (h + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log(u))).cast("long")


class Kth(NamedTuple):
    """The value at a place in ascending order, how many rows lie below it, and how many brackets were tried."""

    value: int
    below: int
    tries: int


def kth_smallest(rows: DataFrame, column: str, k: int, *, error: float = ERROR, few: int = FEW) -> Kth:
    """The ``k``-th smallest value (from 1) of an integer column without nulls that has as many rows at least.

    A quantile sketch gives the two values between which the place should lie. One pass counts the rows below the
    bracket and inside it, exactly: if the place is outside, the sketch was off by more than it says, and the bracket is
    widened to twice the error and counted again. Values of a bracket are counted by value, and those counts alone are
    sorted; a bracket with many values is narrowed by a sketch of its own first.
    """
    low = high = None
    tries = 0
    inside, below = rows.select(F.col(column).alias("v")), 0
    n = inside.count()
    if not 1 <= k <= n:
        raise ValueError(f"place {k} of {n} rows")
    while n > few:
        tries += 1
        share, off = (k - below) / n, error
        while True:
            ends = [max(0.0, share - 2 * off), min(1.0, share + 2 * off)]
            low, high = inside.agg(F.percentile_approx("v", F.array(*map(F.lit, ends)), F.lit(math.ceil(1 / error)))).first()[0]
            low, high = (None if ends[0] == 0 else low), (None if ends[1] == 1 else high)
            under = F.lit(False) if low is None else F.col("v") < low
            over = F.lit(False) if high is None else F.col("v") > high
            lower, middle = inside.agg(F.count(F.when(under, 1)), F.count(F.when(~under & ~over, 1))).first()
            if below + lower < k <= below + lower + middle:
                break
            off *= 2
            tries += 1
        inside = inside.where(~under & ~over)
        below += lower
        if middle == n or low == high:
            break
        n = middle
    counts = table(inside.groupBy("v").count(), "bracket")
    place = _place_of(counts, k - below)
    return Kth(place[0], below + place[1], tries)


def _place_of(counts: DataFrame, k: int) -> tuple[int, int]:
    """The value of the ``k``-th row of values with counts, and how many rows lie below it: Spark sorts the values by ranges, the driver sees a sum for each range."""
    ranked = numbered(counts, [F.col("v")], "ranked", "_n")
    sums = ranked.groupBy(F.floor(F.col("_n") / 4096).alias("cell")).agg(F.sum("count").alias("rows")).orderBy("cell")
    before = 0
    for cell, rows in sums.toLocalIterator():
        if before + rows >= k:
            for v, n in ranked.where(F.floor(F.col("_n") / 4096) == cell).orderBy("_n").select("v", "count").toLocalIterator():
                if before + n >= k:
                    return v, before
                before += n
        before += rows
    raise ValueError(f"no row {k}")


def resample(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", *, share: tuple[int, int] = (25, 100), least_words: int = 20, seed: int = 7, find: Callable[..., Kth] = kth_smallest) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row with an id; ``rank`` from 1 for the rows drawn, else null.

    Of the rows with ``least_words`` words, the ``share`` with the highest scores is drawn, weight plus a Gumbel variate
    of the id: a draw without replacement in proportion to the weights' exponentials. Ties go to the smaller id, and for
    rows of one id and score to those with fewer features. Null and empty texts have no words, no features and a weight
    of 0 and are never drawn; rows without an id are left out; rows that repeat an id stand for themselves; an empty
    table, or one in which too few rows have words enough, draws none. Other columns are dropped.
    """
    weighed = weigh(docs.where(F.col(id_col).isNotNull()), gain, id_col, text_col)
    rows = table(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("_minus", -F.col("score")), "weights")
    able = rows.where(F.col("n_words") >= least_words)
    k = able.count() * share[0] // share[1]
    if not k:
        return rows.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    cut = find(able, "_minus", k)
    tied = able.where(F.col("_minus") == cut.value)
    last = find(tied, "doc_id", k - cut.below)
    drawn = (F.col("n_words") >= least_words) & ((F.col("_minus") < cut.value) | ((F.col("_minus") == cut.value) & (F.col("doc_id") < last.value)))
    edge = (F.col("n_words") >= least_words) & (F.col("_minus") == cut.value) & (F.col("doc_id") == last.value)
    order = [F.col("_minus"), F.col("doc_id"), F.col("n_features")]
    # Rows that share the last id and score: as many of them as are still due.
    ranked = numbered(rows.where(drawn | edge), order, "drawn", "_place")
    got = ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("_place") < k, F.col("_place") + 1).alias("rank"))
    rest = rows.where(~(drawn | edge)).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return rest.unionByName(got)
