"""Operator 2, byte-level BPE by overlapping chunks: pre-tokenise chunks in parallel, stitch them where their boundaries meet again, encode the pieces."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quillhouse.llm.common import blocks

#: White space as the pattern's ``\s`` has it.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: A run of white space and the run of other characters after it. No pre-token reaches over the end of such a run, whatever comes before.
RUN = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_BLANK = re.compile(f"[{SPACE}]")
#: Runs whose ids a worker remembers, and the longest run it remembers.
CACHE_RUNS, CACHE_CHARS = 200_000, 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Runs(dict):
    """Ids, as little-endian 32-bit integers, of each run met so far."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        super().__init__()
        import tiktoken

        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})

    def __missing__(self, run: str) -> bytes:
        out = np.array(self.encoding.encode_ordinary(run), "<u4").tobytes()
        if len(run) <= CACHE_CHARS:
            if len(self) >= CACHE_RUNS:
                self.clear()
            self[run] = out
        return out

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, RUN.findall(text)))


@lru_cache(4)
def _runs(ranks_path: str, pattern: str) -> _Runs:
    return _Runs(ranks_path, pattern)


@lru_cache(4)
def _bytes(ranks_path: str) -> list[bytes]:
    table = {i: b for b, i in read_ranks(ranks_path).items()}
    return [table.get(i, b"") for i in range(max(table, default=-1) + 1)]


def boundaries(text: str, pattern: str, lo: int, hi: int) -> list[int]:
    """Ends of pre-tokens of ``text`` in ``[lo, hi)`` after which a text may be cut: the last character is no white space.

    The end of ``text`` itself does not count, since what follows could prolong the last pre-token.
    """
    import regex

    return [e for m in regex.finditer(pattern, text) if lo <= (e := m.end()) < hi and e < len(text) and not _BLANK.match(text[e - 1])]


_CHUNK = "doc_id long, rn long, chunk int, core int, text string, head array<int>, head_sure array<int>, tail array<int>"


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *, chunk: int = 32_768, overlap: int = 1_024) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` for every row: ``ids`` holds little-endian unsigned 32-bit integers.

    Texts of at most ``chunk`` characters are encoded where they are read. Longer ones are cut into chunks that overlap
    by ``overlap`` characters and dealt over the cluster; each is pre-tokenised from its own first character, so its
    first boundaries may be wrong. Two neighbours are stitched at the first boundary in their overlap that both found:
    one between other characters and white space, which is a boundary wherever one starts, or else any common one, if
    the left chunk is itself stitched so. Chunks that find none (one huge pre-token) are joined and encoded as one. Null
    texts have no ids; ids may be null or repeat, every row has its own result; other columns are dropped.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _runs(ranks_path, pattern)
        for part, *_ in blocks(batches, 1 << 22):
            ids = [runs.ids(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, *_ in blocks(batches):
            for doc, rn, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(1).to_pylist(), strict=True):
                for c, at in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([rn], pa.int64()), pa.array([c], pa.int32()), pa.array([text[at : at + chunk + overlap]])], ["doc_id", "rn", "chunk", "text"])

    def pre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("core", "head", "head_sure", "tail")}
            for text, c in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = boundaries(text, pattern, 1, len(text))
                head = [e for e in found if e < overlap]
                out["core"].append(min(chunk, len(text)))
                out["head"].append([c * chunk + e for e in head])
                out["head_sure"].append([c * chunk + e for e in head if _BLANK.match(text[e])])
                out["tail"].append([c * chunk + e for e in found if e >= chunk])
            cols = [batch.column(0), batch.column(1), batch.column(2), pa.array(out["core"], pa.int32()), batch.column(3)] + [pa.array(out[k], pa.list_(pa.int32())) for k in ("head", "head_sure", "tail")]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "rn", "chunk", "core", "text", "head", "head_sure", "tail"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _runs(ranks_path, pattern)
        for batch in batches:
            for doc, rn, first, lo, hi, parts in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                text = "".join(p["text"][: p["core"]] for p in parts[:-1]) + parts[-1]["text"]
                base = first * chunk
                ids = runs.ids(text[lo - base : None if hi is None else hi - base])
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([rn], pa.int64()), pa.array([first], pa.int32()), pa.array([ids], pa.binary())], ["doc_id", "rn", "first", "ids"])

    short = rows.where(F.char_length("text") <= chunk).mapInArrow(whole, "doc_id long, n_tokens long, ids binary")
    # A number of its own for every long row (its id may be null or shared); rows are told apart by both.
    long = rows.where(F.char_length("text") > chunk).withColumn("rn", F.xxhash64("text"))
    dealt = long.mapInArrow(cut, "doc_id long, rn long, chunk int, text string").repartition("doc_id", "rn", "chunk").mapInArrow(pre, _CHUNK)
    dealt = dealt.dropDuplicates(["doc_id", "rn", "chunk"])
    doc = Window.partitionBy("doc_id", "rn").orderBy("chunk")
    common = F.array_intersect(F.lag("tail").over(doc), F.col("head"))
    sure = F.array_min(F.array_intersect(F.lag("tail").over(doc), F.col("head_sure")))
    met = dealt.withColumn("sure", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(sure)).withColumn("any", F.array_min(common))
    met = met.withColumn("start", F.coalesce(F.col("sure"), F.when(F.lag("sure").over(doc).isNotNull(), F.col("any"))))
    met = met.withColumn("island", F.count("start").over(doc)).withColumn("stop", F.min("start").over(doc.rowsBetween(1, Window.unboundedFollowing)))
    islands = met.groupBy("doc_id", "rn", "island").agg(
        F.min("chunk").alias("first"), F.min("start").alias("start"), F.min("stop").alias("stop"),
        F.sort_array(F.collect_list(F.struct("chunk", "core", "text"))).alias("parts"),
    ).select("doc_id", "rn", "first", "start", "stop", "parts")
    encoded = islands.mapInArrow(joined, "doc_id long, rn long, first int, ids binary")
    ids = F.expr("listagg(ids, X'') within group (order by first)")
    whole_long = encoded.groupBy("doc_id", "rn").agg(ids.alias("ids"))
    copies = long.groupBy("doc_id", "rn").agg(F.count("*").alias("copies"))
    again = whole_long.join(copies, whole_long.rn.eqNullSafe(copies.rn) & whole_long.doc_id.eqNullSafe(copies.doc_id)).select(whole_long.doc_id, "ids", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return short.unionByName(again.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids"))


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``bytes``: the bytes of its ids put together; they need not be valid UTF-8 for a part of a text.

    A null ``ids`` gives null. An id without bytes in the vocabulary raises. A column called ``bytes`` is replaced.
    """
    kept = encoded.drop("bytes")
    place = kept.columns.index(ids_col)
    schema = StructType([*kept.schema.fields, StructField("bytes", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bytes(ranks_path)
        for part, *_ in blocks(batches, 1 << 22, place):
            out = [None if x is None else b"".join([table[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in part.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "bytes"])

    return kept.mapInArrow(run, schema)
