"""Operator 6, line dedup: a sharded minimal perfect hash over repeated lines' hashes, with fingerprint, count and first-document arrays that documents probe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillhouse.llm.common import Keyed, blocks, keyed, partitions, pieces, table, with_keys
from quillhouse.llm.hashing import PerfectHash

EDGE = " \t\n\x0b\x0c\r"
_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}
#: Lines that a task gathers before it sends them on.
FLUSH = 400_000
#: Documents for each shard of the index, at most, and the most frequent lines of all shards that documents know beforehand.
SHARD_DOCS, HOT_LINES = 500_000, 65_536
_SUMS = "shard int, h1 binary, h2 binary, doc binary, docs binary"
_ASKS = "cell int, kind int, h1 binary, h2 binary, doc binary, line binary"
_INDEX = "shard int, n long, hash binary, fingerprints binary, counts binary, first_docs binary, twins binary, hot binary"


def line_key(line: str) -> str:
    """The line without white space at both ends, A to Z in lower case."""
    line = line.strip(EDGE)
    return line.lower() if line.isascii() else line.translate(_LOWER)


def _hashes(texts: list[str], docs: list[int], min_chars: int) -> tuple[np.ndarray, ...]:
    """Two hashes, document and line number of each line whose key is long enough."""
    digests, doc, line = [], [], []
    for d, text in zip(docs, texts, strict=True):
        for n, x in enumerate(text.split("\n")):
            key = line_key(x)
            if len(key) >= min_chars:
                digests.append(xxhash.xxh3_128_digest(key.encode()))
                doc.append(d)
                line.append(n)
    h = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
    return h[:, 0], h[:, 1], np.array(doc, np.int64), np.array(line, np.int32)


def _summed(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row for each pair of hashes: the smallest document and how many documents."""
    if not len(h1):
        return h1, h2, doc, docs
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc, docs = h1[order], h2[order], doc[order], docs[order]
    new = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
    return h1[new], h2[new], doc[new], np.add.reduceat(docs, new)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of rows with equal first column, of a partition sorted by it."""
    key, held = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[lo] != key:
                yield key, held
                held = []
            key = int(keys[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield key, held


def joined(parts: list[pa.RecordBatch], column: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for p in parts for x in p.column(column).to_pylist()), dtype)


class Index:
    """One shard: the perfect hash with its arrays, and the few lines whose first hash another line has too."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, n: np.ndarray) -> None:
        """From lines in the order of ``h1``."""
        same = h1[1:] == h1[:-1]
        twin = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(h1) else np.zeros(0, bool)
        self.twins = np.stack((h1[twin], h2[twin], doc[twin].view(np.uint64)), 1)
        h1, h2, doc, n = h1[~twin], h2[~twin], doc[~twin], n[~twin]
        self.hash = PerfectHash.build(h1)
        place = self.hash.find(h1)
        self.prints, self.counts, self.firsts = np.empty(len(h1), "<u8"), np.empty(len(h1), "<i8"), np.empty(len(h1), "<i8")
        self.prints[place], self.counts[place], self.firsts[place] = h2, n, doc

    @classmethod
    def load(cls, raw: bytes, prints: bytes, firsts: bytes, twins: bytes) -> Index:
        out = cls.__new__(cls)
        out.hash, out.prints, out.firsts = PerfectHash.load(raw), np.frombuffer(prints, "<u8"), np.frombuffer(firsts, "<i8")
        out.twins = np.frombuffer(twins, "<u8").reshape(-1, 3)
        return out

    def earlier(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, shift: int) -> np.ndarray:
        """Which lines a document with a smaller id holds."""
        hit = np.zeros(len(h1), bool)
        if len(self.prints):
            place = self.hash.find(h1)
            hit = (place >= 0) & (self.prints[place] == h2) & (self.firsts[place] >> shift < doc >> shift)
        for (a, b, _), first in zip(self.twins, np.ascontiguousarray(self.twins[:, 2]).view(np.int64), strict=True):
            hit |= (h1 == a) & (h2 == b) & (first >> shift < doc >> shift)
        return hit


def build_index(docs: Keyed, *, min_chars: int = 10, min_docs: int = 2, shards: int) -> DataFrame:
    """One row for each shard: its lines found in ``min_docs`` documents or more, as ``_INDEX`` has it.

    A task first sums its own documents' lines, so a line that a third of all documents hold reaches its shard once for
    each task's share and not once for each document. ``hot`` holds the shard's most frequent lines with their hashes.
    """
    most = -(-HOT_LINES // shards)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            h1, h2, doc, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            shard = (h1 % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            some = np.flatnonzero(np.diff(cuts))
            cols = [[c[i] for i in some] for c in (pieces(x[order], cuts) for x in (h1, h2, doc, n))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], ["shard", "h1", "h2", "doc", "docs"])

        size = 0
        for part, *_ in blocks(batches):
            h1, h2, doc, _line = _hashes(part.column(1).to_pylist(), part.column(0).to_pylist(), min_chars)
            # A document counts once for each of its lines.
            order = np.lexsort((doc, h2, h1))
            h1, h2, doc = h1[order], h2[order], doc[order]
            new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (doc[1:] != doc[:-1]))) if len(h1) else np.zeros(0, bool)
            held.append(_summed(h1[new], h2[new], doc[new], np.ones(int(new.sum()), np.int64)))
            size += int(new.sum())
            if size >= FLUSH:
                yield out()
                size = 0
        if held:
            yield out()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in grouped(batches):
            h1, h2, doc, n = _summed(*(joined(parts, i, t) for i, t in ((1, "<u8"), (2, "<u8"), (3, "<i8"), (4, "<i8"))))
            keep = n >= min_docs
            h1, h2, doc, n = h1[keep], h2[keep], doc[keep], n[keep]
            got = Index(h1, h2, doc, n)
            top = np.argsort(-n, kind="stable")[:most]
            hot = np.stack((h1[top], h2[top], doc[top].view(np.uint64)), 1)
            cols = [got.hash.dump(), got.prints.tobytes(), got.counts.tobytes(), got.firsts.tobytes(), got.twins.astype("<u8").tobytes(), hot.astype("<u8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(h1)], pa.int64()), *(pa.array([b], pa.binary()) for b in cols)], [x.split()[0] for x in _INDEX.split(", ")])

    sent = docs.rows.select("key", "text").mapInArrow(sums, _SUMS)
    return sent.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(index, _INDEX)


def repeated_lines(docs: Keyed, index: DataFrame, *, min_chars: int = 10, shards: int) -> DataFrame:
    """``(key, lines)``: the numbers of lines that an earlier document holds (little-endian 32-bit integers), in one or more rows for each document.

    Documents ask the shards in packed rows. The most frequent lines, ``HOT_LINES`` or a few more of all shards together,
    are known to every task, so that no shard is asked for a line by a large share of all documents.
    """
    shift = docs.shift
    known = np.frombuffer(b"".join(bytes(r.hot) for r in index.where("n > 0").select("hot").toLocalIterator()), "<u8").reshape(-1, 3)
    hot = known[np.lexsort((known[:, 1], known[:, 0]))]
    alone = np.concatenate(([True], hot[1:, 0] != hot[:-1, 0])) & np.concatenate((hot[1:, 0] != hot[:-1, 0], [True])) if len(hot) else np.zeros(0, bool)
    hot = hot[alone]  # lines whose first hash two hot lines share ask their shard

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            h1, h2, doc, line = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            cell = (h1 % np.uint64(shards)).astype(np.int64)
            kind = np.ones(len(cell), np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot[:, 0], h1), len(hot) - 1)
                here = (hot[at, 0] == h1) & (hot[at, 1] == h2)
                gone = here & (hot[at, 2].view(np.int64) >> shift < doc >> shift)
                kind[gone] = 2  # answered; dealt by document
                cell[gone] = doc[gone] % shards
                left = gone | ~here
                h1, h2, doc, line, cell, kind = (x[left] for x in (h1, h2, doc, line, cell, kind))
            if not len(cell):
                return
            order = np.lexsort((kind, cell))
            cell, kind = cell[order], kind[order]
            cuts = np.concatenate(([0], np.flatnonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1, [len(cell)]))
            first = cuts[:-1]
            cols = [pieces(x[order], cuts) for x in (h1, h2, doc, line)]
            bare = [k == 2 for k in kind[first].tolist()]
            for c in cols[:2]:
                c[:] = [b"" if b else x for x, b in zip(c, bare, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cell[first], pa.int32()), pa.array(kind[first], pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], ["cell", "kind", "h1", "h2", "doc", "line"])

        size = 0
        for part, *_ in blocks(batches, 4 << 20):
            held.append(_hashes(part.column(1).to_pylist(), part.column(0).to_pylist(), min_chars))
            size += len(held[-1][0])
            if size >= FLUSH:
                yield from out()
                size = 0
        if held:
            yield from out()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, arrays = None, None
        for cell, parts in grouped(batches):
            for p in parts:
                for i in range(p.num_rows):
                    kind = p.column(1)[i].as_py()
                    if kind == 0:
                        at, arrays = cell, Index.load(*(p.column(j)[i].as_py() for j in (2, 3, 4, 5)))
                        continue
                    doc, line = (np.frombuffer(p.column(j)[i].as_py(), t) for j, t in ((4, "<i8"), (5, "<i4")))
                    if kind == 1:
                        if at != cell:
                            continue
                        h1, h2 = (np.frombuffer(p.column(j)[i].as_py(), "<u8") for j in (2, 3))
                        hit = arrays.earlier(h1, h2, doc, shift)
                        doc, line = doc[hit], line[hit]
                    if len(doc):
                        order = np.argsort(doc, kind="stable")
                        doc, line = doc[order], line[order]
                        cuts = np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)]))
                        yield pa.RecordBatch.from_arrays([pa.array(doc[cuts[:-1]]), pa.array(pieces(line, cuts), pa.binary())], ["key", "lines"])

    asked = docs.rows.select("key", "text").mapInArrow(asks, _ASKS)
    arrays = index.where("n > 0").select(F.col("shard").alias("cell"), F.lit(0).alias("kind"), F.col("hash").alias("h1"), F.col("fingerprints").alias("h2"), F.col("first_docs").alias("doc"), F.col("twins").alias("line"))
    return asked.unionByName(arrays).repartition(shards, "cell").sortWithinPartitions("cell", "kind").mapInArrow(probe, "key long, lines binary")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 10, min_docs: int = 2, shards: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, text)``: each text without the lines that a document with a smaller id holds too.

    A line's key is the line without white space (space, U+0009 to U+000D) at both ends and with A to Z in lower case.
    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents keep their lines only in the smallest
    id; there, and for all other lines, nothing changes. A null or empty text is one empty line. Rows without an id are
    left out; rows that repeat an id count as one document, and each keeps its own text. Of other columns, those named in
    ``keep`` are handed on. Two keys are taken as equal when 128 bits of hash agree.
    """
    got = with_keys(keyed(docs, id_col, text_col, keep))
    shards = shards or max(partitions(docs.sparkSession), -(-got.n // SHARD_DOCS))
    index = table(build_index(got, min_chars=min_chars, min_docs=min_docs, shards=shards), "lines")
    found = repeated_lines(got, index, min_chars=min_chars, shards=shards).groupBy("key").agg(F.collect_list("lines").alias("lines"))
    both = got.rows.join(found, "key", "left").select("doc_id", "text", "lines", *keep)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, *_ in blocks(batches, 4 << 20):
            n_lines, n_dropped, kept = [], [], []
            for text, drops in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                lines = text.split("\n")
                gone = set(np.frombuffer(b"".join(drops), "<i4").tolist()) if drops else ()
                n_lines.append(len(lines))
                if gone:
                    lines = [x for i, x in enumerate(lines) if i not in gone]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string()), *part.columns[3:]], names)

    names = ["doc_id", "n_lines", "n_dropped", "text", *keep]
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return both.mapInArrow(apply, "doc_id long, n_lines long, n_dropped long, text string" + kinds)
