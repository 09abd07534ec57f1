"""Operator 5, suffix-array dedup by sparse distributed prefix doubling: Spark sorts positions by pairs of ranks at growing offsets, until they are unique or past the threshold.

Positions that start from one in seventeen bytes: anchors chosen by content (``anchors``), of which every window of
``length`` bytes has one, equal windows an equal one. Round 1 ranks them by 16 bytes, sorts each with the rank of the
bytes next to it (17 more at ``length`` 50) and drops what is unique; windows of which all bytes around agree are settled
there and then. Round 2 takes up all windows of the anchors that are left and sorts them by the ranks of their two
halves, which is past the threshold. Their bytes are dealt by the rank of round 1, and ranked and sorted where equal ones
meet; windows around a gram that very many share are ranked first and dealt by their own rank. A rank is a hash of the
bytes, so that equal bytes have equal ranks wherever they stand; rows carry packed arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillhouse.llm.anchors import BLOCK, anchors, mix
from quillhouse.llm.common import blocks, keyed, table, with_keys
from quillhouse.llm.lines import grouped

#: Anchors or windows that a task gathers and combines before it sends them on.
FLUSH = 400_000
#: Anchors of one gram, with different bytes around, that a task sends to round 1 from what it gathered; with more, all go on to round 2, since the gram is not unique.
HOT = 64
#: Bytes of text for each cell of the dealing.
CELL_BYTES = 32 << 20
_COLS = ("a", "b", "doc", "low", "count", "split", "before", "after")
_SENT = "bucket int, kind int, n int, base long, " + ", ".join(f"{c} binary" for c in _COLS) + ", bytes binary"
_MARKS = "key long, low binary, count binary, open_low binary, open_count binary, open_gram binary"
#: Kinds of rows: settled windows, windows for round 2, ranked positions, grams that some task has too often, windows with their bytes.
SETTLED, OPEN, RANKED, WILD, BYTES = 0, 1, 2, 3, 4
#: Bytes whose windows are ranked at a time.
STEP_BYTES = 1 << 20
_SIX, _TAG = np.uint64((1 << 48) - 1), np.uint64((1 << 16) - 1)


def narrow(x: np.ndarray) -> bytes:
    """Integers, taken as unsigned ones of 64 bits, in as few bytes each as the largest needs."""
    if not len(x):
        return b""
    x = x.astype("<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def widen(raw: bytes, n: int) -> np.ndarray:
    if not raw:
        return np.zeros(n, np.uint64)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(n, -1)
    return out.view("<u8").ravel()


def _flat(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the spans that begin at ``at`` and have ``size`` places."""
    return np.arange(int(size.sum())) + np.repeat(at - np.cumsum(size) + size, size)


def _send(kind: int, bucket: np.ndarray, doc: np.ndarray, text: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, **arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of packed arrays, one for each bucket; documents as differences. ``text`` is a buffer with the place and length of each item's bytes."""
    if not len(doc):
        return
    order = np.lexsort((doc, bucket))
    bucket, doc = bucket[order], doc[order]
    arrays = {k: v[order] for k, v in arrays.items()}
    cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])).tolist()
    cols: dict[str, list] = {k: [] for k in ("bucket", "kind", "n", "base", *_COLS, "bytes")}
    if text:
        buf, at, size = text[0], text[1][order], text[2][order]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        cols["bucket"].append(int(bucket[lo]))
        cols["kind"].append(kind)
        cols["n"].append(hi - lo)
        cols["base"].append(int(doc[lo]))
        cols["doc"].append(narrow(np.diff(doc[lo:hi], prepend=doc[lo])))
        for k in _COLS:
            if k != "doc":
                cols[k].append(narrow(arrays[k][lo:hi]) if k in arrays else b"")
        cols["bytes"].append(buf[_flat(at[lo:hi], size[lo:hi])].tobytes() if text else b"")
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * (len(_COLS) + 1)]
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), types, strict=True)], list(cols))


def _rows(parts: list[pa.RecordBatch]) -> list[dict]:
    return [r for p in parts for r in p.to_pylist()]


def _received(rows: list[dict], kind: int) -> dict[str, np.ndarray]:
    """The arrays of the rows of a kind."""
    out: dict[str, list] = {k: [np.zeros(0, np.uint64)] for k in _COLS}
    for r in rows:
        if r["kind"] == kind:
            n = r["n"]
            for k in _COLS:
                out[k].append((np.cumsum(widen(r["doc"], n).astype(np.int64)) + r["base"]).view(np.uint64) if k == "doc" else widen(r[k], n))
    got = {k: np.concatenate(v) for k, v in out.items()}
    if kind == BYTES:
        got["bytes"] = np.frombuffer(b"".join(r["bytes"] for r in rows if r["kind"] == kind), np.uint8)
    return got | {"doc": got["doc"].view(np.int64), "split": got["split"].astype(np.int64), "count": got["count"].astype(np.int64)}


def _found(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(key, low, count, gram, context, split, before, after)`` of the anchors, by blocks of text."""
    for part, buf, starts, ends in blocks(batches):
        ids = part.column(0).to_numpy(zero_copy_only=False)
        if len(ids) == 1 and len(buf) > BLOCK:
            for at in range(0, len(buf) - length + 1, BLOCK):
                cut = buf[at : at + BLOCK + length - 1]
                who, low, *rest = anchors(cut, np.array([0]), np.array([len(cut)]), length)
                yield ids[who], low + at, *rest
        else:
            who, *rest = anchors(buf, starts, ends, length)
            yield ids[who], *rest


def _rank(wide: np.ndarray, seed: int) -> np.ndarray:
    """48-bit ranks of equally long rows of bytes."""
    full = np.zeros((len(wide), -(-wide.shape[1] // 8) * 8), np.uint8)
    full[:, : wide.shape[1]] = wide
    out = np.full(len(wide), seed, np.uint64)
    for word in full.view("<u8").T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word)
    return out & _SIX


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _combine(held: list[tuple[np.ndarray, ...]], buckets: int, shift: int) -> Iterator[pa.RecordBatch]:
    """Sends a task's anchors: of equal gram and context only the smallest document's, the others being settled."""
    doc, low, count, gram, context, split, before, after = (np.concatenate(x) for x in zip(*held, strict=True))
    gram, context, before, after = gram & _SIX, context & _SIX, before & _TAG, after & _TAG
    order = np.lexsort((doc, context, gram))
    doc, low, count, gram, context, split, before, after = (x[order] for x in (doc, low, count, gram, context, split, before, after))
    new = _first_of(gram, context)
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    done = doc >> shift > least >> shift
    yield from _send(SETTLED, doc[done] % buckets, doc[done], low=low[done], count=count[done])
    doc, low, count, gram, context, split, before, after = (x[~done] for x in (doc, low, count, gram, context, split, before, after))
    group = np.cumsum(_first_of(gram)) - 1
    hot = (np.bincount(group) > HOT)[group] if len(group) else np.zeros(0, bool)
    if hot.any():
        yield from _send(OPEN, doc[hot] % buckets, doc[hot], a=np.zeros(int(hot.sum()), np.uint64), low=low[hot], count=count[hot])
        some = np.flatnonzero(hot & _first_of(gram))
        yield from _send(WILD, (gram[some] % np.uint64(buckets)).astype(np.int64), doc[some], a=gram[some])
    rest = ~hot
    yield from _send(RANKED, (gram[rest] % np.uint64(buckets)).astype(np.int64), doc[rest], a=gram[rest], b=context[rest], low=low[rest], count=count[rest], split=split[rest], before=before[rest], after=after[rest])


def _first_round(rows: list[dict], shift: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Round 1 in one bucket: windows that are settled, by equal context, and those left for round 2."""
    got, wild = _received(rows, RANKED), np.unique(_received(rows, WILD)["a"])
    order = np.lexsort((got["doc"], got["b"], got["a"]))
    got = {k: x[order] for k, x in got.items()}
    doc = got["doc"]
    new = _first_of(got["a"], got["b"])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]  # of the context
    full = doc >> shift > least >> shift
    settled = {k: got[k][full] for k in ("doc", "low", "count")}
    left = {k: x[~full] for k, x in got.items()}
    free = np.isin(left["a"], wild)

    def meets(has: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """Whose pair of ranks, of the gram and of the bytes next to it, another document shares."""
        at = np.flatnonzero(has)
        at = at[np.lexsort((left["doc"][at], tag[at], left["a"][at]))]
        begin = _first_of(left["a"][at], tag[at])
        group, d = np.cumsum(begin) - 1, left["doc"][at] >> shift
        heads = np.flatnonzero(begin)
        several = d[heads] != d[np.append(heads[1:], len(at)) - 1] if len(heads) else np.zeros(0, bool)
        out = np.zeros(len(has), bool)
        out[at] = several[group]
        return out | (free & has)

    one, two = meets(left["split"] > 0, left["before"]), meets(left["count"] > left["split"], left["after"])
    low = left["low"] + np.where(one, 0, left["split"]).astype(np.uint64)
    count = np.where(one, left["split"], 0) + np.where(two, left["count"] - left["split"], 0)
    keep = one | two
    return settled, {"doc": left["doc"][keep], "a": np.where(free, np.uint64(0), left["a"])[keep], "low": low[keep], "count": count[keep]}


class _Cells:
    """Gathers what a task finds in all its buckets and sends it on by document, so that rows number tasks times cells at most."""

    def __init__(self, cells: int) -> None:
        self.cells, self.size = cells, 0
        self.held: dict[int, list[dict[str, np.ndarray]]] = {SETTLED: [], OPEN: []}

    def add(self, kind: int, **arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(arrays["doc"]):
            self.held[kind].append(arrays)
            self.size += len(arrays["doc"])
            if self.size >= 2 * FLUSH:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        for kind, held in self.held.items():
            if held:
                got = {k: np.concatenate([x[k] for x in held]) for k in ("doc", "low", "count") + (("a",) if kind == OPEN else ())}
                doc = got.pop("doc")
                yield from _send(kind, doc % self.cells, doc, **got)
        self.held, self.size = {SETTLED: [], OPEN: []}, 0


def _by_doc(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row for each document of a cell."""
    rows = _rows(parts)
    both = [_received(rows, kind) for kind in (SETTLED, OPEN)]
    docs = np.unique(np.concatenate([x["doc"] for x in both]))
    cols: list[pa.Array] = [pa.array(docs)]
    for got in both:
        order = np.argsort(got["doc"], kind="stable")
        cuts = np.append(np.searchsorted(got["doc"][order], docs), len(order)).tolist()
        for k, size in (("low", 4), ("count", 1), ("a", 8))[: 3 if got is both[1] else 2]:
            raw = got[k][order].astype(f"<u{size}").tobytes()
            cols.append(pa.array([raw[a * size : b * size] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, ["key", "low", "count", "open_low", "open_count", "open_gram"])


def _runs(doc: np.ndarray, low: np.ndarray) -> dict[str, np.ndarray]:
    """Windows, each by its start, as runs of at most 255 neighbours."""
    order = np.lexsort((low, doc))
    doc, low = doc[order], low[order].astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (low[1:] != low[:-1] + 1)))) if len(doc) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(doc)))
    cut = -(-size // 255)
    at = np.arange(int(cut.sum())) - np.repeat(np.cumsum(cut) - cut, cut)
    head = np.repeat(head, cut) + 255 * at
    return {"doc": doc[head], "low": low[head].astype(np.uint64), "count": np.minimum(255, np.repeat(size, cut) - 255 * at)}


def _removed(a: np.ndarray, b: np.ndarray, doc: np.ndarray, low: np.ndarray, shift: int) -> dict[str, np.ndarray]:
    """Runs of the windows that a smaller document has, of windows with their pairs of ranks."""
    order = np.lexsort((doc, b, a))
    a, b, doc, low = (x[order] for x in (a, b, doc, low))
    new = _first_of(a, b)
    gone = doc >> shift > doc[np.flatnonzero(new)][np.cumsum(new) - 1] >> shift
    return _runs(doc[gone], low[gone])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 50, buckets: int | None = None, as_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``: each text's UTF-8 bytes without those covered by a string of ``length``
    bytes (34 to 200) that also starts in a document with a smaller id.

    ``kept`` is binary, since a removed span may end inside a character; with ``as_text`` it is a string without such
    broken characters. Overlaps count, matches never cross documents,
    and all strings are judged on the input. Null and empty texts have no bytes; texts shorter than ``length`` stay
    whole; rows without an id are left out. Rows that repeat an id are one document: nothing is removed from one for
    standing in the other, and each keeps its own text. Of other columns, those named in ``keep`` are handed on.

    Strings are taken as equal when 96 bits of hash agree, 48 of each of two ranks.
    """
    if not 34 <= length <= 200:
        raise ValueError("length must be from 34 to 200")
    got = with_keys(keyed(docs, id_col, text_col, keep))
    shift = got.shift
    buckets = buckets or got.cells(CELL_BYTES)
    rows = got.rows

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for found in _found(batches, length):
            held.append(found)
            size += len(found[0])
            if size >= FLUSH:
                yield from _combine(held, buckets, shift)
                held, size = [], 0
        if size:
            yield from _combine(held, buckets, shift)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells(buckets)
        for _, parts in grouped(batches):
            got = _rows(parts)
            for kind in (SETTLED, OPEN):
                yield from cells.add(kind, **{k: x for k, x in _received(got, kind).items() if k in ("doc", "a", "low", "count")})
            for kind, found in zip((SETTLED, OPEN), _first_round(got, shift), strict=True):
                yield from cells.add(kind, **found)
        yield from cells.rest()

    def by_doc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in grouped(batches):
            yield _by_doc(parts)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(buckets, "bucket").sortWithinPartitions("bucket")

    sent = dealt(rows.select("key", "text").mapInArrow(send, _SENT)).mapInArrow(settle, _SENT)
    marks = table(dealt(sent).mapInArrow(by_doc, _MARKS), "marks")
    both = rows.join(marks, "key", "left").select("key", "text", "open_low", "open_count", "open_gram", "low", "count", "doc_id", *keep)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows that round 1 left open: their bytes by gram; for grams that too many share, the ranks of both halves
        of each, of equal ones of a task only the smallest document's, the others being removed."""
        half = length // 2
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            a, b, doc, low = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((low, doc, b, a))
            a, b, doc, low = a[order], b[order], doc[order], low[order]
            new = _first_of(a, b)
            gone = doc >> shift > doc[np.flatnonzero(new)][np.cumsum(new) - 1] >> shift
            run = _runs(doc[gone], low[gone])
            yield from _send(SETTLED, run["doc"] % buckets, run["doc"], low=run["low"], count=run["count"])
            a, b, doc, low = (x[~gone] for x in (a, b, doc, low))
            yield from _send(RANKED, (a % np.uint64(buckets)).astype(np.int64), doc, a=a, b=b, low=low.astype(np.uint64))

        size = 0
        for part, buf, starts, _ in blocks(batches):
            lows, counts, grams = (part.column(i).to_pylist() for i in (2, 3, 4))
            some = [i for i, x in enumerate(lows) if x]
            if not some:
                continue
            low = np.frombuffer(b"".join(lows[i] for i in some), "<u4").astype(np.int64)
            count = np.frombuffer(b"".join(counts[i] for i in some), np.uint8).astype(np.int64)
            per = np.array([len(counts[i]) for i in some])
            gram = np.frombuffer(b"".join(grams[i] for i in some), "<u8")
            doc, base = (np.repeat(x[some], per) for x in (part.column(0).to_numpy(zero_copy_only=False), starts))
            near = gram > 0
            if near.any():
                g, d, lo_, c = gram[near], doc[near], low[near], count[near]
                yield from _send(BYTES, (g % np.uint64(buckets)).astype(np.int64), d, (buf, base[near] + lo_, c + length - 1), a=g, low=lo_.astype(np.uint64), count=c.astype(np.uint64))
            low, count, doc, base = (x[~near] for x in (low, count, doc, base))
            if not len(low):
                continue
            doc, base = np.repeat(doc, count), np.repeat(base, count)
            at = _flat(low, count)
            view = np.lib.stride_tricks.sliding_window_view(buf, length)
            for lo in range(0, len(at), FLUSH):
                wide = view[(at + base)[lo : lo + FLUSH]]
                held.append((_rank(wide[:, :half], 1), _rank(wide[:, half:], 2), doc[lo : lo + FLUSH], at[lo : lo + FLUSH]))
                size += len(wide)
                if size >= FLUSH:
                    yield from out()
                    size = 0
        if size:
            yield from out()

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells(buckets)
        for _, parts in grouped(batches):
            all_rows = _rows(parts)
            done, found = _received(all_rows, SETTLED), _received(all_rows, RANKED)
            yield from cells.add(SETTLED, **{k: done[k] for k in ("doc", "low", "count")})
            yield from cells.add(SETTLED, **_removed(found["a"], found["b"], found["doc"], found["low"], shift))
            got = _received(all_rows, BYTES)
            order = np.argsort(got["a"], kind="stable")
            size = got["count"] + length - 1
            first = np.cumsum(size) - size
            heads = np.append(np.flatnonzero(_first_of(got["a"][order])), len(order))
            weight = np.concatenate(([0], np.cumsum(size[order])))
            lo = 0
            while lo < len(heads) - 1:  # whole groups of a gram, a step of bytes at a time
                hi = max(lo + 1, int(np.searchsorted(weight[heads], weight[heads[lo]] + STEP_BYTES, "right")) - 1)
                take = order[heads[lo] : heads[hi]]
                lo = hi
                count = got["count"][take]
                at = _flat(first[take], count)
                view = np.lib.stride_tricks.sliding_window_view(got["bytes"], length)
                cuts = range(0, len(at), 1 << 16)
                a, b = (np.concatenate([_rank(view[at[k : k + (1 << 16)], part], seed) for k in cuts]) for part, seed in ((slice(0, length // 2), 1), (slice(length // 2, None), 2)))
                yield from cells.add(SETTLED, **_removed(a, b, np.repeat(got["doc"][take], count), _flat(got["low"][take].astype(np.int64), count), shift))
        yield from cells.rest()

    opened = both.where("open_low is not null and octet_length(open_low) > 0").select("key", "text", "open_low", "open_count", "open_gram")
    checked = dealt(dealt(opened.mapInArrow(windows, _SENT)).mapInArrow(last, _SENT)).mapInArrow(by_doc, _MARKS)
    more = checked.select("key", F.col("low").alias("more_low"), F.col("count").alias("more_count"))
    final = both.join(more, "key", "left").select("doc_id", "text", "low", "count", "more_low", "more_count", *keep)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, starts, ends in blocks(batches, 4 << 20):
            removed, spans_, kept = [], [], []
            marks_ = [part.column(i).to_pylist() for i in (2, 3, 4, 5)]
            raw = buf.tobytes()
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                low = np.frombuffer((marks_[0][i] or b"") + (marks_[2][i] or b""), "<u4").astype(np.int64)
                if not len(low):
                    removed.append(0)
                    spans_.append(0)
                    kept.append(raw[a:b])
                    continue
                stop = low + np.frombuffer((marks_[1][i] or b"") + (marks_[3][i] or b""), "<u1") + (length - 1)
                gone = np.cumsum(np.bincount(low, minlength=b - a + 1) - np.bincount(stop, minlength=b - a + 1))[: b - a] > 0
                removed.append(int(gone.sum()))
                spans_.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(buf[a:b][~gone].tobytes())
            texts = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ends - starts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_, pa.int64()), texts, *part.columns[6:]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *keep])

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return final.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept " + ("string" if as_text else "binary") + kinds)


def brute_force(texts: dict[int, bytes], length: int = 50) -> dict[int, tuple[int, int, int, str]]:
    """The same by a dictionary of all strings, for tests: ``doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)``."""
    first: dict[bytes, int] = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - length + 1):
            first.setdefault(texts[d][i : i + length], d)
    out = {}
    for d, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        out[d] = (len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out

