"""Records printed over several lines, joined again by bounded blocks of lines: no group is as long as a file.

An attempt to join begins anew at its first line, so what it comes to does not depend on what was before it, and it ends
within ``MOST_LINES`` lines. Lines are dealt once, sorted, into blocks of ``MOST_LINES`` lines, each with the next one
beside it; a task reads block after block and sums up each line as a transition: what it does to the depth of brackets and
to being inside a string. A record ends on the first line that brings the depth back to where it was. Spark's parser says
which intervals are JSON. Those lie inside one another or apart, since no string of a JSON text crosses a line end, so the
outermost ones are the records; a second deal of the lines puts them in place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillhouse.functions.text import whole_json

#: How far a record may run over lines.
MOST_LINES, MOST_BYTES = 1000, 1 << 20
#: Bytes of a block's lines that a task holds to put records together (of a block with more, a join does it); rows and bytes handed on together.
HELD_BYTES, BATCH_ROWS, BATCH_BYTES = 32 << 20, 4096, 8 << 20
#: Writes a table under a name and reads it.
Keep = Callable[[DataFrame, str], DataFrame]
_CLOSED = re.compile(rb'"(?:[^"\\]|\\.)*+"', re.DOTALL)
_TO_QUOTE = re.compile(rb'(?:[^"\\]|\\.)*+"', re.DOTALL)
_NO_BRACKETS = bytes(b for b in range(256) if b not in b"{}[]")
_FOUND = "path {path}, block long, kind string, n long, last long, end_offset long, text binary"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def transition(line: bytes) -> tuple[int, int, bool]:
    """What a line does that begins outside strings: its net depth, its lowest depth, and whether a string is open at its end."""
    rest = _CLOSED.sub(b"", line)
    at = rest.find(b'"')
    marks = (rest if at < 0 else rest[:at]).translate(None, _NO_BRACKETS)
    if len(marks) > 64:
        depth = np.cumsum(np.where(np.isin(np.frombuffer(marks, np.uint8), (0x7B, 0x5B)), 1, -1))
        return int(depth[-1]), min(0, int(depth.min())), at >= 0
    net = low = 0
    for m in marks:
        net += 1 if m in b"{[" else -1
        low = min(low, net)
    return net, low, at >= 0


def transitions(line: bytes) -> tuple[int, int, bool, int, int, bool]:
    """The same from outside and from inside a string."""
    inside = _TO_QUOTE.match(line)
    return *transition(line), *(transition(line[inside.end() :]) if inside else (0, 0, True))


class _Block:
    """The lines of a block and of the next one, in order; ``limits`` are ``MOST_LINES``, ``MOST_BYTES`` and ``HELD_BYTES``."""

    def __init__(self, path: object, block: int, limits: tuple[int, int, int]) -> None:
        self.path, self.block = path, block
        self.most, self.most_bytes, self.most_held = limits
        self.stop = (block + 1) * self.most
        self.lines: list[tuple[int, int, int, bool, bool, bool]] = []  # number, size, end, a record of its own, opener, without its end and no JSON
        self.steps: list[tuple] = []
        self.raws: list[bytes] | None = []  # None once they are too many
        self.held = 0

    def add(self, n: int, raw: bytes, valid: bool, end: int) -> None:
        native, ended = valid and raw.startswith(b"{"), raw.endswith(b"\n")
        self.lines.append((n, len(raw), end, native, not valid and ended and raw.lstrip().startswith(b"{"), not ended and not valid))
        self.steps.append((0, 0, False, 0, 0, False) if native else transitions(raw))
        if self.raws is not None:
            # No record holds a line that is one of its own, or a longer one.
            self.raws.append(b"" if native or len(raw) > self.most_bytes else raw)
            self.held += len(self.raws[-1])
            if self.held > self.most_held:
                self.raws = None

    def intervals(self) -> list[tuple[int, int]]:
        """Places of the block's openers with those on which their brackets are closed, within the caps and before the next record of its own."""
        depths, sizes = [0], [0]
        for line, step in zip(self.lines, self.steps, strict=True):
            depths.append(depths[-1] + step[0])
            sizes.append(sizes[-1] + line[1])
        out, again, native = [], {}, len(self.lines)
        for i in range(len(self.lines) - 1, -1, -1):
            again[depths[i + 1]] = i  # the next line that ends at a depth
            n, _, _, own, opener, _ = self.lines[i]
            if opener and n < self.stop:
                last = again.get(depths[i], i)
                if i < last < native and self.lines[last][0] - n < self.most and sizes[last + 1] - sizes[i] <= self.most_bytes:
                    out.append((i, last))
            if own:
                native = i
        return out[::-1]

    def _open_at_end(self, first: int) -> bool:
        """Whether an attempt from a place is open at the end of the file."""
        depth, size, inside = 0, 0, False
        for i in range(first, len(self.lines)):
            net, low, opens = self.steps[i][3:] if inside else self.steps[i][:3]
            size += self.lines[i][1]
            if depth + low < 0 or depth + net == 0 or (i > first and (i - first >= self.most or size > self.most_bytes or self.lines[i][3])):
                return False
            depth, inside = depth + net, opens
        return True

    def waiting(self) -> Iterator[int]:
        """Of a file's last lines, as many as a record may have, the numbers of those that wait for more; of one block alone for each file, that in which these lines begin."""
        end = self.lines[-1][0]
        goes_on, begins_before = end == self.stop + self.most - 1, end < self.stop - 1 and self.block > 0
        if not goes_on and not begins_before:
            for i, (n, *_, opener, torn) in enumerate(self.lines):
                if n > end - self.most and (torn or (opener and self._open_at_end(i))):
                    yield n

    def found(self) -> Iterator[tuple]:
        """Rows of ``_FOUND``: ``outer`` intervals, put together, which no other of the block covers; ``inner`` ones; ``waits``; and ``block`` where others are before it."""
        if self.block > 0 and self.lines[0][0] < self.stop:
            yield self.path, self.block, "block", self.stop - self.most, None, None, None
        reach = -1
        for i, last in self.intervals():
            whole = i > reach and self.raws is not None
            yield self.path, self.block, "outer" if whole else "inner", self.lines[i][0], self.lines[last][0], self.lines[last][2], b"".join(self.raws[i : last + 1]) if whole else None
            reach = max(reach, last)
        for n in self.waiting():
            yield self.path, n // self.most, "waits", n, n, None, None


def _blocks(batches: Iterator[pa.RecordBatch], limits: tuple[int, int, int]) -> Iterator[_Block]:
    """Block after block of lines ``(path, block, n, raw, valid, end_offset)`` that come sorted."""
    now = None
    for batch in batches:
        for path, block, n, raw, valid, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.path != path or now.block != block:
                if now is not None:
                    yield now
                now = _Block(path, block, limits)
            now.add(n, raw, valid, end)
    if now is not None:
        yield now


def _dealt(rows: DataFrame, block: str) -> DataFrame:
    """``rows`` by blocks, into as many parts as shuffles have: lines shrink so much in a shuffle that parts put together by their size there would be large ones."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", block)


def intervals(lines: DataFrame) -> DataFrame:
    """What ``lines`` (``path, line_number, end_offset, raw``, numbered from 0 without gaps) hold, as rows of ``_FOUND``; see ``_Block.found``."""
    limits = (MOST_LINES, MOST_BYTES, HELD_BYTES)

    def batch(rows: list[tuple], path: pa.DataType) -> pa.RecordBatch:
        kinds = (path, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        rows, size = [], 0
        for block in _blocks(chain([first] if first else [], batches), limits):
            for row in block.found():
                rows.append(row)
                size += len(row[-1] or b"")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield batch(rows, first.schema.types[0])
                    rows, size = [], 0
        if rows:
            yield batch(rows, first.schema.types[0])

    valid = whole_json(F.try_validate_utf8(F.col("raw").cast("string"))).isNotNull()
    own = F.floor(F.col("n") / MOST_LINES)
    rows = lines.select("path", F.col("line_number").cast("long").alias("n"), "raw", valid.alias("valid"), F.col("end_offset").cast("long").alias("end"))
    rows = rows.select("path", F.explode(F.when(own > 0, F.array(own, own - 1)).otherwise(F.array(own))).alias("block"), "n", "raw", "valid", "end")
    return _dealt(rows, "block").sortWithinPartitions("path", "block", "n").mapInArrow(run, _FOUND.format(path=lines.schema["path"].dataType.simpleString()))


def _covered(rows: DataFrame, by: DataFrame) -> DataFrame:
    """``rows`` with ``covered``: whether one of ``by`` begins before it and reaches it. Both go by blocks; none is longer than one."""
    over = F.col("last") >= (F.col("block") + 1) * MOST_LINES
    covers = by.select("path", F.explode(F.when(over, F.array("block", F.col("block") + 1)).otherwise(F.array("block"))).alias("block"), "n", F.col("last").alias("_reach"))
    before = Window.partitionBy("path", "block").orderBy("n").rangeBetween(Window.unboundedPreceding, -1)
    both = rows.withColumn("_asks", F.lit(True)).unionByName(covers, allowMissingColumns=True)
    return both.withColumn("covered", F.coalesce(F.max("_reach").over(before) >= F.col("n"), F.lit(False))).where("_asks").drop("_asks", "_reach")


def _joined(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows`` (``path, block, n, last, end_offset``) that are one JSON text put together."""
    each = rows.withColumn("line_number", F.explode(F.sequence("n", "last")))
    text = F.expr("listagg(raw, X'') within group (order by line_number)")
    whole = lines.select("path", F.col("line_number").cast("long").alias("line_number"), "raw").join(each, ["path", "line_number"]).groupBy("path", "block", "n", "last", "end_offset").agg(text.alias("text"))
    return whole.where(whole_json(F.try_validate_utf8(F.col("text").cast("string"))).isNotNull())


def records(lines: DataFrame, found: DataFrame, keep: Keep) -> DataFrame:
    """``(path, block, n, last, end_offset, text)``: intervals that are one JSON text, the outermost ones among them."""
    names = ("path", "block", "n", "last", "end_offset")
    good = found.where("kind = 'outer' and text is not null").select(*names, "text")
    # Inside an interval that is no JSON, others may be.
    inner = found.where("kind = 'inner'").select(*names)
    if inner.isEmpty():
        return good
    return good.unionByName(keep(_joined(_covered(inner, good).where("not covered").drop("covered"), lines), "joined"))


def _marks(found: DataFrame, tops: DataFrame) -> DataFrame:
    """By block: up to where lines have gone into a record and how many (``_last``, ``_gone``), how many in all blocks before, and from where on lines wait (``_stop``)."""
    stop = (F.col("block") + 1) * MOST_LINES
    top = tops.where("kind <> 'waits'")
    own = top.select("path", F.col("block").alias("_block"), F.col("n").alias("_n"), F.col("last").alias("_last"), (F.least("last", stop - 1) - F.col("n")).alias("_gone"))
    beyond = top.where(F.col("last") >= stop).select("path", (F.col("block") + 1).alias("_block"), F.col("n").alias("_n"), F.col("last").alias("_last"), (F.col("last") - stop + 1).alias("_gone"))
    gone = own.unionByName(beyond)
    # Only files of several blocks have lines before a block.
    later = found.where("kind = 'block'")
    each = gone.join(later.select("path").distinct(), "path", "left_semi").select("path", "_block", "_gone").unionByName(later.select("path", F.col("block").alias("_block"), F.lit(0).cast("long").alias("_gone")))
    so_far = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = each.groupBy("path", "_block").agg(F.sum("_gone").alias("_gone")).withColumn("_gone", F.sum("_gone").over(so_far)).where("_gone > 0").withColumn("_n", F.lit(-1).cast("long"))
    stops = tops.where("kind = 'waits'").select("path", F.explode(F.array("block", F.col("block") + 1)).alias("_block"), F.col("n").alias("_n"), F.lit(True).alias("_stop"))
    counted = gone.unionByName(before, allowMissingColumns=True).withColumn("_ord", F.lit(3))
    return counted.unionByName(stops.withColumn("_ord", F.lit(0)), allowMissingColumns=True)


def reassembled(lines: DataFrame, keep: Keep) -> DataFrame:
    """``lines`` with records that were printed over several lines joined again, numbered anew in each file.

    ``lines`` has ``path, line_number, start_offset, end_offset, raw`` and others, which a record has from its first
    line. An attempt that fails leaves its first line alone and starts again after it; it fails at a bracket too many,
    beyond the caps, if its brackets are closed and it is no JSON, or where a record of its own begins. Lines of an
    attempt that is open at the end of the file, and a last line without its end that is no JSON, are left out.
    """
    good = whole_json(F.try_validate_utf8(F.col("text").cast("string"))).isNotNull()
    found = keep(intervals(lines).withColumn("text", F.when(good, F.col("text"))), "found")
    whole = records(lines, found, keep)
    asks = whole.select("path", "block", "n", "last", F.lit("record").alias("kind")).unionByName(found.where("kind = 'waits'").select("path", "block", "n", "last", "kind"))
    tops = keep(_covered(asks, whole).where("not covered").drop("covered"), "tops")
    texts = whole.select("path", F.col("block").alias("_block"), F.col("n").alias("_n"), F.lit(1).alias("_ord"), F.struct(F.col("n").alias("n"), F.col("text").alias("raw"), F.col("end_offset").alias("end")).alias("_text"))
    n = F.col("line_number").cast("long")
    rows = lines.withColumns({"_block": F.floor(n / MOST_LINES), "_n": n, "_ord": F.lit(2)})
    rows = _dealt(rows.unionByName(texts, allowMissingColumns=True).unionByName(_marks(found, tops), allowMissingColumns=True), "_block")
    here = Window.partitionBy("path", "_block").orderBy("_n", "_ord")
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A record's text is the row before its first line.
    rows = rows.withColumns({"_reach": F.max("_last").over(so_far), "_less": F.coalesce(F.sum("_gone").over(so_far), F.lit(0)), "_stopped": F.max("_stop").over(so_far), "_head": F.lag("_text").over(here)})
    rows = rows.where("_ord = 2 and _stopped is null and (_reach is null or _reach < _n)")
    head = F.col("_head.n") == F.col("_n")
    kinds = {c: lines.schema[c].dataType for c in ("line_number", "end_offset")}
    out = rows.withColumns({
        "line_number": (F.col("_n") - F.col("_less")).cast(kinds["line_number"]), "raw": F.when(head, F.col("_head.raw")).otherwise(F.col("raw")),
        "end_offset": F.when(head, F.col("_head.end")).otherwise(F.col("end_offset")).cast(kinds["end_offset"]),
    })
    return out.select(*lines.columns)
