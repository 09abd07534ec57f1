"""Helpers that the operators share: scratch tables in the cluster's shared folder, and Arrow text as byte blocks."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one task looks at together, unless a single text is longer.
BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = got.get() if got.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: later stages start from these files, whoever wrote them."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, text)`` and the columns ``keep`` of the rows that have an id. Other columns, whatever their names, are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keep).where("doc_id is not null")


class Keyed(NamedTuple):
    """Rows with a ``key`` of their own, and what is known of all of them."""

    rows: DataFrame
    #: Keys shifted to the right by so many bits are equal where ``doc_id`` is, and ordered as it is.
    shift: int
    #: How many rows, and bytes of text.
    n: int
    size: int

    def cells(self, bytes_each: int) -> int:
        """Into how many cells to deal work that grows with the text, so that none outgrows a task."""
        return max(2 * partitions(self.rows.sparkSession), -(-self.size // bytes_each))


def numbered(rows: DataFrame, order: list[Column], name: str, place: str) -> DataFrame:
    """``rows`` with ``place``: their number from 0 in the order of ``order``, over all partitions; equal rows are numbered in any way.

    Spark sorts the rows by ranges into a table; only the number of rows of each range reaches the driver.
    """
    spark = rows.sparkSession
    at = table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = sorted(map(tuple, at.groupBy(part.alias("_part")).count().collect()))
    before = [0, *itertools.accumulate(n for _, n in sizes)]
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before[:-1], strict=True)], "_part long, _before long")
    out = at.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(place, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_before")


def with_keys(rows: DataFrame) -> Keyed:
    """``rows`` (``doc_id``, ``text`` and others) with ``key``: the id where no id repeats, else the id and a number for each different text of it.

    Where ids are too large to hold such a number beside them, their places in the order of all ids stand for them. Takes
    one pass, which shuffles ids only. Ids times the texts of the most repeated one must stay below 2**63.
    """
    each = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("size"))
    most, n, size, low, high, ids = each.agg(F.max("n"), F.sum("n"), F.sum("size"), F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if (most or 1) == 1:
        return Keyed(rows.withColumn("key", F.col("doc_id")), 0, n or 0, size or 0)
    shift = (most - 1).bit_length()
    hashed = rows.withColumn("_hash", F.sha2("text", 256))
    texts = hashed.select("doc_id", "_hash").distinct()
    if -(1 << 63) <= low << shift and (high + 1) << shift <= 1 << 63:
        texts = texts.withColumn("_place", F.col("doc_id"))
    elif ids << shift < 1 << 63:
        texts = texts.join(numbered(each.select("doc_id"), [F.col("doc_id")], "ids", "_place"), "doc_id")
    else:
        raise ValueError(f"{ids} ids, of which one has {most} rows, are too many for keys of 64 bits")
    number = texts.withColumn("key", F.shiftleft("_place", shift) + F.row_number().over(Window.partitionBy("doc_id").orderBy("_hash")) - 1).drop("_place")
    return Keyed(hashed.join(number, ["doc_id", "_hash"]).drop("_hash"), shift, n, size)


def text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column, without a copy; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offs


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES, column: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Cuts batches into runs of rows of about ``limit`` bytes: ``(rows, bytes, starts, ends)``, the offsets counted in ``bytes``."""
    for batch in batches:
        buf, offs = text_of(batch.column(column))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
            hi = min(hi, n)
            yield batch.slice(lo, hi - lo), buf[offs[lo] : offs[hi]], offs[lo:hi] - offs[lo], offs[lo + 1 : hi + 1] - offs[lo]
            lo = hi


def pieces(data: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """``data`` cut at ``cuts`` (with both ends), as bytes."""
    raw, size = data.tobytes(), data.itemsize
    return [raw[a * size : b * size] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
