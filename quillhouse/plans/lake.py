"""Interpreted tables that queries share: written once for an input, read by all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillhouse.sources.staging import shared_dir

#: Files for each value of a column that a table is dealt by.
SPREAD = 8
_WRITTEN: dict[tuple, DataFrame] = {}


def _stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Size and time of an input, so that a changed one is read again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()


def table(spark: SparkSession, sf_dir: str, source: str, name: str, build: Callable[[], DataFrame], by: str | None = None, order: list[str] | None = None) -> DataFrame:
    """The table ``name`` made by ``build`` from the input ``source``; written at its first use in an application.

    With ``by`` it is dealt into a folder for each value of that column, several files each, and sorted there by ``order``,
    of which the last column spreads a value's rows.
    """
    key = (spark.sparkContext.applicationId, sf_dir, source, name, _stamp(spark, f"{sf_dir}/{source}.parquet"))
    if key not in _WRITTEN:
        out = build()
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if by:
            out.repartition(by, F.pmod(F.xxhash64(order[-1]), F.lit(SPREAD))).sortWithinPartitions(by, *order).write.partitionBy(by).parquet(path)
        else:
            out.write.parquet(path)
        _WRITTEN[key] = spark.read.schema(out.schema).parquet(path)
    return _WRITTEN[key]
