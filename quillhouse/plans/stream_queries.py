"""Queries on the micro-batch capture."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillhouse.plans import feed, lake
from quillhouse.plans.record_queries import oracle
from quillhouse.plans.registry import query
from quillhouse.streaming import segments


@query("str6_micro_batches", oracle("", f"select rtype, {feed.STATUS} as status, count(*) as n from turns where not is_blank and not is_torn group by 1, 2"))
def micro_batches(spark: SparkSession, d: str) -> DataFrame:
    """The transcripts landed as segments and streamed into an archive; the second half of them comes with all of the first again."""
    base = f"{lake.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    lines = feed.lines(spark, d).join(feed.turns(spark, d).where("not is_blank and not is_torn").select("transcript", F.col("turn").alias("line_number")), ["transcript", "line_number"])
    text = lines.select(F.rtrim(F.col("raw").cast("string"), F.lit("\n")).alias("value"), (F.pmod(F.xxhash64("transcript"), F.lit(2)) == 0).alias("early"))
    for part in (text.where("early"), text):
        names = part.select("value")
        names.write.mode("append").option("compression", "none").text(f"{base}/in")
        segments.ingest(spark, f"{base}/in", f"{base}/out", f"{base}/state", pattern="*.txt")
    return spark.read.parquet(f"{base}/out").groupBy("rtype", "status").agg(F.count("*").alias("n"))
