"""Micro-batch capture over landed segments: files that never change once they are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillhouse.operators.records import envelope, parse


#: Keeps state by key on disk; its changes go to the checkpoint.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_records(spark: SparkSession, folder: str, pattern: str = "*.jsonl", files_per_batch: int | None = None) -> DataFrame:
    """A stream of parsed records from JSONL segments below ``folder``, ``files_per_batch`` segments at a time or all at once.

    Growing transcripts cannot be tailed by a file source, which goes by path; they are captured by the batch job, or
    landed as segments first.
    """
    source = spark.readStream.format("text").option("pathGlobFilter", pattern)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    raw = source.load(folder).select(F.col("value").cast("binary").alias("raw"))
    parsed = envelope(parse(raw)).withColumn("sha", F.sha2("raw", 256))
    return parsed.select("session_id", "uuid", "rtype", "status", "sha", "text")


def ingest(spark: SparkSession, folder: str, archive: str, checkpoint: str, pattern: str = "*.jsonl", files_per_batch: int | None = None) -> None:
    """Takes all segments that are there into ``archive`` and ends; running again adds only what is new.

    A record is taken once by transcript, id and bytes. Which ones have been taken is the stream's own state, kept by key
    on the executors' disks and, as changes, in ``checkpoint``: a batch looks up the keys that it brings and never reads
    the archive, so the hundredth costs what the second does. A batch that is run again finds the state from before it and
    replaces what it wrote. The number of state partitions is that of shuffle partitions at the first run.
    """
    # The state's store is a setting of a session; the caller's own stays as it is.
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{archive}/batch={number}")

    new = stream_records(own, folder, pattern, files_per_batch).dropDuplicates(["session_id", "uuid", "sha"])
    query = new.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
