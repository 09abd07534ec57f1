"""Micro-batches of segments: each record once, and no batch reads what earlier ones wrote."""

import json
import os

from pyspark.sql import functions as F

from quillhouse.streaming import segments


def record(i):
    return json.dumps({"type": "user", "uuid": f"u{i}", "sessionId": "s", "message": {"role": "user", "content": f"text {i}"}})


def test_many_batches_and_replays(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    for k in range(6):
        (folder / f"{k}.jsonl").write_text("\n".join(record(i) for i in range(10 * k, 10 * k + 15)) + "\n")
    segments.ingest(spark, str(folder), out, state, files_per_batch=1)
    got = spark.read.parquet(out)
    assert got.count() == got.select("uuid").distinct().count() == 65 and got.select("batch").distinct().count() == 6
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != segments.STATE_STORE
    # What was written is not read again: without it, known records still do not come back.
    for name in sorted(os.listdir(out))[:3]:
        os.rename(f"{out}/{name}", str(tmp_path / name))
    left = spark.read.parquet(out).count()
    (folder / "again.jsonl").write_text("\n".join(record(i) for i in range(70)) + "\n" + record(3).replace("text 3", "other") + "\n")
    segments.ingest(spark, str(folder), out, state)
    assert spark.read.parquet(out).count() == left + 5 + 1
    # The last batch is taken back and run again, as after a loss of the driver: the same rows, once.
    last = max(int(x) for x in os.listdir(f"{state}/commits") if x.isdigit())
    for x in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{state}/commits/{x}"):
            os.remove(f"{state}/commits/{x}")
    segments.ingest(spark, str(folder), out, state)
    assert spark.read.parquet(out).where(F.col("uuid").isNotNull()).count() == left + 6
    segments.ingest(spark, str(folder), out, state)
    assert spark.read.parquet(out).count() == left + 6
