"""Exports in chunks, and made-up files of bounded size."""

import hashlib

from quillhouse.plans.registry import capture_queries
from quillhouse.sources import export


def test_chunks_of_a_hot_transcript(spark):
    lines = [("hot" if i % 3 else "b", i, bytearray(f"line {i} ".encode() * (i % 7) + b"\n")) for i in range(9000)] + [(None, 1, bytearray(b"x\n"))]
    want = {k: b"".join(bytes(r) for x, _, r in lines if x == k) for k in ("hot", "b", None)}
    rows = spark.createDataFrame(lines, "transcript string, line_number long, raw binary").repartition(4)
    got = export.as_chunks(rows, limit=5000).collect()
    for k, content in want.items():
        mine = sorted((r for r in got if r.transcript == k), key=lambda r: r.chunk)
        assert b"".join(bytes(r.content) for r in mine) == content and max(r.n_bytes for r in mine) < 5100
        assert all(bytes(r.content) == content[r.start : r.start + r.n_bytes] and r.sha == hashlib.sha256(r.content).hexdigest() for r in mine)
    whole = {r.transcript: (r.sha, r.n_bytes) for r in export.digests(export.as_chunks(rows, limit=5000)).collect()}
    assert whole == {k: (hashlib.sha256(x).hexdigest(), len(x)) for k, x in want.items()}


def test_files_of_a_busy_owner_are_bounded(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id as event_id", "1L as user_id", "'{\"k\": 1}' as props").write.parquet(str(tmp_path / "events.parquet"))
    spark.range(1000).selectExpr("id as o_orderkey", "2L as o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    seen, split = [], capture_queries.transcripts.split_lines
    monkeypatch.setattr(capture_queries.transcripts, "split_lines", lambda files: seen.append(files) or split(files))
    monkeypatch.setattr(capture_queries, "FILE_ROWS", 100)
    assert capture_queries.reassembled(spark, str(tmp_path)).collect() == [(1, 2000, 250 * (20 + 9 + 19 + 23))]
    assert capture_queries.torn(spark, str(tmp_path)).collect() == [(2, 999)]
    assert [f.count() for f in seen] == [10, 10]
