"""Drift of thin records."""

import json

from quillhouse.operators import records


def test_thin_records_declare_their_own_fields_only(spark):
    plain = {"type": "mode", "sessionId": "s", "mode": "m"}
    cases = [plain, plain | {"uuid": "u", "cwd": "/"}, plain | {"message": {}}, {"type": "queue-operation", "sessionId": "s", "timestamp": "t"}]
    rows = spark.createDataFrame([("t", i, bytearray(json.dumps(c).encode())) for i, c in enumerate(cases)], "transcript string, line_number int, raw binary")
    got = {r.line_number: (r.status, [(a.kind, a.detail) for a in r.anomalies]) for r in records.parse(rows).collect()}
    assert got == {0: ("ok", []), 1: ("partial", [("unknown_field", "cwd,uuid")]), 2: ("partial", [("unknown_field", "message")]), 3: ("ok", [])}
