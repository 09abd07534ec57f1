"""The rules for all record types come from one table of kinds."""

import json

from quillhouse.operators import records


def test_each_type_and_level(spark):
    cases = {
        '{"type":"mode","mode":7}': ["mode"],
        '{"type":"mode","mode":null}': [],
        '{"type":"queue-operation","content":{},"timestamp":[]}': ["content", "timestamp"],
        '{"type":"file-history-snapshot","snapshot":[1],"isSnapshotUpdate":"maybe"}': ["isSnapshotUpdate"],
        '{"type":"system","durationMs":"12","retryInMs":"2.5","hasOutput":"Yes","error":{"a":1}}': [],
        '{"type":"system","durationMs":2.5,"retryInMs":"x","hasOutput":7}': ["durationMs", "hasOutput", "retryInMs"],
        '{"type":"attachment","attachment":17,"isMeta":{}}': ["isMeta"],
        '{"type":"user"}': ["message"],
        '{"type":"user","message":"x"}': ["message"],
        '{"type":"user","message":{}}': ["message.content"],
        '{"type":"user","message":{"content":"x","role":1}}': ["message.role"],
        '{"type":"user","message":{"content":[1]}}': ["message.content[]"],
        '{"type":"user","message":{"content":[{"type":"new kind","zz":1},{"type":7},{}]}}': ["message.content[].type"],
        '{"type":"assistant","message":{"content":"x"}}': ["message.content"],
        '{"type":"assistant","message":{"content":[{"type":"tool_use","name":null,"input":[]},{"type":"thinking","thinking":null}],"usage":{"input_tokens":"x","output_tokens":true}}}':
            ["message.content[].id", "message.content[].input", "message.content[].name", "message.content[].thinking", "message.usage.input_tokens"],
        '{"type":"mystery","message":7}': [],
    }
    rows = spark.createDataFrame([(t, bytearray(t.encode())) for t in cases], "t string, raw binary")
    got = {r.t: sorted(r.bad_paths) for r in records.parse(rows).select("t", "bad_paths").collect()}
    assert got == cases and all(json.loads(t) for t in cases)


def test_every_declared_type_has_a_kind_for_each_field():
    table = records.schema()
    assert set(records.DECLARED) <= set(table) and len(records.DECLARED) == 14
    assert all(kind.rstrip("!") in ("text", "bool", "int", "float", "dict", "list", "text or list", "any") for fields in table.values() for kind in fields.values())
    assert {f for p, fields in records.KINDS.items() if p for f in fields} <= {f for fields in table.values() for f in fields}
