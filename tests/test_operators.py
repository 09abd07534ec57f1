"""Operators on small invented transcripts: parsing, rules, capture, search, governance."""

import json

import pytest
from pyspark.sql import functions as F

from quillhouse.functions import text as fn
from quillhouse.operators import authorship, blocks, governance, records, search, sessions
from quillhouse.sources import export, transcripts
from quillhouse.streaming import segments

UUID = "00000000-0000-0000-0000-00000000000a"


def line_rows(spark, *raws):
    rows = [("t", "s", "main", i, r if isinstance(r, (bytes, bytearray)) else bytearray(json.dumps(r).encode() + b"\n")) for i, r in enumerate(raws)]
    return spark.createDataFrame([(a, b, c, d, bytearray(e)) for a, b, c, d, e in rows], "transcript string, session_uuid string, kind string, line_number int, raw binary")


def test_parse_outcomes(spark):
    user = {"type": "user", "uuid": "u", "message": {"role": "user", "content": "hi"}}
    got = {r.line_number: (r.status, [(a.severity, a.kind) for a in r.anomalies]) for r in records.parse(line_rows(
        spark, user, user | {"novel": 1}, {"type": "mystery"}, b"{broken", b"  \n", b"\xff\xfe\n", {"type": "user", "message": {"role": "user", "content": 17}}, {"type": "user"},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "x"}]}}, user | {"message": {"role": "user", "content": "x", "odd": 1}}, b"[1]\n",
        b'{"type":"user","message":{"role":"user","content":"x"}} {"more":1}\n',
    )).collect()}
    assert got[0] == ("ok", []) and got[1] == ("partial", [("info", "unknown_field")]) and got[2] == ("partial", [("warn", "unknown_record_type")])
    assert got[3] == got[5] == got[10] == got[11] == ("anomaly", [("error", "invalid_json")]) and got[4] == ("partial", [("info", "whitespace_line")])
    assert got[6] == got[7] == got[8] == ("anomaly", [("error", "validation_error")]) and got[9] == ("partial", [("info", "unknown_field")])


def test_blocks_and_authorship(spark):
    said = lambda **k: {"type": "user", "message": {"role": "user", "content": k.pop("content", "hello")}, **k}
    tool = {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "go"}, {"type": "tool_use", "id": "t1", "name": "Skill", "input": {"skill": "x"}}, {"type": "thinking", "thinking": "hm"}], "usage": {"input_tokens": 3}}}
    cases = [
        (said(isCompactSummary=True), "compact_summary"), (said(content=[{"type": "tool_result", "tool_use_id": "t1", "content": ["a", {"type": "text", "text": "b"}]}]), "tool_result"),
        (said(toolUseResult={"a": 1}), "tool_result"), (said(sourceToolUseID="t1"), "skill_injection"), (said(sourceToolUseID="zz"), "tool_injection"), (said(origin={"kind": "task-notification"}), "task_notification"),
        (said(promptSource="system"), "task_notification"), (said(origin={"kind": "coordinator"}), "coordinator"), (said(promptSource="typed"), "human_typed"), (said(promptSource="queued"), "human_queued"),
        (said(promptSource="sdk"), "sdk_automation"), (said(content="<command-name> /x </command-name>"), "command_expansion"), (said(content="<local-command-stdout>"), "command_output"), (said(isMeta=True), "harness_meta"),
        (said(content="[Request interrupted by user]"), "interrupt_marker"), (said(isSidechain=True), "dispatch"), (said(promptSource="new"), "unclassified"), (said(version="2.1.99"), "human_inferred"),
        (said(version="2.1.168"), "unclassified"), (said(version="2.x"), "unclassified"), (said(origin={"kind": "human"}, version="2.1.99"), "human_inferred"), (said(content="", version="2.1.99"), "human_inferred"),
        (said(content=[{"type": "text", "text": ""}], version="2.1.99"), "human_inferred"), (said(content=[{"type": "thinking", "thinking": "x"}], version="2.1.99"), "unclassified"), (said(origin={"kind": "odd"}, version="2.1.99"), "unclassified"),
        (said(isMeta=True, content="<local-command-caveat>x"), "harness_meta"), (said(isMeta=True, content="Caveat: x"), "harness_meta"), (said(content="[Request interrupted by user for tool use]"), "interrupt_marker"), (tool, "claude"), ({"type": "system", "subtype": "s"}, "system"),
        ({"type": "attachment", "attachment": {"type": "queued_command", "commandMode": "prompt", "origin": {"kind": "human"}, "prompt": "p"}}, "attachment_queued_human"), ({"type": "attachment", "attachment": {}}, "attachment_furniture"),
    ]
    base = blocks.with_blocks(records.envelope(records.parse(line_rows(spark, *[c for c, _ in cases]))))
    rows = blocks.block_rows(base)
    found = authorship.classify(base, authorship.tool_calls(rows)).collect()
    tool_line = next(i for i, (_, want) in enumerate(cases) if want == "claude")
    got = {r.line_number: (r.author, r.detail) for r in authorship.classify(base, authorship.tool_calls(rows)).collect()}
    assert {i: a for i, (a, _) in got.items()} == {i: want for i, (_, want) in enumerate(cases)}
    assert got[1][1] == "Skill" and got[3][1] == "x" and got[11][1] == "/x" and [got[i][1] for i in (24, 25, 26, 27)] == ["odd", "caveat", None, "tool"]
    assert {r.basis.split(" — ")[0] for r in found} == {"verified", "heuristic"} and all(r.basis.split(" — ")[1] for r in found)
    assert next(r.basis for r in found if r.line_number == 3) == "verified — sourceToolUseID → Skill"
    by = {(r.line_number, r.block_index): r for r in rows.collect()}
    assert by[1, 0].text == "a\nb" and by[tool_line, 2].kind == "thinking" and blocks.usage_rows(records.parse(line_rows(spark, tool))).first().input_tokens == 3


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    main = root / "-p-one" / f"{UUID}.jsonl"
    agent = root / "-p-one" / UUID / "subagents" / "agent-0f.jsonl"
    agent.parent.mkdir(parents=True)
    main.write_bytes(b'{"type":"user"}\n{\n "a": "}{",\n "b": [1]\n}\n{"torn": tru')
    agent.write_bytes(b'{"x":1}\r\n\xff\n{"whole":1}')
    agent.with_name("agent-0f.meta.json").write_text('{"agentType": "t", "description": "d", "toolUseId": "u"}')
    (root / "-p-one" / f"{UUID}.jsonl.bak-7").write_bytes(b'{"type":"user"}\n')
    (root / "-p-one" / "notes.txt").write_text("no")
    return root, main, agent


def test_capture_is_incremental(spark, tree, tmp_path):
    root, main, agent = tree
    archive = str(tmp_path / "archive")
    first = transcripts.capture(spark, str(root), archive, "r1")
    got = {r.path.rsplit("/", 1)[1]: r.content for r in export.as_bytes(first, "path").collect()}
    assert bytes(got["agent-0f.jsonl"]) == agent.read_bytes() and first.where("path like '%.jsonl' and kind = 'main'").count() == 2
    assert bytes(got[main.name]) == b'{"type":"user"}\n{\n "a": "}{",\n "b": [1]\n}\n'
    assert transcripts.capture(spark, str(root), archive, "r2").count() == 0
    with main.open("ab") as f:
        f.write(b"e}\n")
    third = transcripts.capture(spark, str(root), archive, "r3").collect()
    assert [(bytes(r.raw), r.action) for r in third] == [(b'{"torn": true}\n', "grown")]
    main.write_bytes(b'{"other":1}\n')
    assert [(r.action, r.generation) for r in transcripts.capture(spark, str(root), archive, "r4").collect()] == [("diverged", 1)]
    files = transcripts.classify_paths(transcripts.listing(spark, str(root)))
    side = {r.kind: r.agent_type for r in transcripts.sidecars(spark, str(root), files.where("not is_backup")).collect()}
    assert side == {"main": None, "subagent": "t"} and files.count() == 3
    wall = spark.createDataFrame([("-p-one",)], "project_slug string")
    assert transcripts.behind_walls(files, wall, spark.createDataFrame([], "session_uuid string")).count() == 0
    assert transcripts.behind_walls(files, sessions=spark.createDataFrame([(UUID,)], "session_uuid string")).count() == 0
    assert transcripts.capture(spark, str(root), archive, "007").count() == 0


def test_walls_keep_files_shut(spark, tree, tmp_path):
    root, main, _ = tree
    other = root / "-p-two" / f"{UUID[:-1]}b.jsonl"
    other.parent.mkdir()
    other.write_bytes(b'{"type":"user"}\n')
    files = transcripts.classify_paths(transcripts.listing(spark, str(root)))

    def opened(df):
        """How many files the scan of contents read."""
        df.collect()
        plan, seen = [df._jdf.queryExecution().executedPlan()], []
        while plan:
            node = plan.pop()
            while "AdaptiveSparkPlan" in node.nodeName() or "QueryStage" in node.nodeName():
                node = node.executedPlan() if "AdaptiveSparkPlan" in node.nodeName() else node.plan()
            kids = node.children()
            plan += [kids.apply(i) for i in range(kids.size())]
            if "binaryFile" in node.nodeName() and "content" in node.output().mkString(","):
                seen.append(node.metrics().apply("numFiles").value())
        return seen

    wall = spark.createDataFrame([("-p-one",)], "project_slug string")
    assert opened(transcripts.contents(spark, str(root), files)) == [4]
    assert opened(transcripts.contents(spark, str(root), files, projects=wall)) == [1]
    got = transcripts.capture(spark, str(root), str(tmp_path / "walled"), "007", projects=wall)
    assert {r.path.rsplit("/", 1)[1] for r in got.collect()} == {other.name}
    one = spark.createDataFrame([(other.stem,)], "session_uuid string")
    assert transcripts.capture(spark, str(root), str(tmp_path / "walled2"), "1", sessions=one).where("project_slug = '-p-two'").count() == 0
    side = transcripts.sidecars(spark, str(root), files.where("not is_backup"), projects=wall)
    assert {r.agent_type for r in side.collect()} == {None}


def test_a_file_that_cannot_be_read_stops_no_run(spark):
    loaded = spark.createDataFrame([("a", bytearray(b"x\n")), ("b", None)], "path string, content binary")
    good, failed = transcripts.readable(loaded)
    assert [r.path for r in good.collect()] == ["a"] and [(r.path, r.severity, r.kind) for r in failed.collect()] == [("b", "error", "file_ingest_failure")]


def test_same_bytes_however_they_are_split(spark):
    lines = lambda parts: spark.createDataFrame([("f", i, bytearray(x)) for i, x in enumerate(parts)], "path string, line_number long, raw binary")
    for other, want in (([b"ab", b"cdef\n"], True), ([b"abcdef"], False), ([b"abcdeg\n"], False)):
        assert governance.same_bytes(lines([b"abc", b"def\n"]), lines(other)).first().may_swap == want
    cut = export.pieces(lines([b"abc", b"", b"defghij"]), "path", 4).orderBy("block").collect()
    import hashlib

    assert [r.sha for r in cut] == [hashlib.sha256(x).hexdigest() for x in (b"abcd", b"efgh", b"ij")]


def test_export_writes_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", i, bytearray(b"%d\n" % i)) for i in range(5)] + [("b", 0, bytearray(b"x"))], "transcript string, line_number int, raw binary")
    out = {r.transcript: r for r in export.write_files(rows, str(tmp_path / "out")).collect()}
    assert out["a"].n_bytes == 10 and open(out["a"].path, "rb").read() == b"0\n1\n2\n3\n4\n"
    open(out["b"].path, "wb").write(b"kept")
    export.write_files(rows, str(tmp_path / "out")).collect()
    assert open(out["b"].path, "rb").read() == b"kept"


def test_query_terms_never_fail(spark):
    cases = {'a "b c" d': [["b", "c"], ["a"], ["d"]], 'odd " quote': [["odd"], ["quote"]], "foo_bar": [["foo", "bar"]], '""': [], "*)(": [], "": []}
    rows = spark.createDataFrame([(q,) for q in cases] + [(None,)], "q string").select("q", fn.query_terms(F.col("q")).alias("t")).collect()
    for r in rows:
        assert sorted(r.t) == sorted(cases.get(r.q, []))


def test_search_ranks_and_snippets(spark):
    b = spark.createDataFrame([("k1", "text", "the cat sat on the mat"), ("k2", "text", "a cat"), ("k3", "text", "dogs and the cat of Zoë"), ("k4", "text", "")], "block_key string, kind string, text string")
    b = search.indexed(b)
    posts = search.postings(b)
    asked = spark.createDataFrame([(1, "cat the"), (2, '"the cat"'), (3, "")], "query_id int, q string").select("query_id", fn.query_terms(F.col("q")).alias("phrases"))
    hits = {(r.query_id, r.block_key) for r in search.search(asked, posts, b, search.statistics(posts, b)).collect()}
    assert hits == {(1, "k1"), (1, "k3"), (2, "k1"), (2, "k3")}
    assert b.where("block_key = 'k1'").select(search.snippet(F.col("text"), F.array(F.lit("mat")), 3)).first()[0] == "…<mark>mat</mark>"
    words = search.vocabulary(posts)
    assert {r.stem for r in words.where("term in ('dogs', 'zoë')").collect()} == {"dog", "zoe"}
    forms = spark.createDataFrame([(1, "dog ZOE"), (2, '"and cats"'), (3, '"the cats of"')], "query_id int, q string").select("query_id", fn.query_terms(F.col("q")).alias("phrases"))
    stats = search.statistics(posts, b)
    assert {(r.query_id, r.block_key) for r in search.search(forms, posts, b, stats, words=words).collect()} == {(1, "k3"), (3, "k3")}
    assert search.search(forms, posts, b, stats).count() == 0
    with pytest.raises(ValueError):
        search.in_sources(posts, ["nowhere"])


def test_views_pages_overlays(spark):
    with pytest.raises(ValueError):
        sessions.view_filter("other", spark.range(1), spark.range(1))
    rows = spark.createDataFrame([("b", None), ("a", None), ("c", 5)], "session_uuid string, last_seconds long")
    assert [r.session_uuid for r in sessions.page(rows, sessions.session_order()).collect()] == ["c", "a", "b"]
    log = spark.createDataFrame([("s", "set", "x", 1), ("s", "set", "y", 2), ("t", "set", "z", 1), ("t", "remove", None, 3)], "session_uuid string, op string, value string, at int")
    assert [tuple(r) for r in governance.current(log).collect()] == [("s", "y")]
    view = spark.createDataFrame([("t", i) for i in range(0, 40, 2)], "transcript string, line_number int")
    got = sessions.around(view, spark.createDataFrame([("t", 20), ("t", 21)], "transcript string, target int"), 4).orderBy("ordinal").collect()
    assert [r.line_number for r in got] == [16, 18, 20, 22]


def test_stream_takes_each_record_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"type":"user","uuid":"1","sessionId":"s","message":{"role":"user","content":"x"}}\n' * 2)
    for _ in range(2):
        segments.ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_registry_is_complete():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "fts_search_sessions" in entry.queries()


def test_recapture_of_lines_that_know_their_places(spark):
    def lines(parts, at=None):
        rows, here = [], 0
        for i, x in enumerate(parts):
            rows.append(("f", i, here if at is None else at[i], bytearray(x), i == 0))
            here += len(x)
        return spark.createDataFrame(rows, "path string, line_number long, start_offset long, raw binary, is_anomaly boolean")

    before = lines([b"abc\n", b"def\n"])
    for other, want in ((lines([b"abc\ndef\n"]), True), (lines([b"abc\n"]), False), (lines([b"abd\n", b"def\n"]), False), (lines([b"def\n", b"abc\n"]), False), (lines([b"def\n"], [4]), False)):
        got = governance.recapture_counters(before, other).first()
        assert (got.reconciled, got.records_after, got.anomalies_before) == (want, other.count() if want else 2, 1)
    plan = export.pieces(before, "path")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
