"""Walls with reasons, previews, cascades in snapshots, and places in a hot transcript, each against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from quillhouse.functions import text as fn
from quillhouse.operators import governance, sessions

LOG = [
    ("project", "p1", "add", "first", 1), ("project", "p1", "add", "again", 2), ("project", "p1", "remove", None, 3), ("project", "p1", "remove", None, 4), ("project", "p1", "add", "back", 5),
    ("session", "s1", "remove", None, 1), ("session", "s1", "add", None, 2), ("project", "p9", "add", "unknown", 1), ("session", "p1", "add", "a session of that name", 9), ("session", "p1", "remove", None, 10),
]


def test_exclusions(spark):
    log = spark.createDataFrame(LOG, "kind string, target string, op string, reason string, at long")
    held = spark.createDataFrame([("s1", "p1"), ("s2", "p1"), ("s2", "p1"), ("s3", "p2")], "session_uuid string, project_slug string")
    got = {(r.kind, r.target, r.at): (r.changed, r.prior_sessions) for r in governance.exclusion_changes(log, held).collect()}
    assert got == {
        ("project", "p1", 1): (True, 2), ("project", "p1", 2): (False, 0), ("project", "p1", 3): (True, 0), ("project", "p1", 4): (False, 0), ("project", "p1", 5): (True, 2),
        ("session", "s1", 1): (False, 0), ("session", "s1", 2): (True, 0), ("project", "p9", 1): (True, 0), ("session", "p1", 9): (True, 0), ("session", "p1", 10): (True, 0),
    }
    assert sorted(map(tuple, governance.exclusions(log).collect())) == [("project", "p1", "back", 5), ("project", "p9", "unknown", 1), ("session", "s1", None, 2)]
    # Of an exclusion that is repeated the first reason stays.
    assert governance.exclusions(log.where("at <= 2 and target = 'p1'")).first()["reason"] == "first"
    assert governance.exclusion_changes(log.limit(0), held).count() == 0 and governance.exclusions(log.limit(0)).count() == 0


def test_deletion_previews(spark):
    targets = spark.createDataFrame([("project", "p1", "p1", "s1"), ("project", "p1", "p1", "s2"), ("session", "s1", "Title", "s1"), ("project", "empty", "empty", None)], "kind string, target string, label string, session_uuid string")
    records = spark.createDataFrame([("s1",)] * 3 + [("s2",)] + [("s4",)], "session_uuid string")
    sources = spark.createDataFrame([("s1", "/a"), ("s1", "/b"), ("s2", "/c"), ("s2", "/c"), ("s4", "/d")], "session_uuid string, path string")
    disk = spark.createDataFrame([("/a",), ("/c",), ("/c",), ("/d",), ("/z",)], "path string")
    got = sorted(map(tuple, governance.deletion_preview(targets, records, sources, disk).collect()))
    assert got == [("project", "empty", "empty", 0, 0, 0), ("project", "p1", "p1", 2, 4, 2), ("session", "s1", "Title", 1, 3, 1)]
    assert sorted(map(tuple, governance.paths_present(targets, sources, disk).collect())) == [("project", "p1", "/a"), ("project", "p1", "/c"), ("session", "s1", "/a")]


def test_cascade_in_snapshots(spark):
    rows = {
        "records": spark.createDataFrame([("n1", "s1")] * 2 + [("n2", "s1"), ("n2", "s2"), ("n3", "s2")], "snapshot string, session_uuid string"),
        "titles": spark.createDataFrame([("n3", "s1"), ("n3", "s3"), ("n1", "s2")], "snapshot string, session_uuid string"),
    }
    doomed = spark.createDataFrame([("s1",), ("s1",), ("s7",)], "session_uuid string")
    left, ledger = governance.scrub_snapshots(rows, doomed, "why")
    assert sorted(map(tuple, left["records"].select("snapshot", "session_uuid").collect())) == [("n2", "s2"), ("n3", "s2")]
    assert sorted(map(tuple, left["titles"].select("snapshot", "session_uuid").collect())) == [("n1", "s2"), ("n3", "s3")]
    assert sorted((r.snapshot, r.reason, r.n_records) for r in ledger.collect()) == [("n1", "why", 2), ("n2", "why", 1), ("n3", "why", 0)]
    assert not {"s1", "why"} & {r.label_sha for r in ledger.collect()}


def test_prefills(spark):
    rows = spark.createDataFrame([("u", "c", "a"), (None, "c", "a"), (None, "c", None), (None, None, None), ("", "c", "a")], "u string, c string, a string")
    assert [r[0] for r in rows.select(fn.prefill_title(F.col("u"), F.col("c"), F.col("a"))).collect()] == ["u", "a", "c", "", ""]


@pytest.mark.parametrize("run_lines", [1, 7, 4096])
def test_places(spark, monkeypatch, run_lines):
    monkeypatch.setattr(sessions, "RUN_LINES", run_lines)
    r = random.Random(run_lines)
    lines = {"hot": sorted(r.sample(range(400), 150)), "one": [5], "far": [0, 9000, 9001]}
    view = spark.createDataFrame([(t, n, "x") for t, x in lines.items() for n in x], "transcript string, line_number long, other string").repartition(3)
    got = {(x.transcript, x.line_number): (x.at, x.previous_line, x.next_line) for x in sessions.in_places(view, "at").collect()}
    assert got == {(t, n): (i, x[i - 1] if i else None, x[i + 1] if i + 1 < len(x) else None) for t, x in lines.items() for i, n in enumerate(x)}
    page = sorted((x.transcript, x.line_number) for x in sessions.message_page(view, 3, 1).collect())
    assert page == sorted((t, n) for t, x in lines.items() for n in x[1:4])
    targets = spark.createDataFrame([("hot", lines["hot"][70]), ("far", 0), ("one", 6)], "transcript string, target long")
    around = sorted((x.transcript, x.target, x.line_number) for x in sessions.around(view, targets, 5).collect())
    assert around == sorted([("hot", lines["hot"][70], n) for n in lines["hot"][68:73]] + [("far", 0, n) for n in lines["far"]])
