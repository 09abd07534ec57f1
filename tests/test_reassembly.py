"""Joining by blocks of lines against a loop over a file's bytes."""

import json
import random
from collections import defaultdict

import pytest

from quillhouse.sources import reassembly, transcripts


def _scan(line: bytes, state: tuple[int, bool, bool]) -> tuple[tuple[int, bool, bool], bool]:
    """Brackets open after a line, and whether it ends inside a string or after an escape; and whether more were closed than opened."""
    depth, in_string, escaped = state
    below = False
    for ch in line:
        if escaped:
            escaped = False
        elif in_string:
            escaped, in_string = ch == 0x5C, ch != 0x22
        elif ch == 0x22:
            in_string = True
        elif ch in b"{[":
            depth += 1
        elif ch in b"}]":
            depth -= 1
            below = below or depth < 0
    return (depth, in_string, escaped), below


def _is_json(raw: bytes) -> bool:
    try:
        json.loads(raw)
    except ValueError:
        return False
    return True


def _joined_from(raws: list[bytes], first: int) -> int | None:
    """How many lines the record has that opens at ``first``: one where joining fails, ``None`` where the file ends before it closes.

    Joining fails at a bracket too many, beyond the caps, if the brackets are closed and it is no JSON, or where a line of
    its own begins: one that starts with ``{`` and is whole.
    """
    state, size, n = (0, False, False), 0, 0
    for raw in raws[first:]:
        if n and raw.startswith(b"{") and _is_json(raw):
            return 1
        state, below = _scan(raw, state)
        size, n = size + len(raw), n + 1
        if below or (n > 1 and (n > reassembly.MOST_LINES or size > reassembly.MOST_BYTES)):
            return 1
        if state[0] == 0:
            return n if n > 1 and _is_json(b"".join(raws[first : first + n])) else 1
    return None


def _reassemble(raws: list[bytes]) -> list[tuple[int, int]]:
    """``(first line, number of lines)`` of each record; an attempt that fails leaves its first line alone and starts again after it.

    Lines of an attempt still open at the end of the file, and a last line without its end that is no JSON, are left out:
    they wait for more.
    """
    out, i = [], 0
    while i < len(raws):
        n: int | None = 1
        if not _is_json(raws[i]):
            if not raws[i].endswith(b"\n"):
                break
            if raws[i].lstrip().startswith(b"{"):
                n = _joined_from(raws, i)
        if n is None:
            break
        out.append((i, n))
        i += n
    return out


def file_of(r, n):
    """Lines of all kinds, printed records among them, some broken off or with brackets that do not fit."""
    out = []
    for _ in range(n):
        record = {"a": [1, {"b": 'x } " { [', "c": {}}], "d": {"e": [[], [{"f": 1}]]}, "g": [{"h": 2}, {"i": [{"j": 3}]}]}
        pretty = json.dumps(record, indent=r.choice([1, 2])) + "\n"
        kind = r.randrange(12)
        if kind < 3:
            out.append(json.dumps(record) + "\n")
        elif kind < 7:
            out.append(pretty)
        elif kind < 8:
            parts = pretty.splitlines(keepends=True)
            out.append("".join(parts[: r.randrange(1, len(parts))]))
        elif kind < 9:
            parts = pretty.splitlines(keepends=True)
            parts.insert(r.randrange(len(parts)), r.choice(["}\n", "]}}\n", '"\n', "{\n", "\\\n", '{"k": 1}\n', "\n", '  {"k": 1}\n']))
            out.append("".join(parts))
        else:
            out.append(r.choice(["\n", "  \n", "no json\n", "12\n", "{ broken }\n", '{"open": "\n', "  {\n", "}\n", '{"x": "a\\\\"}\n', "\xff{\n"]))
    text = "".join(out)
    return (text[: r.randrange(len(text) + 1)] if r.random() < 0.6 else text).encode("latin-1")


def expected(content):
    raws = content.splitlines(keepends=True) if b"\r" not in content else None
    ends, at = [], 0
    for x in raws:
        at += len(x)
        ends.append(at)
    return [(k, ends[i] - len(raws[i]), ends[i + n - 1], b"".join(raws[i : i + n])) for k, (i, n) in enumerate(_reassemble(raws))]


def run(spark, files):
    rows = spark.createDataFrame(list(files.items()), "path string, content binary").repartition(3)
    got = defaultdict(list)
    for x in transcripts.reassembled(transcripts.split_lines(rows)).collect():
        got[x.path].append((x.line_number, x.start_offset, x.end_offset, bytes(x.raw)))
    return {p: sorted(got[p]) for p in files}


@pytest.mark.parametrize(("most_lines", "most_bytes"), [(1000, 1 << 20), (6, 1 << 20), (40, 150)])
def test_as_the_loop(spark, monkeypatch, most_lines, most_bytes):
    monkeypatch.setattr(reassembly, "MOST_LINES", most_lines)
    monkeypatch.setattr(reassembly, "MOST_BYTES", most_bytes)
    r = random.Random(most_lines)
    files = {f"f{i}": file_of(r, r.choice([1, 2, 3, 8, 40])) for i in range(120)}
    files |= {"none": b"", "hot": file_of(r, 400), "nested": b"{\n" * 300 + b"}\n" * 300, "deep": b'{"a":\n' * 300 + b"1\n" + b"}\n" * 300}
    assert run(spark, files) == {p: expected(c) for p, c in files.items()}


def test_transitions():
    r = random.Random(7)
    for _ in range(3000):
        line = "".join(r.choice('{}[]""\\ab') for _ in range(r.randrange(14))).encode() + b"\n"
        for inside, (net, low, opens) in zip((False, True), (reassembly.transitions(line)[:3], reassembly.transitions(line)[3:]), strict=True):
            (depth, string, escaped), below = _scan(line, (0, inside, False))
            assert (net, opens, low < 0) == (depth, string, below) and not escaped
    assert reassembly.transition(b'{"' + b'\\n' * 300_000 + b'"\n') == (1, 0, False)


def test_no_lines(spark):
    assert transcripts.reassembled(transcripts.split_lines(spark.createDataFrame([], "path string, content binary"))).count() == 0


def test_reassembly_gives_up_and_waits():
    join = _reassemble
    assert join([b"{\n", b'"a":1\n', b"}\n", b"{x\n", b"y}\n", b'{"k":\n']) == [(0, 3), (3, 1), (4, 1)]
    assert join([b'{"k":\n', b'"v",\n']) == [] and join([b"{\n"]) == []
    assert join([b'{"a":[\n', b'{"type":"user"}\n', b"]}\n"]) == [(0, 1), (1, 1), (2, 1)]
    assert join([b'{"a":[\n', b' {"type":"user"}\n', b"]}\n"]) == [(0, 3)]
    assert join([b"[\n", b"1\n", b"]\n"]) == [(0, 1), (1, 1), (2, 1)]
    assert join([b'{"a": "}{\\"",\n', b' "b": 1}\n', b"}\n", b'{"torn": tru']) == [(0, 2), (2, 1)]
    assert join([b"{\n", *[b"1,\n"] * 1200, b"}\n"])[0] == (0, 1)


@pytest.mark.parametrize("held", [0, 200])
def test_blocks_with_too_many_bytes_are_joined_by_spark(spark, monkeypatch, held):
    monkeypatch.setattr(reassembly, "MOST_LINES", 40)
    monkeypatch.setattr(reassembly, "HELD_BYTES", held)
    r = random.Random(held)
    files = {f"f{i}": file_of(r, r.choice([1, 3, 40])) for i in range(30)}
    assert run(spark, files) == {p: expected(c) for p, c in files.items()}


def test_lines_are_sorted_once_in_a_stage(spark):
    files = spark.createDataFrame([("f", bytearray(b'{\n"a": 1\n}\n' * 50))], "path string, content binary")
    plans = []

    def keep(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return transcripts.table(df, name)

    out = reassembly.reassembled(transcripts.split_lines(files), keep)
    assert out.count() == 50
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    for plan in plans:
        sorts = 0
        for node in plan.split("\n"):
            sorts = 0 if "Exchange" in node else sorts + (" Sort [" in node)
            assert sorts <= 1, plan


def test_files_are_cut_where_they_are_read(spark, monkeypatch):
    monkeypatch.setattr(transcripts, "SPLIT_ROWS", 3)
    contents = [b"a\n\nb", b"", None, b"\n", b"\xff\r\n" * 10, b"", b"x", None]
    rows = [(f"f{i}", c if c is None else bytearray(c), None if i % 2 else i) for i, c in enumerate(contents)]
    lines = transcripts.split_lines(spark.createDataFrame(rows, "path string, content binary, other int").coalesce(1))
    want = []
    for path, content, other in rows:
        at = 0
        for k, x in enumerate(bytes(content or b"").splitlines(keepends=True) if path != "f4" else [b"\xff\r\n"] * 10):
            want.append((path, other, k, x, at, at := at + len(x)))
    assert [(x.path, x.other, x.line_number, bytes(x.raw), x.start_offset, x.end_offset) for x in lines.collect()] == want
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
