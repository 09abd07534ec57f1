"""Lines by ranges of bytes against whole files, wherever ranges are cut."""

import hashlib
import random

import pytest

from quillhouse.sources import ranges, transcripts


@pytest.fixture
def files(tmp_path):
    r = random.Random(3)
    out = {"empty": b"", "end": b"\n", "one": b"abc", "bom": b"\xef\xbb\xbfa\r\nb\n", "ends": b"\n\n\na\n\n", "torn": b"a\nb\nc", "long": b"x" * 500 + b"\n" + b"y" * 700}
    for i in range(3):
        out[f"some{i}"] = b"".join(bytes(r.randrange(256) for _ in range(r.choice([0, 1, 3, 40, 90]))) + b"\n" for _ in range(r.choice([5, 30])))
    for name, content in out.items():
        (tmp_path / name).write_bytes(content)
    return {f"{tmp_path}/{name}": content for name, content in out.items()}


def lines_of(content, start=0):
    out, at = [], start
    for x in content[start:].split(b"\n"):
        out.append((at, at + len(x) + 1, x + b"\n"))
        at += len(x) + 1
    out[-1] = (out[-1][0], out[-1][1] - 1, out[-1][2][:-1])
    return [(i, *x) for i, x in enumerate(out) if x[2]]


@pytest.mark.parametrize(("range_bytes", "read_bytes"), [(3, 7), (64, 5), (1000, 100), (1 << 26, 1 << 22)])
def test_every_way_to_cut(files, range_bytes, read_bytes, monkeypatch):
    monkeypatch.setattr(ranges, "READ_BYTES", read_bytes)
    monkeypatch.setattr(ranges, "BATCH_BYTES", 200)
    reader = ranges.LineRangesReader({"manifest": ""})
    for path, content in files.items():
        for start in {0, lines_of(content)[len(lines_of(content)) // 2][1] if content else 0}:
            parts = [p for x in ranges.dealt([(path, start, len(content))], range_bytes) for p in x.parts]
            assert [p[1] for p in parts[1:]] == [p[2] for p in parts[:-1]] and sum(p[2] - p[1] for p in parts) == len(content) - start
            got = []
            with ranges.open_file(path) as f:
                for p in parts:
                    rows = [x for b in reader._lines(f, *p) for x in b.to_pylist()]
                    assert [x["line_number"] for x in rows] == list(range(len(rows)))
                    assert next(reader._counts(f, *p)).to_pylist()[0]["n_lines"] == len(rows)
                    got += [(x["start_offset"], x["end_offset"], x["raw"]) for x in rows]
            assert got == [x[1:] for x in lines_of(content, start)]


def test_source(spark, files):
    rows = [(f"file:{p}" if i % 2 else p, None, len(c)) for i, (p, c) in enumerate(files.items())]
    found = spark.createDataFrame(rows, "path string, start long, length long")
    got = ranges.range_lines(found, range_bytes=100)
    expected = sorted((p, *x) for (p, _, _), c in zip(rows, files.values(), strict=True) for x in lines_of(c))
    assert sorted((x.path, x.line_number, x.start_offset, x.end_offset, bytes(x.raw)) for x in got.collect()) == expected
    chunks = ranges.chunk_digests(found, range_bytes=90, chunk_bytes=64)
    by = {(x.path, x.chunk): (x.sha, x.size, x.line_ends) for x in chunks.collect()}
    for (p, _, n), c in zip(rows, files.values(), strict=True):
        assert all(by[p, k] == (hashlib.sha256(c[64 * k : 64 * k + 64]).hexdigest(), len(c[64 * k : 64 * k + 64]), c[64 * k : 64 * k + 64].count(b"\n")) for k in range(-(-n // 64)))
    trees = {x.path: x for x in ranges.tree_digest(chunks).collect()}
    assert all(trees[p].prefix_bytes == n and trees[p].prefix_lines == c.count(b"\n") for (p, _, n), c in zip(rows, files.values(), strict=True) if n)
    assert ranges.range_lines(found.limit(0)).count() == 0
    with pytest.raises(Exception, match="not exist|No such file|nothing"):
        ranges.range_lines(spark.createDataFrame([("/nothing/here", 0, 5)], "path string, start long, length long")).count()


def test_only_what_is_asked_for_is_read(files):
    # A file of which only the tail is read from its line's first byte on.
    class Watched:
        def __init__(self, f):
            self.f, self.low = f, 1 << 60

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            self.low = min(self.low, self.f.tell())
            return self.f.read(n)

    path, content = next((p, c) for p, c in files.items() if p.endswith("some0"))
    _, start, *_ = lines_of(content)[-1]
    with ranges.open_file(path) as f:
        watched = Watched(f)
        assert sum(len(x) for _, x in ranges._Lines(watched, start, len(content), start, len(content))) == 1
        assert watched.low == start


def test_small_files_share_a_task():
    got = ranges.dealt([(f"f{i:02}", 0, 10) for i in range(20)] + [("z", 5, 1000)], 100)
    assert len(got) == 12 and sum(s - a for r in got for _, a, s, *_ in r.parts) == 1195
    assert all(a % 64 == 0 for r in ranges.dealt([("z", 0, 1000), ("a", 0, 30)], 100, 64) for _, a, *_ in r.parts)


def test_parts(spark, tmp_path):
    from quillhouse.sources import export, staging

    rows = [("hot/x", i, f"line {i} ".encode() * (i % 5) + b"\xff\n") for i in range(300)] + [("one", 0, b"a"), ("none", 0, b""), (None, 1, b"x")]
    lines = spark.createDataFrame(rows, "transcript string, line_number long, raw bytes".replace("bytes", "binary")).repartition(4)
    folder = f"file://{tmp_path}/out"
    got = {r.transcript: r for r in export.write_parts(lines, folder, staging.table, limit=500).collect()}
    assert set(got) == {"hot/x", "one"} and got["hot/x"].n_parts > 5
    whole = b"".join(x for _, _, x in rows[:300])
    there = tmp_path / "out" / "hot_x.jsonl"
    assert b"".join(p.read_bytes() for p in sorted(there.iterdir()) if not p.name.endswith(".crc")) == whole and got["hot/x"].n_bytes == len(whole)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["hot_x.jsonl", "one.jsonl"]
    # What is there stays.
    (tmp_path / "out" / "one.jsonl" / f"{0:020d}").write_bytes(b"kept")
    export.write_parts(lines, folder, staging.table, limit=500)
    assert (tmp_path / "out" / "one.jsonl" / f"{0:020d}").read_bytes() == b"kept" and len(list((tmp_path / "out").iterdir())) == 2
