"""Operator 11, collocations from a weighted de Bruijn graph: edges are the longest grams, nodes the two words that neighbours share; counts of shorter phrases come from the flow through nodes and from the ends of pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillhouse.llm.anchors import mix
from quillhouse.llm.common import partitions, table
from quillhouse.llm.lines import grouped

#: Bytes of text for each cell of the dealing, and edges that a task gathers before it sends them on.
CELL_BYTES, FLUSH = 16 << 20, 2_000_000
#: Stands for what ends a piece, among bytes and among word numbers.
_END, END = b"\xff", 0
_SENT = "cell int, lang string, n int, words binary, first binary, second binary, third binary, count binary"
_GRAPH = "kind int, lang string, first string, second string, third string, f long, node_f long, best long"
#: Kinds of rows of a graph.
EDGE, NODE, WORD = 0, 1, 2


def _byte_map() -> bytes:
    """A to Z in lower case, tabs as spaces, and every mark that ends a piece as one byte that no text has."""
    out = bytearray(range(256))
    out[0x41:0x5B] = range(0x61, 0x7B)
    out[0x09] = 0x20
    for b in b".,;:!?\n\x0b\x0c\r":
        out[b] = _END[0]
    return bytes(out)


_MAP = _byte_map()


def _tokens(text: str) -> list[bytes]:
    """Words, with ``_END`` behind each piece."""
    return (text.encode().translate(_MAP).replace(_END, b" \xff ") + b" \xff").split(b" ")


def _packed(x: np.ndarray) -> bytes:
    """Non-negative integers in 1, 2 or 4 bytes each, as the largest needs; what they take follows from the number of items."""
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _first_of(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


class _Lang:
    """Words of one language met by a task since it last sent, numbered, and its texts as these numbers."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {_END: END}
        self.held: list[np.ndarray] = []

    def add(self, tokens: list[bytes]) -> int:
        number = self.number
        for t in set(tokens).difference(number):
            number[t] = len(number)
        ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
        empty = number.get(b"")
        self.held.append(ids[ids != empty] if empty is not None else ids)
        return len(ids)

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(first, second, third, count)``: one edge for each word, of the word and the two behind it; ``END`` where the piece has none."""
        ids = np.concatenate([*self.held, np.zeros(2, np.int64)])
        one, two, three = ids[:-2], ids[1:-1], ids[2:].copy()
        three[two == END] = END
        on = one != END
        one, two, three = one[on], two[on], three[on]
        bits = max(1, int(len(self.number) - 1).bit_length())
        if 3 * bits < 64:
            key, count = np.unique((one << (2 * bits)) | (two << bits) | three, return_counts=True)
            mask = (1 << bits) - 1
            return key >> (2 * bits), (key >> bits) & mask, key & mask, count
        order = np.lexsort((three, two, one))
        one, two, three = one[order], two[order], three[order]
        at = np.flatnonzero(_first_of(one, two, three))
        return one[at], two[at], three[at], np.diff(np.append(at, len(one)))

    def send(self, lang: str, cells: int) -> Iterator[pa.RecordBatch]:
        """A row for each cell: edges are dealt by their first node, so that all edges that leave it meet."""
        one, two, three, count = self.edges()
        words = list(self.number)
        hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        cell = (mix(hashed[one] * np.uint64(0x9E3779B97F4A7C15) + hashed[two]) % np.uint64(cells)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        one, two, three, count, cell = (x[order] for x in (one, two, three, count, cell))
        cuts = np.append(np.flatnonzero(_first_of(cell)), len(cell)).tolist() if len(cell) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own, at = np.unique(np.concatenate((np.zeros(1, np.int64), one[lo:hi], two[lo:hi], three[lo:hi])), return_inverse=True)
            a, b, c = at[1:].reshape(3, -1)
            cols = [pa.array([int(cell[lo])], pa.int32()), pa.array([lang]), pa.array([hi - lo], pa.int32()), pa.array([b"\n".join([words[i] for i in own.tolist()])], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([_packed(x)], pa.binary()) for x in (a, b, c, count[lo:hi]))], [x.split()[0] for x in _SENT.split(", ")])


def _merged(parts: list[pa.RecordBatch]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a cell's rows in one numbering, and their edges put together, in order."""
    number: dict[bytes, int] = {}
    cols: list[list[np.ndarray]] = [[], [], [], []]
    for p in parts:
        for n, words, *arrays in zip(*(p.column(i).to_pylist() for i in range(2, 8)), strict=True):
            own = words.split(b"\n")
            for w in own:
                number.setdefault(w, len(number))
            here = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
            for k, raw in enumerate(arrays):
                x = _unpacked(raw, n)
                cols[k].append(x if k == 3 else here[x])
    one, two, three, count = (np.concatenate(x) for x in cols)
    order = np.lexsort((three, two, one))
    one, two, three, count = (x[order] for x in (one, two, three, count))
    at = np.flatnonzero(_first_of(one, two, three))
    return list(number), one[at], two[at], three[at], np.add.reduceat(count, at)


def _rows(lang: str, words: list[bytes], kind: int, grams: list[np.ndarray], f: np.ndarray, node_f: np.ndarray | None = None, best: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(f), 1 << 16):
        hi = min(len(f), lo + (1 << 16))
        n = hi - lo
        texts = [pa.array([words[i].decode() for i in g[lo:hi].tolist()], pa.string()) for g in grams] + [pa.nulls(n, pa.string())] * (3 - len(grams))
        rest = [pa.array(x[lo:hi], pa.int64()) if x is not None else pa.nulls(n, pa.int64()) for x in (f, node_f, best)]
        yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([lang] * n), *texts, *rest], [x.split()[0] for x in _GRAPH.split(", ")])


def _flow(lang: str, parts: list[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One cell: a node's count is the flow that leaves it, over edges and at the ends of pieces; a word's share is the flow of its nodes."""
    words, one, two, three, count = _merged(parts)
    end = words.index(_END)
    node = np.cumsum(_first_of(one, two)) - 1
    heads = np.flatnonzero(_first_of(one, two))
    flow = np.add.reduceat(count, heads)
    inner = (two != end) & (three != end)
    out = inner & (count >= least)
    yield from _rows(lang, words, EDGE, [one[out], two[out], three[out]], count[out], flow[node][out])
    best = np.maximum.reduceat(np.where(out, count, 0), heads)
    keep = (two[heads] != end) & (flow >= least)
    yield from _rows(lang, words, NODE, [one[heads][keep], two[heads][keep]], flow[keep], None, best[keep])
    start = np.flatnonzero(_first_of(one[heads]))
    yield from _rows(lang, words, WORD, [one[heads][start]], np.add.reduceat(flow, start))


def graph(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, least: int = 10, cells: int | None = None) -> DataFrame:
    """The weighted de Bruijn graph of all texts by language, as rows of three kinds.

    ``EDGE``: three words that follow each other in a piece ``f`` times, where ``f`` is ``least`` or more, and the count
    ``node_f`` of the node that it leaves. ``NODE``: two words with ``least`` or more, and the count ``best`` of the
    heaviest such edge that leaves it. ``WORD``: a share of a word's count; its shares sum up to all of them. Only edges are
    counted in the texts: every word begins one, which its piece's end may cut short, so the flow that leaves a node,
    with those ends, is how often the two words occur, and the flow of all nodes of a word how often it does.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    if cells is None:
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        cells = max(2 * partitions(spark), -(-size // CELL_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Lang] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size += held.setdefault(lang, _Lang()).add(_tokens(text))
                if size >= FLUSH:
                    for k, x in held.items():
                        yield from x.send(k, cells)
                    held, size = {}, 0
        for k, x in held.items():
            yield from x.send(k, cells)

    def flow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in grouped(batches):
            by: dict[str, list[pa.RecordBatch]] = {}
            for p in parts:
                for i, lang in enumerate(p.column(1).to_pylist()):
                    by.setdefault(lang, []).append(p.slice(i, 1))
            for lang, own in by.items():
                yield from _flow(lang, own, least)

    sent = rows.mapInArrow(send, _SENT).repartition(cells, "cell").sortWithinPartitions("cell")
    return sent.mapInArrow(flow, _GRAPH)


def compact(edges: DataFrame) -> DataFrame:
    """Unary paths: ``(lang, first, second, third, f, path, place)`` of the edges that lie on one, ``path`` the number of its first edge.

    ``edges`` has ``lang, first, second, third, f, node_f, to_f``, the counts of the edge and of the nodes at its two ends.
    An edge is unary where all three are equal: whatever enters leaves by it, so all phrases of a path occur equally
    often and one count stands for all. Neighbouring edges are linked and their distance to the head of the path is found
    by doubling, in as many rounds as the logarithm of the longest path; a path has no cycle, since a piece ends.
    """
    unary = edges.where("f = node_f and f = to_f")
    key = F.xxhash64("lang", "first", "second", "third")
    here = unary.select("lang", "first", "second", "third", "f", key.alias("edge"))
    back = here.select(F.col("lang"), F.col("second").alias("first"), F.col("third").alias("second"), F.col("edge").alias("head"))
    # Of a unary path's node only one edge leaves and one enters.
    chain = table(here.join(back, ["lang", "first", "second"], "left").select("lang", "first", "second", "third", "f", "edge", F.coalesce("head", "edge").alias("head"), F.col("head").isNotNull().cast("long").alias("place")), "paths")
    while True:
        up = chain.select(F.col("edge").alias("head"), F.col("head").alias("_up"), F.col("place").alias("_more")).where("_more > 0")
        if not chain.where("place > 0").join(up, "head", "left_semi").limit(1).count():
            return chain.select("lang", "first", "second", "third", "f", F.col("head").alias("path"), "place")
        moved = chain.join(up, "head", "left")
        chain = table(moved.select("lang", "first", "second", "third", "f", "edge", F.coalesce("_up", "head").alias("head"), (F.col("place") + F.coalesce("_more", F.lit(0))).alias("place")), "paths")


def _score(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 * a * a / (left * right))``, exactly: counts of up to 15 digits."""
    a_, l_, r_ = (x.cast("decimal(15,0)") for x in (a, left, right))
    return F.call_function("div", a_ * a_ * F.lit(1_000_000).cast("decimal(7,0)"), l_ * r_).cast("long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, least: int = 10, inside: int = 50, top: int = 2000, cells: int | None = None) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases of two or three words by score.

    A to Z are lowered; texts are split into pieces at ``.,;:!?`` and U+000A to U+000D, those into words at spaces and
    tabs. Phrases found ``least`` times are candidates; the cut into two parts with the lowest score counts, of equal ones
    the one after fewer words. A pair that a phrase of three words with ``inside`` percent of its count holds is dropped.
    Null languages are ``und``; null and empty texts have no words; rows without an id and rows that repeat count like all
    others; an empty table gives no row; other columns are dropped. Ties in rank go to the larger count, then to the
    phrase in the order of UTF-8 bytes.
    """
    g = table(graph(docs, text_col, lang_col, least=least, cells=cells), "graph")
    words = g.where(F.col("kind") == WORD).groupBy("lang", F.col("first").alias("word")).agg(F.sum("f").alias("f"))
    words = table(words, "words")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = words.where(F.col("f") >= least)
    nodes = g.where(F.col("kind") == NODE).select("lang", "first", "second", "f", "best")
    ends = nodes.select("lang", F.col("first").alias("second"), F.col("second").alias("third"), F.col("f").alias("to_f"))
    edges = table(g.where(F.col("kind") == EDGE).select("lang", "first", "second", "third", "f", "node_f").join(ends, ["lang", "second", "third"]), "edges")
    # On a unary path the counts of a phrase and of both its pairs are one; elsewhere the nodes' own.
    paths = compact(edges).select("lang", "first", "second", "third", "f", F.col("f").alias("node_f"), F.col("f").alias("to_f"))
    triples = paths.unionByName(edges.where("f <> node_f or f <> to_f"))

    def of(side: str, name: str) -> DataFrame:
        return words.select("lang", F.col("word").alias(side), F.col("f").alias(name))

    three = triples.join(of("first", "f1"), ["lang", "first"]).join(of("third", "f3"), ["lang", "third"])
    one, two = _score(F.col("f"), F.col("f1"), F.col("to_f")), _score(F.col("f"), F.col("node_f"), F.col("f3"))
    three = three.withColumn("c", F.least(F.struct(one.alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("to_f").alias("r")), F.struct(two.alias("score"), F.lit(2).alias("k"), F.col("node_f").alias("l"), F.col("f3").alias("r"))))
    three = three.select("lang", F.concat_ws(" ", "first", "second", "third").alias("phrase"), F.col("f").alias("a"), "c.l", "c.r", "c.score")
    # Nodes inside a path go with it; of the others, those with a heavy edge on either side.
    entered = edges.groupBy("lang", F.col("second").alias("first"), F.col("third").alias("second")).agg(F.max("f").alias("entered"))
    open_ = nodes.where(F.col("best") * 100 < F.col("f") * inside).join(entered, ["lang", "first", "second"], "left").where((F.coalesce("entered", F.lit(0)) * 100 < F.col("f") * inside))
    pairs = open_.join(of("first", "f1"), ["lang", "first"]).join(of("second", "f2"), ["lang", "second"])
    pairs = pairs.select("lang", F.concat_ws(" ", "first", "second").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), _score(F.col("f"), F.col("f1"), F.col("f2")).alias("score"))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = three.unionByName(pairs).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return best.join(F.broadcast(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 10, inside: int = 50, top: int = 2000) -> str:
    """DuckDB SQL for the same rows, by counting phrases of each length by themselves."""
    return f"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents where text <> ''),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from p),
f1 as (select lang, x, count(*) as f from (select lang, unnest(w) as x from w) group by all),
f2 as (select lang, x, y, count(*) as f from (select lang, unnest(w[:-2]) as x, unnest(w[2:]) as y from w where len(w) > 1) group by all),
f3 as (select lang, x, y, z, count(*) as f from (select lang, unnest(w[:-3]) as x, unnest(w[2:-2]) as y, unnest(w[3:]) as z from w where len(w) > 2) group by all having count(*) >= {least}),
s as (select lang, sum(f)::bigint as n from f1 group by 1),
held as (select lang, x, y, max(f) as f from (select lang, x, y, f from f3 union all select lang, y, z, f from f3) group by all),
c as (
  select f3.lang, f3.x || ' ' || f3.y || ' ' || z as phrase, f3.f as a, f2.f as l, r.f as r, 2 as k from f3 join f2 using (lang, x, y) join f1 r on r.lang = f3.lang and r.x = z
  union all select f3.lang, f3.x || ' ' || f3.y || ' ' || z, f3.f, l.f, r.f, 1 from f3 join f1 l on l.lang = f3.lang and l.x = f3.x join f2 r on r.lang = f3.lang and r.x = f3.y and r.y = z
  union all select f2.lang, f2.x || ' ' || f2.y, f2.f, l.f, r.f, 1 from f2 join f1 l on l.lang = f2.lang and l.x = f2.x join f1 r on r.lang = f2.lang and r.x = f2.y left join held on held.lang = f2.lang and held.x = f2.x and held.y = f2.y where f2.f >= {least} and coalesce(held.f, 0) * 100 < f2.f * {inside}),
scored as (select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from c),
least as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from least)
select lang, rank, phrase, a, l, r, n, score from ranked join s using (lang) where rank <= {top}"""
