"""Operator 10, n-gram Jaccard join by vertical partitioning: the global order of n-grams is cut into fragments, partial overlaps are counted fragment by fragment and summed for each pair.

The global order is that of the n-grams' hashes, so a fragment is a range of hashes. Two sets that reach the threshold
differ in a bounded number of n-grams; cut into one more fragment than that, they agree in one entirely. Equal fragments
thus find every candidate, and only those are counted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillhouse.llm.anchors import mix
from quillhouse.llm.common import blocks, keyed, partitions, table
from quillhouse.llm.components import components
from quillhouse.llm.lines import grouped
from quillhouse.llm.suffix import narrow, widen

#: Sets of a candidate group, and nodes that share a signature, that are held against each other at a time.
SIDE, CROWD = 256, 1024
#: Different n-grams whose overlaps are counted at a time, and n-grams of a set in one fragment of the order, about.
COLUMNS, FRAGMENT = 4096, 8192
#: Independent orders; a set with too many empty fragments in all of them falls back on its least hashes.
ORDERS = 4
FLUSH = 400_000
#: Rows of cells that a task looks at together, and members of a cell whose pairs are compared with those of other cells.
CELL_ROWS, FEW = 100_000, 16
#: Documents whose texts are found again by a broadcast of their ids, and groups that are looked up by one.
FEW_DOCS, FEW_GROUPS = 100_000, 100_000
#: Bytes of a word that are hashed side by side with other words'; longer words are hashed alone.
LONG = 256
#: A set that more than this share of all documents have is known to every task.
HOT_SHARE = 1 / 4096
#: Bytes of text for each cell of the dealing.
CELL_BYTES = 32 << 20

_GAP = np.zeros(256, bool)
_GAP[[0x20, 9, 10, 11, 12, 13]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[ord("A") : ord("Z") + 1] += 32
#: Masks that keep the first 0 to 8 bytes of a little-endian integer.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def word_hashes(low: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words ``low[heads[i]:tails[i]]``: eight bytes a step, each step keyed on all before it."""
    size = tails - heads
    padded = np.zeros(len(low) + 8, np.uint8)
    padded[: len(low)] = low
    eight = np.ndarray((len(low) + 1,), "<u8", padded, strides=(1,))
    out = size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    at, k = np.flatnonzero(size <= LONG), 0
    while len(at):
        block = eight[heads[at] + k] & _FIRST[np.minimum(size[at] - k, 8)]
        out[at] = mix(out[at] * np.uint64(0x9E3779B97F4A7C15) + block)
        k += 8
        at = at[size[at] > k]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(low[heads[i] : tails[i]].tobytes())
    return out


def shingles(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int) -> list[np.ndarray]:
    """For each text ``buf[starts[i]:ends[i]]`` the sorted distinct hashes of its runs of ``words`` words.

    A to Z count as lower case; words are what stands between space and U+0009 to U+000D. With fewer words, the whole
    sequence is the one run; without any, the set is empty.
    """
    low = _LOW[buf]
    solid = ~_GAP[low]
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[starts[starts < n]] = True
    first = solid & (np.concatenate(([False], ~solid[:-1])) | edge[:-1]) if n else np.zeros(0, bool)
    if n:
        first[0] = solid[0]
    heads = np.flatnonzero(first)
    stop_edge = np.zeros(n + 1, bool)
    stop_edge[ends] = True
    tails = np.flatnonzero(solid & (np.concatenate((~solid[1:], [True])) | stop_edge[1:])) + 1 if n else np.zeros(0, np.int64)
    word = word_hashes(low, heads, tails)
    lo, hi = np.searchsorted(heads, starts), np.searchsorted(heads, ends)
    run = np.zeros(len(word), np.uint64)
    for k in range(min(words, len(word))):
        run[: len(word) - k] = mix(run[: len(word) - k] * np.uint64(0x9E3779B97F4A7C15) + word[k:])
    out = []
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif b > a:
            x = np.zeros(1, np.uint64)
            for h in word[a:b]:
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h)
            out.append(mix(x + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class _Schemes:
    """Classes of sizes, each about ``den / num`` times as wide as the one before, and how many fragments the sets of each are cut into."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.tops, self.parts, self.spare = num, den, [], [], []

    def of(self, n: int) -> int:
        """The class of sets of size ``n``."""
        while not self.tops or self.tops[-1] < n:
            top = max(self.tops[-1] + 1, self.tops[-1] * self.den // self.num) if self.tops else 1
            low = self.tops[-1] + 1 if self.tops else 1
            # By how many elements a set of this class and one no smaller can differ at the threshold, and one more.
            least = 1 + (top + top * self.den // self.num) * (self.den - self.num) // (self.num + self.den)
            # And as many as can be expected to be empty, so that two sets that agree in them alone are rare.
            spare = 0
            for _ in range(20):
                mean = (least + spare) * math.exp(-low / (least + spare))
                spare = int(mean + 3 * math.sqrt(mean)) if low >= 30 else 0
            self.tops.append(top)
            self.parts.append(least + spare)
            self.spare.append(spare)
        return int(np.searchsorted(self.tops, n))

    def reach(self, c: int) -> list[int]:
        """Classes under which a set of class ``c`` signs: its own, and the lower ones with sets it can be linked with."""
        least = -(-(self.tops[c - 1] + 1) * self.num // self.den) if c else 1
        return [x for x in range(c + 1) if self.tops[x] >= least]


def signatures(h: np.ndarray, schemes: _Schemes) -> np.ndarray:
    """Signatures of the set ``h``: two sets at the threshold share one.

    Such sets agree in ``spare + 1`` fragments at least. If either has no more than ``spare`` empty ones, they share one
    that is not empty; if both have more, both sign in the next order as well.
    """
    n = len(h)
    out = []
    own = schemes.of(n)
    for c in schemes.reach(own):
        parts = schemes.parts[c]
        open_ = True
        for order in range(ORDERS):
            x = h if order == 0 else np.sort(mix(h + np.uint64(order)))
            cell = (x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            sums = np.zeros(parts, np.uint64)
            mixed = mix(x + np.uint64(0x2545F4914F6CDD1D))
            np.add.at(sums, cell.astype(np.int64), mixed)
            some = np.bincount(cell.astype(np.int64), minlength=parts) > 0
            tag = np.uint64((c * ORDERS + order) * 0x1000003D)
            out.append(mix(mix(sums[some] + tag) + np.flatnonzero(some).astype(np.uint64)))
            open_ = parts - int(some.sum()) > schemes.spare[c]
            if not open_:
                break
        if open_:  # too many empty fragments in every order: the prefix of the order, rarely needed
            keep = n - -(-schemes.num * n // schemes.den) + 1
            out.append(mix(h[:keep] + np.uint64(c + 0x7F4A7C15)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def sketch(h: np.ndarray) -> bytes:
    """One bit for each residue of the hashes, set where an odd number of them falls: about twice as many bits as hashes.

    Two sets' sketches differ in no more bits than the sets differ in elements. Folding halves a sketch.
    """
    bits = 64
    while bits < 2 * len(h) and bits < 1 << 20:
        bits *= 2
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def _folded(marks: list[bytes], at: np.ndarray, width: int) -> np.ndarray:
    """The sketches ``marks[at]``, all of one width, folded until ``width`` bytes are left."""
    x = np.frombuffer(b"".join([marks[k] for k in at.tolist()]), "<u8").reshape(len(at), -1)
    while x.shape[1] * 8 > width:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def _open(apart: np.ndarray, one: np.ndarray, two: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes, ``apart`` in so many elements at least, can reach the threshold."""
    return (apart * (den + num) <= (one + two) * (den - num)) & (np.minimum(one, two) * den >= np.maximum(one, two) * num)


def near_ties(left: tuple, right: tuple, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Enough pairs ``(node, node)`` to connect all whose sketches and sizes leave it open that they reach the threshold.

    Each side is ``(nodes, sizes, sketches)``. The wider of two sketches is folded until both are as wide; sizes of which
    the smaller is below ``num / den`` of the larger link nothing.
    """
    masks = []
    widths = [np.array([len(x) for x in side[2]], np.int64) for side in (left, right)]
    for w in np.unique(widths[0]).tolist():
        i = np.flatnonzero(widths[0] == w)
        for v in np.unique(widths[1]).tolist():
            j = np.flatnonzero(widths[1] == v)
            small, large = (left[1][i], right[1][j]) if w < v else (right[1][j], left[1][i])
            if w != v and small.max() * den < large.min() * num:
                continue
            x, y = _folded(left[2], i, min(w, v)), _folded(right[2], j, min(w, v))
            step = max(1, (1 << 20) // (len(j) * x.shape[1]))
            for lo in range(0, len(i), step):
                apart = np.bitwise_count(x[lo : lo + step, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
                p, q = np.nonzero(_open(apart, left[1][i[lo : lo + step], None], right[1][None, j], num, den))
                masks.append((i[lo : lo + step][p], j[q]))
    if not masks:
        return left[0][:0], left[0][:0]
    return _forest(left[0], right[0], *(np.concatenate(x) for x in zip(*masks, strict=True)))


def near_pairs(sizes: np.ndarray, marks: list[bytes], i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the pairs ``(i, j)`` their sketches and sizes leave open, as in ``near_ties``."""
    width = np.array([len(x) for x in marks], np.int64)
    out = np.zeros(len(i), bool)
    for code in np.unique(width[i] << 32 | width[j]).tolist():
        w, v = code >> 32, code & 0xFFFFFFFF
        at = np.flatnonzero((width[i] == w) & (width[j] == v) & _open(np.int64(0), sizes[i], sizes[j], num, den))
        for lo in range(0, len(at), 1 << 16):
            k = at[lo : lo + (1 << 16)]
            apart = np.bitwise_count(_folded(marks, i[k], min(w, v)) ^ _folded(marks, j[k], min(w, v))).sum(1, dtype=np.int64)
            out[k] = _open(apart, sizes[i[k]], sizes[j[k]], num, den)
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of one side shares with each of the other, ``COLUMNS`` different elements at a time."""
    a_size, b_size = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    both = np.zeros((len(left), len(right)))
    a_all, b_all = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a_all, b_all)
    if not len(common):
        return both
    a_row, b_row = np.repeat(np.arange(len(left)), a_size), np.repeat(np.arange(len(right)), b_size)
    a_at, b_at = np.searchsorted(common, a_all), np.searchsorted(common, b_all)
    a_in, b_in = common[np.minimum(a_at, len(common) - 1)] == a_all, common[np.minimum(b_at, len(common) - 1)] == b_all
    a_row, a_at, b_row, b_at = a_row[a_in], a_at[a_in], b_row[b_in], b_at[b_in]
    for lo in range(0, len(common), COLUMNS):
        x, y = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        i, j = (a_at >= lo) & (a_at < lo + COLUMNS), (b_at >= lo) & (b_at < lo + COLUMNS)
        x[a_row[i], a_at[i] - lo] = 1
        y[b_row[j], b_at[j] - lo] = 1
        both += x @ y.T
    return both


def _forest(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Enough of the links ``left[i], right[j]`` to connect what all of them connect: each node with the least node of its part."""
    ids, inverse = np.unique(np.concatenate((left, right)), return_inverse=True)
    u, v = inverse[: len(left)][i], inverse[len(left) :][j]
    root = np.arange(len(ids))
    while True:
        low = root.copy()
        np.minimum.at(low, u, root[v])
        np.minimum.at(low, v, root[u])
        low = low[low]
        if (low == root).all():
            break
        root = low
    tied = np.flatnonzero(root != np.arange(len(ids)))
    return ids[tied], ids[root[tied]]


def _cells(sides: Column, side: Column) -> Column:
    """The pairs of sides in which a member of ``side`` takes part."""
    return F.explode(F.transform(F.sequence(F.lit(0), sides - 1), lambda x: F.struct(F.least(x, side).cast("int").alias("lo"), F.greatest(x, side).cast("int").alias("hi"))))


def _deals(members: DataFrame) -> DataFrame:
    """``members`` (``grp, node, sides``) with the cells of the first comparison.

    A group that fits in one side is compared in it. A larger one is dealt into sides twice, each time in its own way, and
    only members of one side are compared: what hangs together is connected by then, with two copies of each member.
    """
    at = lambda k: F.pmod(F.xxhash64("node", "grp", F.lit(k)), F.col("sides")).cast("int") + F.lit(k) * F.col("sides")
    side = F.explode(F.when(F.col("sides") == 1, F.array(F.lit(0))).otherwise(F.array(at(0), at(1))))
    return members.withColumn("side", side).withColumns({"lo": F.col("side"), "hi": F.col("side")})


def _looked_up(members: DataFrame, groups: DataFrame, how: str) -> DataFrame:
    """``members`` with what ``groups`` (a table by ``grp``) says of their group: by broadcast while that table is small, so that a large group is not sent to one task."""
    return members.join(F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups.hint("merge"), "grp", how)


def _still_apart(members: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``members`` of those dealt groups whose members ``labels`` (``node, component``) does not connect, with cells that
    hold every two of them with different labels: all sides of what does not belong to the group's largest part, and these
    against that part's sides."""
    big = members.where("sides > 1").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    parts = big.groupBy("grp", "label").agg(F.count("*").alias("n"))
    groups = parts.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("giant"), F.max("n").alias("held"), F.sum("n").alias("all"), F.count("*").alias("labels")).where("labels > 1")
    rest = F.ceil((F.col("all") - F.col("held")) / most).cast("int")
    groups = table(groups.select("grp", "giant", rest.alias("rest"), F.ceil(F.col("held") / most).cast("int").alias("core")), "apart")
    out = _looked_up(big, groups, "inner")
    inside, h = F.col("label") == F.col("giant"), F.xxhash64("node", "grp", F.lit(2))
    side = F.when(inside, F.col("rest") + F.pmod(h, F.col("core"))).otherwise(F.pmod(h, F.col("rest"))).cast("int")
    out = out.withColumn("side", side).withColumn("cell", _cells(F.when(inside, F.col("rest")).otherwise(F.col("rest") + F.col("core")), F.col("side")))
    return out.select(*members.columns, "side", "cell.lo", "cell.hi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3, num: int = 90, den: int = 100, buckets: int | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: documents whose sets of ``words``-word shingles have a Jaccard similarity of
    ``num / den`` or more are linked, exactly; ``component_id`` is the smallest id reachable by links.

    A to Z count as lower case, words are runs of characters other than space and U+0009 to U+000D. A text with fewer
    words is one shingle; one without words, or null, has an empty set, which links with nothing. Rows without an id are
    left out; rows that repeat an id count as one document that has the links of each, and the largest set's size. Other
    columns are dropped. Words and shingles are told apart by 64 bits of hash, sets by 128.

    Equal sets become one representative first, so copies are never compared. Candidates that share a signature are held
    against each other by their sketches, whose distance is never more than that of the sets, so what it rules out is no
    link; the rest falls into small connected groups. There the order of hashes is cut into fragments of about
    ``FRAGMENT`` n-grams of the largest set; overlaps are counted fragment by fragment, in tasks of their own, and summed
    for each pair; with one fragment a count is the sum. Groups of more than ``SIDE`` members are dealt into sides twice
    and compared side by side, then in full as far as they do not hang together yet. Tasks hand on only enough pairs to
    keep connected what they connect.
    """
    rows = keyed(docs, id_col, text_col)
    n = partitions(rows.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, starts, ends in blocks(batches):
            got = shingles(buf, starts, ends, words)
            size = np.array([len(h) for h in got])
            node = [_node(h) for h in got]
            more = np.array([mix(h ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64) for h in got], np.uint64).view(np.int64)
            marks = [sketch(h) for h in got]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(more, pa.int64()), pa.array(marks, pa.binary()), pa.array(ends - starts, pa.int64())], ["doc_id", "n_shingles", "a", "b", "sketch", "size"])

    sketched = table(rows.mapInArrow(sets, "doc_id long, n_shingles long, a long, b long, sketch binary, size long"), "sets")
    sized = sketched.select("doc_id", "n_shingles", "a", "b")
    n_docs, size = sketched.agg(F.count("*"), F.sum("size")).first()
    buckets = buckets or max(2 * n, -(-(size or 0) // CELL_BYTES))
    least = sized.where("n_shingles > 0").groupBy("n_shingles", "a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes = _Schemes(num, den)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for _, buf, starts, ends in blocks(batches):
            for h in shingles(buf, starts, ends, words):
                if len(h):
                    s = signatures(h, schemes)
                    held.append((s, np.full(len(s), _node(h), np.int64)))
                    size += len(s)
            if size >= FLUSH:
                yield _signed(held, buckets)
                held, size = [], 0
        if size:
            yield _signed(held, buckets)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes that share a signature with another one."""
        for bucket, parts in grouped(batches):
            got = [r for p in parts for r in p.to_pylist()]
            sig = np.concatenate([widen(r["sig"], r["n"]) for r in got])
            node = np.concatenate([np.frombuffer(r["node"], "<i8") for r in got])
            pair = np.unique(np.rec.fromarrays((sig, node)))
            sig, node = pair.f0, pair.f1
            new = np.concatenate(([True], sig[1:] != sig[:-1]))
            at = np.cumsum(new) - 1
            members = np.bincount(at)[at]
            keep = members > 1
            sides = -(-members[keep] // CROWD)
            key = mix(sig[keep] + (np.uint64(bucket) << np.uint64(48))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[keep]), pa.array(sides.astype(np.int32))], ["grp", "node", "sides"])

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ties of a run of cells: the pairs of small ones all at once, large ones one by one."""

        def run(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, lo, hi, side, node, size = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in range(6))
            marks = [x for p in parts for x in p.column(6).to_pylist()]
            starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
            held = np.diff(np.append(starts, len(key)))
            small = (held <= FEW) & (lo[starts] == hi[starts])
            pairs = [np.zeros((0, 2), np.int64)]
            for n in np.unique(held[small]).tolist():
                at = np.stack(np.triu_indices(n, 1), 1)
                pairs.append((starts[small & (held == n)][:, None, None] + at).reshape(-1, 2))
            i, j = np.concatenate(pairs).T
            near = near_pairs(size, marks, i, j, num, den)
            links = [_forest(node, node, i[near], j[near])]
            for k in np.flatnonzero(~small).tolist():
                rows_ = np.arange(starts[k], starts[k] + held[k])
                of = [rows_[side[rows_] == at] for at in (lo[starts[k]], hi[starts[k]])]
                if len(of[0]) and len(of[1]):
                    links.append(near_ties(*[(node[i], size[i], [marks[m] for m in i.tolist()]) for i in of], num, den))
            a, b = (np.concatenate(x) for x in zip(*links, strict=True))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        size = 0
        for _, parts in grouped(batches):
            held += parts
            size += sum(p.num_rows for p in parts)
            if size >= CELL_ROWS:
                yield from run(held)
                held, size = [], 0
        if held:
            yield from run(held)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(buckets, "key").sortWithinPartitions("key")

    key = F.xxhash64("grp", "lo", "hi").alias("key")
    # A set signs as a node that all its copies share.
    signed = rows.select("doc_id", "text").mapInArrow(sign, "bucket int, n int, sig binary, node binary")
    shared = signed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(repeated, "grp long, node long, sides int")
    shared = table(shared, "shared")
    known_by = sketched.where("n_shingles > 0").groupBy(F.col("a").alias("node"), "n_shingles", "b").agg(F.min("sketch").alias("sketch")).drop("b")

    def tied(cells: DataFrame, few: bool = False) -> DataFrame:
        close = cells.hint("merge").join(known_by.hint("merge"), "node")
        return dealt(close.select(key, "lo", "hi", "side", "node", "n_shingles", "sketch")).mapInArrow(tie, "a long, b long")

    groups = _joined_up(shared, tied, CROWD).select(F.col("node").alias("a"), F.col("component").alias("grp"))
    members_ = least.join(groups, "a").select(F.col("rep").alias("node"), "n_shingles", "grp")
    counts = members_.groupBy("grp").agg(F.ceil(F.max("n_shingles") / FRAGMENT).cast("int").alias("frags"), F.greatest(F.count("*") / SIDE, F.sum(F.least("n_shingles", F.lit(FRAGMENT))) / (SIDE * 2000)).alias("load"))
    large = table(counts.where("load > 1 or frags > 1"), "large")
    sided = _looked_up(members_, large, "left").select("grp", "node", F.coalesce(F.ceil("load").cast("int"), F.lit(1)).alias("sides"), F.coalesce("frags", F.lit(1)).alias("frags"))
    sided = table(sided, "groups")

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each set, cut at equal distances of the order into its group's number of fragments."""
        for part, buf, starts, ends in blocks(batches):
            out: tuple[list, ...] = ([], [], [], [])
            for i, (h, frags) in enumerate(zip(shingles(buf, starts, ends, words), part.column(6).to_pylist(), strict=True)):
                cuts = np.searchsorted((h >> np.uint64(32)) * np.uint64(frags) >> np.uint64(32), np.arange(frags + 1))
                for f, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    if b > a:
                        for c, x in zip(out, (i, f, len(h), h[a:b].tobytes()), strict=True):
                            c.append(x)
            taken = part.take(pa.array(out[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), *taken.columns[2:], *(pa.array(c, t) for c, t in zip(out[1:], (pa.int32(), pa.int64(), pa.binary()), strict=True))], names)

    names = ["node", "grp", "lo", "hi", "side", "frags", "frag", "size", "part"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links, where the group has one fragment; else the overlap in this one of each pair that shares something."""
        for _, parts in grouped(batches):
            by: dict[tuple, list[tuple]] = {}
            for p in parts:
                for *cell, side, doc, size, raw in zip(*(p.column(i).to_pylist() for i in range(1, 10)), strict=True):
                    by.setdefault(tuple(cell), []).append((side, doc, size, raw))
            for (grp, lo, hi, frags, _), got in by.items():
                sides = [[(d, size, np.frombuffer(raw, "<u8")) for s, d, size, raw in got if s == at] for at in (lo, hi)]
                if not sides[0] or not sides[1]:
                    continue
                ids, sizes = ([np.array([x[k] for x in side], np.int64) for side in sides] for k in (0, 1))
                both = overlaps(*[[x[2] for x in side] for side in sides])
                if lo == hi:
                    both = np.triu(both, 1)
                total = sizes[0][:, None] + sizes[1][None, :]
                if frags == 1:
                    a, b = _forest(*ids, *np.nonzero((den * both >= num * (total - both)) & (both > 0)))
                    columns = [a, b, np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)]
                else:
                    i, j = np.nonzero(both)
                    columns = [ids[0][i], ids[1][j], both[i, j].astype(np.int64), total[i, j]]
                if len(columns[0]):
                    cell = [pa.array(np.full(len(columns[0]), x, np.int64)) for x in (grp, lo, hi)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), *cell], ["a", "b", "both", "total", "grp", "lo", "hi"])

    def linked(cells: DataFrame, few: bool = False) -> DataFrame:
        texts = rows.join(F.broadcast(cells.select(F.col("node").alias("doc_id")).distinct()), "doc_id", "left_semi") if few else rows
        held = texts.join(cells.select(F.col("node").alias("doc_id"), "grp", "lo", "hi", "side", "frags").hint("merge"), "doc_id").select("doc_id", "text", "grp", "lo", "hi", "side", "frags")
        cut = held.mapInArrow(fragments, "node long, grp long, lo int, hi int, side int, frags int, frag int, size long, part binary")
        met = dealt(cut.select(F.xxhash64("grp", "lo", "hi", "frag").alias("key"), "grp", "lo", "hi", "frags", "frag", "side", "node", "size", "part"))
        found = table(met.mapInArrow(compare, "a long, b long, both long, total long, grp long, lo long, hi long"), "overlaps")
        # A pair may meet in two cells, in each of which every fragment is counted once.
        pairs = found.where("total > 0").groupBy("a", "b", "total", "grp", "lo", "hi").agg(F.sum("both").alias("both"))
        return found.where("total = 0").select("a", "b").unionByName(pairs.where(F.col("both") * den >= (F.col("total") - F.col("both")) * num).select("a", "b"))

    parts = _joined_up(sided, linked, SIDE)
    named = least.join(parts, least.rep == parts.node, "left").select("n_shingles", "a", "b", "copies", F.coalesce("component", "rep").alias("component_id"))
    named = table(named, "named")
    # No more than 1 / HOT_SHARE sets are so frequent, however large the input.
    many = F.col("copies") > F.lit(HOT_SHARE) * n_docs
    hot = named.where(many).drop("copies").withColumnRenamed("component_id", "hot_id")
    known = sized.join(F.broadcast(hot), ["n_shingles", "a", "b"], "left")
    cold = known.where("hot_id is null").drop("hot_id").join(named.where(~many).drop("copies"), ["n_shingles", "a", "b"], "left")
    out = cold.select("doc_id", "n_shingles", "component_id").unionByName(known.where("hot_id is not null").select("doc_id", "n_shingles", F.col("hot_id").alias("component_id")))
    return out.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min(F.coalesce("component_id", "doc_id")).alias("component_id"))


def _joined_up(members: DataFrame, edges_of: Callable[..., DataFrame], most: int) -> DataFrame:
    """``(node, component)`` of the links that ``edges_of`` finds in cells of ``members`` (``grp, node, sides``)."""
    edges = table(edges_of(_deals(members)), "ties")
    labels = components(edges)
    apart = table(_still_apart(members, labels, most), "apart")
    nodes = apart.select("node").distinct().count()
    if not nodes:
        return labels
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(known.unionByName(edges_of(apart, nodes <= FEW_DOCS)))


def _node(h: np.ndarray) -> int:
    return int(h.sum(dtype=np.uint64).view(np.int64)) if len(h) else 0


def _signed(held: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    sig, node = (np.concatenate(x) for x in zip(*held, strict=True))
    bucket = (sig % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, sig, node = bucket[order], sig[order] & np.uint64((1 << 48) - 1), node[order]
    cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])).tolist()
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    return pa.RecordBatch.from_arrays([
        pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), pa.array([b - a for a, b in spans], pa.int32()),
        pa.array([narrow(sig[a:b]) for a, b in spans], pa.binary()), pa.array([node[a:b].tobytes() for a, b in spans], pa.binary()),
    ], ["bucket", "n", "sig", "node"])
