"""Operator 8, embedding near-dedup by the epsilon grid order: vectors sorted by grid cells on leading principal dimensions, sequence intervals joined recursively, distant ones skipped."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillhouse.llm.common import partitions, table
from quillhouse.llm.components import components

#: Vectors of an interval of the sequence that one row holds, and those below which the recursion multiplies.
RUN, LEAF = 8192, 256
#: Leading principal dimensions of the grid.
DIMENSIONS = 8
#: Vectors the principal dimensions are fitted on, those with the least hash of their id. Any axes give the same links.
FIT_ROWS = 4096


def _axes(units: DataFrame) -> dict[int, list[list[float]]]:
    """Leading principal axes for each length of vector, from a bounded sample."""
    sample = units.orderBy(F.xxhash64("vec_id"), "vec_id").select("unit").limit(FIT_ROWS).collect()
    by: dict[int, list] = {}
    for (unit,) in sample:
        by.setdefault(len(unit), []).append(unit)
    out = {}
    for dim, rows in by.items():
        x = np.array(rows)
        x = x - x.mean(0)
        _, vectors = np.linalg.eigh(x.T @ x)
        out[dim] = vectors[:, ::-1][:, :DIMENSIONS].T.tolist()
    return out


def _boxes_apart(lo1: Column, hi1: Column, lo2: Column, hi2: Column, eps: float) -> Column:
    """Whether two boxes of projections are more than ``eps`` apart."""
    gaps = [F.greatest(F.lit(0.0), F.get(lo2, F.lit(i)) - F.get(hi1, F.lit(i)), F.get(lo1, F.lit(i)) - F.get(hi2, F.lit(i))) for i in range(DIMENSIONS)]
    total = gaps[0] * gaps[0]
    for g in gaps[1:]:
        total = total + g * g
    return total > F.lit(eps * eps)


def _bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.min(0), x.max(0)


def _recurse(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray, same: bool, eps: float, cosine: float, at: tuple[int, int], out: list) -> None:
    """Links between two intervals of the sequence: halves them, skips halves whose boxes are apart, multiplies small ones."""
    (la, ha), (lb, hb) = _bounds(pa_), _bounds(pb)
    gap = np.maximum(0, np.maximum(lb - ha, la - hb))
    if float(gap @ gap) > eps * eps:
        return
    if max(len(a), len(b)) <= LEAF:
        i, j = np.nonzero(a @ b.T >= cosine)
        keep = i < j if same else slice(None)
        out.append((i[keep] + at[0], j[keep] + at[1]))
        return
    ma, mb = (len(a) + 1) // 2, (len(b) + 1) // 2
    for s1, o1 in ((slice(0, ma), 0), (slice(ma, None), ma)):
        for s2, o2 in ((slice(0, mb), 0), (slice(mb, None), mb)):
            if (same and o2 < o1) or not len(a[s1]) or not len(b[s2]):
                continue
            _recurse(a[s1], pa_[s1], b[s2], pb[s2], same and o1 == o2, eps, cosine, (at[0] + o1, at[1] + o2), out)


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, u, root[v])
        np.minimum.at(low, v, root[u])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", *, cosine: float = 0.93) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: vectors of equal label are linked when their cosine is at least ``cosine``.

    The cosine is taken in double precision; all links are found. ``n_links`` counts the other vectors linked directly,
    ``component_id`` is the smallest id reachable, ``kept`` says whether that is the vector's own. Vectors that are null,
    empty, zero or hold a null or non-finite component link with nothing, nor do those with a null label or of another
    length; without ``label_col`` all vectors can be linked. Rows without an id are left out; an id that repeats counts
    once, with its least label and vector. Other columns are dropped.

    Unit vectors at this cosine are at most ``eps`` apart. They are sorted by label and grid cell; as sequences do not
    break at equal cells, a label or a cell that holds a third of all rows is many intervals. Intervals of a label whose
    boxes are not further apart meet once, in one task, which halves both and skips halves that are apart.
    """
    spark = vectors.sparkSession
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("v")).select("vec_id", "v.label", "v.vector")
    top = F.aggregate("vector", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    fine = F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.coalesce(F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    rows = table(rows.withColumn("fine", fine).withColumn("top", F.when(F.col("fine"), top)), "vectors")
    good = rows.where("fine and top > 0").withColumn("vector", F.transform("vector", lambda x: x / F.col("top")))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    units = good.withColumn("norm", norm).select("vec_id", F.concat_ws("|", F.size("vector").cast("string"), "label").alias("label"), F.transform("vector", lambda x: x / F.col("norm")).alias("unit"))

    eps = math.sqrt(2 - 2 * min(cosine, 1.0)) * (1 + 1e-9) + 1e-9
    units = table(units, "units")
    axes = _axes(units)
    n = partitions(spark)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                raw, cells, spots = [], [], []
                for unit in part.column(2).to_pylist():
                    u = np.array(unit)
                    p = np.zeros(DIMENSIONS)
                    if len(u) in axes:
                        got = np.array(axes[len(u)]) @ u
                        p[: len(got)] = got
                    raw.append(u.tobytes())
                    spots.append(p.tobytes())
                    cells.append(np.floor(p / eps).astype(int).tolist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(raw, pa.binary()), pa.array(spots, pa.binary()), pa.array(cells, pa.list_(pa.int32()))], ["vec_id", "label", "unit", "spot", "cell"])

    placed = units.mapInArrow(project, "vec_id long, label string, unit binary, spot binary, cell array<int>")
    ordered = placed.repartitionByRange(n, "label", "cell", "vec_id").sortWithinPartitions("label", "cell", "vec_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, name = TaskContext.get().partitionId() << 32, [], None

        def interval() -> pa.RecordBatch:
            ids = np.array([x[0] for x in held], np.int64)
            spots = np.frombuffer(b"".join(x[2] for x in held), np.float64).reshape(len(held), -1)
            lo, hi = _bounds(spots)
            return pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([name]), pa.array([lo.tolist()]), pa.array([hi.tolist()]), pa.array([ids.tobytes()], pa.binary()),
                pa.array([spots.tobytes()], pa.binary()), pa.array([b"".join(x[1] for x in held)], pa.binary()),
            ], ["run", "label", "lo", "hi", "ids", "spots", "units"])

        for batch in batches:
            for vec, label_, unit, spot in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (label_ != name or len(held) == RUN):
                    yield interval()
                    number, held = number + 1, []
                name = label_
                held.append((vec, unit, spot))
        if held:
            yield interval()

    runs = table(ordered.mapInArrow(cut, "run long, label string, lo array<double>, hi array<double>, ids binary, spots binary, units binary"), "runs")
    # Intervals of one label meet in n tasks: each stands in one, and asks in all.
    boxes = runs.select("run", "label", "lo", "hi")
    x = boxes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).alias("x")
    y = boxes.withColumn("part", F.pmod(F.xxhash64("run"), F.lit(n)).cast("int")).alias("y")
    near = ~_boxes_apart(F.col("x.lo"), F.col("x.hi"), F.col("y.lo"), F.col("y.hi"), eps)
    met = x.join(y.hint("shuffle_hash"), (F.col("x.label") == F.col("y.label")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.run") <= F.col("y.run")) & near)
    one = runs.select(F.col("run").alias("a"), F.col("ids").alias("ids_a"), F.col("spots").alias("spots_a"), F.col("units").alias("units_a"))
    two = runs.select(F.col("run").alias("b"), F.col("ids").alias("ids_b"), F.col("spots").alias("spots_b"), F.col("units").alias("units_b"))
    pairs = met.select(F.col("x.run").alias("a"), F.col("y.run").alias("b")).join(one, "a").join(two, "b").repartition(n, "a", "b").select("a", "b", "ids_a", "spots_a", "units_a", "ids_b", "spots_b", "units_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, *raw = (batch.column(c)[i].as_py() for c in range(8))
                ids = [np.frombuffer(raw[k], np.int64) for k in (0, 3)]
                spots = [np.frombuffer(raw[k], np.float64).reshape(len(d), -1) for k, d in zip((1, 4), ids, strict=True)]
                units_ = [np.frombuffer(raw[k], np.float64).reshape(len(d), -1) for k, d in zip((2, 5), ids, strict=True)]
                found: list = []
                _recurse(units_[0], spots[0], units_[1], spots[1], a == b, eps, cosine, (0, 0), found)
                u = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
                v = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
                if not len(u):
                    continue
                nodes = ids[0] if a == b else np.concatenate(ids)
                v = v if a == b else v + len(ids[0])
                count = np.bincount(u, minlength=len(nodes)) + np.bincount(v, minlength=len(nodes))
                # In the order of ids, so that a part's root is its least id.
                order = np.argsort(nodes, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                root = order[_roots(len(nodes), place[u], place[v])][place]
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]]), pa.array(count[some].astype(np.int64))], ["vec_id", "root", "n"])

    links = table(pairs.mapInArrow(compare, "vec_id long, root long, n long"), "links")
    counts = links.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    parts = components(links.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("vec_id"), "component")
    out = rows.select("vec_id").join(counts, "vec_id", "left").join(parts, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
