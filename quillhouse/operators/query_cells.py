"""Any number of queries against rows of texts: both are dealt into cells, and a cell is matched in the task that gets it.

A text is one row with its different names; queries travel in packs. A cell holds one group of queries and one share of the
texts, so a text is dealt once for each group, a query once for each share, and what a query starts from is never a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillhouse.operators.search import K1, B
from quillhouse.operators.word_lists import _coded, _slices

#: Queries of a group, which a task holds at once; words of the texts of a share; queries of a pack; candidates looked at together.
GROUP, SHARE_WORDS, PACK, CANDIDATES = 1 << 22, 1 << 25, 1 << 12, 1 << 21


class _Asked:
    """A group of queries: their names as numbers, and the queries that start with each name."""

    def __init__(self, packs: list[pa.Array]) -> None:
        each = pa.concat_arrays([pc.list_flatten(p) for p in packs])
        self.ids, names, idf = each.flatten()
        split = pc.split_pattern(names, "\n")
        self.need = pc.list_value_length(split).to_numpy().astype(np.int64)
        self.begin = np.cumsum(self.need) - self.need
        self.names, self.code = _coded(split.flatten())
        self.idf = idf.flatten().to_numpy()
        start = self.code[self.begin]
        self.by_start = np.argsort(start, kind="stable")
        self.n_starts = np.bincount(start, minlength=len(self.names))
        self.first = np.cumsum(self.n_starts) - self.n_starts

    def hits(self, texts: pa.RecordBatch, avg: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Queries, rows of ``texts`` (``length, names, tf``) that hold all names of them, and scores, some at a time."""
        length, names, tf = texts.columns
        each = pc.list_value_length(tf).to_numpy().astype(np.int64)
        code = pc.fill_null(pc.index_in(pc.split_pattern(names, "\n").flatten(), value_set=self.names), -1).to_numpy().astype(np.int64)
        known = np.flatnonzero(code >= 0)
        row, code = np.repeat(np.arange(len(each)), each)[known], code[known]
        tf = tf.flatten().to_numpy()[known].astype(np.float64)
        part = tf * (K1 + 1.0) / (tf + K1 * ((1.0 - B) + B * length.to_numpy()[row] / avg))
        at = row * len(self.names) + code
        order = np.argsort(at, kind="stable")
        row, code, part, at = row[order], code[order], part[order], at[order]
        here = np.flatnonzero(self.n_starts[code])
        ends = np.cumsum(self.n_starts[code[here]])
        lo = 0
        while lo < len(here):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + CANDIDATES, "right")))
            some = here[lo:hi]
            n = self.n_starts[code[some]]
            src = np.repeat(some, n)
            query = self.by_start[np.repeat(self.first[code[some]] - (np.cumsum(n) - n), n) + np.arange(len(src))]
            score, rest = self.idf[self.begin[query]] * part[src], np.zeros(len(src))
            for j in range(1, int(self.need[query].max())):
                more = np.flatnonzero(self.need[query] > j)
                place = self.begin[query[more]] + j
                wanted = row[src[more]] * len(self.names) + self.code[place]
                found = np.minimum(np.searchsorted(at, wanted), len(at) - 1)
                met = at[found] == wanted
                rest[more] += np.where(met, self.idf[place] * part[found], 0.0)
                stays = np.ones(len(src), bool)
                stays[more[~met]] = False
                src, query, score, rest = src[stays], query[stays], score[stays], rest[stays]
                if not len(src):
                    break
            if len(src):
                yield query, row[src], -(score + rest)
            lo = hi


def dealt(texts: DataFrame, queries: DataFrame, n_queries: int, n_words: int) -> DataFrame:
    """``texts`` (``key, length, names, tf``) and ``queries`` (``query_id, names, idf``) in cells, a partition each, queries first. Names are joined by newlines."""
    spark = texts.sparkSession
    groups = max(1, -(-n_queries // GROUP))
    shares = max(2 * spark.sparkContext.defaultParallelism, -(-n_words // SHARE_WORDS))
    packs = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(max(groups, -(-n_queries // PACK)))).alias("pack")).agg(F.collect_list(F.struct("query_id", "names", "idf")).alias("queries"))
    packs = packs.select("queries", F.pmod("pack", F.lit(groups)).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("turn"))
    texts = texts.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.pmod(F.xxhash64("key"), F.lit(shares)).alias("share"), F.lit(1).alias("turn"))
    both = packs.unionByName(texts, allowMissingColumns=True)
    cells = both.repartitionById(groups * shares, (F.col("group") * shares + F.col("share")).cast("int")).sortWithinPartitions("turn")
    return cells.select("queries", "key", "length", "names", "tf")


def matched(cells: DataFrame, avg: float, best: bool) -> DataFrame:
    """``(query_id, key, score)`` of each text that holds all names of a query; with ``best``, ``(query_id, hits, score)`` of each cell, the lowest score of its hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: list[pa.Array] = []
        asked = n = low = None
        for batch in batches:
            turn = batch.num_rows - batch.column(0).null_count
            if turn:
                packs.append(batch.column(0).slice(0, turn))
            texts = batch.slice(turn)
            if not texts.num_rows or not packs and asked is None:
                continue
            if asked is None:
                asked = _Asked(packs)
                packs.clear()
                n, low = np.zeros(len(asked.ids), np.int64), np.full(len(asked.ids), np.inf)
            for begin, end in _slices(pc.list_value_length(texts.column(4)).to_numpy()):
                part = texts.slice(begin, end - begin)
                for query, row, score in asked.hits(part.select([2, 3, 4]), avg):
                    if best:
                        n += np.bincount(query, minlength=len(n))
                        np.minimum.at(low, query, score)
                    else:
                        yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(query)), part.column(1).take(pa.array(row)), pa.array(score)], names)
        if best and asked is not None:
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(some)), pa.array(n[some]), pa.array(low[some])], names)

    ids = cells.schema["queries"].dataType.elementType["query_id"].dataType.simpleString()
    second = ("hits", "bigint") if best else ("key", cells.schema["key"].dataType.simpleString())
    names = ["query_id", second[0], "score"]
    return cells.mapInArrow(run, f"query_id {ids}, {second[0]} {second[1]}, score double")
