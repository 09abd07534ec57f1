"""Words of whole texts grouped inside the tasks that read them, so that no row for each word is shuffled or sorted.

Tasks get arrays of words and work through them in slices of bounded size. Rows come out in the order of their words, slice by
slice: written as they come, a file consists of sorted runs, and a reader skips what cannot hold a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillhouse.functions.stems import stem_of

#: Words of a slice; a longer text is a slice of its own.
MOST_WORDS = 1 << 20


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    ends, begin = np.cumsum(lengths), 0
    while begin < len(lengths):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + MOST_WORDS, "right")))
        yield begin, end
        begin = end


def _coded(names: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Different names in order, and the place of each name among them."""
    found = names.dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found.dictionary.take(pa.array(order)), place[found.indices.to_numpy()]


def _stems(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    found = words.dictionary_encode()
    names, place = _coded(pa.array([stem_of(w) for w in found.dictionary.to_pylist()], pa.string()))
    return names, place[found.indices.to_numpy()]


def lists(texts: DataFrame, of: str) -> DataFrame:
    """``texts`` (a key, an array of words) by key and different ``term``, ``stem`` or ``both``, the stems of two words side by side.

    Terms come with ``tf`` and ``first_pos``; the others with the ``length`` of the text and their ``positions`` in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in _slices(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)):
                part = batch.slice(begin, end - begin)
                lengths = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                words = part.column(1).flatten()
                if not len(words):
                    continue
                row = np.repeat(np.arange(len(lengths)), lengths)
                pos = (np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
                names, code = _coded(words) if of == "term" else _stems(words)
                if of == "both":
                    inside = np.flatnonzero(row[1:] == row[:-1])
                    if not len(inside):
                        continue
                    pairs, code = np.unique(code[inside] * len(names) + code[inside + 1], return_inverse=True)
                    names = pc.binary_join_element_wise(names.take(pa.array(pairs // len(names))), names.take(pa.array(pairs % len(names))), " ")
                    row, pos = row[inside], pos[inside]
                groups = code * len(lengths) + row
                order = np.argsort(groups, kind="stable")
                groups = groups[order]
                starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
                heads, bounds = order[starts], np.append(starts, len(order))
                cols = [part.column(0).take(pa.array(row[heads])), names.take(pa.array(code[heads]))]
                if of == "term":
                    cols += [pa.array(np.diff(bounds)), pa.array(pos[heads].astype(np.int64))]
                else:
                    cols += [pa.array(lengths[row[heads]]), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(pos[order]))]
                yield pa.RecordBatch.from_arrays(cols, kinds)

    key = texts.schema[0]
    rest = [("tf", "bigint"), ("first_pos", "bigint")] if of == "term" else [("length", "bigint"), ("positions", "array<int>")]
    kinds = [key.name, of, *[name for name, _ in rest]]
    return texts.mapInArrow(run, f"`{key.name}` {key.dataType.simpleString()}, {of} string, " + ", ".join(f"{name} {kind}" for name, kind in rest))


def rows(texts: DataFrame) -> DataFrame:
    """A row for each of ``texts`` (a key, an array of words) that has words: its ``length``, its different stems joined by newlines as ``names``, and ``tf`` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in _slices(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)):
                part = batch.slice(begin, end - begin)
                part = part.filter(pc.greater(pc.fill_null(pc.list_value_length(part.column(1)), 0), 0))
                if not part.num_rows:
                    continue
                lengths = pc.list_value_length(part.column(1)).to_numpy().astype(np.int64)
                names, code = _stems(part.column(1).flatten())
                groups, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths) * len(names) + code, return_counts=True)
                ends = pa.array(np.searchsorted(groups, np.arange(len(lengths) + 1) * len(names)).astype(np.int32))
                each = pa.ListArray.from_arrays(ends, names.take(pa.array(groups % len(names))))
                cols = [part.column(0), pa.array(lengths), pc.binary_join(each, "\n"), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(cols, [key.name, "length", "names", "tf"])

    key = texts.schema[0]
    return texts.mapInArrow(run, f"`{key.name}` {key.dataType.simpleString()}, length bigint, names string, tf array<int>")
