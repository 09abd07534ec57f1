"""Operator 4, toxicity: Levenshtein automata intersected with a lexicon trie find misspelled terms; context windows weigh abuse against quotation."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillhouse.llm.common import blocks, table

_WORD = re.compile(r"[^\W\d_]+(?:[0-9@$!|*]+[^\W\d_]+)*")
_QUOTE = re.compile("[\"“”«»„‟‘]")
#: Characters of a stem: a term that ends in ``*`` matches every word that starts with it.
STEMS = (4, 5, 6)
#: Words on both sides of a hit that make its context window.
WINDOW = 12
#: Words near a hit that speak about it rather than use it, and words that address someone. Fixed lists in natural order.
REPORTING = frozenset({
    "said", "says", "say", "wrote", "writes", "called", "calls", "word", "words", "term", "quote", "quoted", "reported",
    "sagte", "schrieb", "wort", "dit", "dijo", "palabra", "mot",
})
ADDRESS = frozenset({"you", "your", "you're", "u", "ur", "du", "dich", "dein", "ihr", "tu", "toi", "vous", "te", "tes", "tú", "eres", "usted"})
#: Labelled rows the classifier is fitted on, at most: with label 1, with label 0, those of the least hash.
FIT_TOXIC, FIT_CLEAN = 6_000, 12_000
#: Terms that a task counts before it sends them on, and states that an automaton keeps before it starts anew.
MOST_TERMS, MOST_STATES = 400_000, 100_000


def edits(term: str) -> int:
    """Edits at which a word still counts as the term: none for short terms and stems, two for long ones."""
    n = len(term)
    return 0 if term.endswith("*") or n < 5 else 1 if n < 9 else 2


class Automaton:
    """Levenshtein automata of all terms run together along their trie, made deterministic as far as words need it.

    A state is a set of ``(trie node, edits left)``; ``match`` walks a word through it and returns ``(term, edits)`` of
    the closest term, or nothing. Ties go to the longer, then the first term.
    """

    def __init__(self, terms: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.budget = [0]
        for t in sorted(terms):
            node = 0
            self.budget[0] = max(self.budget[0], edits(t))
            for ch in t.rstrip("*"):
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.budget.append(0)
                node = self.children[node][ch]
                self.budget[node] = max(self.budget[node], edits(t))
            self.term[node] = t if self.term[node] is None else self.term[node]
        self._reset()

    def _reset(self) -> None:
        self.steps: list[dict[str, int]] = []
        self.states: list[frozenset] = []
        self.ends: list[tuple[str, int] | None] = []
        self.number: dict[frozenset, int] = {}
        self.dead = self._state(frozenset())
        self.start = self._state(self._skip({(0, 0)}))

    def _skip(self, at: set[tuple[int, int]]) -> frozenset:
        """Adds what is reached by leaving out letters of a term; keeps the fewest edits for each node."""
        best: dict[int, int] = {}
        todo = list(at)
        while todo:
            node, used = todo.pop()
            if used > self.budget[node] or best.get(node, 99) <= used:
                continue
            best[node] = used
            todo += [(c, used + 1) for c in self.children[node].values()]
        return frozenset(best.items())

    def _state(self, at: frozenset) -> int:
        if at not in self.number:
            self.number[at] = len(self.states)
            self.states.append(at)
            self.steps.append({})
            ends = [(used, -len(t), t) for node, used in at if (t := self.term[node]) and used <= edits(t) and (not used or not t.endswith("*"))]
            self.ends.append((min(ends)[2], min(ends)[0]) if ends else None)
        return self.number[at]

    def _step(self, state: int, ch: str) -> int:
        to = set()
        for node, used in self.states[state]:
            if ch in self.children[node]:
                to.add((self.children[node][ch], used))
            if (t := self.term[node]) and t.endswith("*") and not used:
                to.add((node, used))  # a stem takes any ending
            to.add((node, used + 1))
            to.update((c, used + 1) for c in self.children[node].values())
        got = self._state(self._skip(to))
        self.steps[state][ch] = got
        return got

    def match(self, word: str) -> tuple[str, int] | None:
        if len(self.states) > MOST_STATES:
            self._reset()
        state = self.start
        for ch in word:
            nxt = self.steps[state].get(ch)
            state = self._step(state, ch) if nxt is None else nxt
            if state == self.dead:
                return None
        return self.ends[state]


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _terms(words: set[str]) -> set[str]:
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


class Model:
    """A lexicon, the weights of fuzzy forms and a logistic regression over context features."""

    def __init__(self, terms: list[str], forms: dict[str, float], rare: float) -> None:
        self.terms, self.forms, self.rare = terms, forms, rare
        self.automaton = Automaton(terms)
        self.weights = np.zeros(8)

    def features(self, text: str) -> list[float]:
        words = tokens(text)
        hits = [(i, *m) for i, w in enumerate(words) if (m := self.automaton.match(w))]
        if not hits:
            return [1.0, 0, 0, 0, 0, 0, 0, 0]
        quoted = self._quoted(text) if _QUOTE.search(text) else set()
        abuse = quote = form = address = 0.0
        dense = 0
        exact = [i for i, _, used in hits if not used]
        reports = [i for i, w in enumerate(words) if w in REPORTING]
        spoken_to = [i for i, w in enumerate(words) if w in ADDRESS]

        def near(places: list[int], i: int) -> int:
            """How many of the places lie in the window around ``i``."""
            return bisect_right(places, i + WINDOW) - bisect_left(places, i - WINDOW)

        for i, _, used in hits:
            says = i in quoted or near(reports, i) > 0
            if used:
                form += self.forms.get(words[i], self.rare) * (0.5 if says else 1.0)
            elif says:
                quote += 1
            else:
                abuse += 1
                address += near(spoken_to, i) > 0
            dense = max(dense, near(exact, i))
        return [1.0, math.log1p(abuse), math.log1p(quote), max(-4.0, min(6.0, form)), float(dense), float(bool(exact)), math.log1p(address), math.log1p(1000 * len(exact) / max(1, len(words)))]

    @staticmethod
    def _quoted(text: str) -> set[int]:
        """Numbers of the words that stand between two quotation marks in one line."""
        out: set[int] = set()
        at = 0
        for line in text.lower().split("\n"):
            marks = [m.start() for m in _QUOTE.finditer(line)]
            paired = len(marks) // 2 * 2
            starts = [m.start() for m in _WORD.finditer(line)]
            # Between the marks of a pair an odd number of marks lies before a word.
            out.update(at + k for k, x in enumerate(starts) if (before := bisect_right(marks, x)) % 2 and before < paired)
            at += len(starts)
        return out

    def score(self, text: str) -> float:
        z = float(self.weights @ np.array(self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 25) -> np.ndarray:
    """Newton's method for a ridge-penalised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _lexicon(terms: list[str], clean: list[int], row: np.ndarray, term: np.ndarray, n_toxic: int, least: int) -> list[str]:
    """Terms of high precision that together cover the toxic rows, the widest first; a term must add ``least`` rows.

    ``row`` and ``term`` pair toxic rows, in order, with places in ``terms``; ``clean`` has the clean rows of each term.
    Words that only ride along in copies of one text add nothing once the text's own term is in.
    """
    if not terms:
        return []
    n = len(terms)
    size = np.bincount(term, minlength=n)
    gain, by_term = size.copy(), np.argsort(term, kind="stable")
    ends = np.cumsum(size)
    starts = np.searchsorted(row, np.arange(n_toxic + 1))
    # Place in the order in which of two terms the later wins: a whole word before a stem, the longer, the last.
    rank = np.empty(n, np.int64)
    rank[sorted(range(n), key=lambda k: (not terms[k].endswith("*"), len(terms[k]), terms[k]))] = np.arange(n)
    named = sorted((t.rstrip("*"), k) for k, t in enumerate(terms))
    names, places = [x for x, _ in named], np.array([k for _, k in named])
    left, out = np.ones(n_toxic, bool), []
    while (top := int(gain.max())) >= least:
        some = np.flatnonzero(gain == top)
        name = terms[some[rank[some].argmax()]].rstrip("*")
        # Of a stem and longer ones of nearly equal reach, the longest; a whole word before a stem.
        alike = places[bisect_left(names, name) : bisect_left(names, name + chr(0x10FFFF))]
        alike = alike[(gain[alike] >= 0.98 * top) & (gain[alike] >= least)]
        best = alike[rank[alike].argmax()]
        out.append(terms[best])
        new = row[by_term[ends[best] - size[best] : ends[best]]]
        new = new[left[new]]
        left[new] = False
        gain -= np.bincount(np.concatenate([term[starts[r] : starts[r + 1]] for r in new]), minlength=n)
    # What other terms covered first, but no clean row holds and many toxic ones do, belongs in the lexicon too; of nested stems, the widest.
    wide = [k for k in np.flatnonzero(size >= max(10, 0.02 * n_toxic)).tolist() if not clean[k]]
    for k in sorted(wide, key=lambda k: (terms[k].endswith("*"), -size[k], -len(terms[k]), terms[k])):
        t = terms[k]
        nested = t.endswith("*") and any(o.startswith(t[:-1]) or t[:-1].startswith(o.rstrip("*")) for o in out)
        if not nested and t not in out:
            out.append(t)
    return sorted(out)


def _precise(n_toxic: int, toxic_rows: Column, n_clean: int, clean_rows: Column) -> Column:
    """The share of toxic rows among those with a term, were both labels as frequent."""
    odds = n_clean / max(1, n_toxic)
    return toxic_rows * odds / (toxic_rows * odds + clean_rows + 0.5)


def fit(docs: DataFrame, labels: DataFrame, *, held_out: int = 5, precision: float = 0.97, least: int = 4) -> Model:
    """Learns a model from labelled rows whose ``crc32(doc_id as text) mod held_out`` is not 0.

    Of them it takes at most ``FIT_TOXIC`` rows with label 1 and ``FIT_CLEAN`` with label 0, those with the least hash of
    their id. Terms are counted and held against ``precision`` on the executors; the driver gets the precise ones that
    ``least`` toxic rows hold, however large the sample, and their numbers for each row. Against twice as many clean rows
    a term that none of them holds is precise from 9 toxic rows on. Labels, language, source and id are no inputs of a
    score. Without any labelled row nothing counts as toxic.
    """
    train = labels.where("doc_id is not null and toxic is not null").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(held_out)) != 0)
    train = train.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = None
    for label, most in ((1, FIT_TOXIC), (0, FIT_CLEAN)):
        part = train.where(F.col("toxic") == label).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = table(rows.repartition("doc_id"), "sample").select("doc_id", "text", "toxic")
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: tuple[Counter, Counter] = (Counter(), Counter())

        def send() -> Iterator[pa.RecordBatch]:
            names = list(got[0] | got[1])
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([got[k][t] for t in names], pa.int64()) for k in (1, 0)]], ["term", "toxic", "clean"])
            for c in got:
                c.clear()

        for part, *_ in blocks(batches):
            for label, x in zip(part.column(2).to_pylist(), part.column(1).to_pylist(), strict=True):
                got[label].update(_terms(set(tokens(x))))
            if len(got[0]) + len(got[1]) > MOST_TERMS:
                yield from send()
        yield from send()

    sums = rows.where("toxic in (0, 1)").mapInArrow(counted, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sums = sums.where((F.col("toxic") >= least) & (_precise(n_toxic, F.col("toxic"), n_clean, F.col("clean")) >= precision)).select("term", "clean")
    precise = sorted((r.term, r.clean) for r in sums.toLocalIterator())
    fits = [t for t, _ in precise]
    number = {t: i for i, t in enumerate(fits)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, *_ in blocks(batches):
            got = [np.array(sorted(number[t] for t in _terms(set(tokens(x))) if t in number), np.int32).tobytes() for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.binary())], ["doc_id", "terms"])

    each = [np.frombuffer(bytes(r.terms), np.int32) for r in rows.where("toxic = 1").mapInArrow(held, "doc_id long, terms binary").select("terms").toLocalIterator()]
    at = np.repeat(np.arange(len(each), dtype=np.int32), [len(x) for x in each])
    terms = _lexicon(fits, [c for _, c in precise], at, np.concatenate(each) if each else at, n_toxic, least)
    bare = Model(terms, {}, 0.0)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = bare.automaton.match
        for part, *_ in blocks(batches):
            forms, labels_ = [], []
            for label, x in zip(part.column(2).to_pylist(), part.column(1).to_pylist(), strict=True):
                some = [w for w in set(tokens(x)) if (m := match(w)) and m[1]]
                forms += some
                labels_ += [label] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array(labels_, pa.int32())], ["form", "toxic"])

    found = rows.mapInArrow(seen, "form string, toxic int").groupBy("form").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()
    odds = n_clean / max(1, n_toxic)

    def weight(t: float, c: float) -> float:
        return math.log((t * odds + 0.5) / (c + 0.5))

    few = [(r.t, r.n - r.t) for r in found if r.n <= 3]
    rare = weight(sum(t for t, _ in few) / len(few), sum(c for _, c in few) / len(few)) if few else 0.5
    model = Model(terms, {r.form: weight(r.t, r.n - r.t) for r in found}, max(-1.0, min(2.0, rare)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, *_ in blocks(batches):
            x = [model.features(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    data = rows.mapInArrow(describe, "doc_id long, toxic int, x array<double>").toPandas()
    if not len(data):
        model.weights[0] = -4.0
    else:
        data["order"] = data["x"].map(tuple)  # the same sums wherever the rows came from
        data = data.sort_values(["doc_id", "order"])
        model.weights = logistic(np.array(data["x"].tolist()), data["toxic"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` for every row: the model's probability of label 1, and whether it is 0.5 or more.

    Whole texts are read; a null or empty one gets the score of a text without hits. Rows are judged one by one, null
    ids and repeats included; other columns are dropped.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, *_ in blocks(batches):
            s, h = [], []
            for text in part.column(1).to_pylist():
                s.append(model.score(text))
                h.append(1 if s[-1] >= 0.5 else 0)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array(h, pa.int32())], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
