"""Porter's stemmer as rules on the end of a word, which become column expressions, functions of words inside tasks or, for oracles, SQL.

A rule holds for the part of the word before the ending. Conditions are patterns that both Java and RE2 read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Conditions on a stem: one run of vowels and consonants at least; more than one; exactly one; a vowel.
SOME = f"^(?:{_C})?{_V}{_C}"
MANY = f"^(?:{_C})?{_V}{_C}{_V}{_C}"
ONE = f"^(?:{_C})?{_V}{_C}(?:{_V})?$"
VOWEL = f"^(?:{_C})?[aeiouy]"
#: A short end: consonant, vowel and a consonant other than w, x and y.
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
DOUBLE = "(?:bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"

#: Endings of each step, what replaces them and the condition; the first ending that fits decides.
STEP_1A = [("sses", "ss", ""), ("ies", "i", ""), ("ss", "ss", ""), ("s", "", "")]
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["ement", "ment", "ance", "ence", "able", "ible", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]
#: Letters with marks, and the letters without: what the index takes as the same.
MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


class _Spark:
    """Column expressions."""

    lit = staticmethod(F.lit)

    @staticmethod
    def ends(w: Column, end: str) -> Column:
        return w.endswith(end)

    @staticmethod
    def cut(w: Column, n: int) -> Column:
        return F.substring(w, F.lit(1), F.length(w) - n)

    @staticmethod
    def has(w: Column, pattern: str) -> Column:
        return w.rlike(pattern)

    @staticmethod
    def add(w: Column, end: str) -> Column:
        return F.concat(w, F.lit(end)) if end else w

    @staticmethod
    def choose(cases: list[tuple[Column, Column]], other: Column) -> Column:
        out = F
        for condition, value in cases:
            out = out.when(condition, value)
        return out.otherwise(other)

    @staticmethod
    def both(a: Column, b: Column) -> Column:
        return a & b

    @staticmethod
    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))


class _Sql:
    """SQL text for oracles; ``let`` relies on ``list_transform``."""

    depth = 0

    @staticmethod
    def lit(x: str) -> str:
        return "'" + x + "'"

    @staticmethod
    def ends(w: str, end: str) -> str:
        return f"ends_with({w}, '{end}')"

    @staticmethod
    def cut(w: str, n: int) -> str:
        return f"left({w}, length({w}) - {n})"

    @staticmethod
    def has(w: str, pattern: str) -> str:
        return f"regexp_matches({w}, '{pattern}')"

    @staticmethod
    def add(w: str, end: str) -> str:
        return f"({w} || '{end}')"

    @staticmethod
    def choose(cases: list[tuple[str, str]], other: str) -> str:
        return "case " + " ".join(f"when {a} then {b}" for a, b in cases) + f" else {other} end"

    @staticmethod
    def both(a: str, b: str) -> str:
        return f"({a} and {b})"

    @classmethod
    def let(cls, value: str, body) -> str:
        cls.depth += 1
        name = f"w{cls.depth}"
        return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


class _Plain:
    """Functions of a word; what a case does not need is not worked out."""

    @staticmethod
    def lit(x: str):
        return lambda w: x

    @staticmethod
    def ends(e, end: str):
        def ended(w: str) -> bool:
            return e(w).endswith(end)

        ended.of, ended.end = e, end
        return ended

    @staticmethod
    def cut(e, n: int):
        return lambda w: e(w)[:-n]

    @staticmethod
    def has(e, pattern: str):
        found = re.compile(pattern).search
        return lambda w: found(e(w)) is not None

    @staticmethod
    def add(e, end: str):
        return lambda w: e(w) + end

    @staticmethod
    def choose(cases: list[tuple[Callable, Callable]], other):
        first = getattr(cases[0][0], "of", None)
        # Where all conditions are endings of one word, most words have none of them.
        ends = tuple(c.end for c, _ in cases) if first and all(getattr(c, "of", None) is first for c, _ in cases) else None

        def chosen(w: str):
            if ends and not first(w).endswith(ends):
                return other(w)
            for condition, value in cases:
                if condition(w):
                    return value(w)
            return other(w)

        return chosen

    @staticmethod
    def both(a, b):
        return lambda w: a(w) and b(w)

    @staticmethod
    def let(value, body):
        inner = body(lambda w: w)
        return lambda w: inner(value(w))


def _steps(k) -> list:
    """The steps of the algorithm, each from word to word, in terms of ``k``'s operations."""

    def rules(table: list[tuple[str, str, str]]):
        def step(w):
            cases = []
            for end, new, condition in table:
                stem_ = k.cut(w, len(end))
                changed = k.add(stem_, new)
                cases.append((k.ends(w, end), k.choose([(k.has(stem_, condition), changed)], w) if condition else changed))
            return k.choose(cases, w)

        return step

    def repaired(w):
        """After a removed ``ed`` or ``ing``."""
        return k.choose([(k.has(w, "(?:at|bl|iz)$"), k.add(w, "e")), (k.has(w, DOUBLE), k.cut(w, 1)), (k.has(w, SHORT), k.add(w, "e"))], w)

    def step_1b(w):
        def without(n: int):
            return k.choose([(k.has(k.cut(w, n), VOWEL), k.let(k.cut(w, n), repaired))], w)

        return k.choose([(k.ends(w, "eed"), k.choose([(k.has(k.cut(w, 3), SOME), k.cut(w, 1))], w)), (k.ends(w, "ed"), without(2)), (k.ends(w, "ing"), without(3))], w)

    def step_4(w):
        cases = [(k.ends(w, end), k.choose([(k.has(k.cut(w, len(end)), MANY), k.cut(w, len(end)))], w)) for end in STEP_4]
        cases.append((k.ends(w, "ion"), k.choose([(k.both(k.has(k.cut(w, 3), MANY), k.has(k.cut(w, 3), "[st]$")), k.cut(w, 3))], w)))
        return k.choose(cases, w)

    def step_5(w):
        rest = k.cut(w, 1)
        short = k.choose([(k.both(k.has(rest, ONE), k.has(rest, SHORT)), w), (k.has(rest, ONE), rest)], w)
        return k.choose([(k.ends(w, "e"), k.choose([(k.has(rest, MANY), rest)], short))], w)

    def step_5b(w):
        return k.choose([(k.both(k.ends(w, "ll"), k.has(w, MANY)), k.cut(w, 1))], w)

    return [
        rules(STEP_1A), step_1b, rules([("y", "i", VOWEL)]), rules([(a, b, SOME) for a, b in sorted(STEP_2, key=lambda x: -len(x[0]))]),
        rules([(a, b, SOME) for a, b in STEP_3]), step_4, step_5, step_5b,
    ]


def _stemmed(k, word):
    out = word
    for step in _steps(k):
        out = k.let(out, step)
    return out


def fold(term: Column) -> Column:
    """A term in lower case without marks on its letters."""
    return F.translate(F.lower(term), MARKED, PLAIN)


def stem(term: Column) -> Column:
    """The stem of a term: of Latin words of 3 to 64 letters, by Porter's rules; other terms are only folded.

    A ``y`` at the start is written large while the rules run, since it is a consonant there.
    """

    def of(w: Column) -> Column:
        large = F.when(w.startswith("y"), F.concat(F.lit("Y"), F.substring(w, 2, 64))).otherwise(w)
        return F.when(w.rlike("^[a-z]{3,64}$"), F.lower(_stemmed(_Spark, large))).otherwise(w)

    return _Spark.let(fold(term), of)


_FOLD = str.maketrans(MARKED, PLAIN)
_LATIN = re.compile("[a-z]{3,64}").fullmatch
_of_word = _stemmed(_Plain, lambda w: w)
#: What some step looks for at the end of a word; a word with none of it is its own stem. Endings that end in another one are left out.
_ENDS = {end for table in (STEP_1A, STEP_2, STEP_3) for end, *_ in table} | {*STEP_4, "ion", "ed", "ing", "y", "e", "ll"}
_ENDS = tuple(sorted(e for e in _ENDS if not any(e != x and e.endswith(x) for x in _ENDS)))


@lru_cache(maxsize=1 << 17)
def stem_of(term: str) -> str:
    """The same of one term in lower case, as tokens of the index are."""
    w = term.translate(_FOLD)
    return _of_word("Y" + w[1:] if w[0] == "y" else w).lower() if _LATIN(w) and w.endswith(_ENDS) else w


def stem_sql(term: str) -> str:
    """The same in DuckDB SQL."""
    folded = f"translate(lower({term}), '{MARKED}', '{PLAIN}')"
    large = f"case when starts_with({folded}, 'y') then 'Y' || {folded}[2:] else {folded} end"
    return f"case when regexp_matches({folded}, '^[a-z]{{3,64}}$') then lower({_stemmed(_Sql, large)}) else {folded} end"
