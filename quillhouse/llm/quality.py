"""Operator 7, quality rules by line-first cleaning: judge each line, drop the failing ones, then reject documents that lose too much.

Only DataFrame functions: split, transform, filter and sort over each row's own arrays. Nothing is shuffled, so one
source holding a third of the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
_EDGE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Symbols that count in a line.
LINE_SYMBOLS = SYMBOLS + "{}[]=_~^\\!"
#: Words and phrases of page furniture, in English, German, French and Spanish: they mark a short line of which they stand for most.
NAVIGATION = (
    "home", "menu", "login", "logout", "log in", "log out", "sign in", "sign up", "register", "next", "previous", "back", "back to top", "share", "tweet", "subscribe", "contact", "contact us", "about", "about us",
    "sitemap", "search", "skip to content", "click here", "read more",
    "startseite", "menü", "anmelden", "abmelden", "registrieren", "weiter", "zurück", "nach oben", "teilen", "abonnieren", "kontakt", "über uns", "suche", "zum inhalt springen", "impressum", "weiterlesen",
    "accueil", "connexion", "déconnexion", "s'inscrire", "suivant", "précédent", "haut de page", "partager", "s'abonner", "contactez-nous", "à propos", "plan du site", "rechercher", "aller au contenu", "lire la suite",
    "inicio", "menú", "iniciar sesión", "cerrar sesión", "registrarse", "siguiente", "anterior", "volver arriba", "compartir", "suscribirse", "contacto", "quiénes somos", "mapa del sitio", "buscar", "saltar al contenido", "leer más",
)
#: Phrases that mark a line as boilerplate when they make up enough of it, in the same languages.
BOILERPLATE = (
    "all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy", "use of cookies", "enable javascript", "javascript is disabled", "lorem ipsum", "powered by", "click here", "read more",
    "page not found", "404 not found",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "verwendung von cookies", "hier klicken", "mehr erfahren", "seite nicht gefunden",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "utilisation de cookies", "cliquez ici", "en savoir plus", "page introuvable",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "uso de cookies", "haga clic aquí", "página no encontrada",
)
#: Characters that close a line of prose.
CLOSING = (".", "!", "?", "…", ":", ";", '"', "'", ")", "]", "”", "’", "»", "“", "。", "！", "？", "」")
#: Visible characters of a line that fails for want of a closing mark: shorter ones may be headings, longer ones are paragraphs that lost theirs.
OPEN_LEAST, OPEN_MOST = 30, 300
#: Visible characters of a line that can be navigation, at most.
SHORT = 60
_EITHER = {"phrase": BOILERPLATE, "furniture": NAVIGATION}
_WHOLE = {k: r"(?<![\p{L}\p{N}])(?:" + "|".join(sorted(v, key=len, reverse=True)) + r")(?![\p{L}\p{N}])" for k, v in _EITHER.items()}
#: Symbols at least in a line that fails for them, unless they are half of it.
LEAST_SYMBOLS = 3


def words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_EDGE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def _visible(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, SPACE, ""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once: a bound name stays one when the optimizer moves expressions into each other."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Bits of a window's place; the other bits of a packed number are the hash's.
_PLACE = 24


def _repeated(ws: Column) -> Column:
    """Words that lie in a three-word window found twice or more.

    Windows are first sorted as numbers that hold a part of their hash and their place. Those whose part a neighbour has
    are sorted once more by the whole hash with their place, equal neighbours are kept, and then the places in order, each
    adding three words less what the one before already covers.
    """
    last = F.size(ws) - 2
    none, low = F.array().cast("array<bigint>"), (1 << _PLACE) - 1

    def hashed(i: Column) -> Column:
        return F.xxhash64(F.get(ws, i - 1), F.lit(1), F.get(ws, i), F.lit(2), F.get(ws, i + 1))

    def alike(x: Column) -> Column:
        part = lambda m: F.shiftright(m, _PLACE)
        hit = F.filter(x, lambda m, k: F.coalesce(part(F.get(x, k - 1)) == part(m), F.lit(False)) | F.coalesce(part(F.get(x, k + 1)) == part(m), F.lit(False)))
        return F.transform(hit, lambda m: m.bitwiseAND(F.lit(low)))

    def covered(x: Column) -> Column:
        hit = F.filter(x, lambda m, k: (F.get(x, k - 1)["h"] == m["h"]) | (F.get(x, k + 1)["h"] == m["h"]))
        places = F.sort_array(F.transform(hit, lambda m: m["i"]))
        return F.aggregate(places, F.struct(F.lit(-3).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("sum")), lambda s, p: F.struct(p.alias("at"), (s["sum"] + F.least(F.lit(3).cast("bigint"), p - s["at"])).alias("sum")))["sum"]

    places = F.sequence(F.lit(1).cast("bigint"), last.cast("bigint"))
    packed = F.sort_array(F.transform(places, lambda i: hashed(i.cast("int")).bitwiseAND(F.lit(~low)).bitwiseOR(i)))
    some = F.when(last < 1, none).when(last > low, places).otherwise(_let(packed, alike))
    marks = F.transform(some, lambda i: F.struct(hashed(i.cast("int")).alias("h"), i.alias("i")))
    return _let(F.sort_array(marks), covered)


def _without(low: Column, kind: str) -> Column:
    """Visible characters of a line in lower case besides the phrases of a kind, as whole words."""
    return _visible(F.regexp_replace(low, _WHOLE[kind], ""))


def line_fails(line: Column, chars: Column, following: Column, symbols_in_text: Column, phrases_in_text: Column, max_symbols: float, max_upper: float, max_boilerplate: float, max_furniture: float) -> Column:
    """Whether a line of ``chars`` visible characters, one at least, is to go.

    Its reasons: many symbols (``LEAST_SYMBOLS`` or half of the line, besides their share); shouting; few letters; no
    closing mark at its end, if it has ``OPEN_LEAST`` to ``OPEN_MOST`` characters and the following line does not carry on
    in lower case; a short line of which page furniture holds ``max_furniture``; boilerplate phrases, as whole words, that
    hold more than ``max_boilerplate`` of the characters.
    """

    def by_symbols(n: Column) -> Column:
        return (n > F.lit(max_symbols) * chars) & ((n >= LEAST_SYMBOLS) | (n * 2 >= chars))

    def by_letters(n: Column) -> Column:
        upper = F.char_length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
        return ((n >= 20) & (upper > F.lit(max_upper) * n)) | (n * 3 < chars)

    def by_phrases(low: Column) -> Column:
        found = F.greatest(*[F.contains(low, F.lit(p)) for p in BOILERPLATE])
        return found & (chars - _without(low, "phrase") > F.lit(max_boilerplate) * chars)

    end = F.substring(F.rtrim(line, F.lit(_EDGE)), -1, 1)
    carried_on = F.coalesce(following.rlike(r"^\p{Ll}"), F.lit(False))
    bare = F.regexp_replace(F.lower(line), r"[.,:;!?|>/·•\-\[\]()]+", " ")
    return (
        (symbols_in_text & _let(F.char_length(line) - F.char_length(F.translate(line, LINE_SYMBOLS, "")), by_symbols))
        | ((chars >= 20) & _let(F.char_length(F.regexp_replace(line, r"[^\p{L}]+", "")), by_letters))
        | (chars.between(OPEN_LEAST, OPEN_MOST) & ~end.isin(*CLOSING) & ~carried_on)
        | ((chars <= SHORT) & _let(bare, lambda low: _let(_visible(low), lambda n: (n > 0) & (n - _without(low, "furniture") >= F.lit(max_furniture) * n))))
        | (phrases_in_text & _let(F.lower(line), by_phrases))
    )


def line_first(
    docs: DataFrame,
    text_col: str = "text",
    *,
    min_words: int = 50,
    max_repeat: float = 0.5,
    max_loss: float = 0.3,
    max_symbols: float = 0.08,
    max_upper: float = 0.7,
    max_boilerplate: float = 0.2,
    max_furniture: float = 0.75,
) -> DataFrame:
    """``docs`` with ``quality``: a struct of counts, the cleaned text and the verdict.

    Fields: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``base_failed`` (too few words, or
    more than ``max_repeat`` of them inside repeated three-word windows), ``n_lines_dropped``, ``chars_dropped``,
    ``clean_text`` (lines that pass, and blank ones, joined by a line feed) and ``kept``: false if ``base_failed``, or if
    the dropped lines hold more than ``max_loss`` of the characters in words. Words are runs of characters other than
    space and U+0009 to U+000D. A null or empty text has no words and so fails. Input columns pass through; one that is
    called ``quality`` is replaced. Rows are judged one by one, so repeats and ties need no rule; null ids pass.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def judged(lines: Column, symbols: Column, phrases: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            def at(chars: Column) -> Column:
                fails = line_fails(line, chars, F.get(lines, i + 1), symbols, phrases, max_symbols, max_upper, max_boilerplate, max_furniture)
                return F.struct(line.alias("line"), chars.alias("chars"), F.coalesce((chars > 0) & fails, F.lit(False)).alias("bad"))

            return _let(_visible(line), at)

        return F.transform(lines, one)

    symbols = F.char_length(F.translate(text, LINE_SYMBOLS, "")) < F.char_length(text)
    phrases = _let(F.lower(text), lambda low: F.greatest(*[F.contains(low, F.lit(p)) for p in BOILERPLATE]))
    counted = _let(words(text), lambda ws: F.struct(F.size(ws).alias("n"), _repeated(ws).alias("repeated")))

    def all_of(flags: Column, lines: Column, ws: Column) -> Column:
        return F.struct(
            ws["n"].cast("long").alias("n_words"),
            F.when(flags["symbols"], F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).otherwise(F.lit(0)).cast("long").alias("n_symbols"),
            ws["repeated"].cast("long").alias("n_repeat_words"),
            judged(lines, flags["symbols"], flags["phrases"]).alias("judged"),
        )

    flags = F.struct(symbols.alias("symbols"), phrases.alias("phrases"))
    out = docs.withColumn("quality", _let(flags, lambda f: _let(F.split(text, "\n"), lambda ls: _let(counted, lambda ws: all_of(f, ls, ws)))))
    q = F.col("quality")

    def verdict(v: Column) -> Column:
        total = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda s, x: s + x["chars"])
        solid = F.transform(F.filter(v["judged"], lambda x: x["chars"] > 0), lambda x: x["line"])

        def of(bad: Column) -> Column:
            return F.struct(
                v["n_words"].alias("n_words"), total(v["judged"]).alias("word_chars"), v["n_symbols"].alias("n_symbols"),
                _let(solid, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"), v["n_repeat_words"].alias("n_repeat_words"),
                ((v["n_words"] < min_words) | (v["n_repeat_words"] > F.lit(max_repeat) * v["n_words"])).alias("base_failed"),
                F.size(bad).cast("long").alias("n_lines_dropped"), total(bad).alias("chars_dropped"),
                F.array_join(F.transform(F.filter(v["judged"], lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("clean_text"),
            )

        return _let(F.filter(v["judged"], lambda x: x["bad"]), of)

    out = out.withColumn("quality", _let(q, verdict))
    kept = ~q["base_failed"] & (q["chars_dropped"] <= F.lit(max_loss) * q["word_chars"])
    return out.withColumn("quality", q.withField("kept", kept))


def clean(docs: DataFrame, text_col: str = "text", **rules: float) -> DataFrame:
    """The documents that ``line_first`` keeps, their text without the lines that fail; the other columns as they were.

    A generator that gives one row or none stands in for a filter, which would be pushed below and judge twice.
    """
    judged = line_first(docs, text_col, **rules)
    one = F.explode(F.when(F.col("quality.kept"), F.array(F.col("quality.clean_text"))).otherwise(F.array().cast("array<string>")))
    return judged.select(*[c for c in docs.columns if c not in (text_col, "quality")], one.alias(text_col)).select(*[c for c in docs.columns if c != "quality"])
