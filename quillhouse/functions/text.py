"""Scalar functions as column expressions: slugs, titles, labels, snippets, queries, day slices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_CHARS = 200
_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def whole_json(text: Column) -> Column:
    """A text that is one JSON value and nothing else, parsed; else null.

    The parser by itself reads the first value and leaves what follows it: as the only item of a list it may not stand
    beside anything.
    """
    return F.when(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.try_parse_json(text))


def slug(path: Column) -> Column:
    """An absolute path as a project slug: everything but letters, digits and ``-`` becomes ``-``."""
    return F.regexp_replace(path, "[^A-Za-z0-9-]", "-")


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(_UUID), F.lit(False))


def target_slug(text: Column) -> Column:
    """A target given as path or slug, as a slug."""
    return F.when(text.startswith("/"), slug(text)).otherwise(text)


def _filled(title: Column) -> Column:
    return F.when(F.btrim(title) != "", title)


def display_title(user: Column, custom: Column, ai: Column, uuid: Column) -> Column:
    """The user's title, else the newest custom or generated one, else the start of the id; blank titles are skipped, others kept as they are."""
    return F.coalesce(_filled(user), _filled(ai), _filled(custom), F.substring(uuid, 1, 8))


def archive_title(custom: Column, ai: Column, uuid: Column) -> Column:
    """The title without the user's own."""
    return F.coalesce(ai, custom, F.substring(uuid, 1, 8))


def prefill_title(user: Column, custom: Column, ai: Column) -> Column:
    """What an editor of a title starts from: the user's title, else the generated or custom one, else nothing; never the stand-in made of the id."""
    return F.coalesce(user, ai, custom, F.lit(""))


def project_label(cwd: Column, slug_: Column) -> Column:
    """The last part of the working directory, else the slug's tail after ``-Users-``."""
    last = F.element_at(F.filter(F.split(F.coalesce(cwd, F.lit("")), "/"), lambda x: x != ""), -1)
    return F.coalesce(last, F.when(F.contains(slug_, F.lit("-Users-")), F.substring_index(slug_, "-Users-", -1)), slug_)


def clean_snippet(text: Column) -> Column:
    """A snippet without marks and with single spaces."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, "</?mark>", ""), r"\s+", " "))


def snippet_segments(text: Column) -> Column:
    """``array<struct<text, marked>>``: the parts of a snippet inside and outside its marks."""
    parts = F.split(F.regexp_replace(text, "</mark>", "<mark>"), "<mark>")
    both = F.transform(parts, lambda x, i: F.struct(x.alias("text"), (i % 2 == 1).alias("marked")))
    return F.filter(both, lambda s: s["text"] != "")


def query_terms(query: Column) -> Column:
    """``array<array<string>>``: what a query asks for, each entry a phrase of one or more lower-case tokens.

    With balanced quotation marks the quoted parts are phrases; otherwise marks count as spaces. What has no tokens asks for
    nothing. Never fails.
    """
    parts = F.split(F.coalesce(query, F.lit("")), '"')
    balanced = F.size(parts) % 2 == 1

    def tokens(x: Column) -> Column:
        return F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))

    def plain(x: Column) -> Column:
        # A word with an underscore is one term of several tokens.
        return F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), tokens), lambda t: F.size(t) > 0)

    mixed = F.flatten(F.transform(parts, lambda x, i: F.when(balanced & (i % 2 == 1), F.filter(F.array(tokens(x)), lambda t: F.size(t) > 0)).otherwise(plain(x))))
    return mixed


def day_slice(first: Column, last: Column, zone: str = "UTC") -> Column:
    """``struct<start, length>``: where in its local day a session lies, as fractions of the day.

    The length is at least 1/48; a day or more is the whole day; missing or reversed bounds give null.
    """
    local = F.from_utc_timestamp(first, zone)
    seconds = F.unix_timestamp(last) - F.unix_timestamp(first)
    day = F.struct(
        F.when(seconds >= 86400, F.lit(0.0)).otherwise((F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)) / 86400.0).alias("start"),
        F.when(seconds >= 86400, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0) / 48, seconds / 86400.0)).alias("length"),
    )
    return F.when(seconds >= 0, day)


def title_action(title: Column) -> Column:
    """What a user title asks for: ``delete`` when blank, ``reject`` when longer than allowed, else ``set``."""
    return F.when(F.btrim(F.coalesce(title, F.lit(""))) == "", "delete").when(F.char_length(title) > TITLE_CHARS, "reject").otherwise("set")
