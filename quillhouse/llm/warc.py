"""Operator 1, WARC derivative builder: metadata and plain-text conversion records linked to the responses they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text; elements that end a line; named entities. Fixed values.
SILENT = ("script", "style", "noscript", "template", "svg")
BREAKING = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul"
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&",
    "iexcl": "¡", "cent": "¢", "pound": "£", "yen": "¥", "sect": "§", "copy": "©", "laquo": "«", "raquo": "»", "reg": "®", "deg": "°", "plusmn": "±", "para": "¶", "middot": "·", "iquest": "¿", "times": "×", "divide": "÷",
    "Agrave": "À", "Aacute": "Á", "Acirc": "Â", "Atilde": "Ã", "Auml": "Ä", "Aring": "Å", "AElig": "Æ", "Ccedil": "Ç", "Egrave": "È", "Eacute": "É", "Ecirc": "Ê", "Euml": "Ë", "Iacute": "Í", "Icirc": "Î", "Iuml": "Ï",
    "Ntilde": "Ñ", "Oacute": "Ó", "Ocirc": "Ô", "Ouml": "Ö", "Oslash": "Ø", "Uacute": "Ú", "Ucirc": "Û", "Uuml": "Ü", "szlig": "ß",
    "agrave": "à", "aacute": "á", "acirc": "â", "atilde": "ã", "auml": "ä", "aring": "å", "aelig": "æ", "ccedil": "ç", "egrave": "è", "eacute": "é", "ecirc": "ê", "euml": "ë", "iacute": "í", "icirc": "î", "iuml": "ï",
    "ntilde": "ñ", "oacute": "ó", "ocirc": "ô", "ouml": "ö", "oslash": "ø", "uacute": "ú", "ugrave": "ù", "ucirc": "û", "uuml": "ü", "oelig": "œ",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "sbquo": "‚", "ldquo": "“", "rdquo": "”", "bdquo": "„", "bull": "•", "hellip": "…", "euro": "€", "trade": "™",
}
#: An entity by name or number; numbers of at most six digits that are a character.
ENTITY = "&([A-Za-z]{2,8}|#[0-9]{1,6}|#[xX][0-9a-fA-F]{1,5});"
CRLF = "\r\n"


def _character(entity: Column) -> Column:
    """What an entity stands for, null if that is not known; a space for a number that is no character or a control character."""
    number = F.when(F.lower(F.substring(entity, 2, 1)) == "x", F.conv(F.substring(entity, 3, 5), 16, 10)).otherwise(F.substring(entity, 2, 6)).cast("int")
    plain = (number >= 32) & ~number.between(0x7F, 0xA0) & ~number.between(0xD800, 0xDFFF) & (number <= 0x10FFFF)
    char = F.when(plain, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(F.lit(" "))
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair]), entity)
    return F.when(entity.startswith("#"), char).otherwise(named)


def _read_entities(text: Column) -> Column:
    """``text`` with its entities read once: those that give an ampersand come last."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1)))
    known = F.filter(F.transform(found, lambda e: F.struct(e.alias("e"), _character(e).alias("c"))), lambda x: x["c"].isNotNull())
    put = lambda acc, x: F.replace(acc, F.concat(F.lit("&"), x["e"], F.lit(";")), x["c"])

    def both(k: Column) -> Column:
        first = F.aggregate(F.filter(k, lambda x: x["c"] != "&"), text, put)
        return F.aggregate(F.filter(k, lambda x: x["c"] == "&"), first, put)

    return F.when(F.contains(text, F.lit("&")), F.get(F.transform(F.array(known), both), F.lit(0))).otherwise(text)


def plain_text(html: Column) -> Column:
    """Visible text: silent elements and comments gone, breaking tags as line ends, entities read, white space collapsed.

    A silent element or comment that is never closed goes to the end of the page.
    """
    out = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")
    out = F.regexp_replace(out, rf"(?is)<({'|'.join(SILENT)})(?:[\s/][^>]*)?>.*?(?:</\1(?:[\s/][^>]*)?>|\z)", "")
    out = F.regexp_replace(out, r"[ \t\r\n\f]{2,}|[\t\r\n\f]", " ")  # single spaces stay as they are
    out = F.regexp_replace(out, f"(?i)</?({BREAKING})(/| [^>]*)?>", "\n")
    out = F.regexp_replace(out, "<[^>]*>", "")
    out = F.get(F.transform(F.array(out), _read_entities), F.lit(0))
    lines = F.transform(F.split(F.regexp_replace(out, " {2,}", " "), "\n"), lambda x: F.btrim(x, F.lit(" ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def _urn(*parts: Column) -> Column:
    """An identifier that the same source always gets."""
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "1970-01-01T00:00:00Z", content_type: str = "text/html; charset=utf-8") -> DataFrame:
    """Pages as response records: ``(source_id, record_id, target_uri, date, http_headers, body)``, ids from page id and address."""
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: {content_type}{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF))
    return pages.select(F.col(id_col).alias("source_id"), _urn(F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), url).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), body.alias("body"))


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response: ``metadata`` and ``conversion``.

    Columns: ``source_id, kind, record_id, refers_to, target_uri, date, content_type, source_payload_digest,
    block_digest, content_length, block``. ``refers_to`` is the response's record id; address, date and HTTP headers are
    the source's own (the headers and the source's digest stand in the metadata block); digests are SHA-256 of UTF-8
    bytes. Null bodies count as empty and give an empty conversion. Every row gives its two records, repeats included;
    equal sources give equal ids. A page of any length is read to its end; an empty table gives an empty one. Other
    columns, whatever their names, are dropped; nothing is shuffled.
    """
    base = source.select(
        "source_id", F.col("record_id").alias("refers_to"), F.coalesce("target_uri", F.lit("")).alias("target_uri"), F.coalesce("date", F.lit("1970-01-01T00:00:00Z")).alias("date"),
        F.coalesce("http_headers", F.lit("")).alias("http_headers"), F.coalesce("body", F.lit("")).alias("body"),
    )
    base = base.withColumns({"digest": _digest(F.col("body")), "text": plain_text(F.col("body"))})
    title = F.btrim(F.regexp_replace(F.regexp_extract("body", "(?is)<title[^>]*>([^<]*)</title>", 1), r"[ \t\r\n\f]+", " "), F.lit(" "))
    fields = F.concat(
        F.lit("via: "), "target_uri", F.lit(f"{CRLF}title: "), title, F.lit(f"{CRLF}sourcePayloadDigest: "), "digest", F.lit(f"{CRLF}textLength: "), F.char_length("text").cast("string"),
        F.lit(CRLF), "http_headers",
    )
    two = F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    rows = base.select("source_id", "refers_to", "target_uri", "date", "digest", F.explode(two).alias("r"))
    return rows.select(
        "source_id", "r.kind", _urn(F.col("r.kind"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri", "date", "r.content_type",
        F.col("digest").alias("source_payload_digest"), _digest(F.col("r.block")).alias("block_digest"), F.octet_length("r.block").cast("long").alias("content_length"), "r.block",
    )


def render(records: DataFrame) -> DataFrame:
    """``records`` with ``warc``: each record in WARC/1.1 form, header lines, blank line, block and two line ends."""
    lines = [
        ("WARC-Type", "kind"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "date"),
        ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"),
        ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"),
    ]
    head = F.concat(F.lit(f"WARC/1.1{CRLF}"), *[x for name, c in lines for x in (F.lit(f"{name}: "), F.col(c), F.lit(CRLF))], F.lit("Content-Length: "), F.col("content_length").cast("string"), F.lit(CRLF * 2), F.col("block"), F.lit(CRLF * 2))
    return records.withColumn("warc", head)


def oracle() -> str:
    """The registered query in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text = r"regexp_replace(coalesce(html, ''), '(?s)<!--.*?(?:-->|\z)', '', 'g')"
    for tag in SILENT:
        text = rf"regexp_replace({text}, '(?is)<{tag}(?:[\s/][^>]*)?>.*?(?:</{tag}(?:[\s/][^>]*)?>|\z)', '', 'g')"
    text = rf"regexp_replace({text}, '[ \t\r\n\f]+', ' ', 'g')"
    text = f"regexp_replace({text}, '(?i)</?({BREAKING})(/| [^>]*)?>', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    names = ", ".join(f"{quote(k)}: {quote(v)}" for k, v in ENTITIES.items())
    number = "(case when e[2] in ('x', 'X') then ('0x' || e[3:])::int else e[2:]::int end)"
    char = f"case when e[1] <> '#' then map {{{names}}}[e] when {number} < 32 or {number} between 127 and 160 or {number} between 55296 and 57343 or {number} > 1114111 then ' ' else chr({number}) end"
    put = "lambda t, p: {'e': '', 'c': '', 't': replace(t.t, '&' || p.e || ';', p.c)}"
    text = f"""(select list_reduce([{{'e': '', 'c': '', 't': raw}}] || list_filter(ents, lambda p: p.c <> '&') || list_filter(ents, lambda p: p.c = '&'), {put}).t
      from (select raw, list_filter(list_transform(list_distinct(regexp_extract_all(raw, {quote(ENTITY)}, 1)), lambda e: {{'e': e, 'c': {char}, 't': ''}}), lambda p: p.c is not null) as ents from (select {text} as raw)))"""
    text = rf"trim(regexp_replace(regexp_replace({text}, ' +', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
    urn = lambda x: f"(select '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' from (select md5({x}) as h))"
    crlf = "chr(13) || chr(10)"
    return f"""
with p as (select page_id, coalesce(url, '') as target_uri, coalesce(html, '') as body, {text} as text from pages),
b as (select *, {urn("'response|' || coalesce(page_id::varchar, '') || '|' || target_uri")} as refers_to, 'sha256:' || sha256(body) as digest,
  trim(regexp_replace(regexp_extract(body, '(?is)<title[^>]*>([^<]*)</title>', 1), '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ') as title from p),
r as (
  select page_id, 'metadata' as kind, refers_to, target_uri, 'application/warc-fields' as content_type, digest,
    'via: ' || target_uri || {crlf} || 'title: ' || title || {crlf} || 'sourcePayloadDigest: ' || digest || {crlf} || 'textLength: ' || length(text)::varchar || {crlf}
    || 'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(body)::varchar || {crlf} as block from b
  union all select page_id, 'conversion', refers_to, target_uri, 'text/plain; charset=utf-8', digest, text from b)
select page_id, kind, {urn("kind || '|' || refers_to")} as record_id, refers_to, target_uri, '1970-01-01T00:00:00Z' as date, content_type,
  digest as source_payload_digest, 'sha256:' || sha256(block) as block_digest, strlen(block)::bigint as content_length, block from r
"""
