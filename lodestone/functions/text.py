"""Text columns: spans, normalization, page and query classification. Offsets are code points, from 0, half open."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from lodestone.functions import fixed


#: What counts as white space at the ends of a text, in Unicode's sense.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.trim(c, F.lit(WHITE))


def any_of(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def bind_span(text: Column, quote: Column) -> Column:
    """struct(start, end) of the only occurrence; null if there is none, several (overlapping ones count), or the quote is empty."""
    at = F.position(quote, text)
    again = F.position(quote, text, at + 1)
    return F.when((F.length(quote) > 0) & (at > 0) & (again == 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(quote)).alias("end")))


def span_drop_reason(text: Column, quote: Column) -> Column:
    """Why no span is bound: quote_not_in_source or quote_ambiguous; null where one is."""
    at = F.position(quote, text)
    return F.when((F.length(quote) == 0) | (at == 0), "quote_not_in_source").when(F.position(quote, text, at + 1) > 0, "quote_ambiguous")


def context_window(text: Column, start: Column, end: Column, radius: int = fixed.CONTEXT_RADIUS) -> Column:
    """struct(context, offset): the text around a span and where the span starts in it."""
    first = F.greatest(F.lit(0), start - radius)
    return F.struct(F.substring(text, first + 1, F.least(F.length(text), end + radius) - first).alias("context"), (start - first).alias("offset"))


@pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode composition, which Spark has no function for."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def normalise(c: Column, *, compose: bool = True) -> Column:
    """Composed; line ends LF; at most one empty line; no white space at line ends; one LF at the end."""
    c = nfc(c) if compose else c
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"[^\S\n]+(?=\n|$)", "")
    return F.concat(F.regexp_replace(c, "\n+$", ""), F.lit("\n"))


def looks_parked(text: Column) -> Column:
    return F.lower(text).rlike(any_of(fixed.PARKED)) | (F.length(strip(text)) < fixed.PARKED_CHARS)


def is_consent_wall(text: Column, html: Column) -> Column:
    return (F.length(text) < fixed.THIN_CHARS) & F.lower(F.concat(text, F.lit(" "), F.substring(html, 1, 2000))).rlike(any_of(fixed.CONSENT))


def looks_priced(text: Column) -> Column:
    return text.rlike(fixed.PRICE_SHAPE)


def fetch_outcome(status: Column, content_type: Column, text: Column, html: Column) -> Column:
    """The ordered gates that a fetched page passes: not_modified, http_error, content_type, consent_wall, thin, ok."""
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    return (
        F.when(status == 304, "not_modified").when((status < 200) | (status >= 300), "http_error").when(~kind.isin(fixed.CONTENT_TYPES), "content_type")
        .when(is_consent_wall(text, html), "consent_wall").when(F.length(text) < fixed.THIN_CHARS, "thin").otherwise("ok")
    )


def query_rejection(q: Column) -> Column:
    """The first of four classes that a query falls in; null if it is accepted."""
    return (
        F.when(F.length(q) > fixed.MAX_QUERY_CHARS, "too_long")
        .when(q.rlike("(?i)" + "|".join(fixed.INJECTION)), "injection_attempt")
        .when(F.lower(q).rlike(any_of(fixed.BLOCKED)), "blocklisted_category")
        .when((F.length(strip(q)) < 3) | strip(q).rlike("(?i)" + "|".join(fixed.NON_PRODUCT)), "non_product")
    )


def markers(c: Column) -> Column:
    """Ids in citation marks like [3, 7], in order, without repeats."""
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1)), lambda m: F.transform(F.split(m, r"\s*,\s*"), lambda x: x.cast("long")))))


def without_markers(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s*\[\d+(?:\s*,\s*\d+)*\]", ""))


#: Words before a full stop that do not end a sentence.
ABBREVIATIONS = ["e.g", "i.e", "etc", "vs", "Inc", "Ltd", "Co", "Corp", "Mr", "Mrs", "Ms", "Dr", "St", "No", "approx"]


def sentences(c: Column) -> Column:
    """Segments that end in . ! or ? before white space and a capital, digit or mark; not after an abbreviation."""
    guarded = c
    for word in ABBREVIATIONS:
        guarded = F.regexp_replace(guarded, rf"\b{word.replace('.', '[.]')}\.(?=\s)", word + "\u0001")
    cut = F.split(F.regexp_replace(guarded, r"([.!?]+[\"')\]]*(?:\s*\[\d+(?:\s*,\s*\d+)*\])*)\s+(?=[\p{Lu}\d\[\"'(])", "$1\u0002"), "\u0002")
    return F.filter(F.transform(cut, lambda x: strip(F.replace(x, F.lit("\u0001"), F.lit(".")))), lambda x: x != "")


def capitalised_article(c: Column) -> Column:
    """Words with a capital first letter, joined by underscores."""
    return F.array_join(F.transform(F.split(strip(c), r"\s+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), "_")


def last_page(link: Column) -> Column:
    """The page number of rel="last" in a Link header."""
    return F.regexp_extract(link, r'[?&]page=(\d+)[^>]*>;\s*rel="last"', 1).try_cast("int")


def issue_repo(url: Column) -> Column:
    return F.regexp_extract(url, r"github\.com/([^/]+/[^/]+)/issues/", 1)


def utf16_offset(text: Column, at: Column) -> Column:
    """A code point offset as an offset in UTF-16 units: one more for each character before it beyond U+FFFF."""
    ahead = F.substring(text, F.lit(1), at)
    return at + F.length(ahead) - F.length(F.regexp_replace(ahead, "[\\x{10000}-\\x{10FFFF}]", ""))


def error_note(errors: Column) -> Column:
    """Validation errors (array of struct loc, msg) as one line."""
    return F.array_join(F.transform(errors, lambda e: F.concat(e["loc"], F.lit(": "), e["msg"])), "; ")


def retry_after(c: Column) -> Column:
    """Seconds of a numeric Retry-After; null for dates."""
    return F.trim(c).try_cast("double")
