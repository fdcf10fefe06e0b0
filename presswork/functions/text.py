"""Text: fallbacks, keyword search, script counts, paragraphs."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases of paragraphs that are not part of an article (fixed values).
NOISE_PHRASES = ("subscribe", "follow us", "advertisement", "also read", "read more", "click here", "download app", "all rights reserved", "copyright", "share this", "whatsapp", "facebook", "twitter")
#: The blanks of Unicode (category Zs): no tabs, no ends of lines.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Characters of the shortest paragraph that counts.
SHORTEST_PARAGRAPH = 40
#: Share of letters from which a script decides the language.
SCRIPT_SHARE = 0.1


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor ''; '' counts as missing everywhere."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def strip(c: Column) -> Column:
    """Without white space, Unicode included, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def trim_blanks(c: Column) -> Column:
    """Without blanks at both ends; tabs and ends of lines stay."""
    return F.trim(c, F.lit(BLANKS))


def contains_folded(haystack: Column, needle: str) -> Column:
    """Whether the trimmed needle occurs, case aside; a null haystack is ''."""
    return F.contains(F.lower(F.coalesce(haystack, F.lit(""))), F.lit(needle.strip().lower()))


def fold(text: str | None) -> str:
    """Compatibility form and case folding of a text; null is ''."""
    return unicodedata.normalize("NFKC", text or "").casefold()


@F.pandas_udf(T.StringType())
def normalize_text(text: pd.Series) -> pd.Series:
    """:func:`fold` of a column. Spark has neither step built in."""
    return text.map(fold)


def search_text(*fields: Column) -> Column:
    """What a keyword is looked for in: the fields with blanks between, normalized. Computed at ingestion."""
    return normalize_text(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields]))


def matches_keyword(searchable: Column, keyword: str | None) -> Column:
    """Whether a normalized text holds a keyword; a blank one is held by all."""
    needle = fold((keyword or "").strip())
    return F.contains(searchable, F.lit(needle)) if needle else F.lit(True)


def detect_language(text: Column) -> Column:
    """te or hi if more than a tenth of the letters is Telugu or Devanagari, else en."""
    counts = [F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)) for p in (r"[ఀ-౿]", r"[ऀ-ॿ]", "[a-zA-Z]")]
    total = F.greatest(reduce(lambda a, b: a + b, counts), F.lit(1))
    return F.when(counts[0] / total > SCRIPT_SHARE, "te").when(counts[1] / total > SCRIPT_SHARE, "hi").otherwise("en")


def strip_title_suffix(title: Column) -> Column:
    """A title without what follows its last `` - ``."""
    return strip(F.regexp_replace(title, r"(?s)^(.*) - .*$", "$1"))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for none."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def collapse(text: Column) -> Column:
    """White space runs as single blanks, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def is_noise(paragraph: Column) -> Column:
    """Whether a paragraph is too short or holds a noise phrase."""
    low = F.lower(paragraph)
    return reduce(lambda a, p: a | F.contains(low, F.lit(p)), NOISE_PHRASES, F.length(paragraph) < SHORTEST_PARAGRAPH)


def clean_paragraphs(paragraphs: Column) -> Column:
    """The paragraphs of an article, collapsed, noise left out."""
    return F.filter(F.transform(paragraphs, collapse), lambda p: ~is_noise(p))


def escape_html(text: Column) -> Column:
    """The five special characters of HTML as entities."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def card_text(content: Column, summary: Column) -> Column:
    """What a result card shows: body, summary or none."""
    return F.when(F.coalesce(content, F.lit("")) != "", "body").when(F.coalesce(summary, F.lit("")) != "", "summary").otherwise("none")
