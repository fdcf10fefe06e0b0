"""The conjunctive article filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.functions.text import contains_folded, matches_keyword


def article_predicate(keyword: str | None = None, language: str | None = None, location: str | None = None, state: str | None = None, district: str | None = None, searchable: Column | None = None) -> Column:
    """All filters that are set, joined by and; those left out do not restrict.

    ``location`` is looked for in location, district and state with blanks
    between, so it can span them. Cheap comparisons come before the keyword.
    """
    parts: list[Column] = []
    for column, wanted in (("language", language), ("state", state), ("district", district)):
        if wanted:
            parts.append(contains_folded(F.col(column), wanted))
    if location:
        place = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("location", "district", "state")])
        parts.append(contains_folded(place, location))
    if keyword and keyword.strip():
        parts.append(matches_keyword(F.col("search_text") if searchable is None else searchable, keyword))
    return reduce(lambda a, b: a & b, parts, F.lit(True))
