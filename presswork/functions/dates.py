"""Dates of feeds, sitemaps and pages as instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}([T ].*)?$"
_ZONE = r"(?:[+-]\d{1,2}(?::?\d{2}){0,2}|[A-Za-z][A-Za-z/_]+)$"


def parse_iso(value: Column) -> Column:
    """An ISO date or time; without a zone it is UTC whatever the session's zone, null if it is none."""
    text = F.replace(F.trim(value), F.lit("Z"), F.lit("+00:00"))
    text = F.regexp_replace(text, r"^(.{10}[T ]\d{2}:\d{2})(?![:\d])", "$1:00")
    midnight = F.concat(text, F.lit(" 00:00:00+00:00"))
    zoned = F.when(F.length(text) == 10, midnight).when(F.substring(text, 12, 100).rlike(_ZONE), text).otherwise(F.concat(text, F.lit("+00:00")))
    return F.when(text.rlike(_ISO), zoned.try_cast("timestamp"))


def parse_feed_date(value: Column) -> Column:
    """A date of RFC 822 or ISO form."""
    text = F.regexp_replace(F.trim(value), r"^[A-Za-z]+,?\s+", "")
    text = F.regexp_replace(text, r"\s+(?:GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm Z")), parse_iso(value))
