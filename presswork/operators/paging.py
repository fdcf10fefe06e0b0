"""Newest first, pages and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LIMIT = 100


def check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1 to {MAX_LIMIT}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def newest_page(df: DataFrame, time: str, tie: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the rows, newest first; beyond the end it is empty. Planned as a top-k."""
    check_page(limit, offset)
    return df.orderBy(F.desc(time), tie).offset(offset).limit(limit)


def total(df: DataFrame, name: str = "count") -> DataFrame:
    """The number of rows, as a row of its own: exact even where a page is empty."""
    return df.agg(F.count("*").alias(name))


def page_math(count: Column, limit: Column, offset: Column, shown: Column) -> dict[str, Column]:
    """Number of the page, of all pages, offset of the one before, and whether there is a next one."""
    return {
        "page": (F.floor(offset / limit) + 1).cast("long"),
        "pages": F.greatest(F.lit(1), F.ceil(count / limit)).cast("long"),
        "prev_offset": F.greatest(F.lit(0), offset - limit).cast("long"),
        "has_next": offset + shown < count,
    }
