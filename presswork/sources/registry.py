"""The source registry: an ordered JSON list of sources, and filters over it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions.text import contains_folded
from presswork.schemas import SOURCE

#: Sources that one query looks at, at most (a parameter of queries).
MAX_SOURCES = 40


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of sources; registry_pos is the place in the array.

    Unknown and missing fields are errors, as is anything but an array.
    """
    text = spark.read.text(path, wholetext=True).first()
    rows = json.loads(text[0]) if text else []
    names = SOURCE.names[:-1]
    for row in rows:
        if set(row) != set(names):
            raise ValueError(f"a source has the fields {sorted(row)}, not {sorted(names)}")
    return spark.createDataFrame([(*[row[n] for n in names], k) for k, row in enumerate(rows)], SOURCE)


class Registry:
    """A registry that is read once and again only after :meth:`reload`."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path, self._sources = spark, path, None

    def sources(self) -> DataFrame:
        """All sources, the inactive ones too, in registry order."""
        if self._sources is None:
            self._sources = read_registry(self._spark, self._path).cache()
        return self._sources.orderBy("registry_pos")

    def reload(self) -> None:
        if self._sources is not None:
            self._sources.unpersist()
            self._sources = None


def active_sources(sources: DataFrame, state: str | None = None, language: str | None = None, source: str | None = None) -> DataFrame:
    """Active sources by part of state and language and by exact id or part of name.

    A filter that is None or '' does not restrict; a blank one holds for all.
    """
    keep: Column = F.col("active")
    if state:
        keep = keep & contains_folded(F.col("state"), state)
    if language:
        keep = keep & contains_folded(F.col("language"), language)
    if source:
        keep = keep & ((F.col("id") == source) | contains_folded(F.col("name"), source))
    return sources.where(keep)


def capped_sources(sources: DataFrame, cap: int = MAX_SOURCES) -> DataFrame:
    """The first ``cap`` sources in registry order."""
    return sources.orderBy("registry_pos").limit(cap)


def get_source(sources: DataFrame, source_id: str) -> DataFrame:
    """The source with an id, active or not; no row if there is none."""
    return sources.where(F.col("id") == source_id).limit(1)


def facet(sources: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, sorted."""
    return sources.select(column).distinct().orderBy(column)


def source_table(sources: DataFrame) -> DataFrame:
    """The six columns of the source list."""
    return sources.orderBy("registry_pos").select("id", "name", "state", "language", "type", "base_url")
