"""Snapshots: the articles of each source as of its last refresh, with a time to live.

A snapshot is a folder of article partitions, one for each source, and a fetch
log. A refresh replaces the partitions of its sources only and logs every source
it fetched, those without articles too, so an empty result is fresh as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.cluster import materialize, release
from presswork.operators.ranking import first_n
from presswork.schemas import ARTICLE

#: Seconds that a fetch stays fresh.
TTL_SECONDS = 600

LOG = "source_id string, fetched_at timestamp, n_articles long"
STORED = T.StructType([*ARTICLE.fields, T.StructField("search_text", T.StringType()), T.StructField("registry_pos", T.IntegerType()), T.StructField("item_pos", T.IntegerType())])


def is_fresh(fetched_at: Column, as_of: Column, ttl: int = TTL_SECONDS) -> Column:
    """Younger than the time to live; at exactly that age it is stale."""
    return F.coalesce((as_of - fetched_at) < F.expr(f"INTERVAL {int(ttl)} SECONDS"), F.lit(False))


def latest(log: DataFrame, key: str = "source_id", time: str = "fetched_at") -> DataFrame:
    """The last entry of each key: the last write wins."""
    return first_n(log, 1, [key], F.desc(time))


def fresh_keys(log: DataFrame, as_of: Column, ttl: int = TTL_SECONDS, key: str = "source_id", time: str = "fetched_at") -> DataFrame:
    """Keys whose last entry is fresh."""
    return log.groupBy(key).agg(F.max(time).alias(time)).where(is_fresh(F.col(time), as_of, ttl)).select(key)


def stale_sources(sources: DataFrame, log: DataFrame, as_of: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Sources without a fresh entry: what has to be fetched."""
    return sources.join(fresh_keys(log, as_of, ttl).withColumnRenamed("source_id", "id"), "id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, time: str) -> DataFrame:
    """The latest row of each key of both."""
    return first_n(old.unionByName(new), 1, [key], F.desc(time))


class Snapshot:
    """A snapshot at a path; every process that names the path shares it."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")

    def _read(self, part: str, schema) -> DataFrame:
        self._spark.createDataFrame([], schema).limit(0).write.mode("append").parquet(f"{self._path}/empty_{part}")
        jvm = self._spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self._path}/{part}")
        there = at.getFileSystem(self._spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
        return self._spark.read.schema(schema).parquet(f"{self._path}/{part if there else f'empty_{part}'}")

    def articles(self) -> DataFrame:
        """All stored partitions, whatever their age; see :meth:`current` for what counts."""
        return self._read("articles", STORED)

    def log(self) -> DataFrame:
        return self._read("log", LOG)

    def of_source(self, source_id: str) -> DataFrame:
        """The articles of one source: only its partition is read."""
        return self.articles().where(F.col("source_id") == source_id)

    def put(self, sources: DataFrame, articles: DataFrame, fetched_at: Column) -> None:
        """Replace the articles of ``sources`` (id), which may have none, and log the fetch.

        The log is written last: a refresh that fails leaves its sources stale.
        """
        ids = sources.select(F.col("id").alias("source_id")).distinct()
        # Written once, so that articles and log agree whatever the fetch yields a second time.
        stored = materialize(articles.select(*STORED.names), "fetched")
        counts = stored.groupBy("source_id").agg(F.count("*").alias("n_articles"))
        stored.repartition("source_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(f"{self._path}/articles")
        entries = ids.join(counts, "source_id", "left").select("source_id", fetched_at.alias("fetched_at"), F.coalesce("n_articles", F.lit(0)).cast("long").alias("n_articles"))
        entries.write.mode("append").parquet(f"{self._path}/log")
        release(stored)

    def current(self) -> DataFrame:
        """Articles of sources whose last fetch had any: partitions of emptied sources do not count."""
        live = latest(self.log()).where(F.col("n_articles") > 0).select("source_id")
        return self.articles().join(live, "source_id", "left_semi")

    def get_or_fetch(self, sources: DataFrame, as_of: Column, fetch: Callable[[DataFrame], DataFrame], ttl: int = TTL_SECONDS) -> DataFrame:
        """Articles of ``sources``; those that are stale are fetched and stored first."""
        stale = stale_sources(sources, self.log(), as_of, ttl)
        if not stale.isEmpty():
            self.put(stale, fetch(stale), as_of)
        return self.current().join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")

    def clear(self) -> None:
        """Forget everything."""
        at = self._spark._jvm.org.apache.hadoop.fs.Path(self._path)
        at.getFileSystem(self._spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
