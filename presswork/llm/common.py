"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.cluster import free_shuffles, materialize, release, shared_dir, ship

__all__ = ["LAST", "SPACE_WORD", "free_shuffles", "materialize", "numbered", "read_table", "release", "shared_dir", "ship", "text_key"]

#: A word of the byte-oriented contracts: anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def text_key(text: str | Column = "text", *more: str | Column) -> Column:
    """64-bit key of a row; equal rows share it. Only ever used beside the id."""
    return F.xxhash64(text, *more)


#: Stands for a null id, after all others.
LAST = (1 << 63) - 1


def numbered(documents: DataFrame) -> DataFrame:
    """``documents`` with ``id``: a whole number in the order of doc_id, ``LAST`` where that is null.

    Whole numbers are taken as they are. Ids of any other type are numbered in
    their order: the distinct ones are sorted over all partitions and written.
    """
    if isinstance(documents.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return documents.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    ids = documents.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy("doc_id")
    ids = materialize(ids.withColumn("id", F.monotonically_increasing_id()), "ids")
    return documents.join(ids, "doc_id", "left").withColumn("id", F.coalesce("id", F.lit(LAST)))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
