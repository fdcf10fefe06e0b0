"""Schemas of the tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


#: The source dimension; registry_pos is its order, which decides what a cap keeps.
SOURCE = T.StructType([*_fields(T.StringType(), "id", "name", "region", "state", "language", "type", "base_url"), T.StructField("active", T.BooleanType()), T.StructField("registry_pos", T.IntegerType())])
#: Captured HTTP responses: all that discovery and ingestion know of the network.
RESPONSE = T.StructType([T.StructField("url", T.StringType()), T.StructField("status", T.IntegerType()), *_fields(T.StringType(), "content_type", "body", "final_url"), T.StructField("fetched_at", T.TimestampType())])
#: A discovered candidate; strategy_rank and item_pos give its place in the fallback chain.
RAW_ITEM = T.StructType([*_fields(T.StringType(), "source_id", "url", "title", "summary", "image_url"), T.StructField("published_at", T.TimestampType()), *_fields(T.IntegerType(), "strategy_rank", "item_pos")])
#: What an article page yields.
PAGE = T.StructType([*_fields(T.StringType(), "image", "description", "content", "title", "published"), T.StructField("is_listing", T.BooleanType())])
#: The article record as it is served.
ARTICLE = T.StructType([*_fields(T.StringType(), "id", "title", "content", "summary", "source", "source_id", "source_url", "language", "state", "district", "location"), T.StructField("published_at", T.TimestampType()), T.StructField("image_url", T.StringType())])
ARTICLE_COLUMNS = tuple(ARTICLE.names)
