"""Ingestion: raw items and captured pages become articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.cluster import materialize
from presswork.functions.dates import parse_iso
from presswork.functions.geo import resolve_location
from presswork.functions.html import extract_page
from presswork.functions.text import first_filled, search_text, strip
from presswork.functions.urls import AGGREGATOR, article_id, canonical_url_full
from presswork.operators.ranking import keep_first
from presswork.schemas import ARTICLE_COLUMNS
from presswork.sources.discovery import discover
from presswork.sources.responses import stored_usable, usable

#: Image of an article that has none (a fixed value).
DEFAULT_IMAGE = "https://upload.wikimedia.org/wikipedia/commons/thumb/4/41/Flag_of_India.svg/320px-Flag_of_India.svg.png"
#: Sources up to which the dimension is broadcast; a larger one is joined by shuffling.
BROADCAST_SOURCES = 100_000


def with_sources(items: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Items with the attributes of their source (a small dimension, if it is one)."""
    dim = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"), "language", F.col("state").alias("source_state"), "registry_pos")
    return items.join(F.broadcast(dim) if n_sources <= BROADCAST_SOURCES else dim, "source_id")


def with_pages(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Items with what their page yields; a page that is missing leaves the item alive, with nothing of it."""
    pages = usable(responses).where(~F.contains("url", F.lit(AGGREGATOR))).select("url", "body")
    wanted = items.select("url").distinct()
    pages = pages.join(wanted, "url", "left_semi").select("url", extract_page("body").alias("page"))
    return items.join(pages, "url", "left")


def normalize(items: DataFrame, ingest_ts: Column) -> DataFrame:
    """Article records of items with source and page columns; listing pages and items without title go.

    '' counts as missing in every fallback. A date comes from the feed, else the
    page, else ``ingest_ts``.
    """
    page = F.col("page")
    kept = items.where((F.coalesce("url", F.lit("")) != "") & ~F.coalesce(page["is_listing"], F.lit(False)))
    empty = F.lit("")
    fields = kept.select(
        article_id(canonical_url_full("url")).alias("id"),
        strip(F.coalesce(first_filled(F.col("title"), page["title"]), empty)).alias("title"),
        F.coalesce(page["content"], empty).alias("content"),
        strip(F.coalesce(first_filled(F.col("summary"), page["description"]), empty)).alias("summary"),
        "source",
        "source_id",
        F.col("url").alias("source_url"),
        "language",
        "source_state",
        F.coalesce("published_at", parse_iso(page["published"]), ingest_ts).alias("published_at"),
        F.coalesce(first_filled(F.col("image_url"), page["image"]), F.lit(DEFAULT_IMAGE)).alias("image_url"),
        "registry_pos",
        "item_pos",
    ).where(F.col("title") != "")
    place = resolve_location(F.coalesce("source_state", empty), F.concat_ws(" ", "title", "summary", "content"))
    out = fields.withColumn("place", place).select("*", "place.state", "place.district", "place.location")
    return out.select(*ARTICLE_COLUMNS, search_text(F.col("title"), F.col("summary"), F.col("content")).alias("search_text"), "registry_pos", "item_pos")


def ingest(sources: DataFrame, responses: DataFrame, ingest_ts: Column, resolution: DataFrame | None = None) -> DataFrame:
    """Articles of all given sources, each id once in a source; registry_pos and item_pos give their order.

    The raw items are written to the shared folder first: pages are fetched for
    them once, and a lost executor does not start discovery again.
    """
    good = stored_usable(responses)
    items = materialize(discover(sources, good, resolution), "raw-items")
    joined = with_pages(with_sources(items, sources, sources.count()), good)
    articles = normalize(joined, ingest_ts)
    return keep_first(articles.withColumn("_key", F.struct("source_id", "id")), "_key", "item_pos").drop("_key")


def refresh_totals(articles: DataFrame) -> DataFrame:
    """Articles of each source; ids that several sources have count in each."""
    return articles.groupBy("source_id").agg(F.count("*").alias("n_articles"))
