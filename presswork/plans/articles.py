"""Article queries over the snapshot."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.operators.filters import article_predicate
from presswork.operators.paging import check_page, newest_page, total
from presswork.operators.ranking import keep_first
from presswork.schemas import ARTICLE_COLUMNS
from presswork.sources.registry import MAX_SOURCES, active_sources, capped_sources


class ArticlePage(NamedTuple):
    """The answer to a query: the total as a row, and the page of articles."""

    count: DataFrame
    articles: DataFrame
    limit: int
    offset: int


def matching(articles: DataFrame, sources: DataFrame, keyword: str | None = None, language: str | None = None, location: str | None = None, state: str | None = None, district: str | None = None, source: str | None = None, max_sources: int = MAX_SOURCES) -> DataFrame:
    """Articles of the first active sources that pass, each id once, that meet all filters."""
    chosen = capped_sources(active_sources(sources, state, language, source), max_sources)
    mine = articles.join(chosen.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    # A filter may drop the first of two equal ids, so ids are made unique before it.
    return keep_first(mine, "id", "registry_pos", "item_pos").where(article_predicate(keyword, language, location, state, district))


def query_articles(articles: DataFrame, sources: DataFrame, limit: int = 20, offset: int = 0, **filters) -> ArticlePage:
    """Newest first, with the total before paging. Bounds that are out of range raise ``ValueError``."""
    check_page(limit, offset)
    found = matching(articles, sources, **filters)
    return ArticlePage(total(found), newest_page(found, "published_at", "id", limit, offset).select(*ARTICLE_COLUMNS), limit, offset)


def response(page: ArticlePage) -> DataFrame:
    """count, limit, offset and the articles of a page as one row."""
    rows = page.articles.withColumn("_order", F.struct((-F.unix_micros("published_at")).alias("newest"), "id"))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("_order", F.struct(*ARTICLE_COLUMNS).alias("article")))).alias("all"))
    articles = F.transform("all", lambda r: r["article"])
    return page.count.crossJoin(listed).select("count", F.lit(page.limit).alias("limit"), F.lit(page.offset).alias("offset"), articles.alias("articles"))


def article_by_id(articles: DataFrame, article_id: str) -> DataFrame:
    """The article with an id in the snapshot, whatever its age; no row if there is none."""
    return articles.where(F.col("id") == article_id).orderBy("registry_pos", "item_pos").limit(1).select(*ARTICLE_COLUMNS)
