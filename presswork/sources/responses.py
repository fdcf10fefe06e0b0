"""Captured HTTP responses, and a reader that captures them.

Everything after this module works on the table of responses, so whole crawls
can be replayed. Fetching goes over a table of URLs (``fetch_all``) or is a
Python data source; a URL that fails gives a row, never an error.
"""

from __future__ import annotations

import datetime as dt
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from presswork.cluster import materialize, ship
from presswork.operators.ranking import first_n
from presswork.schemas import RESPONSE

#: Seconds for a listing (feed, sitemap, home page) and for an article page.
LISTING_TIMEOUT, PAGE_TIMEOUT = 6, 8
_AGENT = {"User-Agent": "presswork/1.0"}


def usable(responses: DataFrame) -> DataFrame:
    """Of each URL the latest response with status 200; others might as well not be there.

    A table without a status holds usable responses already and is returned as it is.
    """
    if "status" not in responses.columns:
        return responses
    good = responses.where(F.col("status") == 200)
    return first_n(good, 1, ["url"], F.desc_nulls_last("fetched_at"), "body")


def stored_usable(responses: DataFrame) -> DataFrame:
    """:func:`usable`, written once: url, content_type, body. Bodies are shuffled here and joined from there on."""
    if "status" not in responses.columns:
        return responses
    return materialize(usable(responses).select("url", "content_type", "body"), "usable")


def charset_of(declared: str | None, body: bytes) -> str:
    """The declared charset if it reads the body; else UTF-8 if that does, else Latin-1, which reads anything."""
    for name in filter(None, (declared, "utf-8")):
        try:
            body.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
        return name
    return "latin-1"


def fetch(url: str, timeout: float = LISTING_TIMEOUT) -> tuple:
    """A row of responses; one without a status if the request fails."""
    now = dt.datetime.now(dt.timezone.utc)
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=_AGENT), timeout=timeout) as r:
            raw = r.read()
            return url, r.status, r.headers.get("Content-Type", ""), raw.decode(charset_of(r.headers.get_content_charset(), raw), "replace"), r.geturl(), now
    except urllib.error.HTTPError as error:
        return url, error.code, None, None, None, now
    except (OSError, ValueError):
        return url, None, None, None, None, now


def fetch_all(urls: DataFrame, shares: int = 10, timeout: float = LISTING_TIMEOUT) -> DataFrame:
    """Responses for a table of URLs (``url``), each asked once; ``shares`` requests run at a time.

    A URL that fails gives a row, never an error, so one bad host does not stop
    the others.
    """
    ship(urls.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([fetch(u, timeout) for u in batch["url"]], columns=RESPONSE.names)

    return urls.select("url").distinct().repartition(shares, "url").mapInPandas(run, RESPONSE)


class _Share(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.shares = max(1, int(options.get("shares", "10")))
        self.timeout = float(options.get("timeout", LISTING_TIMEOUT))

    def partitions(self) -> list[InputPartition]:
        return [_Share(self.urls[k :: self.shares]) for k in range(min(self.shares, max(1, len(self.urls))))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for url in partition.urls:
            yield fetch(url, self.timeout)


class HttpSource(DataSource):
    """``spark.read.format("presswork_http").option("urls", "...\\n...")``: one row for each URL."""

    @classmethod
    def name(cls) -> str:
        return "presswork_http"

    def schema(self) -> T.StructType:
        return RESPONSE

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)
