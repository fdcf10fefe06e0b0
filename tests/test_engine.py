"""Registry, discovery, ingestion, queries, snapshots and streams."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from presswork.functions.html import page
from presswork.operators.paging import newest_page, page_math, total
from presswork.operators.ranking import first_n, first_non_empty, keep_first
from presswork.plans import articles as A
from presswork.plans import snapshot as S
from presswork.plans.ingest import DEFAULT_IMAGE, ingest, refresh_totals
from presswork.schemas import ARTICLE_COLUMNS, RESPONSE, SOURCE
from presswork.sources import discovery as D
from presswork.sources import registry as R
from presswork.sources import xml
from presswork.streaming.refresh import read_version, refresh_periodically, upsert_stream, windowed_counts

NOW = dt.datetime(2026, 9, 9, 8, 30)
SOURCES = [
    ("s_tel", "First Source", "South", "Telangana", "Telugu", "tv", "https://one.test/", True, 0),
    ("s_tam", "Second Source", "South", "Tamil Nadu", "Tamil", "tv", "https://two.test/", True, 1),
    ("s_off", "Third Source", "North", "Pan-India", "Hindi", "paper", "https://three.test/", False, 2),
]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(SOURCES, SOURCE)


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


# Registry ------------------------------------------------------------------


def test_registry_filters(sources):
    assert ids(R.active_sources(sources)) == ["s_tam", "s_tel"]
    assert ids(R.active_sources(sources, state="tamil")) == ["s_tam"]
    assert ids(R.active_sources(sources, language=" TELUGU ")) == ["s_tel"]
    assert ids(R.active_sources(sources, state="tamil", language="telugu")) == []
    assert ids(R.active_sources(sources, source="s_tam")) == ["s_tam"] and ids(R.active_sources(sources, source="S_TAM")) == []
    assert ids(R.active_sources(sources, source="second")) == ["s_tam"]
    assert ids(R.active_sources(sources, state="  ")) == ["s_tam", "s_tel"] and ids(R.active_sources(sources, state="%")) == []
    assert ids(R.get_source(sources, "s_off")) == ["s_off"] and R.get_source(sources, "x").count() == 0
    assert ids(R.capped_sources(R.active_sources(sources), 1)) == ["s_tel"]
    assert [r.language for r in R.facet(sources, "language").collect()] == ["Hindi", "Tamil", "Telugu"]
    assert R.source_table(sources).columns == ["id", "name", "state", "language", "type", "base_url"]


def test_registry_file(spark, tmp_path):
    path = tmp_path / "sources.json"
    rows = [dict(zip(SOURCE.names[:-1], s[:-1], strict=True)) for s in SOURCES]
    path.write_text(json.dumps(rows))
    registry = R.Registry(spark, str(path))
    assert [r.id for r in registry.sources().collect()] == ["s_tel", "s_tam", "s_off"]
    path.write_text(json.dumps(rows[:1]))
    assert registry.sources().count() == 3
    registry.reload()
    assert registry.sources().count() == 1
    path.write_text(json.dumps([{"id": "x"}]))
    with pytest.raises(ValueError):
        R.read_registry(spark, str(path))


# Operators -----------------------------------------------------------------


def test_keep_first_and_fallback(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 5), (None, 4)], "k string, p int")
    assert sorted(map(str, (tuple(r) for r in keep_first(df, "k", "p").collect()))) == sorted(map(str, [("a", 1), ("b", 3), (None, 4)]))
    assert first_n(df, 0, ["k"], "p").count() == 0
    ranked = spark.createDataFrame([("x", 1, 0, "b"), ("x", 0, 9, "a"), ("y", 2, 1, "c"), ("y", 2, 0, "d"), ("y", 2, 0, "e")], "k string, r int, q int, v string")
    assert ids(first_non_empty(ranked, ["k"], "r"), "v") == ["a", "c", "d", "e"]
    assert ids(first_non_empty(ranked, ["k"], "r", "q"), "v") == ["a", "d", "e"]


def test_paging(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(9)], "id int, t int")
    assert [r.id for r in newest_page(df, "t", "id", 4, 0).collect()] == [2, 5, 8, 1]
    assert [r.id for r in newest_page(df, "t", "id", 4, 8).collect()] == [6]
    assert newest_page(df, "t", "id", 4, 99).count() == 0 and total(df.where("id > 99")).first()[0] == 0
    for limit, offset in ((0, 0), (101, 0), (1000, 0), (1, -1)):
        with pytest.raises(ValueError):
            newest_page(df, "t", "id", limit, offset)
    plan = newest_page(df, "t", "id", 4, 8)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    rows = spark.createDataFrame([(0, 0, 20), (45, 40, 5), (45, 0, 20)], "count int, offset int, shown int")
    math = page_math(F.col("count"), F.lit(20), F.col("offset"), F.col("shown"))
    got = [tuple(r) for r in rows.select(*[c.alias(n) for n, c in math.items()]).collect()]
    assert got == [(1, 1, 0, False), (3, 3, 20, False), (1, 3, 0, True)]


# Discovery -----------------------------------------------------------------


def responses(spark, bodies):
    rows = []
    for url, body in bodies.items():
        status, kind, text = body if isinstance(body, tuple) else (200, "application/xml", body)
        rows.append((url, status, kind, text, url, NOW))
    return spark.createDataFrame(rows, RESPONSE)


def rss(*items):
    return "<rss><channel>" + "".join(f"<item><link>{u}</link><title>{t}</title>{more}</item>" for u, t, more in items) + "</channel></rss>"


def article(n, host="one.test"):
    return f"https://{host}/news/a-long-headline-{n}"


HOME = '<link rel="alternate" type="application/rss+xml" href="/feed.xml">'


def test_declared_feed(spark, sources):
    feed = rss((article(1), " A ", "<pubDate>Wed, 09 Sep 2026 08:30:00 GMT</pubDate><description>&lt;p&gt;Short&lt;/p&gt;</description>"), ("https://one.test/tag/a-long-headline-2", "x", ""), ("", "no link", ""))
    got = D.from_feeds(sources, responses(spark, {"https://one.test/": HOME, "https://one.test/feed.xml": feed})).collect()
    assert [(r.source_id, r.url, r.title, r.summary, r.published_at, r.strategy_rank, r.item_pos) for r in got] == [("s_tel", article(1), "A", "Short", NOW, 0, 0)]


def test_feed_cap_counts_before_the_filter(spark, sources):
    feed = rss(*[(f"https://one.test/tag/a-long-headline-{i}", "t", "") for i in range(20)], *[(article(i), "t", "") for i in range(20)])
    got = D.from_feeds(sources, responses(spark, {"https://one.test/": HOME, "https://one.test/feed.xml": feed}))
    assert got.count() == 5


def test_guessed_feeds_are_strict(spark, sources):
    feed = rss((article(1), "t", ""))
    plain = {"https://one.test/": "<html></html>"}
    assert D.from_feeds(sources, responses(spark, plain | {"https://one.test/feed": (200, "text/html", feed)})).count() == 0
    assert D.from_feeds(sources, responses(spark, plain | {"https://one.test/feed": (200, "application/rss+xml", feed[:-3])})).count() == 0
    assert D.from_feeds(sources, responses(spark, plain | {"https://one.test/feed": (200, "application/rss+xml", feed)})).count() == 1
    assert D.from_feeds(sources, responses(spark, {"https://one.test/feed": (200, "application/rss+xml", feed)})).count() == 0  # no home page
    declared = {"https://one.test/": HOME, "https://one.test/feed.xml": (200, "text/html", feed[:-3])}
    assert D.from_feeds(sources, responses(spark, declared)).count() == 1
    declared["https://one.test/feed.xml"] = (500, "text/xml", feed)
    assert D.from_feeds(sources, responses(spark, declared)).count() == 0


def test_feed_images_and_summaries(spark, sources):
    media = 'xmlns:media="http://search.yahoo.com/mrss/" xmlns:content="http://purl.org/rss/1.0/modules/content/"'
    cases = [
        '<media:thumbnail url="http://i/1.jpg"/><enclosure url="http://i/2.jpg" type="image/jpeg"/>',
        '<media:thumbnail url="http://i/1.gif"/><media:content url="http://i/v.mp4" medium="video" type="video/mp4"/><media:content url="http://i/3.jpg" medium=""/>',
        '<enclosure url="http://i/a.mp3" type="audio/mp3"/><enclosure url="http://i/4.jpg" type="image/jpeg"/>',
        "<description>&lt;img src='http://i/5.jpg'&gt;short&lt;/img&gt;</description><content:encoded>&lt;p&gt;a  much longer&lt;/p&gt; text than the description is&lt;/p&gt;</content:encoded>",
        "<description>&lt;img src='http://i/x.gif'&gt;&lt;img src='http://i/6.jpg'&gt;</description>",
    ]
    feed = rss(*[(article(i), "t", c) for i, c in enumerate(cases)]).replace("<rss>", f"<rss {media}>")
    got = D.from_feeds(sources, responses(spark, {"https://one.test/": HOME, "https://one.test/feed.xml": feed})).orderBy("item_pos").collect()
    assert [r.image_url for r in got] == ["http://i/1.jpg", "http://i/3.jpg", "http://i/4.jpg", "http://i/5.jpg", None]
    assert got[3].summary == "a much longer text than the description is"


def test_atom_feed(spark, sources):
    feed = f'<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="alternate" href="{article(1)}"/><updated>2026-09-09T08:30:00Z</updated><summary>S</summary></entry></feed>'
    got = D.from_feeds(sources, responses(spark, {"https://one.test/": HOME, "https://one.test/feed.xml": feed})).first()
    assert (got.url, got.title, got.summary, got.published_at) == (article(1), "A", "S", NOW)


def urlset(*locs):
    return '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "".join(f"<url><loc>{u}</loc><lastmod>x</lastmod><lastmod>2026-09-09</lastmod></url>" for u in locs) + "</urlset>"


def index(*locs):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in locs) + "</sitemapindex>"


def test_sitemaps(spark, sources):
    base = "https://one.test"
    got = D.from_sitemaps(sources, responses(spark, {f"{base}/sitemap.xml": urlset(article(1), f"{base}/epaper/long-headline-here", article(2))})).collect()
    assert sorted(r.url for r in got) == [article(1), article(2)] and got[0].published_at == dt.datetime(2026, 9, 9)
    # A plain urlset whose places are sitemaps; "news" goes first, three children at most.
    tree = {f"{base}/sitemap.xml": urlset(*[f"{base}/{n}.xml" for n in ("a", "b", "c", "z-news")]), f"{base}/z-news.xml": urlset(article(9)), f"{base}/a.xml": urlset(article(3)), f"{base}/c.xml": urlset(article(4))}
    assert ids(D.from_sitemaps(sources, responses(spark, tree)), "url") == [article(9)]
    del tree[f"{base}/z-news.xml"], tree[f"{base}/a.xml"]
    assert D.from_sitemaps(sources, responses(spark, tree)).count() == 0  # c is the fourth child
    deep = {f"{base}/sitemap.xml": index(f"{base}/1.xml"), f"{base}/1.xml": index(f"{base}/2.xml"), f"{base}/2.xml": urlset(article(5))}
    assert D.from_sitemaps(sources, responses(spark, deep)).count() == 1
    deep |= {f"{base}/2.xml": index(f"{base}/3.xml"), f"{base}/3.xml": urlset(article(5))}
    assert D.from_sitemaps(sources, responses(spark, deep)).count() == 0
    robots = {f"{base}/robots.txt": f"User-agent: *\nSITEMAP: {base}/own.xml", f"{base}/own.xml": urlset(article(6)), f"{base}/sitemap.xml": urlset(article(7))}
    assert ids(D.from_sitemaps(sources, responses(spark, robots)), "url") == [article(6)]
    robots[f"{base}/own.xml"] = "<broken"
    assert ids(D.from_sitemaps(sources, responses(spark, robots)), "url") == [article(7)]
    many = {f"{base}/sitemap.xml": urlset(*[f"{base}/tag/x-long-headline-{i}" for i in range(30)], *[article(i) for i in range(40)])}
    assert D.from_sitemaps(sources, responses(spark, many)).count() == 25


def test_only_what_is_named_is_parsed_and_once(spark, sources, monkeypatch):
    """Spark must not push the parser below the join that chooses documents, where it would read every page."""
    plans = []

    def plan_of(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    monkeypatch.setattr(D, "materialize", lambda df, name, write=D.materialize: write(plan_of(df), name))
    crawl = responses(spark, {"https://one.test/": HOME, "https://one.test/feed.xml": rss((article(1), "A", "")), "https://two.test/sitemap.xml": urlset(article(2))})
    assert ids(plan_of(D.from_feeds(sources, crawl)), "url") == [article(1)]
    assert ids(plan_of(D.from_sitemaps(sources, crawl)), "url") == [article(2)]
    for parser, times in (("parse_feed(", 1), ("parse_sitemap(", D.MAX_DEPTH + 1)):
        assert sum(p.count(parser) for p in plans) == times
        assert all(p.index(parser) < p.index("Join Inner") for p in plans if parser in p)  # plans begin with their last step


def test_many_documents_are_parsed_in_pieces(spark):
    n = 2 * xml.PIECE + 1
    made = spark.range(0, n, 1, 1).select("id", F.concat(F.lit("<rss><item><link>l"), "id", F.lit("</link></item></rss>")).alias("feed"), F.concat(F.lit("<urlset><url><loc>l"), "id", F.lit("</loc></url></urlset>")).alias("map"))
    got = made.select("id", xml.parse_feed("feed").alias("f"), xml.parse_sitemap("map").alias("m")).select("id", "f.entries.link", "m.entries.loc").collect()
    assert len(got) == n and all(r.link == r.loc == [f"l{r.id}"] for r in got)


def test_home_page_links(spark, sources):
    links = "".join(f'<a href="{article(i % 30)}">T <b>{i}</b></a>' for i in range(60)) + '<a href="/tag/xx-long-headline">x</a>'
    got = D.from_home_pages(sources, responses(spark, {"https://one.test/": f'<a href="/about">x</a>{links}'})).orderBy("item_pos").collect()
    assert [r.url for r in got] == [article(i) for i in range(25)] and got[0].title == "T0" and [r.item_pos for r in got] == list(range(25))


def test_aggregator(spark, sources):
    feed = rss(("https://news.google.com/rss/articles/1", "Head - Sub - Paper", "<updated>2026-09-09T08:30:00Z</updated>"), ("https://news.google.com/rss/articles/2", "y", ""))
    url = D.SEARCH_FEED.replace("{domain}", "one.test")
    table = spark.createDataFrame([("https://news.google.com/rss/articles/1", article(1))], "link string, url string")
    got = D.from_aggregator(sources, responses(spark, {url: feed}), table).collect()
    assert [(r.url, r.title, r.published_at) for r in got] == [(article(1), "Head - Sub", None)]
    links = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "link string")
    moved = spark.createDataFrame([("g1", 200, "", "", "https://e.com/a", NOW), ("g2", 200, "", "", "https://news.google.com/x", NOW)], RESPONSE)
    replies = spark.createDataFrame([("g2", '["https://www.google.com/x","https://e.com/b\\\\"]')], "link string, reply string")
    assert {r.link: r.url for r in D.resolution_table(links, moved, replies).collect()} == {"g1": "https://e.com/a", "g2": "https://e.com/b"}


def test_decoder_request(spark):
    df = spark.createDataFrame([("https://news.google.com/rss/articles/CBM\"x?oc=5", '<c-wiz><div data-n-a-sg="S" data-n-a-ts="17">'), ("https://news.google.com/rss/articles/y", "<div>")], "link string, page string")
    asked, nothing = [r[0] for r in df.select(D.resolver_request(F.col("link"), F.col("page"))).collect()]
    [[[name, inner]]] = json.loads(asked)
    assert name == "Fbv4je" and json.loads(inner)[0] == "garturlreq" and json.loads(inner)[2:] == ['CBM"x', "17", "S"] and nothing is None


def test_fallback_chain(spark, sources):
    both = {"https://one.test/": HOME + f'<a href="{article(3)}">h</a>', "https://one.test/feed.xml": rss((article(1), "t", "")), "https://one.test/sitemap.xml": urlset(article(2)), "https://two.test/": f'<a href="{article(4, "two.test")}">h</a>'}
    got = {r.source_id: (r.url, r.strategy_rank) for r in D.discover(sources, responses(spark, both)).collect()}
    assert got == {"s_tel": (article(1), 0), "s_tam": (article(4, "two.test"), 3)}
    del both["https://one.test/feed.xml"]
    assert {r.strategy_rank for r in D.discover(sources, responses(spark, both)).where("source_id = 's_tel'").collect()} == {1}


# Ingestion and queries -----------------------------------------------------


def crawl(spark):
    text = "<article>" + "<p>Words of a paragraph about Khammam that is long enough to be kept here.</p>" * 4 + "</article>"
    feed = rss(
        (article(1), "First", "<pubDate>Wed, 09 Sep 2026 08:30:00 GMT</pubDate>"),
        (article(1) + "?utm_source=rss", "Again", ""),
        (article(2), "", ""),
        (article(3), "Listing", ""),
        (article(4), "Page is gone", ""),
        (article(5), "", ""),
    )
    pages = {
        "https://one.test/": HOME,
        "https://one.test/feed.xml": feed,
        article(1): text,
        article(2): '<title>From the page</title><meta property="article:published_time" content="2026-09-08T00:00:00Z">',
        article(3): '<body class="archive">',
        article(4): (404, "text/html", text),
        article(5): "<p>nothing</p>",
        "https://two.test/": f'<a href="{article(1)}">Copy elsewhere</a><a href="{article(6, "two.test")}">Other place Warangal</a>',
    }
    return responses(spark, pages)


@pytest.fixture(scope="module")
def stored(spark, sources):
    return ingest(sources.where("active"), crawl(spark), F.lit(dt.datetime(2026, 9, 1))).cache()


def test_ingest(stored):
    rows = {(r.source_id, r.title): r for r in stored.collect()}
    assert set(rows) == {("s_tel", "First"), ("s_tel", "From the page"), ("s_tel", "Page is gone"), ("s_tam", "Copy elsewhere"), ("s_tam", "Other place Warangal")}
    first = rows["s_tel", "First"]
    assert first.published_at == NOW and first.district == "Khammam" and first.state == "Telangana" and first.content.count("paragraph") == 4 and first.image_url == DEFAULT_IMAGE
    assert rows["s_tel", "From the page"].published_at == dt.datetime(2026, 9, 8)
    assert rows["s_tel", "Page is gone"].content == "" and rows["s_tel", "Page is gone"].published_at == dt.datetime(2026, 9, 1)
    assert rows["s_tam", "Other place Warangal"].district == ""
    assert {r.source_id: r.n_articles for r in refresh_totals(stored).collect()} == {"s_tel": 3, "s_tam": 2}


def test_query(spark, sources, stored):
    every = A.query_articles(stored, sources)
    assert every.count.first()[0] == 4 and [r.title for r in every.articles.collect()][:2] == ["First", "From the page"]
    assert every.articles.columns == list(ARTICLE_COLUMNS)
    assert A.query_articles(stored, sources, keyword="PARAGRAPH").count.first()[0] == 1
    assert A.query_articles(stored, sources, source="s_tam").count.first()[0] == 2
    assert A.query_articles(stored, sources, max_sources=1).count.first()[0] == 3
    assert A.query_articles(stored, sources, location="khammam khammam telangana").count.first()[0] == 1
    assert A.query_articles(stored, sources, district="kham", state="TELANGANA", language="telugu").count.first()[0] == 1
    one = A.response(A.query_articles(stored, sources, limit=2, offset=1)).first()
    assert (one["count"], one.limit, one.offset, [a.title for a in one.articles][:1]) == (4, 2, 1, ["From the page"])
    empty = A.response(A.query_articles(stored, sources, offset=50)).first()
    assert (empty["count"], empty.articles) == (4, [])
    with pytest.raises(ValueError):
        A.query_articles(stored, sources, limit=0)
    known = stored.first().id
    assert A.article_by_id(stored, known).count() == 1 and A.article_by_id(stored, "none").count() == 0


# Snapshots -----------------------------------------------------------------


def test_freshness_edges(spark):
    rows = spark.createDataFrame([(NOW - dt.timedelta(seconds=s),) for s in (0, 599, 600, 601)] + [(None,)], "t timestamp")
    assert [r[0] for r in rows.select(S.is_fresh(F.col("t"), F.lit(NOW))).collect()] == [True, True, False, False, False]


def test_snapshot(spark, sources, stored, tmp_path):
    snap = S.Snapshot(spark, str(tmp_path / "snap"))
    assert snap.articles().count() == 0 and snap.log().count() == 0
    asked = []

    def fetch(stale):
        asked.append(sorted(r.id for r in stale.collect()))
        return stored.join(stale.select(F.col("id").alias("source_id")), "source_id", "left_semi")

    active = sources.where("active")
    assert snap.get_or_fetch(active, F.lit(NOW), fetch).count() == 5
    assert snap.get_or_fetch(active, F.lit(NOW + dt.timedelta(seconds=599)), fetch).count() == 5
    assert asked == [["s_tam", "s_tel"]] and snap.of_source("s_tam").count() == 2
    later = F.lit(NOW + dt.timedelta(seconds=600))
    assert ids(S.stale_sources(active, snap.log(), later)) == ["s_tam", "s_tel"]
    # A source that has nothing now is emptied, and that is fresh too.
    one = sources.where("id = 's_tam'")
    assert snap.get_or_fetch(one, later, lambda stale: stored.limit(0)).count() == 0
    assert snap.current().count() == 3 and S.stale_sources(one, snap.log(), later).count() == 0
    snap.clear()
    assert snap.articles().count() == 0
    new = S.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "k string, t int"), spark.createDataFrame([("a", 2)], "k string, t int"), "k", "t")
    assert sorted(tuple(r) for r in new.collect()) == [("a", 2), ("b", 1)]


# Streams -------------------------------------------------------------------


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    query = upsert_stream(stream, str(tmp_path / "data"), str(tmp_path / "cp"), "user_id", "ts", "event_id")
    assert query.awaitTermination(120)
    want = first_n(events, 1, ["user_id"], F.desc("ts"), F.desc("event_id"))
    got = read_version(spark, str(tmp_path / "data"), 0)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    counts = windowed_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    assert counts.awaitTermination(120)
    assert spark.table("counted").agg(F.sum("n")).first()[0] == events.count()
    ran = []
    assert refresh_periodically(spark, lambda: ran.append(1), str(tmp_path / "clock"), once=True) is None and ran == [1]
    clock = refresh_periodically(spark, lambda: ran.append(1), str(tmp_path / "clock"), period=1)
    clock.awaitTermination(6)
    clock.stop()
    assert len(ran) > 1


def test_captured_pages_can_be_read(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert sum(bool(page(r.html)["content"]) for r in rows) > len(rows) // 2 and all(page(r.html)["title"] for r in rows)


def test_live_fetch_of_a_table_of_urls(spark):
    """A local server: declared, undeclared and wrong charsets, an error page, a port where nobody listens."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from presswork.sources.responses import fetch_all, usable

    pages = {"/utf": ("text/html; charset=utf-8", "é".encode()), "/none": ("text/html", "é".encode()), "/latin": ("text/html", "é".encode("latin-1")), "/wrong": ("text/html; charset=nonsense", "é".encode())}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            kind, body = pages.get(self.path, ("text/html", b"gone"))
            self.send_response(200 if self.path in pages else 404)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        wanted = [(f"{base}{p}",) for p in (*pages, "/lost", "/utf")] + [("http://127.0.0.1:9/",), ("no url",)]
        got = fetch_all(spark.createDataFrame(wanted, "url string"), shares=3, timeout=5).collect()
    finally:
        server.shutdown()
    by = {r.url.removeprefix(base): r for r in got}
    assert len(got) == 7 and all(by[p].status == 200 and by[p].body == "é" for p in pages)
    assert by["/lost"].status == 404 and by["http://127.0.0.1:9/"].status is None and by["no url"].body is None
    assert usable(spark.createDataFrame(got)).count() == 4


def test_robots_lines_lose_any_white_space(spark):
    from presswork.sources.discovery import sitemap_candidates
    from presswork.sources.responses import stored_usable

    sources = spark.createDataFrame([("a", "https://a.test/")], "id string, base_url string")
    good = stored_usable(spark.createDataFrame([("https://a.test/robots.txt", "text/plain", "User-agent: *\nSitemap:\thttps://a.test/m.xml \nSITEMAP:https://a.test/n.xml")], "url string, content_type string, body string"))
    found = [r.url for r in sitemap_candidates(sources, good).orderBy("cand_rank").collect()]
    assert found[:2] == ["https://a.test/m.xml", "https://a.test/n.xml"]


def test_dates_without_a_zone_are_utc_in_any_session(spark):
    import datetime as dt

    from presswork.functions.dates import parse_iso

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        rows = spark.createDataFrame([("2024-05-01",), ("2024-05-01T10:20:30",), ("2024-05-01 10:20",), ("2024-05-01T10:20:30Z",), ("2024-05-01T10:20:30+05:30",), ("2024-05-01T10:20:30.5-0100",), ("soon",)], "t string")
        got = [r.s for r in rows.select(parse_iso(F.col("t")).cast("double").alias("s")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    noon = lambda *a: dt.datetime(2024, 5, 1, *a, tzinfo=dt.timezone.utc).timestamp()
    assert got == [noon(), noon(10, 20, 30), noon(10, 20), noon(10, 20, 30), noon(4, 50, 30), noon(11, 20, 30) + 0.5, None]
