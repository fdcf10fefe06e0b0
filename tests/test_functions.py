"""Column functions on hand-written cases."""

from __future__ import annotations

import datetime as dt
from urllib.parse import parse_qsl, urlencode, urlsplit

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from presswork.functions import dates, geo, html, text, urls


def values(spark, rows, column, schema="v string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


URLS = {
    "https://WWW.Example.com/a/b/?utm_source=x&id=5#frag": "https://example.com/a/b?id=5",
    "http://example.com/": "http://example.com",
    "HTTPS://example.com:8080/Path/?ref=x&UTM_Medium=y&b=&a=1": "https://example.com:8080/Path?b=&a=1",
    "https://example.com/x?flag": "https://example.com/x?flag=",
    "  https://www.example.com/a  ": "https://example.com/a",
    "https://user:pw@example.com/a//": "https://user:pw@example.com/a",
    "": "",
    None: "",
}


def test_canonical_url(spark):
    assert values(spark, list(URLS), urls.canonical_url) == list(URLS.values())
    assert values(spark, list(URLS), urls.canonical_url_full) == list(URLS.values())
    assert values(spark, ["https://e.com/a?q=a%20b&x=%7E"], urls.canonical_url_full) == ["https://e.com/a?q=a+b&x=~"]


@settings(max_examples=1, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["http", "https"]), st.from_regex(r"\A[a-z]{1,8}\.(com|org)\Z"), st.from_regex(r"\A(/[A-Za-z0-9-]{1,6}){0,3}/?\Z"), st.lists(st.tuples(st.sampled_from(["id", "page", "utm_x", "ref", "q"]), st.from_regex(r"\A[a-z0-9]{0,4}\Z")), max_size=4)), min_size=40, max_size=60))
def test_canonical_url_forms_agree(spark, parts):
    rows = [f"{s}://{h}{p}" + ("?" + "&".join(f"{k}={v}" for k, v in q) if q else "") for s, h, p, q in parts]
    native = values(spark, rows, urls.canonical_url)
    assert native == values(spark, rows, urls.canonical_url_full)
    for row, got in zip(rows, native, strict=True):
        u = urlsplit(row)
        kept = [(k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k not in ("utm_x", "ref")]
        assert got == u._replace(path=u.path.rstrip("/"), query=urlencode(kept)).geturl()


def test_article_id(spark):
    same = ["https://www.example.com/a/?utm_source=x", "https://example.com/a", "https://example.com/a/"]
    ids = values(spark, same, lambda c: urls.article_id(urls.canonical_url(c)))
    assert len(set(ids)) == 1 and len(ids[0]) == 16
    assert ids[0] != values(spark, ["https://example.com/b"], lambda c: urls.article_id(urls.canonical_url(c)))[0]


ARTICLES = {
    "https://e.com/news/2024/05/long-headline-about-things": True,
    "https://e.com/council-opens-bridge-4711": True,
    "https://e.com/one-two-three-four": True,
    "https://e.com/a1": True,
    "https://e.com/story/٣": True,
    "https://e.com/about-us": False,
    "https://e.com/contact": False,
    "https://e.com/crime/": False,
    "https://e.com/tag/longer-headline-here": False,
    "https://e.com/E-Paper/longer-headline-here": False,
    "https://e.com/taglines/longer-headline-here": True,
    "https://e.com/news/short": False,
    "https://e.com/": False,
    "https://www.indianexpress.com/article/some-long-headline-1": False,
    "https://e.com/x?u=news.google.com/long-headline-here-1": False,
    "": False,
    None: False,
}


def test_is_article_url(spark):
    assert values(spark, list(ARTICLES), urls.is_article_url) == list(ARTICLES.values())


def test_url_parts(spark):
    assert values(spark, ["https://www.e.www.com/x"], urls.domain) == ["e.com"]
    assert values(spark, ["https://e.com/a.XML", "https://e.com/Sitemap/1", "https://e.com/a"], urls.is_sitemap_url) == [True, True, False]
    df = spark.createDataFrame([("https://e.com/a/b", "../c"), ("https://e.com", "//f.com/x"), ("https://e.com/a", None)], "b string, h string")
    assert [r[0] for r in df.select(urls.resolve_url("b", "h")).collect()] == ["https://e.com/c", "https://f.com/x", None]


def test_keyword(spark):
    searchable = spark.createDataFrame([("Straße ﬁre", None, "CAFÉ రేవంత్")], "a string, b string, c string").select(text.search_text(F.col("a"), F.col("b"), F.col("c")).alias("s"))
    for keyword, want in (("STRASSE", True), ("fire", True), ("café", True), (" రేవంత్ ", True), ("fire  café", True), ("absent", False), ("", True), (None, True), ("  ", True)):
        assert searchable.select(text.matches_keyword(F.col("s"), keyword)).first()[0] is want


def test_languages(spark):
    rows = ["తెలుగు వార్తలు", "हिन्दी समाचार", "plain English", "", None, "a" * 90 + "త" * 10, "a" * 89 + "త" * 11, "త" * 20 + "ह" * 80]
    assert values(spark, rows, text.detect_language) == ["te", "hi", "en", "en", "en", "en", "te", "te"]


def test_text_helpers(spark):
    assert values(spark, ["Head - Sub - Paper", "No suffix", " - x"], text.strip_title_suffix) == ["Head - Sub", "No suffix", ""]
    assert values(spark, ["a  b\nc", "", None, " "], text.word_count) == [3, 0, 0, 0]
    assert values(spark, ["<a href=\"x\">'&'</a>"], text.escape_html) == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;"]
    df = spark.createDataFrame([("", "b"), (None, ""), (" ", "b")], "a string, b string")
    assert [r[0] for r in df.select(text.first_filled(F.col("a"), F.col("b"))).collect()] == ["b", None, " "]
    cards = df.select(text.card_text(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in cards] == ["summary", "none", "body"]
    long = "A paragraph that is  long enough to count as text"
    assert values(spark, [[long, "short", long + " Read More"]], text.clean_paragraphs, "v array<string>") == [["A paragraph that is long enough to count as text"]]


def test_dates(spark):
    utc = dt.datetime(2026, 9, 9, 8, 30)
    got = values(spark, ["2026-09-09T08:30:00Z", "2026-09-09T14:00:00+05:30", "2026-09-09", "2026", "nonsense", None], dates.parse_iso)
    assert got == [utc, utc, dt.datetime(2026, 9, 9), None, None, None]
    got = values(spark, ["Wed, 09 Sep 2026 08:30:00 GMT", "9 Sep 2026 14:00:00 +0530", "2026-09-09T08:30:00Z", "x", None], dates.parse_feed_date)
    assert got == [utc, utc, utc, None, None]


def test_places(spark):
    rows = ["Warangal rally, then Hyderabad", "nothing here", None, "ఖమ్మం జిల్లా", "secunderabad"]
    assert values(spark, rows, geo.earliest_district) == ["Warangal", None, None, "Khammam", "Secunderabad"]
    assert sum(len(a) for a in geo.GAZETTEER.values()) == 57 and len(geo.GAZETTEER) == 22
    tag = values(spark, rows[:2], geo.location_tag)
    assert tag[0].location_found and tag[0].lat == 17.9784 and not tag[1].location_found and tag[1].lat is None
    df = spark.createDataFrame([("Telangana", "in Khammam"), ("Telangana", "x"), ("Tamil Nadu", "Warangal"), ("Andhra Pradesh & Telangana", "Nalgonda")], "s string, t string")
    got = [tuple(r[0]) for r in df.select(geo.resolve_location(F.col("s"), F.col("t"))).collect()]
    assert got == [("Telangana", "Khammam", "Khammam"), ("Telangana", "", ""), ("Tamil Nadu", "", ""), ("Andhra Pradesh & Telangana", "Nalgonda", "Nalgonda")]
    assert geo.gazetteer(spark).count() == 57


# Pages ---------------------------------------------------------------------

LONG = "This paragraph is certainly long enough to be taken for the real text of an article, number {}."


def body(n, start=0):
    return "".join(f"<p>{LONG.format(i)}</p>" for i in range(start, start + n))


def test_noise_goes_and_the_article_stays():
    p = html.page(f'<body class="post post-template-default social"><div class="ad-wrapper">{body(4)}</div><div class="social-share"><p>{LONG.format(9)}</p></div><script>var x = 1;</script></body>')
    assert p["content"].count("number") == 4 and "number 9" not in p["content"] and "var" not in p["content"]


def test_densest_block():
    p = html.page(f"<body><div><p>{LONG.format(0)}</p></div><section>{body(5, 1)}</section></body>")
    assert p["content"].count("number") == 5 and len(p["content"]) > 200
    assert html.page("<body><p>short</p><p>shorter</p></body>")["content"] == ""


def test_body_ladder_overwrites_until_long_enough():
    one, many = f"<p>{LONG.format(0)}</p>", body(3, 1)
    p = html.page(f'<div itemprop="articleBody">{one}</div><div class="x entry-content y">{many}</div>')
    assert "number 0" not in p["content"] and p["content"].count("number") == 3
    p = html.page(f'<div itemprop="articleBody">{many}</div><article>{one}</article>')
    assert "number 0" not in p["content"]
    exact = "x" * 200
    assert html.page(f"<article><p>{exact}</p></article><main><p>{'y' * 250}</p></main>")["content"] == "y" * 250  # 200 does not stop the ladder


def test_unclosed_paragraphs_do_not_nest():
    p = html.page(f"<article><p>{LONG.format(1)}<p>{LONG.format(2)}<div>x</div></article>")
    assert p["content"].split("\n\n") == [LONG.format(1), LONG.format(2)]


def test_page_fields():
    page = html.page('<head><meta property="og:title" content=" T "><meta name="description" content="D"><meta property="og:image" content="https://e.com/i.png"><meta property="article:published_time" content="2024-05-01"><title>x</title></head><body class="archive category-crime">')
    assert (page["title"], page["description"], page["image"], page["published"], page["is_listing"]) == ("T", "D", "https://e.com/i.png", "2024-05-01", True)
    page = html.page('<title> Plain </title><body class="single"><img src="/r.png" width="900"><img src="http://e.com/a.gif" width="900"><img src="http://e.com/s.jpg" width="100"><img src="http://e.com/b.jpg" width="300px"><time datetime="2024-05-02">')
    assert (page["title"], page["image"], page["published"], page["is_listing"], page["description"]) == ("Plain", "http://e.com/b.jpg", "2024-05-02", False, None)
    assert html.page(None) == {"image": None, "description": None, "content": "", "title": None, "published": None, "is_listing": False}


def test_listing_flag_forms_agree(spark):
    rows = ['<body class="archive x">', "<body class='single tagged'>", "<body>", '<body id="a" class="blog">', "", None]
    flags = values(spark, rows, html.listing_flag)
    assert flags == [True, False, False, True, False, False] == [html.page(r)["is_listing"] for r in rows]


def test_html_udfs(spark):
    page = '<link type="application/rss+xml" href="/f.xml"><link type="text/css" href="/c"><a href="/x">One <b>two</b></a><a>no</a>'
    assert values(spark, [page], html.feed_links) == [["/f.xml"]]
    assert [tuple(a) for a in values(spark, [page], html.page_links)[0]] == [("/x", "Onetwo")]
    assert values(spark, ["<p>a</p> b<br>c", None], html.html_text) == ["a b c", ""]


@pytest.mark.parametrize("markup", ["<p><p><p", "</div></p>", "<![CDATA[x]]>", "<a href>", "<" * 50, "<div>" * 500])
def test_broken_markup_never_fails(markup):
    assert html.page(markup)["is_listing"] is False
