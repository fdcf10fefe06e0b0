"""HTML: a flat outline on the standard parser, and what a page yields.

A page is read once into an outline: elements in the order they open, each with
the span of places it covers, and the strings with their places. What lies
inside an element is what lies in its span, so noise is a set of spans to leave
out and nothing is taken out of a tree. From what stays one record is gathered
(metas, times, images, paragraphs), and rules select from the record.

Paragraphs end where HTML says they do (a block begins), so an unclosed ``<p>``
does not swallow the ones after it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.functions.text import NOISE_PHRASES, SHORTEST_PARAGRAPH
from presswork.schemas import PAGE

# They decide results.
LISTING_CLASSES = ("archive", "category", "tag", "author", "search", "blog", "paged")
NOISE_TAGS = ("script", "style", "nav", "footer", "aside", "form", "iframe")
NOISE_CLASS_PARTS = ("related", "social", "share", "advert", "ad-", "-ad", "newsletter", "subscribe", "comment")
NOISE_CLASS = "ad"
#: Where paragraphs of an article are looked for, in order (CSS).
BODY_SELECTORS = (
    'div[itemprop="articleBody"] p',
    'div[class*="entry-content"] p',
    "article p",
    'div[class*="article-body"] p',
    'div[class*="articleBody"] p',
    'div[class*="story-content"] p',
    'div[class*="storyContent"] p',
    'div[class*="story_content"] p',
    'div[class*="content-area"] p',
    'div[class*="article-content"] p',
    'div[class*="article_content"] p',
    'div[class*="post-content"] p',
    "div.artText p",
    "div.storytxt p",
    "div.storyDetails p",
    'section[class*="article"] p',
    ".story-body p",
    ".article p",
    "main article p",
    "main p",
)
PUBLISHED_METAS = ("article:published_time", "og:article:published_time", "article:modified_time")
#: Metas by property, then by name where one is given, in the order they are tried.
IMAGE_METAS = (("og:image", None), ("og:image:secure_url", None), ("twitter:image", "twitter:image"), ("twitter:image:src", "twitter:image:src"))
TITLE_METAS = (("og:title", None), ("twitter:title", "twitter:title"))
DESCRIPTION_METAS = (("og:description", None), ("description", "description"))
#: A noise element with so many paragraphs of such a length holds the article and stays.
HOLDER_PARAGRAPHS, HOLDER_LENGTH = 3, 60
#: Text longer than this ends the search by selectors; shorter text gives way to the densest block.
ENOUGH_TEXT = 200
#: Least width of an image that stands for an article.
LEAST_WIDTH = 200

_LINK = T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_UNREAD = frozenset(("script", "style", "template"))
_NOTHING = {"image": None, "description": None, "content": "", "title": None, "published": None, "is_listing": False}


@dataclass(slots=True)
class Element:
    tag: str
    attrs: dict[str, str]
    #: Index of the element around it, -1 at the top.
    around: int
    #: Places covered: from its own to the first after it.
    begin: int
    end: int = -1
    #: Strings and elements directly inside.
    parts: int = 0

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class Outline(HTMLParser):
    """Elements and strings of a page, numbered by place."""

    def __init__(self, html: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.places: list[int] = []
        self.strings: list[str] = []
        self._open: list[int] = []
        self._unread = 0
        self._place = 0
        self.feed(html or "")
        self.close()
        while self._open:
            self._end()

    def _next(self) -> int:
        self._place += 1
        if self._open:
            self.elements[self._open[-1]].parts += 1
        return self._place

    def _end(self) -> None:
        element = self.elements[self._open.pop()]
        element.end = self._place + 1
        self._unread -= element.tag in _UNREAD

    def _end_of(self, tag: str, barrier: str = "") -> None:
        for depth in range(len(self._open) - 1, -1, -1):
            name = self.elements[self._open[depth]].tag
            if name == tag:
                while len(self._open) > depth:
                    self._end()
                return
            if name == barrier:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _ENDS_P:
            self._end_of("p", barrier="table")
        place = self._next()
        element = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self._open[-1] if self._open else -1, place)
        if tag in _VOID:
            element.end = place + 1
        else:
            self._open.append(len(self.elements))
            self._unread += tag in _UNREAD
        self.elements.append(element)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        self._end_of(tag)

    def handle_endtag(self, tag: str) -> None:
        self._end_of(tag)

    def handle_data(self, data: str) -> None:
        place = self._next()
        stripped = data.strip()
        if stripped and not self._unread:
            self.places.append(place)
            self.strings.append(stripped)

    def text(self, element: Element | None = None, between: str = " ") -> str:
        """The readable strings of an element (all), each stripped, the empty ones left out."""
        if element is None:
            return between.join(self.strings)
        return between.join(self.strings[bisect_left(self.places, element.begin) : bisect_left(self.places, element.end)])

    def leave_out(self, spans: list[tuple[int, int]]) -> None:
        """Forget what lies in ``spans`` (in order, none inside another). Elements become None, to keep their numbers."""

        def outside(place: int) -> bool:
            k = bisect_left(spans, (place + 1,)) - 1
            return k < 0 or place >= spans[k][1]

        kept = [k for k, place in enumerate(self.places) if outside(place)]
        self.places, self.strings = [self.places[k] for k in kept], [self.strings[k] for k in kept]
        self.elements = [e if e is not None and outside(e.begin) else None for e in self.elements]


def collapse(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _is_noise(e: Element) -> bool:
    names = e.attrs.get("class", "")
    return e.tag in NOISE_TAGS or NOISE_CLASS in e.classes or any(x in names for x in NOISE_CLASS_PARTS)


def noise(outline: Outline) -> list[tuple[int, int]]:
    """Spans of navigation, advertising and the like; none that holds the article, none inside another."""
    long = [e.begin for e in outline.elements if e.tag == "p" and len(outline.text(e, "")) >= HOLDER_LENGTH]
    spans: list[tuple[int, int]] = []
    for e in outline.elements:
        if (spans and e.begin < spans[-1][1]) or e.tag in ("html", "body") or not _is_noise(e):
            continue
        inside = bisect_left(long, e.end) - bisect_left(long, e.begin + 1)
        if e.tag in ("script", "style") or inside < HOLDER_PARAGRAPHS:
            spans.append((e.begin, e.end))
    return spans


@dataclass
class Record:
    """What a page has to offer, in document order."""

    properties: dict[str, str] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)
    times: list[str] = field(default_factory=list)
    images: list[tuple[str, str]] = field(default_factory=list)
    titles: list[str] = field(default_factory=list)
    body_classes: list[str] | None = None
    #: Clean text of each paragraph that counts, and the elements around it, the nearest first.
    paragraphs: list[tuple[str, list[int]]] = field(default_factory=list)


def gather(outline: Outline) -> Record:
    """One pass over the elements that are left."""
    r = Record()
    for e in outline.elements:
        if e is None:
            continue
        a = e.attrs
        if e.tag == "meta":
            for key, known in (("property", r.properties), ("name", r.names)):
                if key in a:
                    known.setdefault(a[key], a.get("content", "").strip())
        elif e.tag == "time" and "datetime" in a:
            r.times.append(a["datetime"].strip())
        elif e.tag == "img" and "src" in a:
            r.images.append((a["src"], a.get("width", "")))
        elif e.tag == "title":
            r.titles.append(outline.text(e) if e.parts == 1 else "")
        elif e.tag == "body" and r.body_classes is None:
            r.body_classes = e.classes
        elif e.tag == "p":
            text = collapse(outline.text(e))
            low = text.lower()
            if len(text) >= SHORTEST_PARAGRAPH and not any(x in low for x in NOISE_PHRASES):
                around, k = [], e.around
                while k >= 0:
                    around.append(k)
                    k = outline.elements[k].around
                r.paragraphs.append((text, around))
    return r


_STEP = re.compile(r'(?P<tag>\w*)(?:\.(?P<token>[\w-]+)|\[(?P<name>\w+)(?P<how>\*?=)"(?P<value>[^"]*)"\])?')


def _steps(selector: str) -> list[dict[str, str | None]]:
    """The compound selectors around the last one, the innermost first."""
    return [_STEP.fullmatch(x).groupdict() for x in selector.split()[-2::-1]]


def _fits(e: Element, step: dict[str, str | None]) -> bool:
    if step["tag"] and e.tag != step["tag"] or step["token"] and step["token"] not in e.classes:
        return False
    if not step["name"]:
        return True
    value = e.attrs.get(step["name"], "")
    return step["value"] in value if step["how"] == "*=" else value == step["value"]


_BODY_STEPS = [_steps(x) for x in BODY_SELECTORS]


def _stands_in(around: list[int], steps: list[dict[str, str | None]], outline: Outline) -> bool:
    """Whether the elements around a paragraph fit the steps one after the other, outward."""
    wanted = iter(steps)
    step = next(wanted)
    for k in around:
        if _fits(outline.elements[k], step):
            step = next(wanted, None)
            if step is None:
                return True
    return False


def _joined(texts: Iterable[str]) -> str:
    return "\n\n".join(texts)


def select_body(r: Record, outline: Outline) -> str:
    """Paragraphs by the selectors, each with any replacing the one before; the densest block if that is little."""
    best = ""
    for steps in _BODY_STEPS:
        best = _joined(text for text, around in r.paragraphs if _stands_in(around, steps, outline)) or best
        if len(best) > ENOUGH_TEXT:
            return best
    if len(best) >= ENOUGH_TEXT:
        return best
    blocks: defaultdict[int, list[str]] = defaultdict(list)
    for text, around in r.paragraphs:
        blocks[around[0] if around else -1].append(text)
    dense = _joined(max(blocks.values(), key=lambda texts: sum(map(len, texts)), default=[]))
    return dense if len(dense) >= ENOUGH_TEXT else best


def select_meta(r: Record, wanted: tuple[tuple[str, str | None], ...]) -> str | None:
    """The first of some metas with content. A property that is there hides the name that goes with it."""
    found = (r.properties[p] if p in r.properties else r.names.get(n, "") for p, n in wanted)
    return next(filter(None, found), None)


def select_image(r: Record) -> str | None:
    """The image that the metas name, else the first wide one; only absolute addresses count."""
    image = select_meta(r, IMAGE_METAS)
    for source, width in r.images if not image else ():
        digits = re.fullmatch(r"\s*\+?([0-9]+)\s*", width.replace("px", ""))
        if source.startswith("http") and not source.endswith(".gif") and digits and int(digits[1]) >= LEAST_WIDTH:
            image = source
            break
    return image if image and image.startswith("http") else None


def page(html: str | None) -> dict:
    """What an article page yields; all empty if the page can not be read."""
    try:
        outline = Outline(html)
    except (ValueError, AssertionError):
        return dict(_NOTHING)
    outline.leave_out(noise(outline))
    r = gather(outline)
    dates = [*(r.properties.get(p) for p in PUBLISHED_METAS), *r.times[:1]]
    return {
        "image": select_image(r),
        "description": select_meta(r, DESCRIPTION_METAS),
        "content": select_body(r, outline),
        "title": select_meta(r, TITLE_METAS) or next(iter(r.titles), None) or None,
        "published": next((d for d in dates[:-1] if d), dates[-1]) if r.times else next(filter(None, dates), None),
        "is_listing": any(c in LISTING_CLASSES for c in r.body_classes or ()),
    }


@F.pandas_udf(PAGE)
def extract_page(html: pd.Series) -> pd.DataFrame:
    """:func:`page` of a column (a parser has to see each page by itself)."""
    return pd.DataFrame([page(h) for h in html], columns=PAGE.names)


@F.pandas_udf(T.ArrayType(_LINK))
def page_links(html: pd.Series) -> pd.Series:
    """The links of a page in document order."""

    def links(o: Outline) -> list[dict[str, str]]:
        return [{"href": e.attrs["href"], "text": o.text(e, "")} for e in o.elements if e.tag == "a" and "href" in e.attrs]

    return pd.Series([links(Outline(h)) for h in html], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def feed_links(html: pd.Series) -> pd.Series:
    """The feeds a page declares, in document order."""
    kinds = ("application/rss+xml", "application/atom+xml")
    return pd.Series([[e.attrs["href"] for e in Outline(h).elements if e.tag == "link" and e.attrs.get("type") in kinds and e.attrs.get("href")] for h in html], dtype=object)


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    """The text of a piece of HTML, white space collapsed."""
    return html.map(lambda h: collapse(Outline(h).text()) if h else "")


def whole_references(html: Column) -> Column:
    """HTML in which only references with their ``;`` are ones: the ``&`` of any other is escaped.

    HTML itself (and so :func:`page`) reads some old names without it, as ``&amp``.
    """
    return F.regexp_replace(html, r"&(?=#?[A-Za-z0-9]++(?!;))", "&amp;")


def listing_flag(html: Column) -> Column:
    """The listing flag of :func:`page` by pattern, for pages with a plain body tag."""
    names = F.regexp_extract(html, r"(?i)<body[^>]*?\sclass\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.coalesce(F.arrays_overlap(F.split(names, r"\s+"), F.array(*map(F.lit, LISTING_CLASSES))), F.lit(False))
