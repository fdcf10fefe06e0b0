"""Feeds and sitemaps as structured columns.

The standard parser runs in an Arrow UDF: documents come in two dialects, with
and without name spaces, children in any order, and may break off in the middle;
what was complete until then still counts.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents that are parsed at a time.
PIECE = 256
#: Name space of media elements.
MEDIA = "http://search.yahoo.com/mrss/"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
_ENTRY = _struct(
    **dict.fromkeys(("link", "title", "published", "updated", "description", "encoded"), _TEXT),
    thumbnails=_TEXTS,
    media=T.ArrayType(_struct(url=_TEXT, medium=_TEXT, type=_TEXT)),
    files=T.ArrayType(_struct(href=_TEXT, type=_TEXT)),
)
FEED = _struct(well_formed=T.BooleanType(), entries=T.ArrayType(_ENTRY))
SITEMAP = _struct(root=_TEXT, entries=T.ArrayType(_struct(loc=_TEXT, title=_TEXT, dates=_TEXTS)))


def _split(tag: str) -> tuple[str, str]:
    """Name space and name of a tag."""
    space, _, name = tag.rpartition("}")
    return space.lstrip("{"), name


def _ended(body: str, wanted: tuple[str, ...]) -> Iterator[tuple[ElementTree.Element | None, bool]]:
    """Wanted elements as they end; last (None, well-formed)."""
    try:
        for _, element in ElementTree.iterparse(io.BytesIO(body.lstrip("﻿ \t\r\n").encode("utf-8", "replace")), events=("end",), parser=ElementTree.XMLParser(encoding="utf-8")):
            if _split(element.tag)[1] in wanted:
                yield element, True
        yield None, True
    except ElementTree.ParseError:
        yield None, False


def _inner(element: ElementTree.Element) -> str:
    """Text of an element, markup inside kept."""
    return (element.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in element)


def _entry(element: ElementTree.Element) -> dict:
    out: dict = {"link": None, "title": None, "published": None, "updated": None, "description": None, "encoded": None, "thumbnails": [], "media": [], "files": []}

    def put(name: str, value: str | None) -> None:
        if out[name] is None and value:
            out[name] = value

    for c in element.iter():
        space, name = _split(c.tag)
        media = space == MEDIA
        if media and name == "thumbnail":
            out["thumbnails"].append(c.get("url", ""))
        elif media and name == "content":
            out["media"].append({"url": c.get("url", ""), "medium": c.get("medium", ""), "type": c.get("type", "")})
        elif media or c is element:
            continue
        elif name == "link":
            if c.get("href") is None:
                put("link", (c.text or "").strip())
            elif c.get("rel", "alternate") == "alternate":
                put("link", c.get("href"))
            if c.get("href"):
                kind = "enclosure" if c.get("rel") == "enclosure" else "link"
                out["files"].append({"href": c.get("href"), "type": c.get("type", ""), "kind": kind})
        elif name == "enclosure":
            out["files"].insert(0, {"href": c.get("url", c.get("href", "")), "type": c.get("type", ""), "kind": "enclosure"})
        elif name == "title":
            put("title", "".join(c.itertext()))
        elif name in ("pubDate", "published", "date", "issued"):
            put("published", (c.text or "").strip())
        elif name in ("updated", "modified"):
            put("updated", (c.text or "").strip())
        elif name in ("description", "summary"):
            put("description", _inner(c))
        elif name in ("encoded", "content"):
            put("encoded", _inner(c))
    # Enclosures come before other links, each in document order.
    files = [f for f in out["files"] if f["kind"] == "enclosure"] + [f for f in out["files"] if f["kind"] == "link"]
    out["files"] = [{"href": f["href"], "type": f["type"]} for f in files]
    return out


def read_feed(body: str | None) -> dict:
    entries, well = [], False
    for element, good in _ended(body or "", ("item", "entry")):
        if element is None:
            well = good
        else:
            entries.append(_entry(element))
    return {"well_formed": well, "entries": entries}


class _Sitemap:
    """Target of the XML parser: collects the places of a sitemap as their elements end."""

    def __init__(self) -> None:
        self.root: str | None = None
        self.entries: list[dict] = []
        self._path: list[str] = []
        self._text: list[list[str]] = []
        self._entry: dict = {}

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        name = _split(tag)[1]
        if self._text:
            self._text[-1].append("")  # what follows a child is not the text of its parent
        self._path.append(name)
        self._text.append([])
        if len(self._path) == 1:
            self.root = name
        elif len(self._path) == 2:
            self._entry = {"loc": None, "title": "", "dates": []}

    def data(self, data: str) -> None:
        if self._text and "" not in self._text[-1]:
            self._text[-1].append(data)

    def end(self, tag: str) -> None:
        name, depth, text = self._path.pop(), len(self._path), "".join(self._text.pop())
        entry = self._entry
        if depth == 2 and name == "loc" and entry["loc"] is None:
            entry["loc"] = text
        if depth >= 2 and text and name == "title":
            entry["title"] = text.strip()
        if depth >= 2 and text and name in ("publication_date", "lastmod"):
            entry["dates"].append(text.strip())
        if depth == 1 and entry["loc"]:
            self.entries.append(entry | {"loc": entry["loc"].strip()})

    def close(self) -> dict:
        return {"root": self.root, "entries": self.entries}


def read_sitemap(body: str | None) -> dict | None:
    """Name of the root and the places it lists; None for what is no whole document."""
    parser = ElementTree.XMLParser(target=_Sitemap(), encoding="utf-8")
    try:
        parser.feed((body or "").lstrip("﻿ \t\r\n").encode("utf-8", "replace"))
        return parser.close()
    except ElementTree.ParseError:
        return None


def _once(udf):
    """A function that is run where it stands, called not deterministic for that.

    Else Spark would parse again for each filter over what it gives, and before
    the join that chooses what is parsed.
    """
    return udf.asNondeterministic()


def _in_pieces(bodies: Iterator[pd.Series], read: Callable[[str | None], dict], names: list[str]) -> Iterator[pd.DataFrame]:
    """What ``read`` makes of each document; a worker holds that of :data:`PIECE` documents, however many a batch has."""
    for batch in bodies:
        for k in range(0, len(batch), PIECE):
            yield pd.DataFrame([read(b) for b in batch.iloc[k : k + PIECE]], columns=names)


@_once
@F.pandas_udf(FEED)
def parse_feed(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """An RSS or Atom document: whether it is whole, and its entries."""
    yield from _in_pieces(bodies, read_feed, FEED.names)


@_once
@F.pandas_udf(SITEMAP)
def parse_sitemap(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A sitemap: name of the root and the children with a location; root is null if it is no XML."""
    yield from _in_pieces(bodies, lambda b: read_sitemap(b) or {"root": None, "entries": None}, SITEMAP.names)
