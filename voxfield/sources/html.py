"""Parsing of pages: text, links and cards, by a tolerant state machine on the standard parser, in Arrow batches."""

from __future__ import annotations

import html.parser
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield.session import small_batches

_SKIP = {"script", "style", "noscript", "template", "nav", "footer", "head"}
_BREAK = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "article", "section", "header", "ul", "ol", "table", "blockquote"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Page(html.parser.HTMLParser):
    """Collects text outside skipped elements, links with their text, and the texts of elements of a class. Unclosed elements end with
    the element around them."""

    def __init__(self, card_class: str | None = None):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.cards = [], [], []
        self.open: list[str] = []
        self.card_class, self.card_depth, self.link = card_class, None, None

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag in _BREAK:
            self.parts.append("\n")
        if tag not in _VOID:
            self.open.append(tag)
        if tag == "a" and values.get("href"):
            self.link = [values["href"], []]
            self.links.append(self.link)
        if self.card_class and self.card_depth is None and self.card_class in (values.get("class") or "").split():
            self.card_depth = len(self.open)
            self.cards.append([])

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        if tag == "a":
            self.link = None
        if tag in _BREAK:
            self.parts.append("\n")
        if self.card_depth is not None and len(self.open) < self.card_depth:
            self.card_depth = None

    def handle_data(self, data):
        if _SKIP.isdisjoint(self.open):
            self.parts.append(data)
        if self.link is not None:
            self.link[1].append(data)
        if self.card_depth is not None:
            self.cards[-1].append(data)


def parse(page: str | None, card_class: str | None = None) -> _Page:
    p = _Page(card_class)
    p.feed(page or "")
    p.close()
    return p


def _clean(parts: list[str]) -> str:
    lines = (" ".join(x.split()) for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x)


def pieces(batches: Iterator[pa.RecordBatch], html_col: str = "h", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about `most` bytes of pages each; a longer page is a slice of its own. So a worker holds the strings of one slice, not of a whole batch."""
    for b in batches:
        at, size = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(html_col)), 0).to_pylist()):
            if i > at and size + n > most:
                yield b.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < b.num_rows:
            yield b.slice(at)


def page_text(pages: DataFrame, key: str, html_col: str) -> DataFrame:
    """(key, text): the readable text of each page, a line for each block; a null page has the empty text."""
    rows = pages.select(F.col(key).alias("k"), F.col(html_col).alias("h"))
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([_clean(parse(x).parts) for x in b.column("h").to_pylist()], pa.string())], ["k", "text"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, text string").withColumnRenamed("k", key)


def page_links(pages: DataFrame, key: str, html_col: str) -> DataFrame:
    """(key, pos, href, label): a row for each link."""
    rows = pages.select(F.col(key).alias("k"), F.col(html_col).alias("h"))
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = [(k, i, href, " ".join("".join(t).split())) for k, x in zip(b.column("k").to_pylist(), b.column("h").to_pylist(), strict=True) for i, (href, t) in enumerate(parse(x).links)]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field("k").type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], ["k", "pos", "href", "label"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, pos int, href string, label string").withColumnRenamed("k", key)


def page_cards(pages: DataFrame, key: str, html_col: str, card_class: str, least: int = 10) -> DataFrame:
    """(key, pos, body): the texts of the elements with a class (reviews, answers, replies), of `least` characters or more."""
    rows = pages.select(F.col(key).alias("k"), F.col(html_col).alias("h"))
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = [(k, i, c) for k, x in zip(b.column("k").to_pylist(), b.column("h").to_pylist(), strict=True) for i, c in enumerate(" ".join("".join(t).split()) for t in parse(x, card_class).cards) if len(c) >= least]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field("k").type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], ["k", "pos", "body"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, pos int, body string").withColumnRenamed("k", key)
