"""Fields of pages by selectors: a page becomes a small tree, selectors find elements in it, and their texts go back to Spark, where
dates, counts and ratings are read with column functions.

A selector is a comma list of paths; a path is a space list of steps, each below the one before; a step is a tag with any of #id, .class,
[name], [name=value] and [name*=part]. Matches come in page order, each once."""

from __future__ import annotations

import html.parser
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield.session import small_batches
from voxfield.sources.html import pieces

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_STEP = re.compile(r"(?P<tag>^[a-zA-Z][\w-]*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<name>[\w:-]+)(?:(?P<op>\*?=)'?(?P<value>[^\]']*)'?)?\]")


class Field(NamedTuple):
    """What to take: `choices` are tried in turn and the first with a match gives all its matches ("" is the card or page itself); `attr` takes an attribute instead of the text;
    `lines` keeps the pieces of text apart by line breaks; `raw` takes a script's content; elements that match `without` are left out of the text; `above` takes the text of
    the nearest element of that tag around each match, its pieces joined by spaces (empty if there is none)."""

    choices: tuple[str, ...]
    attr: str | None = None
    lines: bool = False
    without: str | None = None
    raw: bool = False
    above: str | None = None


class Node:
    __slots__ = ("tag", "attrs", "up", "down")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up, self.down = tag, attrs, up, []


class _Tree(html.parser.HTMLParser):
    """Unclosed elements end with the one around them; an end without a start is passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.down.append(node)
        if tag not in _VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.here.down.append(Node(tag, {k: v or "" for k, v in attrs}, self.here))

    def handle_endtag(self, tag):
        node = self.here
        while node.up is not None and node.tag != tag:
            node = node.up
        if node.up is not None:
            self.here = node.up

    def handle_data(self, data):
        last = self.here.down[-1] if self.here.down else None
        if isinstance(last, str):
            self.here.down[-1] = last + data
        else:
            self.here.down.append(data)


def tree(page: str | None) -> Node:
    t = _Tree()
    t.feed(page or "")
    t.close()
    return t.root


@lru_cache(maxsize=1024)
def _paths(selector: str) -> tuple[tuple[tuple[tuple[str, str, str], ...], ...], ...]:
    """Paths of steps of tests (kind, name, value)."""

    def step(text):
        tests = []
        for m in _STEP.finditer(text):
            if m["tag"]:
                tests.append(("tag", m["tag"].lower(), ""))
            elif m["id"]:
                tests.append(("=", "id", m["id"]))
            elif m["cls"]:
                tests.append(("word", "class", m["cls"]))
            else:
                tests.append((m["op"] or "has", m["name"], m["value"] or ""))
        if not tests:
            raise ValueError(f"not a selector step: {text!r}")
        return tuple(tests)

    return tuple(tuple(step(s) for s in path.split()) for path in selector.split(","))


def _fits(node: Node, tests) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            if node.tag != name:
                return False
            continue
        have = node.attrs.get(name)
        if have is None or (kind == "=" and have != value) or (kind == "*=" and value not in have) or (kind == "word" and value not in have.split()):
            return False
    return True


def _below(node: Node, path, top: Node) -> bool:
    """Whether the steps of `path` are met by ancestors of `node` in order; the innermost ancestor that fits is always the best choice."""
    steps = len(path)
    while steps and node.up is not None and node is not top:
        node = node.up
        if _fits(node, path[steps - 1]):
            steps -= 1
    return not steps


def find(top: Node, selector: str) -> list[Node]:
    """Elements below `top`, in page order; no recursion, so depth is no limit. Ancestors above `top` don't count."""
    paths, out, stack = _paths(selector), [], list(reversed(top.down))
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            continue
        if any(_fits(node, p[-1]) and _below(node, p[:-1], top) for p in paths):
            out.append(node)
        stack.extend(reversed(node.down))
    return out


def around(node: Node, tag: str) -> Node | None:
    """The nearest ancestor of this tag."""
    while (node := node.up) is not None and node.tag != tag:
        pass
    return node


def text_of(top: Node, lines: bool = False, without: frozenset[int] = frozenset(), joint: str | None = None) -> str:
    """The trimmed pieces of text, joined by nothing, by line breaks or by `joint`; scripts and styles have none."""
    out, stack = [], list(reversed(top.down))
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            if piece := node.strip():
                out.append(piece)
        elif node.tag not in ("script", "style", "template") and id(node) not in without:
            stack.extend(reversed(node.down))
    return (joint or ("\n" if lines else "")).join(out)


def take(top: Node, field: Field) -> list[str]:
    for selector in field.choices:
        if nodes := find(top, selector) if selector else [top]:
            if field.above:
                return [text_of(up, joint=" ") if (up := around(n, field.above)) else "" for n in nodes]
            if field.attr:
                return [n.attrs.get(field.attr, "") for n in nodes]
            if field.raw:
                return ["".join(x for x in n.down if isinstance(x, str)) for n in nodes]
            out = frozenset(map(id, find(top, field.without))) if field.without else frozenset()
            return [text_of(n, field.lines, out) for n in nodes]
    return []


def _parts(page: str | None, cards: str | None) -> Iterator[Node]:
    """The page's tree or its cards, one page at a time; a tree holds itself by its links, so they are cut as soon as it is read."""
    root = tree(page)
    yield from find(root, cards) if cards else [root]
    stack = [root]
    while stack:
        node = stack.pop()
        stack += [x for x in node.down if isinstance(x, Node)]
        node.up, node.down = None, []


def fields(pages: DataFrame, key: str, html_col: str, wanted: dict[str, Field], cards: str | None = None) -> DataFrame:
    """(key, pos, one array<string> for each field): a row for each page, or for each element that matches `cards`; a card inside another
    counts too. A null or empty page gives empty arrays, and no cards. A worker holds the fields of about 1 MB of pages, or of one longer page."""
    rows = pages.select(F.col(key).alias("k"), F.col(html_col).alias("h"))
    names = list(wanted)
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = [(k, i, *[take(t, wanted[n]) for n in names]) for k, page in zip(b.column("k").to_pylist(), b.column("h").to_pylist(), strict=True) for i, t in enumerate(_parts(page, cards))]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field("k").type), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.list_(pa.string())) for c in columns[2:]]], ["k", "pos", *names])

    schema = f"k {rows.schema['k'].dataType.simpleString()}, pos int, " + ", ".join(f"`{n}` array<string>" for n in names)
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)
