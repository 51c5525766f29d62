"""Paged sources as a Spark data source: a client says what pages a topic has, and a scan asks only for those that its filters and its limit need, each in a task of its own.

    spark.dataSource.register(PagedPosts)
    spark.read.format("paged_posts").option("client", "package.module:Client").option("client_arg", folder).option("topic", "tea").option("limit", 500).load()

A client is made with one text (`client_arg`) on the driver and in each task. `pages(topic)` lists a topic's pages from the newest, `fetch(topic, page)` gives a page's posts as dicts of the columns.
With the option `pushdown` at `true`, which needs spark.sql.python.filterPushdown.enabled, `topic = ...` and `posted_at >= ...` in a query do what the options `topic` and `since` do."""

from __future__ import annotations

import datetime as dt
import importlib
import json
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple, Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

_UTC = dt.timezone.utc


class Page(NamedTuple):
    """What is known of a page without asking for it: its number, how many posts it has, and the times of its newest and oldest one."""

    number: int
    posts: int
    newest: dt.datetime
    oldest: dt.datetime


class Client(Protocol):
    def pages(self, topic: str) -> list[Page]: ...

    def fetch(self, topic: str, page: int) -> list[dict]: ...


def _aware(at: dt.datetime) -> dt.datetime:
    return at if at.tzinfo else at.replace(tzinfo=_UTC)


def _time(text: str) -> dt.datetime:
    return _aware(dt.datetime.fromisoformat(text.replace("Z", "+00:00")))


class Fixtures:
    """A client of saved replies: <folder>/<topic>/page-<number>.json, a list of posts, and beside it page-<number>.meta.json, the sidecar with `posts`, `newest` and `oldest`.
    The folder must be mounted on all machines. Pages without a sidecar are left out, as their saving didn't end."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def pages(self, topic: str) -> list[Page]:
        out = []
        for side in (self.folder / topic).glob("page-*.meta.json"):
            meta = json.loads(side.read_text(encoding="utf-8"))
            out.append(Page(int(side.name[5:-10]), meta["posts"], _time(meta["newest"]), _time(meta["oldest"])))
        return sorted(out, key=lambda p: p.number)

    def fetch(self, topic: str, page: int) -> list[dict]:
        return json.loads((self.folder / topic / f"page-{page}.json").read_text(encoding="utf-8"))

    def save(self, topic: str, page: int, posts: list[dict]) -> None:
        """Writes a reply, then its sidecar."""
        times = sorted(p["posted_at"] for p in posts)
        (self.folder / topic).mkdir(parents=True, exist_ok=True)
        (self.folder / topic / f"page-{page}.json").write_text(json.dumps(posts), encoding="utf-8")
        (self.folder / topic / f"page-{page}.meta.json").write_text(json.dumps({"posts": len(posts), "newest": times[-1], "oldest": times[0]}), encoding="utf-8")


class _Part(InputPartition):
    def __init__(self, topic: str, page: int, take: int | None):
        super().__init__((topic, page, take))
        self.topic, self.page, self.take = topic, page, take


class PagedPosts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_posts"

    def schema(self) -> str:
        return "topic string, page int, id string, title string, body string, posted_at timestamp"

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (_PushingReader if options.get("pushdown") == "true" else _Reader)(options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.topic, self.since = options.get("topic"), _time(options["since"]) if options.get("since") else None
        self.limit = int(options["limit"]) if options.get("limit") else None

    def client(self) -> Client:
        module, _, name = self.options["client"].partition(":")
        return getattr(importlib.import_module(module), name)(self.options.get("client_arg", ""))

    def partitions(self) -> list[_Part]:
        if self.topic is None:
            raise ValueError("paged_posts needs a topic: as an option, or as a filter with `pushdown`")
        out, left = [], self.limit
        for page in self.client().pages(self.topic):
            if (left is not None and left <= 0) or not page.posts:
                continue
            if self.since and page.newest < self.since:
                continue
            out.append(_Part(self.topic, page.number, left))
            if left is not None and not (self.since and page.oldest < self.since):
                left -= page.posts  # of a page that `since` cuts it isn't known how many count; a page after it may be asked for in vain
        return out or [_Part(self.topic, -1, 0)]

    def read(self, part: _Part) -> Iterator[tuple]:
        n = 0
        for p in self.client().fetch(part.topic, part.page) if part.page >= 0 else ():
            at = _time(p["posted_at"])
            if self.since and at < self.since:
                continue
            if part.take is not None and n >= part.take:
                return
            n += 1
            yield part.topic, part.page, p["id"], p.get("title"), p.get("body"), at


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A topic and lower bounds of time choose pages; Spark still checks the bounds row by row."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("topic",) and self.topic in (None, f.value):
                self.topic = f.value
                continue
            if isinstance(f, (GreaterThanOrEqual, GreaterThan)) and f.attribute == ("posted_at",):
                self.since = max(_aware(f.value), self.since) if self.since else _aware(f.value)
            yield f
