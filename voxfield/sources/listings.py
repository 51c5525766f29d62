"""Result lists of sites: the addresses that a search or board page leads to, and listings that are posts themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfield.sources.feeds import _metrics, _posts
from voxfield.sources.select import Field, fields

# For each site the links of its lists, its address, what a link must and must not hold, and what is taken of it (None: all, else a pattern's first group).
_LISTS = {
    "ptt": (".title a[href]", "https://www.ptt.cc", "/bbs/", None, None),
    "mobile01": ("a[href*=topicdetail]", "https://www.mobile01.com", "topicdetail", None, None),
    "cosme": ("a[href*=/products/]", "https://www.cosme.net", "/products/", None, None),
    "tabelog": ("a[href*=/rst/]", "https://tabelog.com", "/rst/", "rvwPart", r"^([^?]*)"),
    "yelp_html": ("a[href*=/biz/]", "https://www.yelp.com", "/biz/", "?", None),
    "five_ch": ("a[href*=/test/read]", "https://itest.5ch.net", "/test/read", None, None),
    "trustpilot": ("a[href*=/review/]", "https://www.trustpilot.com", "/review/", None, r"^([^?]*?)/review/"),
}


def joined(base: str, href: Column) -> Column:
    """An address on a page of the site's top level, made whole."""
    return F.when(F.rlike(href, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), href).when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).when(F.startswith(href, F.lit("/")), F.concat(F.lit(base), href)).otherwise(F.concat(F.lit(base + "/"), href))


def result_links(pages: DataFrame, key: str, html: str, source: str) -> DataFrame:
    """(key, pos, url): the addresses of each page's results in page order, from 0, each once. A null page has none."""
    selector, base, must, never, part = _LISTS[source]
    rows = fields(pages, key, html, {"href": Field((selector,), "href")})
    fit = F.filter("href", lambda x: x.contains(must) & (~x.contains(never) if never else F.lit(True)))
    whole = F.array_distinct(F.transform(fit, lambda x: joined(base, F.regexp_extract(x, part, 1) if part else x)))
    return rows.select(key, F.posexplode(whole).alias("pos", "url"))


def lihkg(pages: DataFrame, html: str, topic: str, fetched: str, since: str | None = None) -> DataFrame:
    """Threads of a board's pages whose title holds the topic, in either case: title without tag and count, author, time, replies and likes from the text of the block around the link. The title is
    the body, as lists have no more. A thread that several pages or links name counts once. Likes are the likes said (not the replies)."""
    selector = ("a[href*=/thread/]",)
    rows = fields(pages.select(F.col(html).alias("h"), F.monotonically_increasing_id().alias("k")), "k", "h", {"href": Field(selector, "href"), "title": Field(selector), "block": Field(selector, above="div")})
    links = rows.select(F.explode(F.arrays_zip("href", "title", "block")).alias("x")).select("x.*")
    thread = F.regexp_extract("href", r"/thread/([0-9]+)/page/1", 1)
    title = F.trim(F.regexp_replace(F.trim(F.regexp_replace("title", r"\s*\[[0-9]+\]\s*$", "")), r"^\[.*?\]\s*", ""))
    number = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("long")
    at = F.coalesce(F.try_to_timestamp(F.regexp_extract("block", r"([0-9]{4}-[0-9]{2}-[0-9]{2}\s*[0-9]{2}:[0-9]{2})", 1)), F.lit(fetched).cast("timestamp"))
    rows = links.withColumn("tid", thread).where((F.col("tid") != "") & (F.lower("title").contains(topic.lower())))
    return _posts(
        rows, "lihkg", "HK", "zh-HK", since, id=F.concat(F.lit("lihkg_"), "tid"), url=F.concat(F.lit("https://lihkg.com/thread/"), "tid"),
        author=F.coalesce(F.nullif(F.regexp_extract("block", r"([^\s·]+?)\s*·\s*[0-9]{4}-[0-9]{2}-[0-9]{2}", 1), F.lit("")), F.lit("anonymous")), title=title, body=title, posted_at=at,
        metrics=_metrics(reply_count=F.coalesce(number("title", r"\[([0-9]+)\]\s*$"), number("block", r"(?i)([0-9]+)\s*repl")), likes=number("block", r"(?i)([0-9]+)\s*lik")),
    )


def first_or(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of first, or if it has none those of second, in one plan: whether first is empty is one row that second is joined with, and where that row is missing Spark's adaptive
    plan leaves the whole second branch out."""
    empty = first.select(F.lit(1).alias("_n")).limit(1).agg(F.count("*").alias("_n")).where("_n = 0")
    return first.unionByName(second.join(F.broadcast(empty), F.lit(True)).drop("_n"))
