"""JSON feeds of reviews, forums and blogs as posts. Each function takes rows with the reply of one request in a column and returns a
row for each post: id, source, region, language, url, author, title, body, posted_at, metrics (map). Nothing leaves the JVM.

`since` is an inclusive lower bound; rows whose time can't be read are dropped; a post that several replies hold counts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfield.functions.jsonx import script_text
from voxfield.functions.time import epoch


def _posts(rows: DataFrame, source: str, region: str, language: str, since: str | None, **columns: Column) -> DataFrame:
    out = rows.select(
        columns["id"].cast("string").alias("id"), F.lit(source).alias("source"), F.lit(region).alias("region"), F.lit(language).alias("language"),
        *[F.coalesce(columns.get(c, F.lit("")), F.lit("")).alias(c) for c in ("url", "author", "title", "body")], columns["posted_at"].cast("timestamp").alias("posted_at"), columns["metrics"].alias("metrics"),
    )
    out = out.where(F.col("id").isNotNull() & (F.col("id") != "") & F.col("posted_at").isNotNull())
    out = out.where(F.col("posted_at") >= F.lit(since).cast("timestamp")) if since else out
    # of several rows of an id the first in this order stays, so a rerun keeps the same
    order = F.struct(*[c for c in out.columns if c not in ("id", "metrics")], F.map_entries("metrics").alias("m"))
    return out.groupBy("id").agg(F.min_by(F.struct(*out.columns), order).alias("p")).select("p.*")


def _metrics(**values: Column) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[F.coalesce(v.try_cast("long"), F.lit(0).cast("long")) for v in values.values()]))


_LABEL = "struct<label: string>"
_APP = f"struct<feed: struct<entry: array<struct<id: {_LABEL}, author: struct<name: {_LABEL}>, title: {_LABEL}, content: {_LABEL}, updated: {_LABEL}, `im:rating`: {_LABEL}, `im:version`: {_LABEL}, `im:voteSum`: {_LABEL}, `im:voteCount`: {_LABEL}>>>>"


def app_store(replies: DataFrame, column: str, country: str, language: str, since: str | None = None) -> DataFrame:
    """Store reviews; entries without an author are the app's own and are dropped."""
    rows = replies.select(F.explode(F.from_json(column, _APP)["feed"]["entry"]).alias("e")).where("e.author.name.label is not null")
    e = lambda name: F.col("e")[name]["label"]
    return _posts(
        rows, f"app_store_{country}", country.upper(), language, since, id=e("id"), author=F.col("e.author.name.label"), title=e("title"), body=e("content"),
        posted_at=F.try_to_timestamp(e("updated")), metrics=_metrics(rating=e("im:rating"), vote_sum=e("im:voteSum"), vote_count=e("im:voteCount")),
    )


_REDDIT = "struct<data: struct<children: array<struct<kind: string, data: struct<id: string, title: string, selftext: string, author: string, permalink: string, created_utc: double, score: bigint, num_comments: bigint>>>>>"


def reddit(replies: DataFrame, column: str, region: str, since: str | None = None) -> DataFrame:
    """Listings: only items of kind t3 with an id."""
    rows = replies.select(F.explode(F.from_json(column, _REDDIT)["data"]["children"]).alias("c")).where("c.kind = 't3'")
    d = lambda name: F.col("c.data")[name]
    body = F.trim(F.concat_ws("\n\n", d("title"), F.nullif(d("selftext"), F.lit(""))))
    return _posts(
        rows, "reddit_old", region, "en", since, id=d("id"), author=d("author"), title=d("title"), body=body, url=F.concat(F.lit("https://old.reddit.com"), d("permalink")),
        posted_at=F.timestamp_seconds(d("created_utc")), metrics=_metrics(score=d("score"), num_comments=d("num_comments")),
    )


_DCARD = "array<struct<id: string, title: string, content: string, excerpt: string, forumName: string, school: string, anonymousSchool: boolean, createdAt: string, likeCount: bigint, commentCount: bigint>>"


def dcard(replies: DataFrame, column: str, since: str | None = None) -> DataFrame:
    """An array of posts, or an object that has it as `data`; the excerpt stands in for a missing content."""
    is_array = F.startswith(F.ltrim(F.col(column)), F.lit("["))
    array = F.from_json(F.when(is_array, F.col(column)).otherwise(F.get_json_object(column, "$.data")), _DCARD)
    rows = replies.select(F.explode(array).alias("p")).where("p.id is not null")
    p = lambda name: F.col("p")[name]
    return _posts(
        rows, "dcard", "TW", "zh-TW", since, id=p("id"), author=p("school"), title=p("title"), body=F.coalesce(F.nullif(p("content"), F.lit("")), p("excerpt")), url=F.concat(F.lit("https://www.dcard.tw/p/"), p("id")),
        posted_at=F.try_to_timestamp(p("createdAt")), metrics=_metrics(likes=p("likeCount"), comments=p("commentCount")),
    )


_MEDIUM = "struct<payload: struct<value: struct<id: string, title: string, creatorId: string, uniqueSlug: string, firstPublishedAt: bigint, content: struct<bodyModel: struct<paragraphs: array<struct<type: int, text: string>>>>, virtuals: struct<totalClapCount: bigint>>, references: struct<User: map<string, struct<name: string, username: string>>>>>"
# Paragraph types of prose.
_PROSE = [1, 6, 7, 9, 2, 3, 4]


def medium(replies: DataFrame, column: str, region: str, language: str, since: str | None = None) -> DataFrame:
    """Articles: the guard before the JSON is cut off, prose and heading paragraphs are joined, the author is looked up by id."""
    bare = F.regexp_replace(column, r"^[^{]*", "")
    rows = replies.select(F.from_json(bare, _MEDIUM)["payload"].alias("p")).where("p.value.id is not null")
    prose = F.filter(F.col("p.value.content.bodyModel.paragraphs"), lambda x: x["type"].isin(_PROSE))
    author = F.try_element_at(F.col("p.references.User"), F.col("p.value.creatorId"))["name"]
    return _posts(
        rows, "medium", region, language, since, id=F.col("p.value.id"), author=author, title=F.col("p.value.title"), body=F.array_join(F.transform(prose, lambda x: x["text"]), "\n\n"), url=F.concat(F.lit("https://medium.com/p/"), F.col("p.value.id")),
        posted_at=epoch(F.col("p.value.firstPublishedAt")), metrics=_metrics(claps=F.col("p.value.virtuals.totalClapCount")),
    )


_LD = "struct<`@type`: string, itemReviewed: struct<name: string>, review: array<struct<`@id`: string, headline: string, reviewBody: string, datePublished: string, author: struct<name: string>, reviewRating: struct<ratingValue: string>>>>"


def json_ld_reviews(pages: DataFrame, column: str, url: str, source: str, region: str, language: str, since: str | None = None) -> DataFrame:
    """Reviews in a page's JSON-LD script. Ids are hashes of address, author, time and text, so a reread finds the same."""
    script = script_text(F.col(column), "application/ld+json")
    rows = pages.select(F.col(url).alias("u"), F.explode(F.from_json(script, _LD)["review"]).alias("r"))
    r = lambda name: F.col("r")[name]
    author, at = F.col("r.author.name"), r("datePublished")
    key = F.substring(F.sha2(F.concat_ws("|", "u", author, at, r("reviewBody")).cast("binary"), 256), 1, 16)
    return _posts(rows, source, region, language, since, id=key, author=author, title=r("headline"), body=r("reviewBody"), url=F.col("u"), posted_at=F.try_to_timestamp(at), metrics=_metrics(rating=F.col("r.reviewRating.ratingValue").try_cast("double")))


def search_results(pages: DataFrame, column: str, key: str) -> DataFrame:
    """Result links of a search page, with redirects unwrapped to the address they carry."""
    from voxfield.sources.html import page_links

    links = page_links(pages, key, column)
    target = F.coalesce(F.url_decode(F.try_parse_url("href", F.lit("QUERY"), F.lit("uddg"))), F.col("href"))
    return links.select(key, "pos", target.alias("url"), "label")
