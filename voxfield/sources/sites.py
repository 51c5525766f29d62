"""Pages of forums, review sites, news and video as posts, in the columns of `feeds`. Selectors find the texts (`select.fields`); everything after that is column functions.

Ids that a site doesn't give are the first 16 hex digits of the SHA-256 of what tells a post apart, so a second reading finds the same. A
missing or unreadable time is `fetched`, the time the page was read, or 1970 where none is given. Texts shorter than the site's bound and null pages give no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfield.sources.feeds import _metrics, _posts
from voxfield.sources.select import Field, fields

_EPOCH = "1970-01-01 00:00:00"


def _first(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(name), F.lit(1)), F.lit(""))


def _number(text: Column, pattern: str = r"([0-9]+)") -> Column:
    return F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("long"), F.lit(0).cast("long"))


def _digest(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(F.concat_ws("\n\n", *parts).cast("binary"), 256), 1, 16))


def _time(text: Column, fetched: str | None) -> Column:
    return F.coalesce(F.try_to_timestamp(text), F.lit(fetched or _EPOCH).cast("timestamp"))


def _joined(name: str, least: int, most: int | None = None) -> Column:
    """Texts longer than `least`, of the first `most` matches, as paragraphs."""
    texts = F.slice(name, 1, most) if most else F.col(name)
    return F.trim(F.array_join(F.filter(texts, lambda x: F.length(x) > least), "\n\n"))


# For each review site the cards, the fields and the least length of a body.
_REVIEWS = {
    "yelp_html": ("[class*=review]", {"body": Field(("[class*=comment], [class*=review-content] p, [lang]",)), "author": Field(("[class*=user-name], [class*=author]",)), "rating": Field(("[class*=star-rating], [aria-label*=star]",), "aria-label"), "time": Field(("[class*=date], time",), "datetime")}, 10),
    "cosme": ("[class*=review-list] li, [class*=review-item], [class*=ReviewItem]", {"body": Field(("[class*=review-text], [class*=comment], [class*=body]",)), "author": Field(("[class*=user-name], [class*=reviewer]",)), "rating": Field(("[class*=rating] img, [class*=star]",), "alt")}, 20),
    "tabelog": ("[class*=rvw-item], [class*=review-item]", {"body": Field(("[class*=rvw-item__comment], [class*=comment], [class*=body]",)), "author": Field(("[class*=rvw-item__user], [class*=user-name]",)), "rating": Field(("[class*=rvw-item__rating], [class*=rating]",))}, 20),
    "yahoo_japan_reviews": ("[class*=reviewItem], .review-item, [class*=Review]", {"body": Field(("[class*=reviewText], [class*=comment], [class*=body]",)), "author": Field(("[class*=reviewer], [class*=userName]",)), "rating": Field(("[class*=rating], [class*=star]",))}, 10),
    "trustpilot": ("[class*=review-card], article", {"title": Field(("h2, .review-title, [class*=title]",)), "body": Field((".review-content__text, .review-body, [class*=content]",)), "author": Field(("[class*=consumer-name], [class*=author]",)), "rating": Field(("[class*=star-rating], img[alt*=star]",), "alt")}, 1),
}


def reviews(pages: DataFrame, html: str, url: str, source: str, region: str, language: str, fetched: str | None = None, since: str | None = None) -> DataFrame:
    """Cards of a review site: yelp_html, cosme, tabelog, yahoo_japan_reviews or trustpilot. Equal reviews of one source are one post. A rating
    is the first number of its text or label; tabelog's, which has decimals, is rounded half to even."""
    cards, wanted, least = _REVIEWS[source]
    rows = fields(pages, url, html, wanted, cards)
    body, author = _first("body"), _first("author")
    title = _first("title") if "title" in wanted else F.lit("")
    if source == "tabelog":
        rating = F.bround(F.coalesce(F.regexp_extract(_first("rating"), r"([0-9]+\.?[0-9]*)", 1).try_cast("double"), F.lit(0.0)), 0)
    else:
        rating = _number(_first("rating"), "([0-9])" if source in ("cosme", "yahoo_japan_reviews") else "([0-9]+)")
    product = [F.regexp_extract(F.col(url), "/product/([a-zA-Z0-9]+)", 1)] if source == "yahoo_japan_reviews" else []
    at = _time(_first("time"), fetched) if "time" in wanted else _time(F.lit(None).cast("string"), fetched)
    return _posts(rows.where(F.length(body) >= least), source, region, language, since, id=_digest(source, *product, title, body), url=F.col(url), author=author, title=title, body=body, posted_at=at, metrics=_metrics(rating=rating))


def reviews_or_json_ld(pages: DataFrame, html: str, url: str, source: str, region: str, language: str, fetched: str | None = None, since: str | None = None) -> DataFrame:
    """A page's JSON-LD reviews where its first script of that type is sound and has a list of them; the cards of all other pages."""
    from voxfield.functions.jsonx import script_json
    from voxfield.sources.feeds import json_ld_reviews

    has = F.coalesce(F.try_variant_get(script_json(F.col(html), "application/ld+json"), "$.review", "array<variant>").isNotNull(), F.lit(False))
    rest = pages.where(~has)
    return json_ld_reviews(pages.where(has), html, url, source, region, language, since).unionByName(reviews(rest, html, url, source, region, language, fetched, since)).dropDuplicates(["id"])


def ptt(pages: DataFrame, html: str, url: str, board: str, since: str | None = None) -> DataFrame:
    """Board articles: head lines and pushes are no part of the body (10 characters or more); pushes and boos are counted by their marks."""
    # Marks of head lines, of a push and of a boo; the site's time format.
    heads, push, boo = ["作者", "標題", "時間"], "推", "噓"
    stamp = r"([A-Za-z]{3}\s+[A-Za-z]{3}\s+[0-9]{1,2}\s+[0-9]{2}:[0-9]{2}:[0-9]{2}\s+[0-9]{4})"
    wanted = {
        "title": Field(("title", ".article-metaline-right")), "meta": Field((".article-meta-value",)), "tags": Field((".push .push-tag",)),
        "body": Field(("#main-content",), lines=True, without="#main-content .article-meta-line, #main-content .article-metaline, #main-content .push"),
    }
    rows = fields(pages, url, html, wanted)
    kept = F.filter(F.split(_first("body"), "\n"), lambda x: ~(x.startswith(heads[0]) | x.startswith(heads[1]) | x.startswith(heads[2])))
    body = F.trim(F.array_join(kept, "\n"))
    raw = F.try_element_at(F.filter("meta", lambda x: F.rlike(x, F.lit(stamp))), F.lit(1))
    # the day's name isn't needed to read the time
    at = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(raw, stamp, 1), r"^[A-Za-z]+\s+([A-Za-z]+)\s+([0-9]+)\s+([0-9:]+)\s+([0-9]+)$", "$1 $2 $4 $3"), F.lit("MMM d yyyy HH:mm:ss"))
    article = F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"\.html", "")
    return _posts(
        rows.where(F.length(body) >= 10), "ptt", "TW", "zh-TW", since, id=F.concat(F.lit(f"ptt:{board}:"), article), url=F.col(url), author=_first("meta"), title=F.element_at(F.split(_first("title"), " - "), 1), body=body,
        posted_at=F.coalesce(at, F.lit(_EPOCH).cast("timestamp")), metrics=_metrics(push=F.size(F.filter("tags", lambda x: F.contains(x, F.lit(push)))), boo=F.size(F.filter("tags", lambda x: ~F.contains(x, F.lit(push)) & F.contains(x, F.lit(boo))))),
    )


def mobile01(pages: DataFrame, html: str, url: str, since: str | None = None) -> DataFrame:
    """Threads: the opening post of 10 characters or more; the id is the address's `t`."""
    wanted = {"title": Field(("h1", ".topic-title", "title")), "author": Field((".username", "[class*=author]")), "body": Field((".single-post-content", "[class*=content]"), lines=True), "replies": Field(("[class*=reply-count]", "[class*=reply]"))}
    carried = pages.withColumn("_k", F.struct(F.col(url).alias("u"), F.regexp_extract(F.col(html), r"([0-9]{4}-[0-9]{2}-[0-9]{2}\s+[0-9]{2}:[0-9]{2})", 1).alias("at")))
    rows = fields(carried, "_k", html, wanted)
    u = F.col("_k.u")
    return _posts(
        rows.where(F.length(_first("body")) >= 10), "mobile01", "TW", "zh-TW", since, id=F.concat(F.lit("mobile01:"), F.try_parse_url(u, F.lit("QUERY"), F.lit("t"))), url=u, author=_first("author"), title=_first("title"), body=_first("body"),
        posted_at=_time(F.col("_k.at"), None), metrics=_metrics(replies=_number(_first("replies"))),
    )


def five_ch(pages: DataFrame, html: str, url: str, since: str | None = None) -> DataFrame:
    """Threads: every post of 10 characters or more; times are Japan's without a zone and taken as they stand."""
    wanted = {"body": Field((".message, .escaped, dd",)), "date": Field((".date, dt",)), "author": Field((".name",))}
    # post elements; the message inside one isn't a post of its own
    rows = fields(pages, url, html, wanted, ".post, .res")
    stamp = r"(?U)([0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{4}-[0-9]{2}-[0-9]{2})\s*[\(（]?\w+[\)）]?\s*([0-9]{2}:[0-9]{2}(?::[0-9]{2})?)"
    at = F.concat_ws(" ", F.translate(F.regexp_extract(_first("date"), stamp, 1), "/", "-"), F.regexp_extract(_first("date"), stamp, 2))
    return _posts(rows.where(F.length(_first("body")) >= 10), "five_ch", "JP", "ja", since, id=_digest("five_ch", F.col(url), _first("date"), _first("body")), url=F.col(url), author=_first("author"), body=_first("body"), posted_at=_time(at, None), metrics=F.create_map().cast("map<string, bigint>"))


# For each news site the selectors of title, paragraphs, author, time and comment count, and the length a paragraph must exceed.
_NEWS = {
    "yahoo_news_jp": (("article h1", "h1", "title"), (".article_body p", ".articleBody p", "[data-component=ArticleBody] p", "article p"), (".source", "[class*=source]", "[class*=credit]"), ("time[datetime]",), (".commentCount", "[class*=CommentCount]", "[class*=comment]"), 10),
    "yahoo_news_us": (("h1", "[data-test-locator=headline]", "title"), ("article p, [data-test-locator=body] p, .caas-body p",), ("[data-test-locator=author]", ".caas-attr-item-author"), ("time[datetime]", "[data-test-locator=publish-date]"), ("[data-test-locator=comment-count]", ".comment-count"), 20),
    "yahoo_news_tw": (("h1", "[data-test-locator=headline]", "title"), ("article p, [data-test-locator=body] p, .caas-body p",), ("[data-test-locator=author]", ".caas-attr-item-author"), ("time[datetime]", "[data-test-locator=publish-date]"), ("[data-test-locator=comment-count]", ".comment-count"), 20),
}


def news(pages: DataFrame, html: str, url: str, source: str, region: str, language: str, fetched: str | None = None, since: str | None = None) -> DataFrame:
    """Articles: the paragraphs of the first selector with matches; title and body of 20 characters or more together."""
    title, body, author, time, comments, least = _NEWS[source]
    rows = fields(pages, url, html, {"title": Field(title), "body": Field(body), "author": Field(author), "time": Field(time, "datetime"), "comments": Field(comments)})
    text = _joined("body", least)
    count = _number(F.replace(_first("comments"), F.lit(","), F.lit("")))
    rows = rows.where(F.length(_first("title")) + 2 + F.length(text) >= 20)
    return _posts(rows, source, region, language, since, id=_digest(source, F.col(url)), url=F.col(url), author=_first("author"), title=_first("title"), body=text, posted_at=_time(_first("time"), fetched), metrics=_metrics(comments=count))


def quora(pages: DataFrame, html: str, url: str, region: str, language: str, since: str | None = None) -> DataFrame:
    """Question pages with their answers (of the first 20 those beyond 30 characters); challenge pages, told by their first 2,000 characters, give no row."""
    head = F.substring(html, 1, 2000)
    real = pages.where(~(F.contains(head, F.lit("Just a moment")) | F.contains(head, F.lit("challenges.cloudflare.com"))))
    wanted = {
        "title": Field(("h1", "[class*=Question] span", "title")), "question": Field(("[class*=question_text], .q-text, [class*=Question] [class*=text]",)),
        "answers": Field(("div.q-box.spacing_log_answer_content", ".q-box.qu-userSelect--text", "[class*=Answer] [class*=text]", "[class*=answer] p")),
        "author": Field(("[class*=User] span, [class*=author], a[href*=/profile/] span, .q-user",)), "time": Field(("[class*=Question] time, [class*=timestamp], [class*=date]",), "datetime"), "count": Field(("[class*=answer_count], [class*=AnswerCount]",)),
    }
    rows = fields(real, url, html, wanted).where(~_first("title").isin("", "Error", "Quora"))
    author = F.coalesce(F.try_element_at(F.filter(F.slice("author", 1, 5), lambda x: (F.length(x) > 1) & ~x.startswith("http")), F.lit(1)), F.lit(""))
    at = F.coalesce(F.try_element_at(F.filter(F.slice("time", 1, 3), lambda x: x != ""), F.lit(1)), F.lit(""))
    body = F.trim(F.concat_ws("\n\n", F.nullif(_joined("question", 10, 3), F.lit("")), F.nullif(_joined("answers", 30, 20), F.lit(""))))
    return _posts(rows, "quora", region, language, since, id=_digest("quora", F.col(url)), url=F.col(url), author=author, title=_first("title"), body=body, posted_at=_time(at, None), metrics=_metrics(answers=_number(_first("count"))))


def discuss_hk(pages: DataFrame, html: str, url: str, since: str | None = None) -> DataFrame:
    """Threads: the opening post, with the views and replies of the head. Times are Hong Kong's and become UTC; the id is the address's `tid`."""
    # The names of the two counts.
    views, replies = "瀏覽", "回覆"
    wanted = {"title": Field((".thread-subject span", "title")), "head": Field((".viewthread-number li",)), "body": Field((".postmessage-content.t_msgfont",)), "author": Field((".author-detail a.name",)), "date": Field((".postinfo .post-date",))}
    rows = fields(pages, url, html, wanted).where(F.size("body") > 0)
    stamp = F.regexp_extract(_first("date"), r"([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\s+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)", 1)
    local = F.coalesce(F.try_to_timestamp(stamp, F.lit("yyyy-M-d H:mm:ss")), F.try_to_timestamp(stamp, F.lit("yyyy-M-d H:mm")))
    count = lambda name: F.regexp_replace(F.coalesce(F.try_element_at(F.filter("head", lambda x: F.contains(x, F.lit(name))), F.lit(1)), F.lit("")), "[^0-9]", "")
    thread = F.coalesce(F.nullif(F.regexp_extract(F.col(url), "tid=([0-9]+)", 1), F.lit("")), F.regexp_extract(F.col(url), "([0-9]+)[^0-9]*$", 1))
    return _posts(
        rows, "discuss_hk", "HK", "zh-HK", since, id=F.concat(F.lit("discuss_hk:"), F.nullif(thread, F.lit(""))), url=F.col(url), author=_first("author"), title=_first("title"), body=_first("body"),
        posted_at=F.coalesce(F.to_utc_timestamp(local, "Asia/Hong_Kong"), F.lit(_EPOCH).cast("timestamp")), metrics=_metrics(views=count(views), replies=count(replies), posts=F.size("body")),
    )


_NEXT = "struct<props: struct<initialProps: struct<pageProps: struct<article: struct<articleId: string, title: string, content: struct<text: string, blocks: array<struct<text: string>>>, author: struct<nickname: string, name: string>, publishTime: string, publishedAt: string, createdAt: string, commentCount: bigint>>>>>"


def hk01(pages: DataFrame, html: str, url: str, since: str | None = None) -> DataFrame:
    """Articles: what the page's own data script says, and where it says nothing the visible title and paragraphs beyond 20 characters."""
    wanted = {
        "script": Field(("script#__NEXT_DATA__",), raw=True), "heading": Field(("h1#articleTitle", "h1[data-testid=article-title]", "h1")), "meta": Field(("meta[property=og:title]",), "content"),
        "paragraphs": Field((".article-grid__content-section p, [class*=article] p, .content p, article p",)), "by": Field(("h1#articleTitle",), "data-author"), "author": Field(("[class*=author], .author-name, [data-author]",)),
    }
    rows = fields(pages, url, html, wanted).withColumn("a", F.from_json(_first("script"), _NEXT)["props"]["initialProps"]["pageProps"]["article"])
    some = lambda *c: F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in c], F.lit(""))
    blocks = F.filter(F.transform(F.coalesce("a.content.blocks", F.array().cast("array<struct<text: string>>")), lambda b: F.trim(F.coalesce(b["text"], F.lit("")))), lambda t: t != "")
    told = F.concat_ws("\n\n", F.nullif(F.array_join(blocks, "\n\n"), F.lit("")), F.nullif(F.col("a.content.text"), F.lit("")))
    stamp = F.coalesce(F.nullif("a.publishTime", F.lit("")), F.nullif("a.publishedAt", F.lit("")), F.nullif("a.createdAt", F.lit("")))
    number = stamp.try_cast("double").cast("long")
    at = F.coalesce(F.timestamp_millis(F.when(number > 10_000_000_000, number).otherwise(number * 1000)), F.try_to_timestamp(stamp), F.lit(_EPOCH).cast("timestamp"))
    article = some(F.col("a.articleId"), F.regexp_extract(F.col(url), "/article/([0-9]+)", 1))
    out = rows.select(
        F.col(url).alias("u"), some(F.col("a.title"), _first("heading"), _first("meta")).alias("title"), some(told, _joined("paragraphs", 20)).alias("body"),
        some(F.col("a.author.nickname"), F.col("a.author.name"), _first("by"), _first("author")).alias("author"), at.alias("at"), F.coalesce("a.commentCount", F.lit(0)).alias("n"), article.alias("article"),
    )
    out = out.where((F.col("title") != "") | (F.col("body") != ""))
    key = F.when(F.col("article") != "", F.concat(F.lit("hk01:"), "article")).otherwise(_digest("hk01", F.col("u")))
    return _posts(out, "hk01", "HK", "zh-HK", since, id=key, url=F.col("u"), author=F.col("author"), title=F.col("title"), body=F.col("body"), posted_at=F.col("at"), metrics=_metrics(comments=F.col("n")))


def openrice(pages: DataFrame, html: str, url: str, fetched: str | None = None, since: str | None = None) -> DataFrame:
    """Review articles told by their text alone: the first word is the author, `Level n` the rating; after the date and the views come the title, if its
    line has fewer than 100 characters, and the body."""
    rows = fields(pages, url, html, {"lines": Field(("",), lines=True)}, "article").select(F.col(url).alias("u"), _first("lines").alias("t"))
    after = F.regexp_extract("t", r"(?s)[0-9]{4}-[0-9]{2}-[0-9]{2}\s*[0-9]+\s*views?\s*(?:Follow\s*)?(.+)", 1)
    rows = rows.withColumn("rest", F.trim(F.when(after != "", after).otherwise(F.col("t")), F.lit(" \n\t")))
    line = F.trim(F.substring_index("rest", "\n", 1))
    short = F.length(line) < 100
    title = F.when(short, line).otherwise("")
    body = F.when(short, F.trim(F.substring(F.col("rest"), F.length(F.substring_index("rest", "\n", 1)) + 2, F.lit(1 << 30)), F.lit(" \n\t"))).otherwise(F.col("rest"))
    place = F.coalesce(F.nullif(F.regexp_extract("u", "-r([0-9]+)(?:/|$)", 1), F.lit("")), F.col("u"))
    # the id takes the first 80 characters, as the site's own ids of reviews aren't on the page
    key = F.concat(F.lit("openrice_"), place, F.lit("_"), F.substring(F.sha2(F.substring(body, 1, 80).cast("binary"), 256), 1, 12))
    return _posts(
        rows.where((body != "") | (title != "")), "openrice", "HK", "zh-HK", since, id=key, url=F.col("u"), author=F.coalesce(F.nullif(F.regexp_extract("t", r"^(\S+)", 1), F.lit("")), F.lit("anonymous")), title=title, body=body,
        posted_at=_time(F.regexp_extract("t", "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), fetched), metrics=_metrics(rating=_number(F.col("t"), r"Level\s*([0-9]+)")),
    )


def count_text(s: Column) -> Column:
    """`1.7M`, `73K` or `1,234` as a whole number, cut towards zero; 0 for another form."""
    pattern = r"^\s*([0-9,.]+)([KkMmBb]?)"
    unit = F.upper(F.regexp_extract(s, pattern, 2))
    n = F.replace(F.regexp_extract(s, pattern, 1), F.lit(","), F.lit("")).try_cast("decimal(20,6)")
    return F.coalesce((n * F.when(unit == "K", 1_000).when(unit == "M", 1_000_000).when(unit == "B", 1_000_000_000).otherwise(1)).cast("long"), F.lit(0).cast("long"))


def youtube(pages: DataFrame, html: str, url: str, region: str, language: str, fetched: str, since: str | None = None) -> DataFrame:
    """Watch pages: the description, or the title where there is none. `3 years ago` is counted back from `fetched`; without a date the time is 1970."""
    from voxfield.functions.time import relative_date

    wanted = {
        "title": Field(("h1.ytd-watch-metadata", "h1 yt-formatted-string", "h1")), "meta": Field(("meta[name=title]",), "content"),
        "author": Field(("yt-formatted-string#channel-name", "#owner yt-formatted-string a", "ytd-channel-name yt-formatted-string")), "body": Field(("ytd-expander #description, yt-formatted-string#description",)),
        "comments": Field(("ytd-comments-header-renderer .count-text span, yt-formatted-string.count-text",)), "info": Field(("ytd-watch-info-text span", "yt-formatted-string#info span, .view-count")),
    }
    rows = fields(pages, url, html, wanted)
    title = F.coalesce(F.nullif(_first("title"), F.lit("")), _first("meta"))
    views = count_text(F.regexp_extract(_first("info"), r"(?i)([0-9,.]+[KMB]?)\s*(?:views|次)", 1))
    at = F.coalesce(relative_date(F.coalesce(F.try_element_at(F.col("info"), F.lit(3)), F.lit("")), F.lit(fetched).cast("timestamp")), F.lit(_EPOCH).cast("timestamp"))
    video = F.regexp_extract(F.col(url), "v=([a-zA-Z0-9_-]{11})", 1)
    return _posts(
        rows.where((title != "") & (_first("author") != "")), "youtube_html", region, language, since, id=F.when(video != "", F.concat(F.lit("youtube_html:"), video)).otherwise(_digest("youtube_html", F.col(url))), url=F.col(url), author=_first("author"), title=title,
        body=F.coalesce(F.nullif(_first("body"), F.lit("")), title), posted_at=at, metrics=_metrics(views=views, comment_count=count_text(F.regexp_extract(_first("comments"), "([0-9,]+)", 1))),
    )


_PLAY = "array<struct<reviewId: string, userName: string, content: string, score: bigint, thumbsUpCount: bigint, replyContent: string, at: string>>"


def google_play(replies: DataFrame, column: str, app: str, country: str, language: str, fetched: str | None = None, since: str | None = None) -> DataFrame:
    """Store reviews as a JSON array. The title is the first sentence if it has fewer than 100 characters; the developer's reply follows the body.
    The source carries the country."""
    r = lambda name: F.col("r")[name]
    rows = replies.select(F.explode(F.from_json(column, _PLAY)).alias("r")).where("r.reviewId is not null and r.reviewId <> ''")
    content = F.coalesce(r("content"), F.lit(""))
    first = F.trim(F.substring_index(content, "。", 1))
    reply = F.when(F.coalesce(r("replyContent"), F.lit("")) != "", F.concat(F.lit("\n\n[Developer Reply]\n"), r("replyContent"))).otherwise("")
    return _posts(
        rows, f"google_play_{country}", country.upper(), language, since, id=F.concat(F.lit("gp_"), r("reviewId")), url=F.lit(f"https://play.google.com/store/apps/details?id={app}"), author=F.coalesce(F.nullif(r("userName"), F.lit("")), F.lit("anonymous")),
        title=F.when(F.length(first) < 100, first), body=F.concat(content, reply), posted_at=_time(r("at"), fetched), metrics=_metrics(rating=r("score"), thumbs_up=r("thumbsUpCount")),
    )
