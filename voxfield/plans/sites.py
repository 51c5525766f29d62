"""Queries of the site parsers: pages are written from the documents, with the markup each site has, and read back."""

from pyspark.sql import functions as F

from voxfield.plans.catalog import query, table
from voxfield.sources import listings, sites

_BODY = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_NL = "chr(10) || chr(10)"


def _docs(spark, sf_dir):
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", escaped.alias("t"), F.length("text").alias("n"))


def _html(*parts):
    """Strings are markup; columns are taken as they are."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pages(rows, card, per=20, head="<html><head><title>all</title></head><body><h1>all</h1>", url="https://site.example/page/"):
    """Pages of the cards of `per` ids each."""
    groups = rows.groupBy(F.floor(F.col("doc_id") / per).alias("page")).agg(F.array_sort(F.collect_list(F.struct("doc_id", card.alias("c")))).alias("x"))
    return groups.select(_html(url, F.col("page")).alias("u"), _html(head, F.array_join(F.transform("x", lambda y: y["c"]), ""), "</body></html>").alias("h"))


# Markup of a card of each review site: what stands before the body, between body and rating, and after it.
_CARDS = {
    "yelp_html": ('<li class="review-x"><p class="comment_1" lang="en">', '</p><div class="star-rating" aria-label="', ' star rating"></div><br><time datetime="2024-02-03">then</time></li>'),
    "cosme": ('<div class="review-item"><p class="review-text">', '</p><span class="rating"><img alt="', '"></span><i class="reviewer">r</i></div>'),
    "tabelog": ('<div class="rvw-item"><p class="rvw-item__comment">', '</p><b class="rvw-item__rating">', "</b></div>"),
    "yahoo_japan_reviews": ('<div class="review-item"><p class="reviewText">', '</p><b class="star">', "</b></div>"),
    "trustpilot": ('<article><h2>h</h2><p class="review-body">', '</p><img alt="', ' stars of 5"></article>'),
}
_SITES = [("yelp_html", "US", "en", 10), ("cosme", "JP", "ja", 20), ("tabelog", "JP", "ja", 20), ("yahoo_japan_reviews", "JP", "ja", 10), ("trustpilot", "US", "en", 1)]


def _review_query(source, region, language, least):
    title, product = ("h" if source == "trustpilot" else ""), ("'' || " + _NL + " || " if source == "yahoo_japan_reviews" else "")
    # yahoo_japan_reviews: the address has no product, so its part of the key is empty
    rating = "CASE length(text) % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 4 END" if source == "tabelog" else "length(text) % 5 + 1"
    at = "TIMESTAMP '2024-02-03 00:00:00'" if source == "yelp_html" else "TIMESTAMP '2024-05-06 07:08:09'"
    sql = f"SELECT DISTINCT '{source}:' || substr(sha256({product}'{title}' || {_NL} || body), 1, 16) AS id, body, rating::BIGINT AS rating, '{region}' AS region, {at} AS posted_at FROM (SELECT {_BODY} AS body, min({rating}) AS rating FROM documents GROUP BY 1) WHERE length(body) >= {least}"

    @query(f"site_{source}", sql)
    def run(spark, sf_dir):
        first, second, third = _CARDS[source]
        n = F.col("n")
        # 2.5, 2.9, 3.5 and 4.4 show rounding half to even
        mark = F.element_at(F.array(*map(F.lit, ["2.5", "2.9", "3.5", "4.4"])), (n % 4 + 1).cast("int")) if source == "tabelog" else n % 5 + 1
        pages = _pages(_docs(spark, sf_dir), _html(first, F.col("t"), second, mark, third))
        posts = sites.reviews(pages, "h", "u", source, region, language, fetched="2024-05-06 07:08:09")
        return posts.groupBy("id", "body", "region", F.col("posted_at").cast("timestamp_ntz").alias("posted_at")).agg(F.min(F.col("metrics")["rating"]).alias("rating"))

    return run


for _site in _SITES:
    _review_query(*_site)


@query(
    "site_trustpilot_mixed",
    f"SELECT substr(sha256('https://site.example/page/' || doc_id || '|' || source || '|2024-01-02|' || text), 1, 16) AS id, text AS body, 5::BIGINT AS rating FROM documents WHERE doc_id % 2 = 0"
    f" UNION ALL SELECT DISTINCT 'trustpilot:' || substr(sha256('h' || {_NL} || {_BODY}), 1, 16), {_BODY}, 3::BIGINT FROM documents WHERE doc_id % 2 = 1 AND length({_BODY}) >= 1",
)
def site_trustpilot_mixed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    review = F.struct(F.lit("h").alias("headline"), F.col("text").alias("reviewBody"), F.lit("2024-01-02").alias("datePublished"), F.struct(F.col("source").alias("name")).alias("author"), F.struct(F.lit("5").alias("ratingValue")).alias("reviewRating"))
    ld = docs.where("doc_id % 2 = 0").select(_html("https://site.example/page/", F.col("doc_id")).alias("u"), _html('<script type="application/ld+json">', F.to_json(F.struct(F.array(review).alias("review"))), "</script>").alias("h"))
    first, second, third = _CARDS["trustpilot"]
    cards = _pages(_docs(spark, sf_dir).where("doc_id % 2 = 1"), _html(first, F.col("t"), second, F.lit(3), third), per=40)
    posts = sites.reviews_or_json_ld(ld.unionByName(cards), "h", "u", "trustpilot", "US", "en")
    return posts.select("id", "body", F.col("metrics")["rating"].alias("rating"))


@query("site_ptt", f"SELECT 'ptt:board:M.' || doc_id AS id, lang || ' title' AS title, source AS author, {_BODY} AS body, TIMESTAMP '2024-02-03 04:05:06' AS posted_at, doc_id % 4 AS push, doc_id % 3 AS boo FROM documents WHERE length({_BODY}) >= 10")
def site_ptt(spark, sf_dir):
    d = F.col("doc_id")
    line = lambda name, value: ('<div class="article-metaline"><span class="article-meta-tag">' + name + '</span><span class="article-meta-value">', value, "</span></div>")
    mark = lambda text, n: F.repeat(F.lit(f'<div class="push"><span class="push-tag">{text} </span><span>said</span></div>'), n.cast("int"))
    page = _html("<html><head><title>", F.col("lang"), ' title - board</title></head><body><div id="main-content">', *line("作者", F.col("source")), *line("時間", F.lit("Sat Feb  3 04:05:06 2024")), F.col("t"), mark("推", d % 4), mark("噓", d % 3), "</div></body></html>")
    pages = _docs(spark, sf_dir).select(_html("https://site.example/bbs/board/M.", d, ".html").alias("u"), page.alias("h"))
    posts = sites.ptt(pages, "h", "u", "board")
    return posts.select("id", "title", "author", "body", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), F.col("metrics")["push"].alias("push"), F.col("metrics")["boo"].alias("boo"))


@query("site_mobile01", f"SELECT 'mobile01:' || doc_id AS id, lang AS title, source AS author, {_BODY} AS body, TIMESTAMP '2024-02-03 04:05:00' AS posted_at, doc_id AS replies FROM documents WHERE length({_BODY}) >= 10")
def site_mobile01(spark, sf_dir):
    page = _html("<h1>", F.col("lang"), '</h1><a class="username">', F.col("source"), '</a><span>2024-02-03 04:05</span><div class="single-post-content">', F.col("t"), '</div><i class="reply-count">', F.col("doc_id"), " replies</i>")
    posts = sites.mobile01(_docs(spark, sf_dir).select(_html("https://site.example/topicdetail.php?f=1&t=", F.col("doc_id")).alias("u"), page.alias("h")), "h", "u")
    return posts.select("id", "title", "author", "body", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), F.col("metrics")["replies"].alias("replies"))


@query("site_five_ch", f"SELECT DISTINCT 'five_ch:' || substr(sha256('https://site.example/page/' || doc_id // 20 || {_NL} || '2024/02/03(土) 04:05:06' || {_NL} || {_BODY}), 1, 16) AS id, {_BODY} AS body, TIMESTAMP '2024-02-03 04:05:06' AS posted_at FROM documents WHERE length({_BODY}) >= 10")
def site_five_ch(spark, sf_dir):
    card = _html('<div class="post"><b class="name">x</b><span class="date">2024/02/03(土) 04:05:06</span><div class="message">', F.col("t"), "</div></div>")
    return sites.five_ch(_pages(_docs(spark, sf_dir), card), "h", "u").select("id", "body", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


def _news_query(source, region, language, least, body_open, extra):
    key = f"'{source}:' || substr(sha256('https://site.example/news/' || doc_id), 1, 16)"
    body = f"CASE WHEN length({_BODY}) > {least} THEN {_BODY} ELSE '' END"
    sql = f"SELECT {key} AS id, source || ' news' AS title, {body} AS body, TIMESTAMP '2024-02-03 04:05:06' AS posted_at, 1200 + doc_id % 100 AS comments FROM documents WHERE length(source || ' news') + 2 + length({body}) >= 20"

    @query(f"site_{source}", sql)
    def run(spark, sf_dir):
        d = F.col("doc_id")
        page = _html("<html><title>no</title><article><h1>", F.col("source"), f' news</h1><time datetime="2024-02-03T04:05:06Z">t</time>{body_open}<p>', F.col("t"), "</p><p>short</p></div></article>", extra[0], F.format_string(extra[1], d % 100), "</b></html>")
        posts = sites.news(_docs(spark, sf_dir).select(_html("https://site.example/news/", d).alias("u"), page.alias("h")), "h", "u", source, region, language)
        return posts.select("id", "title", "body", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), F.col("metrics")["comments"].alias("comments"))

    return run


_news_query("yahoo_news_jp", "JP", "ja", 10, '<div class="article_body">', ('<b class="commentCount">', "1,2%02d"))
_news_query("yahoo_news_us", "US", "en", 20, '<div class="caas-body">', ('<b class="comment-count">', "12%02d"))
_news_query("yahoo_news_tw", "TW", "zh-TW", 20, '<div data-test-locator="body">', ('<b data-test-locator="comment-count">', "12%02d"))


@query("site_quora", f"SELECT 'quora:' || substr(sha256('https://site.example/q/' || doc_id), 1, 16) AS id, lang || '?' AS title, source AS author, CASE WHEN length({_BODY}) > 30 THEN {_BODY} || {_NL} || {_BODY} ELSE '' END AS body, doc_id % 7 AS answers FROM documents WHERE doc_id % 5 <> 0")
def site_quora(spark, sf_dir):
    """Every fifth page is a challenge; its documents stay away because the parser must refuse it."""
    d, answer = F.col("doc_id"), ('<div class="q-box spacing_log_answer_content">', F.col("t"), "</div>")
    page = _html(F.when(d % 5 == 0, "<title>Just a moment...</title>").otherwise("<title>Quora</title>"), "<h1>", F.col("lang"), '?</h1><a class="User"><span>', F.col("source"), "</span></a>", *answer, *answer, '<b class="answer_count">', d % 7, " answers</b>")
    posts = sites.quora(_docs(spark, sf_dir).select(_html("https://site.example/q/", d).alias("u"), page.alias("h")), "h", "u", "HK", "en")
    return posts.select("id", "title", "author", "body", F.col("metrics")["answers"].alias("answers"))


@query(
    "site_youtube",
    f"SELECT 'youtube_html:' || lpad(doc_id::VARCHAR, 11, '0') AS id, lang || ' video' AS title, CASE WHEN {_BODY} = '' THEN lang || ' video' ELSE {_BODY} END AS body, TIMESTAMP '2024-05-06 00:00:00' - to_days((doc_id % 9 + 1)::INTEGER * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 30 ELSE 365 END::INTEGER) AS posted_at, CASE doc_id % 3 WHEN 0 THEN 1234 WHEN 1 THEN 73000 ELSE 1700000 END::BIGINT AS views, 12345::BIGINT AS comments FROM documents",
)
def site_youtube(spark, sf_dir):
    d = F.col("doc_id")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (d % 3 + 1).cast("int"))
    page = _html(
        "<h1>", F.col("lang"), ' video</h1><div id="owner"><yt-formatted-string><a>ch</a></yt-formatted-string></div><ytd-watch-info-text><span>', pick("1,234", "73K", "1.7M"), " views</span><span>.</span><span>", d % 9 + 1,
        pick(" days ago", " months ago", " years ago"), '</span></ytd-watch-info-text><ytd-expander><div id="description">', F.col("t"), '</div></ytd-expander><yt-formatted-string class="count-text">12,345 Comments</yt-formatted-string>',
    )
    posts = sites.youtube(_docs(spark, sf_dir).select(_html("https://site.example/watch?v=", F.lpad(d.cast("string"), 11, "0")).alias("u"), page.alias("h")), "h", "u", "HK", "zh-HK", "2024-05-06 00:00:00")
    return posts.select("id", "title", "body", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), F.col("metrics")["views"].alias("views"), F.col("metrics")["comment_count"].alias("comments"))


@query(
    "feed_google_play",
    "SELECT 'gp_' || doc_id AS id, CASE WHEN length(trim(split_part(text, '。', 1))) < 100 THEN trim(split_part(text, '。', 1)) ELSE '' END AS title, text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '[Developer Reply]' || chr(10) || source ELSE '' END AS body, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 600) AS posted_at, doc_id % 5 + 1 AS rating, n_chars::BIGINT AS thumbs_up, 'google_play_jp' AS source FROM documents",
)
def feed_google_play(spark, sf_dir):
    at = F.date_format(F.timestamp_seconds(F.col("doc_id") * 600 + 1704067200), "yyyy-MM-dd HH:mm:ss")
    review = F.struct(F.col("doc_id").cast("string").alias("reviewId"), F.lit("").alias("userName"), F.col("text").alias("content"), (F.col("doc_id") % 5 + 1).alias("score"), F.col("n_chars").alias("thumbsUpCount"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("replyContent"), at.alias("at"))
    pages = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 100).alias("page")).agg(F.to_json(F.collect_list(review)).alias("reply"))
    posts = sites.google_play(pages, "reply", "app", "jp", "ja")
    return posts.select("id", "title", "body", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), F.col("metrics")["rating"].alias("rating"), F.col("metrics")["thumbs_up"].alias("thumbs_up"), "source")


@query("site_discuss_hk", f"SELECT 'discuss_hk:' || doc_id AS id, lang AS title, source AS author, {_BODY} AS body, TIMESTAMP '2024-02-02 20:05:00' AS posted_at, 12000 + doc_id % 100 AS views, doc_id AS replies, 2::BIGINT AS posts FROM documents")
def site_discuss_hk(spark, sf_dir):
    d = F.col("doc_id")
    page = _html(
        '<h1 class="thread-subject"><span>', F.col("lang"), '</span></h1><ul class="viewthread-number"><li>瀏覽: 12,', F.format_string("%03d", d % 100), "</li><li>回覆: ", d, '</li></ul><div class="author-detail"><a class="name">', F.col("source"),
        '</a></div><div class="postinfo"><span class="post-date">#1 發表於 2024-2-3 4:05</span></div><div class="postmessage-content t_msgfont">', F.col("t"), '</div><div class="postmessage-content t_msgfont">reply</div>',
    )
    posts = sites.discuss_hk(_docs(spark, sf_dir).select(_html("https://site.example/viewthread.php?tid=", d).alias("u"), page.alias("h")), "h", "u")
    return posts.select("id", "title", "author", "body", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), *[F.col("metrics")[m].alias(m) for m in ("views", "replies", "posts")])


_SQUARE = r"regexp_replace(text, '^ +| +$', '', 'g')"


@query("site_hk01", f"SELECT 'hk01:' || (1000000 + doc_id) AS id, source AS title, CASE WHEN doc_id % 3 > 0 THEN {_SQUARE} WHEN length({_BODY}) > 20 THEN {_BODY} ELSE '' END AS body, CASE doc_id % 3 WHEN 0 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS posted_at, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 50 END AS comments FROM documents")
def site_hk01(spark, sf_dir):
    """Every third page has no data script; the times of the others are seconds or milliseconds."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").join(_docs(spark, sf_dir).select("doc_id", "t"), "doc_id")
    article = F.struct(F.col("source").alias("title"), F.struct(F.array(F.struct(F.col("text").alias("text")), F.struct(F.lit(" ").alias("text"))).alias("blocks")).alias("content"), F.when(d % 3 == 1, 1704067200).otherwise(1704067200000).alias("publishTime"), (d % 50).alias("commentCount"))
    data = F.replace(F.to_json(F.struct(F.struct(F.struct(F.struct(article.alias("article")).alias("pageProps")).alias("initialProps")).alias("props"))), F.lit("</"), F.lit("<\\/"))
    script = F.when(d % 3 == 0, "").otherwise(_html('<script id="__NEXT_DATA__" type="application/json">', data, "</script>"))
    page = _html("<head>", script, '</head><body><h1 id="articleTitle" data-author="x">', F.col("source"), "</h1><article><p>", F.when(d % 3 == 0, F.col("t")).otherwise("seen"), "</p></article></body>")
    posts = sites.hk01(docs.select(_html("https://site.example/article/", d + 1000000).alias("u"), page.alias("h")), "h", "u")
    return posts.select("id", "title", "body", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), F.col("metrics")["comments"].alias("comments"))


_TB = r"regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^[ \n\t]+|[ \n\t]+$', '', 'g')"


@query("site_openrice", f"SELECT 'openrice_' || doc_id || '_' || substr(sha256(substr({_TB}, 1, 80)), 1, 12) AS id, lang || ' place' AS title, {_TB} AS body, source AS author, TIMESTAMP '2024-02-03 00:00:00' AS posted_at, doc_id % 6 AS rating FROM documents")
def site_openrice(spark, sf_dir):
    d = F.col("doc_id")
    page = _html("<article><b>", F.col("source"), "</b><i>Level ", d % 6, "</i><i>2024-02-03</i><i>12 views</i><i>Follow</i><h3>", F.col("lang"), " place</h3><p>", F.col("t"), "</p></article>")
    posts = sites.openrice(_docs(spark, sf_dir).select(_html("https://site.example/hk/r-x-r", d).alias("u"), page.alias("h")), "h", "u")
    return posts.select("id", "title", "body", "author", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), F.col("metrics")["rating"].alias("rating"))


_LINKS = {
    "ptt": ('<div class="title"><a href="/bbs/b/M.{}.html">t</a><a href="/other">o</a></div>', "https://www.ptt.cc/bbs/b/M.{}.html"),
    "tabelog": ('<a href="https://tabelog.com/rst/{}?x=1">r</a><a href="/rst/{}/rvwPart">v</a><a href="rst/{}">no</a>', "https://tabelog.com/rst/{}"),
    "yelp_html": ('<a href="/biz/p{}">b</a><a href="/biz/p{}?q=1">again</a>', "https://www.yelp.com/biz/p{}"),
    "trustpilot": ('<a href="/x{}/review/a?p=1">r</a><a href="/x{}/review/b">r</a>', "https://www.trustpilot.com/x{}"),
}


def _list_query(source):
    markup, want = (x.split("{}") for x in _LINKS[source])
    url = f"'{want[0]}' || doc_id || '{want[1]}'"

    @query(f"list_{source}", f"SELECT doc_id // 20 AS page, (row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) - 1)::INTEGER AS pos, {url} AS url FROM documents")
    def run(spark, sf_dir):
        card = markup[:1]
        for piece in markup[1:]:
            card += [F.col("doc_id"), piece]
        rows = _pages(_docs(spark, sf_dir), _html(*card), url="")
        return listings.result_links(rows.select(F.col("u").cast("bigint").alias("page"), "h"), "page", "h", source)


for _source in _LINKS:
    _list_query(_source)


@query(
    "site_lihkg",
    "SELECT 'lihkg_' || doc_id AS id, 'thread ' || source || ' of ' || lang AS title, 'u' || doc_id % 9 AS author, TIMESTAMP '2024-02-03 04:05:00' AS posted_at, doc_id % 50 AS replies, doc_id % 7 AS likes FROM documents WHERE lang = 'en'",
)
def site_lihkg(spark, sf_dir):
    """The first list, of threads on another topic, gives nothing, so the second one is read."""
    d = F.col("doc_id")
    card = _html('<div><a href="/thread/', d, '/page/1">[tag] thread ', F.col("source"), " of ", F.col("lang"), " [", d % 50, ']</a><span>u', d % 9, " · 2024-02-03 04:05 · ", d % 7, ' likes</span><a href="/thread/', d, '/page/3">3</a></div>')
    pages = _pages(_docs(spark, sf_dir), card)
    hot, latest = (listings.lihkg(pages, "h", topic, "2024-05-06 00:00:00") for topic in ("of nothing", "OF EN"))
    posts = listings.first_or(hot, latest)
    return posts.select("id", "title", "author", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), F.col("metrics")["reply_count"].alias("replies"), F.col("metrics")["likes"].alias("likes"))
