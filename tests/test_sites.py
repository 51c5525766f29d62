"""Selectors and site parsers on small pages with damage."""

import pytest
from pyspark.sql import functions as F

from voxfield.sources import sites
from voxfield.sources.select import Field, fields, find, take, text_of, tree


def test_selectors():
    root = tree('<div id="a" class="x y"><p class="t-1">one<br>two</p><p>three</div><p class="y">four<script>no()</script></p><img alt="5 stars"/>')
    text = lambda s: [text_of(n) for n in find(root, s)]
    assert text("p") == ["onetwo", "three", "four"]
    assert text("#a p") == ["onetwo", "three"] and text(".x .t-1") == ["onetwo"] and text("div.y p[class]") == ["onetwo"]
    assert text("[class*='y'], p") == ["onetwothree", "onetwo", "three", "four"]
    assert text("p p") == [] and find(root, "[id=b]") == []
    assert take(root, Field(("b", "img[alt*=star]"), "alt")) == ["5 stars"]
    assert take(root, Field(("#a",), lines=True, without="#a .t-1")) == ["three"]
    with pytest.raises(ValueError):
        find(root, "p, >")


def test_an_unclosed_element_ends_with_the_one_around_it():
    root = tree("<ul><li><b>x<i>y</ul></p><p>z")
    assert [text_of(n) for n in find(root, "li")] == ["xy"] and [text_of(n) for n in find(root, "p")] == ["z"]


def test_deep_pages_do_not_recurse():
    assert text_of(find(tree("<div>" * 20_000 + "x" + "</div>" * 20_000), "div div div")[0]) == "x"


def test_fields_of_null_empty_and_repeated_pages(spark):
    pages = spark.createDataFrame([("a", None, 1), ("b", "", 2), ("c", "<p>1</p><p>2</p>", 3), ("c", "<p>1</p>", 4)], "u string, h string, pos int")
    rows = {(r.u, r.pos, tuple(r.p)) for r in fields(pages, "u", "h", {"p": Field(("p",))}).collect()}
    assert rows == {("a", 0, ()), ("b", 0, ()), ("c", 0, ("1", "2")), ("c", 0, ("1",))}
    cards = fields(pages, "u", "h", {"p": Field(("b",))}, "p").collect()
    assert sorted((r.u, r.pos, len(r.p)) for r in cards) == [("c", 0, 0), ("c", 0, 0), ("c", 1, 0)]


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "u string, h string")
    assert sites.reviews(pages, "h", "u", "cosme", "JP", "ja").count() == 0
    assert sites.news(pages, "h", "u", "yahoo_news_us", "US", "en").count() == 0
    assert sites.ptt(pages, "h", "u", "b").count() == 0 and sites.mobile01(pages, "h", "u").count() == 0


def test_short_bodies_and_bad_times(spark):
    page = '<div class="review-x"><p lang="en">{}</p><time datetime="{}"></time></div>'
    pages = spark.createDataFrame([("a", page.format("too short"[:9], "2024-01-01")), ("b", page.format("long enough", "yesterday")), ("c", page.format("long enough too", "2024-01-05T01:02:03Z"))], "u string, h string")
    rows = {r.url: str(r.posted_at) for r in sites.reviews(pages, "h", "u", "yelp_html", "US", "en", fetched="2024-03-01").collect()}
    assert rows == {"b": "2024-03-01 00:00:00", "c": "2024-01-05 01:02:03"}
    assert [r.url for r in sites.reviews(pages, "h", "u", "yelp_html", "US", "en", fetched="2024-03-01", since="2024-02-01").collect()] == ["b"]


def test_counts(spark):
    rows = spark.createDataFrame([("1.7M",), ("73K",), ("1,234",), ("2b",), ("none",), (None,)], "s string")
    assert [r[0] for r in rows.select(sites.count_text(rows.s)).collect()] == [1_700_000, 73_000, 1234, 2_000_000_000, 0, 0]


def test_reviews_fall_back_by_the_parsed_script(spark):
    """Cards count unless the first JSON-LD script is sound and lists reviews: an organisation's script, a broken one and one without reviews all fall back."""
    from voxfield.sources import sites

    card = '<article><h2>t</h2><p class="review-body">card {}</p></article>'
    org, review = '{"@type": "Organization", "name": "n"}', '{"review": [{"headline": "h", "reviewBody": "ld %d", "datePublished": "2024-01-02", "author": {"name": "a"}}]}'
    script = '<script type="application/ld+json">{}</script>'.format
    pages = [
        (1, card.format(1)), (2, script(org) + card.format(2)), (3, script(review % 3) + card.format(3)), (4, script(org) + script(review % 4) + card.format(4)),
        (5, script('{"review": [{"reviewBody": "broken"') + card.format(5)), (6, script('"reviewBody"') + card.format(6)), (7, script('{"review": []}') + card.format(7)), (8, None),
    ]
    df = spark.createDataFrame([(f"u{k}", h) for k, h in pages], "u string, h string")
    got = {(r["url"], r["body"]) for r in sites.reviews_or_json_ld(df, "h", "u", "trustpilot", "US", "en").collect()}
    assert got == {("u1", "card 1"), ("u2", "card 2"), ("u3", "ld 3"), ("u4", "card 4"), ("u5", "card 5"), ("u6", "card 6")}


def test_one_row_of_an_id_stays_whatever_the_order(spark):
    from voxfield.sources import feeds

    rows = [('{"data": {"children": [{"kind": "t3", "data": {"id": "a", "title": "%s", "created_utc": 1700000000.0, "score": %d}}]}}' % (t, k),) for k, t in enumerate("cab")]
    got = [feeds.reddit(spark.createDataFrame(x, "r string"), "r", "US").collect() for x in (rows, rows[::-1])]
    assert [[r["title"] for r in g] for g in got] == [["a"], ["a"]]


def test_result_lists(spark):
    """Relative, absolute and protocol-less links, each once in page order; links of another kind, and pages without any, give nothing."""
    from voxfield.sources.listings import result_links

    pages = {
        "ptt": ('<div class="title"><a href="/bbs/a/M.1.html">x</a></div><a href="/bbs/a/M.2.html">outside</a><div class="title"><a href="/man/x">m</a></div>', ["https://www.ptt.cc/bbs/a/M.1.html"]),
        "mobile01": ('<a href="topicdetail.php?f=1&t=2">x</a><a href="//m.mobile01.com/topicdetail.php?t=3">y</a><a href="topicdetail.php?f=1&t=2">again</a>', ["https://www.mobile01.com/topicdetail.php?f=1&t=2", "https://m.mobile01.com/topicdetail.php?t=3"]),
        "cosme": ('<a href="/products/1/">x</a><a href="/brands/2">y</a>', ["https://www.cosme.net/products/1/"]),
        "tabelog": ('<a href="/rst/1?x=2">x</a><a href="/rst/1">y</a><a href="/rst/rvwPart/3">z</a>', ["https://tabelog.com/rst/1"]),
        "yelp_html": ('<a href="/biz/a">x</a><a href="/biz/b?q">y</a><a href="https://www.yelp.com/biz/c">z</a>', ["https://www.yelp.com/biz/a", "https://www.yelp.com/biz/c"]),
        "five_ch": ('<a href="/test/read.cgi/a/1/">x</a>', ["https://itest.5ch.net/test/read.cgi/a/1/"]),
        "trustpilot": ('<a href="/review/n?p=2">x</a><a href="/z/review/n">y</a>', ["https://www.trustpilot.com", "https://www.trustpilot.com/z"][1:]),
    }
    for source, (page, want) in pages.items():
        rows = result_links(spark.createDataFrame([(1, page), (2, None), (3, "")], "k int, h string"), "k", "h", source).collect()
        got = [r["url"] for r in sorted(rows, key=lambda r: r["pos"]) if r["k"] == 1 and r["url"].rstrip("/") != "https://www.trustpilot.com"]
        assert got == want and {r["k"] for r in rows} == {1}, source


def test_lihkg_list(spark):
    from voxfield.sources.listings import lihkg

    page = (
        '<div>far<div><a href="/thread/7/page/1">[HK] Tea time [12]</a> ann · 2026-01-02 03:04 · 5 likes</div></div><div><a href="/thread/7/page/1">Tea again</a></div>'
        '<div><a href="/thread/8/page/1">TEA</a> bob · 2026-01-02 · 9 replies</div><div><a href="/thread/9/page/1">coffee</a></div><a href="/thread/10/page/1">bare tea</a><a href="/about/tea">tea</a>'
    )
    got = {r["id"]: r for r in lihkg(spark.createDataFrame([(page,), (None,)], "h string"), "h", "tea", "2026-02-01 00:00:00").collect()}
    said = {k: (r["title"], r["author"], str(r["posted_at"]), r["metrics"]["reply_count"], r["metrics"]["likes"]) for k, r in got.items()}
    assert said["lihkg_8"] == ("TEA", "bob", "2026-02-01 00:00:00", 9, 0) and said["lihkg_10"] == ("bare tea", "anonymous", "2026-02-01 00:00:00", 0, 0)
    assert said["lihkg_7"] == ("Tea time", "ann", "2026-01-02 03:04:00", 12, 5) and len(said) == 3


def test_the_second_branch_is_left_out(spark, tmp_path):
    """With rows in the first branch the second one isn't read: its reader would fail."""
    from voxfield.sources.listings import first_or

    schema = "x bigint"
    spark.range(3).withColumnRenamed("id", "x").write.parquet(str(tmp_path / "one"))
    one = spark.read.schema(schema).parquet(str(tmp_path / "one"))
    fails = one.select(F.when(F.col("x") >= 0, F.raise_error(F.lit("was read"))).otherwise(F.col("x")).cast("bigint").alias("x"))
    assert sorted(r["x"] for r in first_or(one, fails).collect()) == [0, 1, 2]
    assert sorted(r["x"] for r in first_or(one.where("x > 9"), one.where("x > 0")).collect()) == [1, 2]
    assert first_or(one.where("x > 9"), one.where("x > 9")).count() == 0


def test_pages_are_held_one_at_a_time(spark):
    """The tree of a page goes when its fields are taken, without waiting for the collector; batches of pages are short."""
    import gc
    import tracemalloc

    from voxfield.sources import select

    page = "".join(f"<div class=c><p>{k} " + "x" * 80 + "</p></div>" for k in range(1000))
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        for _ in range(20):
            for card in select._parts(page, ".c"):
                assert len(select.take(card, select.Field(("p",)))) == 1
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        gc.enable()
    assert peak < 5_000_000  # a tree is about 1 MB
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    out = select.fields(spark.createDataFrame([(1, page), (2, None)], "k int, h string"), "k", "h", {"p": select.Field(("p",))})
    assert int(spark.conf.get(key)) <= 1000 and sorted((r.k, len(r.p)) for r in out.collect()) == [(1, 1000), (2, 0)]
