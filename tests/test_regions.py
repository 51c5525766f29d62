"""The region dimension, and the coverage block of evidence."""

import json

from tests.test_operators import shuffled
from voxfield.operators import evidence, relations, textrank
from voxfield.sources import regions as G


def test_defaults_run_by_category_and_priority(spark):
    dim = G.regions(spark)
    rows = G.default_sources(dim).orderBy("region", "run").collect()
    runs = {r: [x.source for x in rows if x.region == r] for r in ("HK", "US", "JP")}
    assert runs["HK"] == ["lihkg", "discuss_hk", "reddit_old", "baby_kingdom", "app_store_hk", "hk_lifestyle_blogs", "yahoo_news_hk"]
    assert runs["US"] == ["reddit_old", "app_store_us", "yahoo_news_us"]
    assert runs["JP"] == ["five_ch", "yahoo_japan_reviews", "cosme", "app_store_jp", "yahoo_news_jp"]
    assert not [x for x in rows if x.stance == "prohibited" or x.excluded]


def test_the_listing_keeps_its_rules(spark):
    dim = G.regions(spark)
    assert G.violations(dim).count() == 0 and dim.count() == len(G.parse()) == 104
    assert dim.select("region", "source").distinct().count() == 104
    us = {r.region: r for r in G.listing(dim).collect()}["US"]
    assert (us.sources, us.enabled, us.opt_in, us.excluded, us.categories, us.languages) == (11, 3, 6, 2, "forums,news_comments,reviews", "en")
    reviews = G.by_category(dim, include_opt_in=True).where("region = 'US' and category = 'reviews'").orderBy("rank")
    assert [r.source for r in reviews.collect()] == ["trustpilot", "yelp_html", "app_store_us", "google_play_us"]
    assert G.by_category(dim).where("category = 'social'").count() == 0
    assert G.by_category(dim, include_excluded=True, include_opt_in=True).count() == 104


def test_violations_are_named(spark):
    rows = [("R", "", [], 0, "a", "forums", 1, 0, 3, "prohibited", True, False), ("R", "", [], 1, "a", "odd", 1, 5, 6, "maybe", False, False), ("R", "", [], 2, "b", None, 1, None, 1, None, False, False), ("S", "", [], 0, "a", "qa", 1, 1, 5, "silent", True, True)]
    got = {tuple(r) for r in G.violations(spark.createDataFrame(rows, G.SCHEMA)).collect()}
    assert got == {
        ("R", "a", "prohibited but runs by default"), ("R", "a", "persona_value outside 1 to 5"), ("R", "a", "unknown category"), ("R", "a", "unknown stance"), ("R", "a", "journey_value outside 1 to 5"), ("R", "a", "listed before"),
        ("R", "b", "unknown category"), ("R", "b", "unknown stance"), ("R", "b", "persona_value outside 1 to 5"),
    }


def test_a_listing_is_read_from_json(spark, tmp_path):
    one = {"region_id": "XX", "display_name": "X", "primary_languages": ["xx"], "sources": [{"source_id": "s", "category": "qa", "priority": 1, "persona_value": 2, "journey_value": 3}, {"source_id": "t", "category": "qa", "priority": 1, "persona_value": 2, "journey_value": 3, "tos_scraping_stance": "prohibited", "default_enabled": False}]}
    (tmp_path / "x.json").write_text(json.dumps(one, indent=1))
    dim = G.read_regions(spark, str(tmp_path))
    assert sorted(dim.columns) == sorted(G.regions(spark).columns)
    assert [(r.place, r.source, r.stance, r.default_enabled, r.excluded) for r in dim.orderBy("place").collect()] == [(0, "s", "unknown", True, False), (1, "t", "prohibited", False, False)]
    assert [r.source for r in G.default_sources(dim).collect()] == ["s"]


def test_unknown_sources_have_no_weight(spark):
    dim = spark.createDataFrame([("R", "", [], 0, "a", "qa", 1, 4, 1, "silent", True, False), ("R", "", [], 1, "a", "qa", 1, 1, 1, "silent", True, False)], G.SCHEMA)
    counts = spark.createDataFrame([("R", "a", 3), ("R", "z", 9), ("Q", "a", 2), (None, None, 1)], "region string, source string, n long")
    got = {(r.region, r.category): (r.posts, r.weight, r.share) for r in G.weigh(counts, dim).collect()}
    assert got == {("R", "qa"): (3, 12, 1.0), ("R", None): (9, 0, 0.0), ("Q", None): (2, 0, 0.0), (None, None): (1, 0, 0.0)}


def test_coverage_is_sorted_indented_json(spark):
    counts = spark.createDataFrame([(1, "b", "forums", 8), (1, 'a"x', "qa", 1), (1, "c", None, 1), (2, None, None, 2), (3, "s", "social", 1), (3, "v", "video_comments", 1), (3, "r", "reviews", 1)], "cluster int, source string, category string, n long")
    got = {r.cluster: r.coverage for r in relations.coverage_json(counts, "cluster").collect()}
    assert sorted(got) == [1, 2, 3]
    for text in got.values():
        assert json.dumps(json.loads(text), indent=2, sort_keys=True) == text
    one = json.loads(got[1])
    assert one["sources_used"] == ["b", 'a"x', "c"] and one["doc_counts"] == {'a"x': 1, "b": 8, "c": 1} and one["coverage_tier"] == "limited"
    assert one["bias_warning"].startswith("80% of evidence from a single source (b); no reviews/social/video_comments coverage; persona likely skews")
    assert json.loads(got[2])["sources_used"] == [] and json.loads(got[3])["bias_warning"] == "balanced coverage across categories"


def test_header_holds_region_and_coverage(spark):
    members = spark.createDataFrame([(1, "s", "en"), (2, None, None)], "cluster int, source string, lang string")
    words = spark.createDataFrame([], "cluster int, rank int, term string")
    coverage = spark.createDataFrame([(1, "{\n}")], "cluster int, coverage string")
    from pyspark.sql import functions as F

    heads = {r.cluster: r.header.split("\n") for r in evidence.evidence_header(members, words, coverage=coverage, region=F.lit("HK")).collect()}
    assert heads[1][:4] == ["CLUSTER METADATA", "- cluster_id: 1", "- region: HK", "- size: 1 posts"] and heads[1][7:] == ["", "DATA SOURCE COVERAGE (deterministic; informational)", "{", "}", "", "EVIDENCE PACK", ""]
    assert "{}" in heads[2]


def test_one_vs_rest_looks_at_the_most_frequent_terms(spark):
    terms = spark.createDataFrame([(1, "a")] * 3 + [(2, "b")] * 2 + [(1, "c")] * 2 + [(2, "d")], "k int, term string")
    got = {(r.k, r.term) for r in textrank.ctfidf_one_vs_rest(terms, "k", most=2).collect()}
    assert got == {(1, "a"), (2, "b")}  # b and c are equal: by name


def test_terms_leave_texts_where_they_are(spark, tmp_path):
    """Vectors don't count where Spark weighs whether clusters can be broadcast; texts, of signs that are no words here, are not moved to meet them."""
    from pyspark.sql import functions as F

    from voxfield.plans.regions import _terms

    signs = F.concat_ws("", *[F.translate(F.sha2(F.concat(F.col("id"), F.lit(f"-{i}")).cast("binary"), 256), "0123456789abcdef", "!#$%&()*+,-./:;<") for i in range(30)])
    spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("alpha beta "), signs).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    vector = F.array(*[F.rand(k) for k in range(16)])
    spark.range(3000).select((2 * F.col("id")).alias("vec_id"), vector.alias("embedding"), (F.col("id") % 2).cast("int").alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "60000")
    try:
        rows = []
        moved = shuffled(spark, lambda: rows.extend(textrank.ctfidf(_terms(spark, str(tmp_path)), "cluster").collect()))
    finally:
        spark.conf.set(key, old)
    assert sorted((r.cluster, r["rank"], r.term, r.weight) for r in rows) == [(c, k + 1, t, 1500.0) for c in (0, 1) for k, t in enumerate(["alpha", "alpha beta", "beta"])]
    assert moved < 1_000_000  # the texts are 11.5 MB
