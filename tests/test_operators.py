"""Known cases: expected values of scalar functions, trends, coverage, keywords, clusters, pages and streams."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxfield.functions import jsonx, text, time, vector
from voxfield.operators import clusters, density, evidence, relations, textrank, trends
from voxfield.sinks import csv
from voxfield.sources import html


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("said", "want"), [("MTR Mobile!", "mtr_mobile"), ("--", "untitled"), ("", "untitled"), ("CON", "con_topic"), ("é tea", "tea"), ("com10", "com10")])
def test_slugify(spark, said, want):
    assert one(spark, text.slugify(F.col("s")), s=said) == want


def test_pages_come_in_pieces():
    """All rows in order, null pages too; no piece of several pages is beyond the bound."""
    import pyarrow as pa

    pages = ["x" * n for n in (10, 900, 200, 5000, 1, 1)] + [None, "é" * 400, ""]
    batch = pa.RecordBatch.from_pydict({"k": list(range(9)), "h": pa.array(pages, pa.string())})
    cut = list(html.pieces([batch, batch.slice(0, 0)], most=1000))
    assert [x for b in cut for x in b["h"].to_pylist()] == pages and [b.num_rows for b in cut] == [2, 1, 1, 5]
    assert all(b.num_rows == 1 or sum(len((x or "").encode()) for x in b["h"].to_pylist()) <= 1000 for b in cut)


def test_slugify_query_like_its_sql(spark, tmp_path):
    """Texts that are device names, or null."""
    import duckdb

    import __spark_entry__ as e

    rows = [(1, "Éaux."), (2, "CON"), (3, None), (4, "--"), (5, "A b"), (6, "com1")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, e.queries()["slugify"](spark, str(tmp_path)).collect())) == sorted(con.execute(e.oracle_sql()["slugify"]).fetchall())


@pytest.mark.parametrize(("said", "want"), [("1.7M views", 1_700_000), ("73K", 73_000), ("1,234", 1234), ("2B", 2_000_000_000), ("none", None)])
def test_count_suffix(spark, said, want):
    assert one(spark, text.count_suffix(F.col("s")), s=said) == want


@pytest.mark.parametrize(("said", "want"), [("4.5/5", 4.5), ("rated 3 / 5 stars", 3.0), ("4", 4.0), ("44", None), ("no", None)])
def test_rating(spark, said, want):
    assert one(spark, text.rating(F.col("s")), s=said) == want


@pytest.mark.parametrize(("said", "days"), [("90d", 90), ("48h", 2), ("2w", 14), ("6m", 180), ("5x", None), ("d", None)])
def test_since(spark, said, days):
    now = dt.datetime(2026, 5, 1)
    got = one(spark, time.since(F.col("s"), F.lit(now).cast("timestamp_ntz")), s=said)
    assert got == (None if days is None else now - dt.timedelta(days=days))


@pytest.mark.parametrize(("said", "days"), [("3 days ago", 3), ("1 month ago", 30), ("2 Years ago", 730), ("a while ago", None)])
def test_relative_date(spark, said, days):
    now = dt.datetime(2026, 5, 1)
    got = one(spark, time.relative_date(F.col("s"), F.lit(now).cast("timestamp_ntz")), s=said)
    assert got == (None if days is None else now - dt.timedelta(days=days))


def test_hash_and_truncate(spark):
    assert one(spark, text.author_hash(F.col("s"), "a"), s="") == ""
    a, b = (one(spark, text.author_hash(F.col("s"), salt), s="me") for salt in "ab")
    assert len(a) == 64 and a != b
    assert one(spark, text.truncate(F.col("s"), 5), s="abc defg") == "abc…" and one(spark, text.truncate(F.col("s"), 5), s="abcde") == "abcde"
    assert one(spark, text.post_text(F.lit(""), F.col("s")), s="body") == "body" and one(spark, text.post_text(F.lit("t"), F.col("s")), s="body") == "t\n\nbody"


def test_compounds_and_expansion(spark):
    assert one(spark, text.compound_variants(F.col("s")), s="AlipayHK") == ["alipay hk", "Alipay HK"]
    assert "iPhone 16" in one(spark, text.compound_variants(F.col("s")), s="iPhone16")
    assert "a b c" in one(spark, text.compound_variants(F.col("s")), s="a_b-c")
    cases = {"HKDollar": ["hk dollar", "HK Dollar"], "ABC_def": ["ABC def"], "aBC": ["a bc", "a BC"], "x2y": ["x y", "x y", "x 2 y"], "": [], "plain": [], "ABCé": []}
    assert {k: one(spark, text.compound_variants(F.col("s")), s=k) for k in cases} == cases
    rows = textrank.expand_topics(spark.createDataFrame([("tea",)], "topic string"), ["{topic} review", "TEA", "best {topic}"], 10).orderBy("pos").collect()
    assert [r["query"] for r in rows] == ["tea", "tea review", "best tea"]


def test_tolerant_json(spark):
    for said in ('{"k": 1}', 'Sure:\n```json\n{"k": 1}\n```\nbye', 'well {"k": 1} ok'):
        assert one(spark, F.try_variant_get(jsonx.tolerant_object(F.col("s")), "$.k", "int"), s=said) == 1
    assert one(spark, jsonx.tolerant_object(F.col("s")), s="no") is None
    assert one(spark, jsonx.tolerant_array(F.col("s")), s='["a", "b", ""]') == ["a", "b"]
    assert one(spark, jsonx.tolerant_array(F.col("s")), s='here ["a"] there') == ["a"]
    assert one(spark, jsonx.tolerant_array(F.col("s")), s='"a",\n{x}\n b ') == ["a", "b"]


def posts(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp_ntz, complaint boolean")


def test_trends(spark):
    none = trends.bucket_trend(posts(spark, []), time.iso_week(F.col("ts")), "ts", "complaint")
    assert none.count() == 0 and trends.spikes(none).count() == 0
    months = [(dt.datetime(2026, m, 15), False) for m in (1, 2, 3)] + [(None, True)]
    assert trends.bucket_trend(posts(spark, months), time.month(F.col("ts")), "ts", "complaint").count() == 3
    day = trends.bucket_trend(posts(spark, [(dt.datetime(2026, 1, 5, h), h < 2) for h in range(3)]), time.iso_week(F.col("ts")), "ts", "complaint").first()
    assert (day["post_count"], day["complaint_count"], day["sentiment_score"]) == (3, 2, -0.667)
    counts = [1, 1, 20, 1]
    weeks = [(dt.datetime(2026, 1, 5) + dt.timedelta(weeks=w, minutes=i), False) for w, n in enumerate(counts) for i in range(n)]
    found = trends.spikes(trends.bucket_trend(posts(spark, weeks), time.iso_week(F.col("ts")), "ts", "complaint")).collect()
    assert [r["post_count"] for r in found] == [20]


@pytest.mark.parametrize(("n", "want"), [(0, "single-perspective"), (1, "single-perspective"), (2, "limited"), (3, "balanced"), (4, "balanced"), (5, "high")])
def test_tier(spark, n, want):
    assert one(spark, relations.tier(F.col("n")), n=n) == want


def test_coverage_and_bias(spark):
    counts = spark.createDataFrame([(1, "lihkg", "forums", 8), (1, "app", "reviews", 2), (2, "f", "forums", 3), (2, "x", None, 3)], "c int, source string, category string, n long")
    got = {r["c"]: r for r in relations.coverage(counts, "c").collect()}
    assert got[1]["categories_present"] == "forums,reviews" and "qa" in got[1]["categories_missing"] and got[1]["coverage_tier"] == "limited"
    bias = {r["c"]: r["bias_warning"] for r in relations.bias_warning(counts, "c").collect()}
    assert bias[1] == "80% of evidence from a single source (lihkg); no social/video_comments coverage" and "text-first" in bias[2]


def test_quotes(spark):
    quotes = spark.createDataFrame([(1, " the train "), (2, "was late"), (3, "x"), (4, " "), (5, None)], "doc_id long, quote string")
    texts = spark.createDataFrame([(1, "so the train came"), (2, "it was punctual"), (4, "t"), (5, "t")], "doc_id long, text string")
    assert {r["doc_id"]: r["error"] for r in evidence.quote_errors(quotes, texts).collect()} == {2: "not verbatim", 3: "not in pack", 4: "empty", 5: "empty"}


def test_sets_and_dedup(spark):
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "claim string")
    got = {(r["claim"], r["change"]) for r in relations.set_changes(frame(["a", "b", "b"]), frame(["b", "c"])).collect()}
    assert got == {("a", "resolved"), ("c", "emerged"), ("b", "persisted")}
    rows = spark.createDataFrame([("s", 1), ("s", 2)], "source string, id long")
    assert relations.not_seen(rows, rows.where("id = 1"), ["source", "id"]).count() == 1


def test_vectors(spark):
    assert one(spark, vector.cosine_distance(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)))) == pytest.approx(1)
    rows = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [0.9, 0.1, 0.0]), ("d", [0.0, 0.0, 1.0])], "k string, v array<double>")
    assert [r["k"] for r in clusters.nearest(rows, [1.0, 0.0, 0.0], 2, "k", "v").collect()] == ["a", "c"]
    chunked = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])], "p int, c int, v array<double>")
    assert clusters.pooled_chunks(chunked, "p", "v", "c").first()["v"] == pytest.approx([0.5**0.5] * 2) and clusters.pooled_chunks(chunked, "p", "v", "c", "last").first()["v"] == [0.0, 1.0]


@pytest.mark.parametrize(("n", "starts"), [(512, 1), (513, 2), (0, 1), (1000, 3)])
def test_chunks(spark, n, starts):
    got = textrank.chunks(spark.createDataFrame([(1, "w " * n)], "k int, t string"), "k", F.col("t")).orderBy("chunk").collect()
    assert len(got) == starts and got[0]["n_words"] == min(n, 512)


def test_keywords(spark):
    rows = spark.createDataFrame([(0, "expensive price fare price"), (0, "the price fare too expensive"), (1, "crowded train platform"), (1, "platform crowded again crowded")], "c int, t string")
    terms = rows.select("c", F.explode(textrank.bigrams(textrank.tokens_en(F.col("t")))).alias("term"))
    for f in (textrank.ctfidf, textrank.ctfidf_one_vs_rest):
        got = f(terms, "c", 5).collect()
        sets = [{r["term"] for r in got if r["c"] == c} for c in (0, 1)]
        assert sets[0] != sets[1] and "price" in sets[0] and "crowded" in sets[1]
    assert textrank.ctfidf(terms.where("c = 0"), "c").count() == 0


def test_cjk_grams(spark):
    assert one(spark, textrank.cjk_grams(F.col("s")), s="abc 東京, 駅") == ["東京", "京駅", "東", "京", "駅"]
    assert one(spark, textrank.cjk_grams(F.col("s")), s="東の京こと") == ["東京", "京こ", "東", "京", "こ", "と"][:5]
    assert one(spark, textrank.tokenize(F.col("s"), F.lit("US")), s="The cats don't") == ["cats", "don't"]


def test_planted_clusters(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 6, (5, 8))
    rows = [("t", 20 * c + i, (centers[c] + rng.normal(0, 0.4, 8)).tolist(), c) for c in range(5) for i in range(20)] + [("u", 500, [1.0] * 8, 9)]
    df = spark.createDataFrame(rows, "topic string, id long, v array<double>, planted int")
    got = density.density_clusters(df, ["topic"], "id", "v", 1.6, 5, 8).join(df, ["topic", "id"]).collect()
    found = sum(any(sum(r["planted"] == c and r["label"] == k for r in got) >= 10 for k in range(9)) for c in range(5))
    assert found >= 4 and [r["label"] for r in got if r["topic"] == "u"] == [-1]
    assert clusters.representatives(df.where("topic = 't'"), "planted", "id", "v", 3).count() == 15
    assert {r["path"] for r in clusters.small_guard(df, ["topic"], 50).select("path").collect()} == {"single", "density"}


def test_pages():
    p = html.parse('<head><title>x</title></head><nav>menu</nav><p>One <b>two<p>three<script>var a</script><a href="/u">link <i>me</a><div class="card big">Review text <span>here</span></div><footer>f</footer>', "card")
    assert html._clean(p.parts) == "One two\nthreelink me\nReview text here"
    assert [(h, "".join(t)) for h, t in p.links] == [("/u", "link me")] and ["".join(c) for c in p.cards] == ["Review text here"]
    assert html.parse(None).parts == []


def test_exports(spark, tmp_path):
    rows = [("p1", None, 'say "hi",\nok', dt.datetime(2024, 1, 2, 3, 4, 5), {"likes": 3, 'a"b': None}, "x"), ("p2", "s", None, dt.datetime(2024, 1, 2, 3, 4, 5, 600), {}, "x"), ("p3", "s", "", None, None, "x")]
    posts = spark.createDataFrame(rows, "id string, source string, body string, posted_at timestamp, engagement_metrics map<string,bigint>, raw_metadata string")
    csv.write_posts(posts, f"{tmp_path}/c")
    back = {r["id"]: r for r in spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{tmp_path}/c").fillna("").collect()}
    assert list(back["p1"].asDict()) == csv.POST_COLUMNS
    assert back["p1"]["body"] == 'say "hi",\nok' and back["p1"]["source"] == "" and back["p1"]["title"] == ""
    assert json.loads(back["p1"]["engagement_metrics"]) == {"likes": 3, 'a"b': None} and '"likes": 3' in back["p1"]["engagement_metrics"]
    assert [back[k]["engagement_metrics"] for k in ("p2", "p3")] == ["", ""] and back["p3"]["posted_at"] == ""
    assert dt.datetime.fromisoformat(back["p2"]["posted_at"]).microsecond == 600 and "." not in back["p1"]["posted_at"]
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    got = csv.upsert(old, spark.createDataFrame([(2, "c", 2), (3, "d", 2)], old.schema), ["k"], "at").collect()
    assert {(r["k"], r["v"]) for r in got} == {(1, "a"), (2, "c"), (3, "d")}


def test_stream_state(spark, tmp_path):
    from voxfield.streaming import events as S

    rng = random.Random(1)
    rows = [(i, dt.datetime(2024, 1, 8) + dt.timedelta(hours=i), i % 3, rng.choice(["view", "error"])) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id int, event_type string")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    out = S.run_once(S.deduplicated(S.read_events(spark, f"{tmp_path}/in", df.schema), ["user_id"]), "d", "append", f"{tmp_path}/d")
    assert out.count() == 3
    S.upsert_state(out.drop("_batch"), f"{tmp_path}/state", ["user_id"], "event_id")
    S.upsert_state(out.drop("_batch"), f"{tmp_path}/state", ["user_id"], "event_id")
    assert spark.read.parquet(f"{tmp_path}/state").count() == 3


def test_raw_post_files(spark, tmp_path):
    import json

    from voxfield.schema import flat_replies
    from voxfield.sources import files

    post = {"id": "1", "source": "s", "body": "b", "posted_at": "2026-01-01T00:00:00Z", "engagement_metrics": {"likes": 3}, "replies": [{"id": "r", "body": "x"}]}
    (tmp_path / "a.json").write_text(json.dumps([post, post | {"id": "2", "replies": []}]))
    (tmp_path / "a._run.json").write_text('{"emitted": 2}')
    (tmp_path / "b.json").write_text(json.dumps([post | {"id": "3"}]))
    rows = files.raw_posts(spark, str(tmp_path))
    assert {r["id"] for r in rows.select("id").collect()} == {"1", "2", "3"}
    assert [r["id"] for r in files.newest(rows).select("id").collect()] == ["3"]
    assert flat_replies(rows).count() == 2 and files.last_changed(rows, "source").count() == 1
    (tmp_path / "log.jsonl").write_text('{"id": 1, "type": "queued", "data": "{}"}\nbroken\n{"id": 2, "type": "done", "data": "{}"}\n')
    assert [r["type"] for r in files.event_log(spark, f"{tmp_path}/log.jsonl").orderBy("id").collect()] == ["queued", "done"]


def test_search_results_and_cards(spark):
    from voxfield.sources.feeds import search_results

    page = '<a href="//x.org/l/?uddg=https%3A%2F%2Fexample.org%2Fa">A</a><a href="/b">B</a><p class="r">too short</p><p class="r">a review of some length</p>'
    pages = spark.createDataFrame([(1, page), (2, None)], "k int, h string")
    assert [r["url"] for r in search_results(pages, "h", "k").orderBy("pos").collect()] == ["https://example.org/a", "/b"]
    assert [r["body"] for r in html.page_cards(pages, "k", "h", "r").collect()] == ["a review of some length"]


def test_synthesis_retries_and_isolates(spark):
    from voxfield.operators import synthesis as S

    block = "[doc_0123456789ab] (x)\n  some words here\n"
    docs = [("doc_0123456789ab", "some words here")]
    packs = spark.createDataFrame([(1, block, docs)], "cluster int, block string, docs array<struct<doc: string, text: string>>")
    good = S.synthesize(packs, S.quoting_client).first()
    assert good["attempts"] == 2 and good["errors"] == []

    def failing():
        def ask(prompt):
            raise RuntimeError("down")

        return ask

    bad = S.synthesize(packs, failing).first()
    assert bad["errors"] == ["call failed: down"]
    assert S.persona_errors({"goals": [{"claim": "x", "evidence": ["doc_z"]}], "representative_quotes": []}, {"doc_a"}, {}) == ["goals[0] cites unknown doc_z", "0 quotes, at least 1 needed"]


def test_evidence_pack_shows_representatives_first(spark):
    members = spark.createDataFrame([(1, k, None if k == 3 else f"text\n{k}" + "x" * 700, "s", None if k == 5 else "en") for k in range(40)] + [(2, 99, "only", None, "fr")], "cluster int, doc_id int, text string, source string, lang string")
    reps = spark.createDataFrame([(1, 30, 1), (1, 3, 2), (1, 5, 3), (2, 99, 1)], "cluster int, doc_id int, rank int")
    pack = evidence.evidence_pack(members, reps, others=30)
    rows = {r.doc_id: r for r in pack.collect()}
    assert sorted(rows) == [k for k in range(33) if k != 3] + [99] and rows[30].rep_no == 1 and rows[5].rep_no == 2 and rows[0].rep_no is None
    assert len(rows[30].snippet) == 600 and len(rows[0].snippet) == 300 and rows[0].hidden == 7 and rows[99].hidden == 0 and rows[5].lang == "unknown"
    blocks = {r.cluster: r for r in evidence.evidence_block(pack).collect()}
    assert blocks[1].n_docs == 32 and blocks[1].block.endswith("... and 7 more posts in this cluster (not shown)") and "representative #2" in blocks[1].block
    words = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "cluster int, rank int, term string")
    heads = {r.cluster: r.header for r in evidence.evidence_header(members, words).collect()}
    assert heads[1].splitlines()[2:5] == ["- size: 40 posts", "- top keywords (c-TF-IDF): a, b", '- source distribution: {"s": 40}'] and "- source distribution: {}" in heads[2]


def test_themes_are_recovered_by_token_or_phrase(spark):
    claims = spark.createDataFrame([(1, "App drains the Battery overnight"), (2, "batteries"), (3, "slow on start up"), (4, None), (5, "")], "id int, t string")
    got = relations.recovered(claims, "id", "t", {"power": (["battery"], []), "start": ([], ["START up"])})
    assert sorted(map(tuple, got.collect())) == [(1, "power"), (3, "start")]


def shuffled(spark, f):
    """Bytes that all stages that f runs write for others."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def total():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    f()
    return total() - before


def test_evidence_pack_moves_only_the_texts_it_shows(spark, tmp_path):
    """Where the clusters of documents are too many to broadcast, other texts stay where they are."""
    text = F.concat_ws("", *[F.sha2(F.concat(F.col("id"), F.lit(f"-{i}")).cast("binary"), 256) for i in range(30)])
    spark.range(6000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang")).write.parquet(f"{tmp_path}/documents")
    spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("cluster")).write.parquet(f"{tmp_path}/ids")
    members = spark.read.parquet(f"{tmp_path}/documents").join(spark.read.parquet(f"{tmp_path}/ids"), "doc_id")
    reps = spark.createDataFrame([(c, 2 * r + c, r) for c in (0, 1) for r in (1, 2)], "cluster long, doc_id long, rank int")
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "16000")
    try:
        rows = []
        moved = shuffled(spark, lambda: rows.extend(evidence.evidence_pack(members, reps, others=3).collect()))
    finally:
        spark.conf.set(key, old)
    assert len(rows) == 10 and {(r.cluster, r.doc_id, r.rep_no, r.hidden) for r in rows} == {(c, 2 * k + c, n, 2995) for c in (0, 1) for k, n in ((1, 1), (2, 2), (0, None), (3, None), (4, None))}
    assert moved < 1_000_000  # the texts are 11.5 MB


def test_keywords_count_rare_terms_by_hash(spark):
    """A million terms that occur once are neither held nor moved one by one; the frequent ones are counted in full."""
    rare = spark.range(0, 1_000_000, numPartitions=4).select((F.col("id") % 2).alias("c"), F.md5(F.col("id").cast("string").cast("binary")).alias("term"))
    often = spark.range(40_000).select(F.floor(F.col("id") / 20_000).alias("c"), F.concat(F.lit("w"), F.floor(F.sqrt(F.col("id") % 10_000)) / 10).alias("term"))
    rows = []
    moved = shuffled(spark, lambda: rows.extend(textrank.ctfidf(rare.union(often), "c", 3, most=50).collect()))
    assert sorted((r.c, r["rank"], r.term, r.weight) for r in rows) == [(c, k + 1, f"w9.{9 - k}", 398.0 - 4 * k) for c in (0, 1) for k in range(3)]
    assert moved < 40_000_000  # the rare terms are 32 MB, and were moved twice


@pytest.mark.parametrize("spread", [1, 4])
@pytest.mark.parametrize("f", ["ctfidf", "ctfidf_one_vs_rest"])
def test_keywords_are_exact_where_buckets_are_full(spark, monkeypatch, spread, f):
    """Few buckets for terms of nearly equal counts: those left out at first may hold one of the most frequent."""
    monkeypatch.setattr(textrank, "_BUCKETS", 64)
    rng = random.Random(spread)
    mentions = [(rng.randrange(3), f"t{int(400 * rng.random() ** spread)}") for _ in range(6000)]
    got = {(r.c, r.term) for r in getattr(textrank, f)(spark.createDataFrame(mentions, "c int, term string"), "c", 100, most=3).collect()}
    total = {}
    for _, t in mentions:
        total[t] = total.get(t, 0) + 1
    want = set(sorted(total, key=lambda t: (-total[t], t))[:3])
    assert got == {(c, t) for c, t in mentions if t in want}
