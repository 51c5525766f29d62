"""Queries of joins, aggregates, set operations and comparisons.

Test tables stand in: documents for posts, embeddings.label for clusters (vec_id = doc_id), sources get a category by rule."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxfield.operators import relations as R
from voxfield.plans.catalog import query, table

_CATS = "['forums', 'reviews', 'social', 'video_comments', 'qa', 'blogs', 'news_comments']"
#: Sources whose number is divisible by 5 are not registered.
_REG = f"(SELECT DISTINCT source, {_CATS}[(substr(source, 4)::INTEGER % 7 + 1)] AS category, substr(source, 4)::INTEGER // 7 + 1 AS priority FROM documents WHERE substr(source, 4)::INTEGER % 5 <> 0)"


def registry(spark, sf_dir):
    number = F.substring("source", 4, 9).cast("int")
    rows = table(spark, sf_dir, "documents").select("source").distinct().where(number % 5 != 0)
    return rows.select("source", F.element_at(F.array(*map(F.lit, R.CATEGORIES)), (number % 7 + 1).cast("int")).alias("category"), F.floor(number / 7).cast("int").alias("p")).select("source", "category", (F.col("p") + 1).alias("priority"))


def members(spark, sf_dir, cluster="label"):
    """(cluster, doc_id, source, lang, text): documents with a cluster, which is an expression on embeddings. Spark moves a semi-join on members to the documents only while all columns are plain ones."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.expr(cluster).alias("cluster"))
    return table(spark, sf_dir, "documents").join(e, "doc_id")


_MEM = "(SELECT label AS cluster, d.* FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"


@query("anti_already_embedded", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0')")
def anti_already_embedded(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text_hash", F.sha2(F.col("text").cast("binary"), 256))
    cache = docs.where("source = 'src0'").select("text_hash").distinct()
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return R.not_seen(R.not_seen(docs, cache, ["text_hash"]), known, ["doc_id"]).select("doc_id")


@query("seen_posts_upsert", "SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2")
def seen_posts_upsert(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    old = events.where("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return R.seen_update(old, events.where("ts >= TIMESTAMP_NTZ '2024-01-15 00:00:00'"), ["user_id", "event_type"], "ts")


@query("embedding_upsert", "SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def embedding_upsert(spark, sf_dir):
    from voxfield.sinks.csv import upsert

    rows = table(spark, sf_dir, "events").select("user_id", "value", "event_id")
    return upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["user_id"], "event_id")


@query("semi_window", f"SELECT cluster, count(*) AS size FROM {_MEM} WHERE doc_id IN (SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00') GROUP BY 1")
def semi_window(spark, sf_dir):
    inside = table(spark, sf_dir, "events").where("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'").select(F.col("event_id").alias("doc_id"))
    return members(spark, sf_dir).join(inside, "doc_id", "left_semi").groupBy("cluster").agg(F.count("*").alias("size"))


@query("source_category", f"SELECT r.category, count(*) AS n, min(r.priority) AS best FROM documents d JOIN {_REG} r USING (source) GROUP BY 1")
def source_category(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(registry(spark, sf_dir), "source").groupBy("category").agg(F.count("*").alias("n"), F.min("priority").alias("best"))


@query("unknown_sources", f"SELECT source, count(*) AS n FROM documents WHERE source NOT IN (SELECT source FROM {_REG}) GROUP BY 1")
def unknown_sources(spark, sf_dir):
    return R.not_seen(table(spark, sf_dir, "documents"), registry(spark, sf_dir), ["source"]).groupBy("source").agg(F.count("*").alias("n"))


@query("registry_order", f"SELECT source, category, row_number() OVER (PARTITION BY category ORDER BY priority, source)::INTEGER AS place FROM {_REG}")
def registry_order(spark, sf_dir):
    return registry(spark, sf_dir).select("source", "category", F.row_number().over(Window.partitionBy("category").orderBy("priority", "source")).alias("place"))


@query("left_defaults", "SELECT e.vec_id, coalesce(d.source, 'unknown') AS source, coalesce(d.lang, 'en') AS lang, coalesce(length(d.text), 0)::INTEGER AS n FROM embeddings e LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 <> 0) d ON d.doc_id = e.vec_id")
def left_defaults(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0")
    return table(spark, sf_dir, "embeddings").select("vec_id").join(docs, F.col("doc_id") == F.col("vec_id"), "left").select("vec_id", F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("lang", F.lit("en")).alias("lang"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))


@query(
    "status_full_outer",
    """SELECT n_nationkey AS key, c AS customers, s AS suppliers, p AS docs FROM (SELECT c_nationkey AS n_nationkey, count(*) AS c FROM customer GROUP BY 1)
       FULL JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS s FROM supplier GROUP BY 1) USING (n_nationkey)
       FULL JOIN (SELECT substr(source, 4)::INTEGER AS n_nationkey, count(*) AS p FROM documents GROUP BY 1) USING (n_nationkey)""",
)
def status_full_outer(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("suppliers"))
    d = table(spark, sf_dir, "documents").groupBy(F.substring("source", 4, 9).cast("int").alias("key")).agg(F.count("*").alias("docs"))
    return c.join(s, "key", "full").join(d, "key", "full")


@query("stage_dimension", "SELECT k AS stage_no, s AS stage, coalesce(n, 0) AS posts FROM (SELECT unnest(range(6)) AS k, unnest(['Awareness', 'Consideration', 'Decision', 'Onboarding', 'Use', 'Loyalty/Churn']) AS s) LEFT JOIN (SELECT doc_id % 4 AS k, count(*) AS n FROM documents GROUP BY 1) USING (k)")
def stage_dimension(spark, sf_dir):
    stages = spark.createDataFrame(list(enumerate(R.STAGES)), "stage_no long, stage string")
    counts = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 4).alias("stage_no")).agg(F.count("*").alias("posts"))
    return stages.join(counts, "stage_no", "left").select("stage_no", "stage", F.coalesce("posts", F.lit(0).cast("long")).alias("posts"))


@query("doc_lookup", f"SELECT 'doc_' || substr(sha256(doc_id::VARCHAR), 1, 12) AS short_id, doc_id, category FROM documents LEFT JOIN {_REG} USING (source) WHERE 'doc_' || substr(sha256(doc_id::VARCHAR), 1, 12) IN (SELECT 'doc_' || substr(sha256(vec_id::VARCHAR), 1, 12) FROM embeddings WHERE label = 3)")
def doc_lookup(spark, sf_dir):
    from voxfield.functions.text import short_id

    wanted = table(spark, sf_dir, "embeddings").where("label = 3").select(short_id("doc", F.col("vec_id")).alias("short_id"))
    docs = table(spark, sf_dir, "documents").select(short_id("doc", F.col("doc_id")).alias("short_id"), "doc_id", "source")
    return docs.join(wanted, "short_id", "left_semi").join(registry(spark, sf_dir), "source", "left").select("short_id", "doc_id", "category")


@query("verbatim_quote", "SELECT doc_id, quote, contains(text, trim(quote)) AS verbatim FROM (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN 'not in the text' ELSE ' ' || substr(text, 5, 30) END AS quote FROM documents)")
def verbatim_quote(spark, sf_dir):
    quotes = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "not in the text").otherwise(F.concat(F.lit(" "), F.substring("text", 5, 30))).alias("quote"))
    return quotes.join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "quote", F.contains("text", F.trim("quote")).alias("verbatim"))


@query(
    "theme_recovery",
    """SELECT b.item_id, count(*) AS matches FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS toks FROM benchmark) b
       JOIN (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS toks FROM documents) d ON len(list_intersect(b.toks, d.toks)) > 0 GROUP BY 1""",
)
def theme_recovery(spark, sf_dir):
    return R.theme_matches(table(spark, sf_dir, "benchmark"), "item_id", table(spark, sf_dir, "documents"), "doc_id", "text")


@query("distribution", f"""SELECT cluster, string_agg(lang || ':' || n, ',' ORDER BY n DESC, lang) AS histogram FROM (SELECT cluster, lang, count(*) AS n FROM {_MEM} GROUP BY 1, 2) GROUP BY 1""")
def distribution(spark, sf_dir):
    return R.as_histogram(R.distribution(members(spark, sf_dir), "cluster", "lang"), "cluster")


@query(
    "distributions_grouping_sets",
    f"""SELECT cluster, source, lang, month, count(*) AS n FROM (SELECT m.*, strftime(ts, '%Y-%m') AS month FROM {_MEM} m JOIN events e ON m.doc_id = e.event_id) GROUP BY GROUPING SETS ((cluster, source), (cluster, lang), (cluster, month), (cluster))""",
)
def distributions_grouping_sets(spark, sf_dir):
    ts = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.date_format("ts", "yyyy-MM").alias("month"))
    c = [F.col(x) for x in ("cluster", "source", "lang", "month")]
    rows = members(spark, sf_dir).join(ts, "doc_id")
    return rows.groupingSets([c[:2], [c[0], c[2]], [c[0], c[3]], c[:1]], *c).agg(F.count("*").alias("n"))


def _source_counts(spark, sf_dir):
    counts = members(spark, sf_dir).groupBy("cluster", "source").agg(F.count("*").alias("n"))
    return counts.join(registry(spark, sf_dir), "source", "left")


_SC = f"(SELECT cluster, source, category, n FROM (SELECT cluster, source, count(*) AS n FROM {_MEM} GROUP BY 1, 2) LEFT JOIN {_REG} USING (source))"


@query(
    "coverage_tier",
    f"""SELECT cluster, array_to_string(p, ',') AS categories_present, array_to_string(list_sort(list_filter({_CATS}, lambda c: NOT list_contains(p, c))), ',') AS categories_missing, len(p)::INTEGER AS category_count,
        CASE WHEN len(p) <= 1 THEN 'single-perspective' WHEN len(p) = 2 THEN 'limited' WHEN len(p) <= 4 THEN 'balanced' ELSE 'high' END AS coverage_tier
        FROM (SELECT cluster, list_sort(list(DISTINCT category) FILTER (category IS NOT NULL)) AS p FROM {_SC} GROUP BY 1)""",
)
def coverage_tier(spark, sf_dir):
    return R.coverage(_source_counts(spark, sf_dir), "cluster")


@query(
    "bias_warning",
    f"""SELECT lang, CASE WHEN w = '' THEN 'balanced coverage across categories' ELSE w END AS bias_warning FROM (SELECT lang, concat_ws('; ',
        CASE WHEN top_n / size > 0.7 THEN floor(top_n * 100 / size)::INTEGER || '% of evidence from a single source (' || top || ')' END,
        CASE WHEN len(g) > 0 THEN 'no ' || array_to_string(g, '/') || ' coverage' END,
        CASE WHEN len(p) > 0 AND len(list_filter(p, lambda c: c NOT IN ('forums', 'qa', 'news_comments'))) = 0 THEN 'persona likely skews text-first / forum-native; short-form social and video voices are absent' END) AS w
        FROM (SELECT *, list_sort(list_filter(['social', 'video_comments', 'reviews'], lambda c: NOT list_contains(p, c))) AS g FROM
          (SELECT lang, list(DISTINCT category) FILTER (category IS NOT NULL) AS p, sum(n) AS size, max(n) AS top_n, (list(source ORDER BY n DESC, source))[1] AS top FROM
            (SELECT lang, source, category, n FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) LEFT JOIN {_REG} USING (source)) GROUP BY 1)))""",
)
def bias_warning(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).join(registry(spark, sf_dir), "source", "left")
    return R.bias_warning(counts, "lang")


_NEG, _POS = ["bad", "worst", "hain", "scum", "idiot"], ["good", "best", "thst", "ingre"]


@query(
    "claim_grounding",
    f"""WITH ev AS (SELECT user_id AS claim, (user_id % 10)::INTEGER AS cluster, event_id AS doc FROM events UNION ALL SELECT user_id, (user_id % 10)::INTEGER, event_id FROM events WHERE event_type = 'error'),
        sc AS (SELECT doc_id AS doc, len(list_filter({_POS}, lambda w: contains(lower(text), w))) - len(list_filter({_NEG}, lambda w: contains(lower(text), w))) AS s FROM documents)
        SELECT claim, cluster, count(DISTINCT ev.doc) AS n_users, count(*) FILTER (s < 0) AS negative, count(*) FILTER (coalesce(s, 0) = 0) AS neutral, count(*) FILTER (s > 0) AS positive,
        round(count(DISTINCT ev.doc) / greatest(any_value(size), 1), 3) AS pct_of_cluster FROM ev LEFT JOIN sc USING (doc) JOIN (SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY 1) USING (cluster) GROUP BY 1, 2""",
)
def claim_grounding(spark, sf_dir):
    mentions = table(spark, sf_dir, "events").select(F.col("user_id").alias("claim"), (F.col("user_id") % 10).cast("int").alias("cluster"), F.col("event_id").alias("doc"), "event_type")
    # errors are mentioned twice
    evidence = mentions.drop("event_type").unionByName(mentions.where("event_type = 'error'").drop("event_type"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    sizes = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("size"))
    return R.grounding(evidence, texts, sizes, _NEG, _POS)


@query("stage_sparsity", "SELECT k AS stage, coalesce(n, 0) AS cites, CASE WHEN n IS NULL THEN 'none' WHEN n < 2 THEN 'thin' ELSE 'ok' END AS sparsity FROM (SELECT unnest(range(6)) AS k) LEFT JOIN (SELECT conv_id % 7 AS k, count(DISTINCT text) AS n FROM conversations WHERE turn > 2 AND conv_id % 7 <> 1 GROUP BY 1) USING (k)")
def stage_sparsity(spark, sf_dir):
    cites = table(spark, sf_dir, "conversations").where("turn > 2 and conv_id % 7 <> 1").groupBy((F.col("conv_id") % 7).alias("stage")).agg(F.countDistinct("text").alias("n"))
    out = spark.range(6).select(F.col("id").alias("stage")).join(cites, "stage", "left")
    return out.select("stage", F.coalesce("n", F.lit(0).cast("long")).alias("cites"), F.when(F.col("n").isNull(), "none").when(F.col("n") < 2, "thin").otherwise("ok").alias("sparsity"))


@query("confidence", "SELECT user_id, greatest(0.0, round(1 - 0.1 * count(DISTINCT event_type), 6))::DOUBLE AS confidence FROM events WHERE value > 50 GROUP BY 1")
def confidence(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value > 50").groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).select("user_id", R.confidence(F.col("n")).alias("confidence"))


_PRICES = [("a", 3.0, 0.3, 3.75, 15.0), ("b", 0.27, 0.07, 0.27, 1.1)]
_PRICED = "(VALUES ('a', 3.0, 0.3, 3.75, 15.0), ('b', 0.27, 0.07, 0.27, 1.1)) t(provider, p_in, p_cached, p_write, p_out)"


def _prices(spark):
    from voxfield.operators.costs import PRICES

    return spark.createDataFrame(_PRICES, f"provider string, {', '.join(f'{p} double' for p in PRICES)}")


@query(
    "token_cost",
    f"""SELECT provider, sum(i)::BIGINT AS input_tokens, sum(c)::BIGINT AS cached_input_tokens, sum(o)::BIGINT AS output_tokens, round(sum(i) / 1e6 * p_in + sum(c) / 1e6 * p_cached + sum(w) / 1e6 * p_write + sum(o) / 1e6 * p_out, 6) AS cost_usd
       FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS provider, n_chars AS i, n_chars // 2 AS c, n_chars // 4 AS w, 350 AS o FROM documents)
       JOIN {_PRICED} USING (provider) GROUP BY provider, p_in, p_cached, p_write, p_out""",
)
def token_cost(spark, sf_dir):
    from voxfield.operators.costs import TOKENS, usage_cost

    n = F.col("n_chars")
    counts = (n, F.floor(n / 2), F.floor(n / 4), F.lit(350))
    use = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("provider"), *[c.alias(t) for c, t in zip(counts, TOKENS, strict=True)])
    return usage_cost(use, _prices(spark)).drop("cache_write_tokens")


@query("source_share", "SELECT source, n, round(100.0 * n / sum(n) OVER (), 2)::DOUBLE AS pct FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def source_share(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


@query("dominance", f"SELECT cluster, lang, pct FROM (SELECT cluster, lang, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY cluster), 2)::DOUBLE AS pct FROM {_MEM} GROUP BY 1, 2) WHERE pct > 60")
def dominance(spark, sf_dir):
    counts = R.distribution(members(spark, sf_dir), "cluster", "lang").withColumnRenamed("value", "lang")
    return counts.select("cluster", "lang", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("cluster")), 2).alias("pct")).where("pct > 60")


@query("stats_distinct", "SELECT count(*) AS posts, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, max(n_chars) AS longest FROM documents")
def stats_distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("posts"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"), F.max("n_chars").alias("longest"))


@query("largest_cluster", "SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY 1 ORDER BY size DESC, cluster LIMIT 1")
def largest_cluster(spark, sf_dir):
    sizes = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("size"))
    return sizes.orderBy(F.desc("size"), "cluster").limit(1)


@query("scan_counters", "SELECT source, count(*) AS emitted, count(*) - count(DISTINCT text) AS duplicates FROM documents GROUP BY 1")
def scan_counters(spark, sf_dir):
    by_text = table(spark, sf_dir, "documents").groupBy("source", F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.count("*").alias("n"))
    return by_text.groupBy("source").agg(F.sum("n").alias("emitted"), F.sum(F.col("n") - 1).alias("duplicates"))


def _claims(spark, sf_dir, early):
    # one side has the sources before src5 by name, the other the rest; a claim is a whole text, by its hash
    docs = table(spark, sf_dir, "documents").where("source < 'src5'" if early else "source >= 'src5'")
    return docs.select(F.sha2(F.col("text").cast("binary"), 256).alias("claim"), F.coalesce("lang", F.lit("unspecified")).alias("severity"))


_BEFORE = "(SELECT sha256(text) AS claim, coalesce(lang, 'unspecified') AS severity FROM documents WHERE source < 'src5')"
_AFTER = "(SELECT sha256(text) AS claim, coalesce(lang, 'unspecified') AS severity FROM documents WHERE source >= 'src5')"


@query("emerged_resolved_persisted", f"SELECT *, 'emerged' AS change FROM (SELECT * FROM {_AFTER} EXCEPT SELECT * FROM {_BEFORE}) UNION ALL SELECT *, 'resolved' FROM (SELECT * FROM {_BEFORE} EXCEPT SELECT * FROM {_AFTER}) UNION ALL SELECT *, 'persisted' FROM (SELECT * FROM {_BEFORE} INTERSECT SELECT * FROM {_AFTER})")
def emerged_resolved_persisted(spark, sf_dir):
    return R.set_changes(_claims(spark, sf_dir, True), _claims(spark, sf_dir, False))


@query("comparative", f"SELECT claim, severity, CASE WHEN a > 0 AND b > 0 THEN 'both' WHEN a > 0 THEN 'a' ELSE 'b' END AS unique_to FROM (SELECT claim, severity, sum(a) AS a, sum(b) AS b FROM (SELECT *, 1 AS a, 0 AS b FROM {_BEFORE} UNION ALL SELECT *, 0, 1 FROM {_AFTER}) GROUP BY 1, 2)")
def comparative(spark, sf_dir):
    from voxfield.operators.windows import comparative as compared

    return compared(_claims(spark, sf_dir, True), _claims(spark, sf_dir, False), "a", "b").fillna("both", ["unique_to"])


@query("ttl_lookup", "SELECT user_id, max(ts) AS recorded_at, arg_max(event_type, (ts, event_id)) AS result FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOUR GROUP BY 1")
def ttl_lookup(spark, sf_dir):
    fresh = table(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ '2024-01-30 00:00:00' - INTERVAL 24 HOUR")
    return fresh.groupBy("user_id").agg(F.max("ts").alias("recorded_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("result"))


@query("citation_numbers", "SELECT conv_id, text, dense_rank() OVER (PARTITION BY conv_id ORDER BY first_turn, text)::INTEGER AS citation FROM (SELECT conv_id, text, min(turn) AS first_turn FROM conversations GROUP BY 1, 2)")
def citation_numbers(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").groupBy("conv_id", "text").agg(F.min("turn").alias("first_turn"))
    return first.select("conv_id", "text", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("first_turn", "text")).alias("citation"))


@query("persona_journey", "SELECT p.user_id AS persona_id, p.n AS claims, j.n AS stages FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) p LEFT JOIN (SELECT user_id, count(DISTINCT event_type) AS n FROM events WHERE value > 95 GROUP BY 1) j USING (user_id)")
def persona_journey(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    p = events.where("event_type = 'view'").groupBy(F.col("user_id").alias("persona_id")).agg(F.count("*").alias("claims"))
    j = events.where("value > 95").groupBy(F.col("user_id").alias("persona_id")).agg(F.countDistinct("event_type").alias("stages"))
    return p.join(j, "persona_id", "left")


@query("persona_rows", "SELECT persona_id, field, string_agg(claim, ' | ' ORDER BY pos, claim) AS claims FROM (SELECT conv_id AS persona_id, role AS field, turn AS pos, text AS claim FROM conversations) GROUP BY 1, 2")
def persona_rows(spark, sf_dir):
    from voxfield.sinks.csv import persona_rows as rows

    return rows(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("persona_id"), F.col("role").alias("field"), F.col("turn").alias("pos"), F.col("text").alias("claim")))


@query("region_rollup", "SELECT r_name, n_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)")
def region_rollup(spark, sf_dir):
    r, n, s = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("order_cost", "SELECT c_mktsegment, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def order_cost(spark, sf_dir):
    c, o, x = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    # revenue by order first, so the joins see one row an order
    by_order = x.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    rows = by_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("r"), 2).alias("revenue"))
