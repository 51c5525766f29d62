"""Queries of the feed parsers: replies are written from the documents and parsed back."""

from pyspark.sql import functions as F

from voxfield.plans.catalog import query, table
from voxfield.sources import feeds

_AT = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 600)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.col("text").alias("body"), F.timestamp_seconds(F.col("doc_id") * 600 + 1704067200).alias("at"))


def _label(c):
    return F.struct(c.cast("string").alias("label"))


def _plain(posts, *metrics):
    return posts.select("id", "title", "body", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), *[F.col("metrics")[m].alias(m) for m in metrics])


@query("feed_app_store", f"SELECT doc_id::VARCHAR AS id, 'by ' || source AS title, text AS body, {_AT} AS posted_at, doc_id % 5 + 1 AS rating, n_chars AS vote_sum FROM documents WHERE {_AT} >= TIMESTAMP '2024-01-03 00:00:00'")
def feed_app_store(spark, sf_dir):
    entry = F.struct(
        _label(F.col("doc_id")).alias("id"), F.struct(_label(F.col("source")).alias("name")).alias("author"), _label(F.concat(F.lit("by "), "source")).alias("title"), _label(F.col("body")).alias("content"),
        _label(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("updated"), _label(F.col("doc_id") % 5 + 1).alias("im:rating"), _label(F.col("n_chars")).alias("im:voteSum"),
    )
    about = F.struct(_label(F.lit("app")).alias("id"), F.lit(None).cast("struct<name: struct<label: string>>").alias("author"), *[F.lit(None).cast("struct<label: string>").alias(c) for c in ("title", "content", "updated", "im:rating", "im:voteSum")])
    pages = _docs(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 50).alias("page")).agg(F.collect_list(entry).alias("e"))
    replies = pages.select(F.to_json(F.struct(F.struct(F.concat(F.array(about), "e").alias("entry")).alias("feed"))).alias("reply"))
    return _plain(feeds.app_store(replies, "reply", "hk", "zh-HK", "2024-01-03 00:00:00"), "rating", "vote_sum")


@query("feed_reddit", f"SELECT doc_id::VARCHAR AS id, source AS title, trim(source || chr(10) || chr(10) || text) AS body, {_AT} AS posted_at, n_chars AS score FROM documents WHERE doc_id % 4 <> 0")
def feed_reddit(spark, sf_dir):
    item = F.struct(F.when(F.col("doc_id") % 4 == 0, "t1").otherwise("t3").alias("kind"), F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("body").alias("selftext"), F.unix_seconds("at").cast("double").alias("created_utc"), F.col("n_chars").alias("score")).alias("data"))
    pages = _docs(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 25).alias("page")).agg(F.collect_list(item).alias("c"))
    replies = pages.select(F.to_json(F.struct(F.struct(F.col("c").alias("children")).alias("data"))).alias("reply"))
    return _plain(feeds.reddit(replies.union(replies), "reply", "HK"), "score")


@query("feed_dcard", f"SELECT doc_id::VARCHAR AS id, source AS title, text AS body, {_AT} AS posted_at, n_chars AS likes FROM documents")
def feed_dcard(spark, sf_dir):
    d = _docs(spark, sf_dir)
    post = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("body")).alias("content"), F.col("body").alias("excerpt"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("createdAt"), F.col("n_chars").alias("likeCount"))
    pages = d.groupBy(F.floor(F.col("doc_id") / 25).alias("page")).agg(F.collect_list(post).alias("c"))
    replies = pages.select(F.when(F.col("page") % 2 == 0, F.to_json("c")).otherwise(F.to_json(F.struct(F.col("c").alias("data")))).alias("reply"))
    return _plain(feeds.dcard(replies, "reply"), "likes")


@query("feed_medium", f"SELECT doc_id::VARCHAR AS id, source AS title, source || chr(10) || chr(10) || text AS body, {_AT} AS posted_at, n_chars AS claps, 'name of ' || source AS author FROM documents")
def feed_medium(spark, sf_dir):
    paragraphs = F.array(F.struct(F.lit(3).alias("type"), F.col("source").alias("text")), F.struct(F.lit(4000).alias("type"), F.lit("skipped").alias("text")), F.struct(F.lit(1).alias("type"), F.col("body").alias("text")))
    value = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("source").alias("creatorId"), F.unix_millis("at").alias("firstPublishedAt"), F.struct(F.struct(paragraphs.alias("paragraphs")).alias("bodyModel")).alias("content"), F.struct(F.col("n_chars").alias("totalClapCount")).alias("virtuals"))
    users = F.struct(F.create_map("source", F.struct(F.concat(F.lit("name of "), "source").alias("name"))).alias("User"))
    replies = _docs(spark, sf_dir).select(F.concat(F.lit("])}while(1);</x>"), F.to_json(F.struct(F.struct(value.alias("value"), users.alias("references")).alias("payload")))).alias("reply"))
    posts = feeds.medium(replies, "reply", "HK", "zh-HK")
    return posts.select("id", "title", "body", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), F.col("metrics")["claps"].alias("claps"), "author")


@query("feed_json_ld", "SELECT substr(sha256('u' || doc_id || '|' || source || '|2024-01-02|' || text), 1, 16) AS id, 'h' AS title, text AS body, TIMESTAMP '2024-01-02 00:00:00' AS posted_at, doc_id % 5 + 1 AS rating FROM documents")
def feed_json_ld(spark, sf_dir):
    review = F.struct(F.lit("h").alias("headline"), F.col("body").alias("reviewBody"), F.lit("2024-01-02").alias("datePublished"), F.struct(F.col("source").alias("name")).alias("author"), F.struct((F.col("doc_id") % 5 + 1).cast("string").alias("ratingValue")).alias("reviewRating"))
    html = F.concat(F.lit('<html><script type="application/ld+json">'), F.to_json(F.struct(F.array(review).alias("review"))), F.lit("</script>"))
    pages = _docs(spark, sf_dir).select(F.concat(F.lit("u"), "doc_id").alias("u"), html.alias("h"))
    return _plain(feeds.json_ld_reviews(pages, "h", "u", "trust", "HK", "en"), "rating")


@query("adaptive_min_size", "SELECT lang, count(*) AS posts, greatest(15, count(*) // 40) AS min_cluster_size, CASE WHEN count(*) < 50 THEN 'partial coverage' ELSE 'ok' END AS warning FROM documents GROUP BY 1")
def adaptive_min_size(spark, sf_dir):
    out = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("posts"))
    return out.select("lang", "posts", F.greatest(F.lit(15).cast("long"), F.floor(F.col("posts") / 40)).alias("min_cluster_size"), F.when(F.col("posts") < 50, "partial coverage").otherwise("ok").alias("warning"))


@query("schema_violations", "SELECT doc_id::VARCHAR AS id, 'signal_type' AS field, 'not in domain: ' || lang AS problem FROM documents UNION ALL SELECT doc_id::VARCHAR, 'url', 'missing' FROM documents WHERE doc_id % 3 = 0")
def schema_violations(spark, sf_dir):
    from voxfield.schema import violations

    known = {"id": F.col("doc_id").cast("string"), "source_category": F.lit("forums"), "url": F.when(F.col("doc_id") % 3 != 0, "u"), "signal_type": F.col("lang"), "body": F.col("text")}
    columns = ("id", "source", "source_category", "region", "language", "url", "author_hash", "body", "posted_at", "signal_type")
    return violations(table(spark, sf_dir, "documents").select(*[known.get(c, F.lit("x")).alias(c) for c in columns]))


@query("first_match", "SELECT user_id, min(event_id) FILTER (event_type = 'purchase') AS event_id FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'purchase') > 0")
def first_match(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("job_matrix", "SELECT source AS topic, v AS variant, p AS phase, row_number() OVER (PARTITION BY source ORDER BY p, v)::INTEGER AS job FROM (SELECT DISTINCT source FROM documents), (SELECT unnest(['', ' review', ' vs']) AS v), (SELECT unnest([1, 2]) AS p)")
def job_matrix(spark, sf_dir):
    from pyspark.sql import Window

    topics = table(spark, sf_dir, "documents").select(F.col("source").alias("topic")).distinct()
    jobs = topics.withColumn("variant", F.explode(F.array(F.lit(""), F.lit(" review"), F.lit(" vs")))).withColumn("phase", F.explode(F.array(F.lit(1), F.lit(2))))
    return jobs.withColumn("job", F.row_number().over(Window.partitionBy("topic").orderBy("phase", "variant")))
