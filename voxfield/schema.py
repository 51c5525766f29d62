"""Schemas and closed domains of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed domains.
DOMAINS = {
    "source_category": ["forums", "reviews", "social", "video_comments", "qa", "blogs", "news_comments"],
    "signal_type": ["opinion", "experience", "comparison", "complaint", "recommendation"],
}

REPLY = "struct<id: string, author_hash: string, body: string, posted_at: timestamp, language_detected: string, parent_reply_id: string, engagement_metrics: map<string, bigint>, raw_metadata: string>"
POST = T.StructType.fromDDL(
    f"""id string, source string, source_category string, region string, language string, language_detected string, url string, author_hash string, title string, body string,
    posted_at timestamp, signal_type string, engagement_metrics map<string, bigint>, replies array<{REPLY}>, raw_metadata string"""
)
REQUIRED = ("id", "source", "source_category", "region", "language", "url", "author_hash", "body", "posted_at", "signal_type")


def violations(posts: DataFrame) -> DataFrame:
    """(id, field, problem): required fields that are null, and values outside their domain."""
    checks = [F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("field"), F.lit("missing").alias("problem"))) for c in REQUIRED]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(v), F.struct(F.lit(c).alias("field"), F.concat(F.lit("not in domain: "), F.col(c)).alias("problem"))) for c, v in DOMAINS.items()]
    return posts.select("id", F.explode(F.array_compact(F.array(*checks))).alias("x")).select("id", "x.field", "x.problem")


def flat_replies(posts: DataFrame) -> DataFrame:
    """(post_id, reply columns): a row for each reply; posts without any have none."""
    return posts.select(F.col("id").alias("post_id"), F.explode("replies").alias("r")).select("post_id", "r.*")
