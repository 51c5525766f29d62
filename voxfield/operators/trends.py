"""Bucketed trends: one hash aggregate, no window over raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_trend(posts: DataFrame, label: Column, ts: str, complaint: str) -> DataFrame:
    """Per label: observed first and last time, posts, complaints and sentiment = -complaints/posts (3 digits).
    Rows without a time are left out; empty buckets are not made up."""
    return (
        posts.where(F.col(ts).isNotNull())
        .groupBy(label.alias("bucket"))
        .agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("post_count"), F.count_if(F.col(complaint)).alias("complaint_count"))
        .withColumn("sentiment_score", F.round(-F.col("complaint_count") / F.col("post_count"), 3))
    )


def spikes(buckets: DataFrame, floor: int = 3) -> DataFrame:
    """Buckets of at least twice the median count and at least `floor`; none if there are fewer than three buckets.
    The median is a one-row aggregate of the buckets, not of the posts."""
    limit = buckets.agg(F.greatest(2 * F.median("post_count"), F.lit(floor)).alias("_limit"), F.count("*").alias("_n"))
    return buckets.join(F.broadcast(limit), (F.col("post_count") >= F.col("_limit")) & (F.col("_n") >= 3)).drop("_limit", "_n")
