"""The same topic in two windows of time, and two topics side by side: clusters as a window sees them, and what changed in their claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDES = ("before", "after")


def window_label(side: str, cutoff: Column) -> Column:
    """`Before 2024-01-20` or `After 2024-01-20`."""
    return F.concat(F.lit(f"{side.capitalize()} "), F.date_format(cutoff, "yyyy-MM-dd"))


def window_members(members: DataFrame, at: str, before: Column, after: Column) -> DataFrame:
    """members with `side`: those earlier than `before` and those not earlier than `after`. With before later than after a row is in both windows, with a gap some are in none; rows
    without a time are in none. One pass, no shuffle."""
    sides = F.array_compact(F.array(F.when(F.col(at) < before, F.lit(SIDES[0])), F.when(F.col(at) >= after, F.lit(SIDES[1]))))
    return members.select("*", F.explode(sides).alias("side"))


def window_clusters(windowed: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """windowed (side, cluster, doc_id) and reps (cluster, doc_id, rank) -> the clusters (side, cluster, size) that have members in a window, and their representatives
    (side, cluster, doc_id, rank, inside): those in the window, ranked anew, or all of the cluster's own where none is."""
    sizes = windowed.groupBy("side", "cluster").agg(F.count("*").alias("size"))
    inside = windowed.select("side", "cluster", "doc_id", F.lit(True).alias("inside")).distinct()
    # a row for each representative and window of its cluster, so the window below sees ten rows a side
    of = sizes.select("side", "cluster").join(reps, "cluster").join(inside, ["side", "cluster", "doc_id"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    group = Window.partitionBy("side", "cluster")
    kept = of.withColumn("_any", F.bool_or("inside").over(group)).where("inside or not _any")
    return sizes, kept.select("side", "cluster", "doc_id", F.row_number().over(group.orderBy("rank", "doc_id")).alias("rank"), "inside")


def pain_points(personas: DataFrame, field: str = "pain_points") -> DataFrame:
    """(claim, severity) of a field of persona records, each once; a severity that is missing or empty is `unspecified`."""
    claims = personas.select(F.explode(F.col(field)["claims"]).alias("c"))
    return claims.select("c.claim", F.coalesce(F.nullif("c.severity", F.lit("")), F.lit("unspecified")).alias("severity")).distinct()


def shifts(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """(keys, change) of the distinct claims of two windows: resolved, emerged or persisted. One aggregate over both sides."""
    both = before.select(*keys, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(*keys, F.lit(0).alias("b"), F.lit(1).alias("a")))
    seen = both.groupBy(*keys).agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return seen.select(*keys, F.when(F.col("b") < F.col("a"), "emerged").when(F.col("b") > F.col("a"), "resolved").otherwise("persisted").alias("change"))


def shift_summary(changed: DataFrame) -> DataFrame:
    """One row, `summary`: how many pain points emerged, were resolved and persisted, zeros left out."""
    n = {k: F.count_if(F.col("change") == k) for k in ("emerged", "resolved", "persisted")}
    parts = [F.when(n[k] > 0, F.concat(n[k], F.lit(f" {words}."))) for k, words in (("emerged", "new pain points emerged"), ("resolved", "pain points resolved"), ("persisted", "pain points persisted"))]
    said = F.concat_ws(" ", *parts)
    return changed.agg(F.when(said == "", "No significant shifts detected.").otherwise(said).alias("summary"))


def comparative(a: DataFrame, b: DataFrame, topic_a: str, topic_b: str) -> DataFrame:
    """(claim, severity, unique_to) of the pain points of two topics: null for those that both have."""
    change = F.col("change")
    return shifts(a, b, "claim", "severity").select("claim", "severity", F.when(change == "resolved", topic_a).when(change == "emerged", topic_b).alias("unique_to"))


def comparative_summary(compared: DataFrame, topic_a: str, topic_b: str) -> DataFrame:
    """One row, `summary`: how many are shared, and how many each topic has alone, zeros left out."""
    own = F.col("unique_to")
    counts = [(F.count_if(own.isNull()), "pain points shared across both topics"), *[(F.count_if(own == t), f"pain points unique to {t}") for t in (topic_a, topic_b)]]
    said = F.concat_ws(" ", *[F.when(n > 0, F.concat(n, F.lit(f" {words}."))) for n, words in counts])
    return compared.agg(F.when(said == "", "No pain points identified in either topic.").otherwise(said).alias("summary"))
