"""CSV and JSON exports of posts, personas and events. Writers go through Spark's committer, so a file is whole or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Columns of the posts export, in order.
POST_COLUMNS = ["id", "source", "source_category", "region", "language", "language_detected", "url", "author_hash", "title", "body", "posted_at", "signal_type", "engagement_metrics"]


def _text(posts: DataFrame, name: str) -> Column:
    if name not in posts.columns:
        return F.lit("")
    c, kind = F.col(name), posts.schema[name].dataType
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        zone = F.date_format(c, "XXX") if isinstance(kind, T.TimestampType) else F.lit("")
        c = F.concat(whole, F.when(F.extract(F.lit("SECOND"), c) % 1 == 0, "").otherwise(F.date_format(c, ".SSSSSS")), zone)
    elif isinstance(kind, T.MapType):
        name_of = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
        pairs = F.transform(F.map_entries(c), lambda x: F.concat(name_of(x["key"]), F.lit(": "), F.coalesce(x["value"].cast("string"), F.lit("null"))))
        c = F.when(F.size(c) > 0, F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")))
    return F.coalesce(c.cast("string"), F.lit(""))


def post_rows(posts: DataFrame) -> DataFrame:
    """The thirteen columns of the posts export as text. Nulls, columns that posts lack and empty metrics become empty; metrics become JSON, times ISO 8601
    in the session's zone, with a fraction only where there is one. Other columns stay out."""
    return posts.select(*[_text(posts, name).alias(name) for name in POST_COLUMNS])


def write_posts(posts: DataFrame, path: str) -> None:
    post_rows(posts).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def persona_rows(claims: DataFrame) -> DataFrame:
    """One row for each persona: the claims of each field in their order, joined by ' | '. claims: persona_id, field, pos, claim."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "claim")))
    return claims.groupBy("persona_id", "field").agg(F.concat_ws(" | ", F.transform(ordered, lambda x: x["claim"])).alias("claims"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """old and new rows with the newest of each key: what an INSERT OR REPLACE leaves. One hash aggregate; columns as in old."""
    rows = old.unionByName(new.select(*old.columns))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.col(newest)).alias("r")).select(*[F.col("r")[c].alias(c) for c in rows.columns])


def write_partitioned(rows: DataFrame, path: str, by: list[str]) -> None:
    """Parquet by partition; only the partitions in rows are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_partitions(spark: SparkSession, path: str, wanted: DataFrame, by: list[str]) -> DataFrame:
    """The rows of a table written by `write_partitioned` whose partition wanted has: the scan leaves out all others by the join's keys as it runs. Spark broadcasts the keys if they
    are small."""
    return spark.read.parquet(path).join(wanted.select(*by).distinct(), by)


def write_run(rows: DataFrame, path: str, run: dict[str, str], at: str) -> dict:
    """Writes the rows as JSON to path/records, then path/sidecar with what the run is, when it wrote and what it wrote: the number of rows and the first and last time, observed while they
    were written, not by a second pass. A task that is run again counts once. A reader that waits for the sidecar never sees half a run."""
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, F.count("*").alias("records_emitted"), F.min(at).cast("string").alias("first"), F.max(at).cast("string").alias("last")).write.mode("overwrite").json(f"{path}/records")
    meta = run | {k: v for k, v in seen.get.items() if v is not None}
    line = rows.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in meta.items()], F.current_timestamp().alias("finished_at"))
    line.coalesce(1).write.mode("overwrite").json(f"{path}/sidecar")
    return meta


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_comparison(path: str, personas: DataFrame, changed: DataFrame, summary: DataFrame, about: dict[str, str]) -> None:
    """A comparison as JSON: path/personas by side (records with `side`), path/changes, and last path/comparison, one line of what is compared, when, and the summary. A reader that waits
    for the last sees all of it. Personas stay rows, so a comparison of any size is written by its tasks."""
    personas.write.mode("overwrite").partitionBy("side").json(f"{path}/personas")
    changed.write.mode("overwrite").json(f"{path}/changes")
    line = summary.select(*[F.lit(v).alias(k) for k, v in about.items()], "summary", F.current_timestamp().alias("generated_at"))
    line.coalesce(1).write.mode("overwrite").json(f"{path}/comparison")
