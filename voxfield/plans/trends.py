"""Time-series queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxfield.functions.time import iso_week, month
from voxfield.operators import trends as T
from voxfield.plans.catalog import query, table

_AGG = """min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS post_count, count(*) FILTER (event_type = 'error') AS complaint_count,
       round(-1.0 * count(*) FILTER (event_type = 'error') / count(*), 3) AS sentiment_score"""


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("ts", (F.col("event_type") == "error").alias("complaint"))


@query("weekly_trend", f"SELECT strftime(ts, '%G-W%V') AS bucket, {_AGG} FROM events WHERE ts IS NOT NULL GROUP BY 1")
def weekly_trend(spark, sf_dir):
    return T.bucket_trend(_events(spark, sf_dir), iso_week(F.col("ts")), "ts", "complaint")


@query("monthly_trend", f"SELECT strftime(ts, '%Y-%m') AS bucket, {_AGG} FROM events WHERE ts IS NOT NULL GROUP BY 1")
def monthly_trend(spark, sf_dir):
    return T.bucket_trend(_events(spark, sf_dir), month(F.col("ts")), "ts", "complaint")


_DAYS = "(SELECT strftime(ts, '%Y-%m-%d %H') AS bucket, count(*) AS post_count FROM events WHERE event_type = 'error' GROUP BY 1)"


def _hours(spark, sf_dir):
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select("ts", F.lit(True).alias("complaint"))
    return T.bucket_trend(errors, F.date_format("ts", "yyyy-MM-dd HH"), "ts", "complaint")


@query("spikes", f"SELECT bucket, post_count FROM {_DAYS} WHERE post_count >= (SELECT greatest(2 * median(post_count), 3) FROM {_DAYS}) AND (SELECT count(*) FROM {_DAYS}) >= 3")
def spikes(spark, sf_dir):
    return T.spikes(_hours(spark, sf_dir)).select("bucket", "post_count")


@query("series_span", "SELECT count(*) AS total_posts, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def series_span(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count("*").alias("total_posts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("bucket_delta", f"SELECT bucket, post_count, post_count - lag(post_count) OVER (ORDER BY bucket) AS delta, lead(post_count) OVER (ORDER BY bucket) AS next_count FROM {_DAYS}")
def bucket_delta(spark, sf_dir):
    w = Window.orderBy("bucket")  # over buckets, not over posts
    return _hours(spark, sf_dir).select("bucket", "post_count", (F.col("post_count") - F.lag("post_count").over(w)).alias("delta"), F.lead("post_count").over(w).alias("next_count"))


@query("cumulative_share", "SELECT source, n, round(sum(n) OVER (ORDER BY n DESC, source ROWS UNBOUNDED PRECEDING) / (sum(n) OVER ()), 4)::DOUBLE AS cum_share FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def cumulative_share(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    upto = Window.orderBy(F.desc("n"), "source").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("source", "n", F.round(F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy()), 4).alias("cum_share"))


@query("running_median", f"SELECT bucket, median(post_count) OVER (ORDER BY bucket ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS running_median FROM {_DAYS}")
def running_median(spark, sf_dir):
    w = Window.orderBy("bucket").rowsBetween(-6, 0)
    held = F.array_sort(F.collect_list("post_count").over(w))
    low = F.element_at(held, F.floor((F.size(held) + 1) / 2).cast("int"))
    high = F.element_at(held, F.floor(F.size(held) / 2 + 1).cast("int"))
    return _hours(spark, sf_dir).select("bucket", ((low + high) / 2).alias("running_median"))


@query("spline_controls", f"SELECT bucket, round(c + (nx - pv) / 6.0, 6)::DOUBLE AS c1, round(nx - (nn - c) / 6.0, 6)::DOUBLE AS c2 FROM (SELECT bucket, post_count AS c, coalesce(lag(post_count) OVER w, post_count) AS pv, coalesce(lead(post_count) OVER w, post_count) AS nx, coalesce(lead(post_count, 2) OVER w, lead(post_count) OVER w, post_count) AS nn FROM {_DAYS} WINDOW w AS (ORDER BY bucket))")
def spline_controls(spark, sf_dir):
    w = Window.orderBy("bucket")
    c = F.col("post_count")
    rows = _hours(spark, sf_dir).select("bucket", c, F.coalesce(F.lag(c).over(w), c).alias("pv"), F.coalesce(F.lead(c).over(w), c).alias("nx"), F.coalesce(F.lead(c, 2).over(w), F.lead(c).over(w), c).alias("nn"))
    return rows.select("bucket", F.round(c + (F.col("nx") - F.col("pv")) / 6.0, 6).alias("c1"), F.round(F.col("nx") - (F.col("nn") - c) / 6.0, 6).alias("c2"))


@query(
    "journey_emotion",
    """SELECT user_id AS journey, arg_max(event_type, (v, event_id)) AS emotion, round(40 + (1 - max(v)) * 200, 3)::DOUBLE AS y
       FROM (SELECT user_id, event_type, event_id, CASE WHEN event_type = 'error' THEN 1 - c WHEN event_type = 'view' THEN least(greatest(c, 0.3), 0.7) ELSE c END AS v FROM (SELECT *, least(greatest(value / 100, 0), 1) AS c FROM events)) GROUP BY 1""",
)
def journey_emotion(spark, sf_dir):
    c = F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0))
    v = F.when(F.col("event_type") == "error", 1 - c).when(F.col("event_type") == "view", F.least(F.greatest(c, F.lit(0.3)), F.lit(0.7))).otherwise(c)
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", v.alias("v"))
    return rows.groupBy(F.col("user_id").alias("journey")).agg(F.max_by("event_type", F.struct("v", "event_id")).alias("emotion"), F.round(40 + (1 - F.max("v")) * 200, 3).alias("y"))


@query("event_ids", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS seq FROM events")
def event_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"))


@query("terminal_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, bool_or(event_type = 'purchase') AS done FROM events GROUP BY 1")
def terminal_state(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.bool_or(F.col("event_type") == "purchase").alias("done"))


@query("stage_latest", "SELECT user_id, event_type AS stage, arg_max(value, (ts, event_id)) AS pct, arg_min(event_id, (ts, event_id)) AS first_id FROM events GROUP BY 1, 2")
def stage_latest(spark, sf_dir):
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("stage")).agg(F.max_by("value", at).alias("pct"), F.min_by("event_id", at).alias("first_id"))


@query("progress_pct", "SELECT user_id, event_id, round(100.0 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) / count(*) OVER (PARTITION BY user_id), 2)::DOUBLE AS pct FROM events")
def progress_pct(spark, sf_dir):
    w = Window.partitionBy("user_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(100.0 * F.row_number().over(w.orderBy("event_id")) / F.count("*").over(w), 2).alias("pct"))
