"""Streaming queries, run over what there is (availableNow)."""

import uuid

from pyspark.sql import functions as F

from voxfield.plans.catalog import query, table
from voxfield.session import shared_folder
from voxfield.streaming import events as S
from voxfield.streaming import runs as R


def _stream(spark, sf_dir):
    # the table is one file; a stream reads folders, and a glob names it
    path = f"{sf_dir}/events.parquet*"
    return S.read_events(spark, path, table(spark, sf_dir, "events").schema)


def _once(spark, stream, name, mode):
    return S.run_once(stream, name, mode, f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}")


@query("stream_dedup", "SELECT user_id, event_type, 1::BIGINT AS kept FROM events GROUP BY 1, 2")
def stream_dedup(spark, sf_dir):
    out = _once(spark, S.deduplicated(_stream(spark, sf_dir), ["user_id", "event_type"], "60 days"), "stream_dedup", "append")
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("kept"))


@query("stream_tumbling", "SELECT date_trunc('week', ts)::TIMESTAMP AS start_ts, count(*) AS post_count, count(*) FILTER (event_type = 'error') AS complaint_count FROM events GROUP BY 1")
def stream_tumbling(spark, sf_dir):
    out = _once(spark, S.tumbling_weeks(_stream(spark, sf_dir)), "stream_tumbling", "complete")
    last = out.agg(F.max("_batch").alias("b"))
    return out.join(F.broadcast(last), F.col("_batch") == F.col("b")).select(F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), "post_count", "complaint_count")


@query("stream_sliding", "SELECT start_ts, count(*) AS n FROM (SELECT unnest(range(4)) AS k, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR AS start_ts FROM events) GROUP BY 1")
def stream_sliding(spark, sf_dir):
    out = _once(spark, S.sliding(_stream(spark, sf_dir)), "stream_sliding", "complete")
    last = out.agg(F.max("_batch").alias("b"))
    return out.join(F.broadcast(last), F.col("_batch") == F.col("b")).select(F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), "n")


@query(
    "stream_sessions",
    """SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 2 HOUR AS end_ts, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
       (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
)
def stream_sessions(spark, sf_dir):
    out = _once(spark, S.sessions(_stream(spark, sf_dir), lateness="60 days"), "stream_sessions", "complete")
    last = out.agg(F.max("_batch").alias("b"))
    return out.join(F.broadcast(last), F.col("_batch") == F.col("b")).select("user_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), "n")


@query("stream_terminal", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, bool_or(event_type = 'purchase') AS done FROM events GROUP BY 1")
def stream_terminal(spark, sf_dir):
    out = _once(spark, R.latest_stage(_stream(spark, sf_dir), "user_id", "ts", "event_id", "event_type", ["purchase"]), "stream_terminal", "update")
    return out.groupBy("user_id").agg(F.max_by(F.struct("last_type", "done"), "_batch").alias("x")).select("user_id", "x.last_type", "x.done")


@query(
    "stream_numbered",
    """SELECT user_id, event_id, seq, event_type FROM (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) WHERE ended = 0""",
)
def stream_numbered(spark, sf_dir):
    """Numbers a run's events up to its first purchase and hands the batches to two sinks; the rows are read back from the second."""
    top = f"{shared_folder(spark)}/stream-numbered-{uuid.uuid4().hex}"
    out = R.numbered(_stream(spark, sf_dir).select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type", ["purchase"])
    R.fan_out(out, [R.json_sink(f"{top}/log"), R.parquet_sink(f"{top}/table")], f"{top}/state")
    return spark.read.parquet(f"{top}/table").select("user_id", "event_id", "seq", "event_type")
