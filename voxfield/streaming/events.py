"""The run-event log as a stream: file source, watermarks, keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """A folder of Parquet files as a stream; naive times become timestamps, as watermarks need."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, keys: list[str], lateness: str = "7 days") -> DataFrame:
    """The first event of each key within the watermark; state is dropped behind it."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def tumbling_weeks(events: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Counts for each week from Monday (the epoch was a Thursday, hence the offset)."""
    week = F.window("ts", "7 days", "7 days", "4 days")
    return events.withWatermark("ts", lateness).groupBy(week.alias("w")).agg(F.count("*").alias("post_count"), F.count_if(F.col("event_type") == "error").alias("complaint_count")).select(F.col("w.start").alias("start_ts"), "post_count", "complaint_count")


def sliding(events: DataFrame, length: str = "1 day", slide: str = "6 hours", lateness: str = "7 days") -> DataFrame:
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start_ts"), "n")


def sessions(events: DataFrame, gap: str = "2 hours", lateness: str = "7 days") -> DataFrame:
    return events.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what there is and returns what its table holds then. In complete mode a batch holds the whole result, so only the last one is kept."""
    spark = stream.sparkSession
    table = f"{checkpoint}/table"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/_batch={number}")  # a batch that is tried again replaces itself
        if mode == "complete" and number:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/_batch={number - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    q = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.parquet(table)


def append_jsonl(stream: DataFrame, path: str, checkpoint: str):
    """The log as JSON lines, each event once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_state(batch: DataFrame, table: str, keys: list[str], newest: str) -> None:
    """For foreachBatch: merges a batch into a Parquet table of the newest row of each key. The old table is set aside until the new one is in
    place; a run that was cut off in between finds it there, and merging a batch again changes nothing. That needs a file system whose rename is atomic: object stores have
    none, there `runs.parquet_sink` and an upsert over its batches do."""
    from voxfield.sinks.csv import upsert

    spark = batch.sparkSession
    jvm = spark._jvm
    path, old, fresh = (jvm.org.apache.hadoop.fs.Path(table + x) for x in ("", "-old", "-next"))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) and fs.exists(old):
        fs.rename(old, path)
    new = batch if not fs.exists(path) else upsert(spark.read.parquet(table), batch, keys, newest)
    new.write.mode("overwrite").parquet(table + "-next")
    fs.delete(old, True)
    if fs.exists(path):
        fs.rename(path, old)
    fs.rename(fresh, path)
    fs.delete(old, True)
