"""File scans: raw posts, event logs, the newest file of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxfield.schema import POST


def raw_posts(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Files of JSON arrays of posts, without the sidecars of their runs. Broken rows are kept apart in _corrupt, or fail the scan if strict."""
    schema = POST if strict else T.StructType([*POST.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where(~F.col("_metadata.file_name").endswith("._run.json"))


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of events; corrupt lines are skipped."""
    return spark.read.schema("id bigint, type string, data string").option("mode", "DROPMALFORMED").json(path).where("id is not null")


def newest(rows: DataFrame) -> DataFrame:
    """The rows of the last file by name."""
    named = rows.withColumn("_file", F.col("_metadata.file_path"))
    last = named.agg(F.max("_file").alias("_last"))
    return named.join(F.broadcast(last), F.col("_file") == F.col("_last")).drop("_file", "_last")


def last_changed(rows: DataFrame, by: str) -> DataFrame:
    """(by, changed): when the files of each group changed last."""
    return rows.select(by, F.col("_metadata.file_modification_time").alias("t")).groupBy(by).agg(F.max("t").alias("changed"))
