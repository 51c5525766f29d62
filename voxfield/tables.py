"""Tables in the shared folder, which cut the lineage of loops: a lost executor costs a reread."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from voxfield.session import shared_folder

_made: dict[str, SparkSession] = {}


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back. `release` removes it; what is left goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables made by `written` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_table_path", None)
        if path and (spark := _made.pop(path, None)):
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _at_exit() -> None:
    for path, spark in _made.items():
        try:
            _remove(spark, path)
        except Exception:  # the session has ended; its folder is the cluster's to clear
            return
