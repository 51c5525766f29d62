"""Keyed state of runs over several batches, and sinks that a failure meets between."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from voxfield.streaming import runs

SCHEMA = "run string, at timestamp, n bigint, kind string"


def put(spark, folder, k, rows):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    spark.createDataFrame([(r, at(n), n, kind) for r, n, kind in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "in")
    put(spark, path, 1, [("a", 2, "view"), ("a", 1, "start"), ("b", 3, "start")])
    put(spark, path, 2, [("b", 5, "view"), ("a", 4, "done"), ("a", 6, "late"), ("c", 7, "error"), ("c", 8, "late")])
    put(spark, path, 3, [("a", 9, "late"), ("b", 10, "view"), ("c", 11, "start")])
    return path


WANT = {("a", 1, 1), ("a", 2, 2), ("a", 4, 3), ("b", 3, 1), ("b", 5, 2), ("b", 10, 3), ("c", 7, 1)}


def rows(spark, path, read="parquet"):
    df = getattr(spark.read, read)(path)
    return sorted((r["run"], r["n"], r["seq"]) for r in df.collect())


def numbers(spark, folder):
    return runs.numbered(stream(spark, folder), "run", ["at", "n"], "kind", ["done", "error", "cancelled"], 3_600_000)


def test_a_batch_killed_between_two_sinks(spark, folder, tmp_path):
    """The second batch fails after the first sink has it. After a restart both sinks hold every event once."""
    first, second, failed = str(tmp_path / "one"), str(tmp_path / "two"), []

    def fails_once(batch, number):
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("killed")
        runs.parquet_sink(second)(batch, number)

    def start():
        runs.fan_out(numbers(spark, folder), [runs.json_sink(first), fails_once], str(tmp_path / "state"))

    with pytest.raises(Exception, match="killed"):
        start()
    assert len(rows(spark, first, "json")) > len(rows(spark, second))
    start()
    assert failed == [1] and set(rows(spark, first, "json")) == set(rows(spark, second)) == WANT
    assert len(rows(spark, first, "json")) == len(rows(spark, second)) == len(WANT)


def test_latest_stage(spark, folder, tmp_path):
    path = str(tmp_path / "out")
    out = runs.latest_stage(stream(spark, folder), "run", "at", "n", "kind", ["done", "error"])
    runs.fan_out(out, [runs.parquet_sink(path)], str(tmp_path / "state"), "update")
    last = spark.read.parquet(path).groupBy("run").agg(F.max_by(F.struct("last_type", "done"), "_batch").alias("x"))
    assert {(r["run"], *r["x"]) for r in last.collect()} == {("a", "late", True), ("b", "view", False), ("c", "start", True)}
