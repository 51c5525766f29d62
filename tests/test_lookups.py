"""Robots rules, cached lookups, merged personas, pruned partitions and the sidecar of a run on known cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from voxfield.operators import lookups
from voxfield.sinks import csv


def test_robots(spark):
    files = spark.createDataFrame(
        [("http://a.b", "User-agent: x\nDisallow: /x\nUser-agent: *\nDisallow: /p # c\nnonsense\nDisallow: /p/q\nDisallow:\n"), ("https://all", "user-AGENT: BOT\r\nDISALLOW: /"), ("http://none", None)],
        "host string, text string",
    )
    rules = lookups.robots_rules(files, "host", "text", "bot")
    assert {tuple(r) for r in rules.collect()} == {("http://a.b", "/p"), ("http://a.b", "/p/q"), ("https://all", "/")}
    urls = ["http://a.b/p/q/r?x=/x", "http://A.b/pp", "http://a.b/x", "http://a.b:80/P", "https://all", "https://all/k", "http://none/p", "http://other/p", "no address", None, "http://a.b/x"]
    got = {r["url"]: r["rule"] for r in lookups.robots_check(spark.createDataFrame([(u,) for u in urls], "url string"), "url", rules).collect()}
    assert got == {"http://a.b/p/q/r?x=/x": "/p/q", "http://A.b/pp": "/p", "http://a.b/x": None, "http://a.b:80/P": None, "https://all": "/", "https://all/k": "/", "http://none/p": None, "http://other/p": None, "no address": None}


def test_cached(spark):
    """Hits up to the lifetime, over a bucket's edge too; older entries are expired, later ones not seen; the newest wins; no entry is a miss."""
    day = dt.datetime(2026, 1, 1)
    s = lambda n: day + dt.timedelta(seconds=n)
    cache = spark.createDataFrame([("a", s(10), "one"), ("a", s(95), "two"), ("b", s(50), None), ("c", s(500), "late")], "k string, recorded_at timestamp, result string")
    asked = [("a", 9, "miss", None), ("a", 10, "hit", "one"), ("a", 110, "hit", "two"), ("a", 195, "hit", "two"), ("a", 196, "expired", None), ("b", 149, "hit", None), ("c", 400, "miss", None), ("d", 1, "miss", None), (None, 1, "miss", None)]
    requests = spark.createDataFrame([(k, s(n), n) for k, n, *_ in asked], "k string, at timestamp, n int")
    got = {(r["k"], r["n"]): (r["status"], r["result"]) for r in lookups.cached(requests, cache, "k", "at", 100).collect()}
    assert got == {(k, n): (status, result) for k, n, status, result in asked}
    # the next run's replies go in by upsert, of one key and time the newest
    more = csv.upsert(cache, requests.where("k = 'd'").select("k", F.col("at").alias("recorded_at"), F.lit("new").alias("result")), ["k", "recorded_at"], "result")
    assert lookups.cached(requests.where("k = 'd'"), more, "k", "at", 100).first()["result"] == "new"


def test_merged_personas(spark):
    from voxfield.operators.personas import merged_personas

    rows = [(1, [1.0, 0.0], ["a"]), (2, [5.0, 0.5], ["b", "a"]), (3, [0.0, 2.0], ["c"]), (4, [2.0, 1.2], None), (5, [0.0, 0.0], ["z"]), (6, None, ["y"])]
    got = {r["id"]: (r["merged"], r["claims"]) for r in merged_personas(spark.createDataFrame(rows, "id int, v array<double>, claims array<string>"), "id", "v", "claims").collect()}
    assert got == {1: ([1, 2, 4], ["a", "b"]), 3: ([3], ["c"]), 5: ([5], ["z"]), 6: ([6], ["y"])}  # 4 is near 2 only


def test_partitions_are_pruned_as_the_query_runs(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(60).select(F.col("id"), (F.col("id") % 6).alias("topic"), F.when(F.col("id") % 2 == 0, "HK").otherwise("US").alias("region"))
    csv.write_partitioned(rows, path, ["topic", "region"])
    csv.write_partitioned(rows.where("topic = 3").withColumn("id", -F.col("id")), path, ["topic", "region"])  # replaces its own partition only
    dimension = str(tmp_path / "d")
    spark.createDataFrame([(3, "x"), (4, "y")], "topic bigint, name string").write.parquet(dimension)
    out = csv.read_partitions(spark, path, spark.read.parquet(dimension).where("name = 'x'"), ["topic"])
    assert sorted(r["id"] for r in out.collect()) == sorted(-k for k in range(60) if k % 6 == 3)
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString()


def test_a_run_has_its_sidecar(spark, tmp_path):
    path = str(tmp_path / "run")
    posts = spark.range(25).select("id", F.timestamp_seconds(F.col("id") * 60).alias("posted_at")).repartition(3)
    meta = csv.write_run(posts, path, {"source": "s", "region": "HK"}, "posted_at")
    side = json.loads(next(p for p in (tmp_path / "run" / "sidecar").glob("part-*")).read_text())
    assert side["records_emitted"] == meta["records_emitted"] == 25 and side["source"] == "s" and side["first"] == "1970-01-01 00:00:00" and side["last"] == "1970-01-01 00:24:00" and "finished_at" in side
    assert spark.read.json(f"{path}/records").count() == 25
    boom = posts.withColumn("x", F.when(F.col("id") == 20, F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        csv.write_run(boom, str(tmp_path / "other"), {"source": "s"}, "posted_at")
    assert not (tmp_path / "other" / "sidecar").exists()
    assert csv.write_run(posts.limit(0), str(tmp_path / "none"), {"source": "s"}, "posted_at")["records_emitted"] == 0
