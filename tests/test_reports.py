"""Reports, costs, and windows on small cases."""

import datetime as dt

from pyspark.sql import functions as F

from tests.test_operators import shuffled
from voxfield.operators import costs as C
from voxfield.operators import diagnostics as D
from voxfield.operators import windows as W

_M = "cluster string, doc_id string, source string, lang string, text string"


def report(spark, members, reps=(), words=(), **more):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    lines = D.report_lines(make(members, _M), make(reps, "cluster string, doc_id string, rank int"), make(words, "cluster string, term string, rank int"), "topic", "HK", **more)
    return [r.line for r in lines.orderBy(*[F.asc_nulls_first(c) for c in D.ORDER]).collect()]


def test_report(spark):
    members = [("a", f"p{k}", "s1", "zh", "x" * 201 if k == 0 else "one\ntwo") for k in range(9)] + [("a", "p9", "s2", None, None)] + [("b", f"q{k}", f"s{k % 2}", "en", "t") for k in range(4)] + [(None, f"n{k}", "s1", "en", "t") for k in range(6)]
    got = report(spark, members, [("a", "p0", 1), ("a", "p1", 2), ("a", "p9", 3), ("a", "p2", 4), ("b", "gone", 1)], [("a", f"w{k:02}", k) for k in range(1, 13)])
    assert got == [
        "# Cluster Diagnostics — topic (HK)", "", "Total posts: 20", "Clusters found: 2", "Noise (unclustered): 6 (30.0%)", "",
        "## 1. Cluster Sizes", "", "Range: 4 – 10", "```", "  " + "█" * 40 + " 10", "  " + "█" * 16 + " 4", "```", "", "## 2. Cluster Details", "",
        "### Cluster a — size 10", "", "**Keywords:** " + ", ".join(f"w{k:02}" for k in range(1, 11)), "", "**Representative posts:**", "1. `p0`: " + "x" * 200 + "…", "2. `p1`: one two", "3. `p9`: ", "",
        "**Source distribution:**", "  - s1: 9 (90.0%)", "    ⚠ This cluster is >80% from one source — bias risk", "  - s2: 1 (10.0%)", "", "**Language distribution:**", "  - zh: 9", "",
        "### Cluster b — size 4", "", "**Representative posts:**", "1. `gone`: ", "", "**Source distribution:**", "  - s0: 2 (50.0%)", "  - s1: 2 (50.0%)", "", "**Language distribution:**", "  - en: 4", "",
        "## 3. Parameter Suggestions", "", "✓ Noise ratio (30.0%) is in a healthy range (5–40%).", "",
    ]


def test_report_without_clusters(spark, tmp_path):
    got = report(spark, [(None, "n", None, None, None)], least=5)
    assert "No clusters found — all posts classified as noise." in got and "```" not in got and "  - Lowering the least cluster size (current: 5)" in got
    low = report(spark, [("a", "n", None, None, None)])
    assert "ℹ Noise ratio is low (0.0%). Consider:" in low and "Noise (unclustered): 0 (0.0%)" in report(spark, [])
    lines = D.report_lines(*[spark.createDataFrame([], s) for s in (_M, "cluster string, doc_id string, rank int", "cluster string, term string, rank int")], "t", "r")
    D.write_report(lines, str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()][0] == "# Cluster Diagnostics — t (r)"


def test_report_moves_only_the_texts_it_shows(spark, tmp_path):
    """Where the clusters of documents are too many to broadcast, other texts stay where they are."""
    text = F.concat_ws("", *[F.sha2(F.concat(F.col("id"), F.lit(f"-{i}")).cast("binary"), 256) for i in range(30)])
    spark.range(6000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang")).write.parquet(f"{tmp_path}/documents")
    spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("cluster")).write.parquet(f"{tmp_path}/ids")
    members = spark.read.parquet(f"{tmp_path}/documents").join(spark.read.parquet(f"{tmp_path}/ids"), "doc_id")
    reps = spark.createDataFrame([(c, 2 * r + c, r) for c in (0, 1) for r in (1, 2, 3, 4)] + [(0, 9000, 3)], "cluster long, doc_id long, rank int")
    words = spark.createDataFrame([(0, "w", 1)], "cluster long, term string, rank int")
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "16000")
    try:
        rows = []
        moved = shuffled(spark, lambda: rows.extend(D.report_lines(members, reps, words, "topic", "HK").collect()))
    finally:
        spark.conf.set(key, old)
    shown = sorted((r.cluster, r.pos, r.line.split("`: ")[1][-1:], r.line.split("`")[1]) for r in rows if r.part == 2 and r.block == 3)
    assert shown == sorted([(str(c), k, "…", str(2 * k + c)) for c in (0, 1) for k in (1, 2, 3)] + [("0", 3, "", "9000")])
    assert moved < 1_000_000  # the texts are 11.5 MB


def test_costs(spark):
    packs = spark.createDataFrame([("a", "x" * 36, 9), ("b", None, 2)], "k string, block string, size int")
    rows = {r.k: r for r in C.estimated_usage(packs, "k", "block", "size").collect()}
    assert tuple(rows["a"])[1:] == (10, 910, 10, 10, 3700) and rows["b"].evidence_tokens == 360
    use = spark.createDataFrame([("p", 1_000_000, None, 500_000, 10), ("p", 1, 2, 3, None), ("q", 1, 1, 1, 1)], "provider string, " + ", ".join(f"{t} long" for t in C.TOKENS))
    prices = spark.createDataFrame([("p", 3.0, 0.3, 4.0, 15.0)], "provider string, " + ", ".join(f"{p} double" for p in C.PRICES))
    got = {r.provider: r for r in C.usage_cost(use, prices).collect()}
    assert (got["p"].input_tokens, got["p"].cached_input_tokens, got["p"].cost_usd, got["q"].cost_usd) == (1_000_001, 2, 5.000166, None)


def test_windows_overlap_or_leave_a_gap(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    at = lambda n: F.lit(day(n)).cast("timestamp_ntz")
    posts = spark.createDataFrame([("a", k, day(k)) for k in range(1, 9)] + [("b", 20, day(5)), ("b", 21, None)], "cluster string, doc_id int, ts timestamp_ntz")
    sides = lambda before, after: sorted((r.side, r.doc_id) for r in W.window_members(posts, "ts", at(before), at(after)).collect())
    assert sides(5, 5) == [("after", k) for k in (5, 6, 7, 8, 20)] + [("before", k) for k in (1, 2, 3, 4)]
    assert sides(3, 8) == [("after", 8), ("before", 1), ("before", 2)] and len(sides(7, 3)) == 14
    reps = spark.createDataFrame([("a", 2, 1), ("a", 7, 2), ("a", 1, 3), ("b", 21, 1)], "cluster string, doc_id int, rank int")
    sizes, kept = W.window_clusters(W.window_members(posts, "ts", at(5), at(5)), reps)
    assert sorted(tuple(r) for r in sizes.collect()) == [("after", "a", 4), ("after", "b", 1), ("before", "a", 4)]
    assert sorted(tuple(r) for r in kept.collect()) == [("after", "a", 7, 1, True), ("after", "b", 21, 1, False), ("before", "a", 1, 2, True), ("before", "a", 2, 1, True)]
    assert [spark.range(1).select(W.window_label(s, at(5))).first()[0] for s in W.SIDES] == ["Before 2024-01-05", "After 2024-01-05"]


def test_shifts_and_topics(spark):
    one, two = (spark.createDataFrame(rows, "claim string, severity string") for rows in ([("x", "high"), ("y", "unspecified"), ("y", "unspecified")], [("x", "low"), ("y", "unspecified"), ("z", "low")]))
    assert sorted(tuple(r) for r in W.shifts(one, two, "claim").collect()) == [("x", "persisted"), ("y", "persisted"), ("z", "emerged")]
    assert W.shift_summary(W.shifts(one, two, "claim")).first()[0] == "1 new pain points emerged. 2 pain points persisted."
    assert W.shift_summary(W.shifts(one.limit(0), two.limit(0), "claim")).first()[0] == "No significant shifts detected."
    both = W.comparative(one, two, "A", "B")
    assert sorted(map(repr, map(tuple, both.collect()))) == sorted(map(repr, [("x", "high", "A"), ("x", "low", "B"), ("y", "unspecified", None), ("z", "low", "B")]))
    assert W.comparative_summary(both, "A", "B").first()[0] == "1 pain points shared across both topics. 1 pain points unique to A. 2 pain points unique to B."
    assert W.comparative_summary(both.limit(0), "A", "B").first()[0] == "No pain points identified in either topic."


def test_said_dates(spark):
    from voxfield.functions.time import said_date

    now = dt.datetime(2026, 5, 1, 12)
    said = {"3 days ago": now - dt.timedelta(3), "2hours ago": now - dt.timedelta(hours=2), "1 MONTH ago": now - dt.timedelta(30), "Yesterday": now - dt.timedelta(1), " today ": now, "2024-01-15": dt.datetime(2024, 1, 15), "15 jan 2024": dt.datetime(2024, 1, 15), "15 January 2024": dt.datetime(2024, 1, 15), "JAN 15, 2024": dt.datetime(2024, 1, 15), "soon": None, "": None}
    rows = spark.createDataFrame([(k,) for k in said], "s string")
    assert {r.s: r.t for r in rows.select("s", said_date(F.col("s"), F.lit(now).cast("timestamp_ntz")).alias("t")).collect()} == said


def test_runs_order_and_jobs(spark, tmp_path):
    from voxfield.operators import posts as O
    from voxfield.sinks.csv import write_comparison

    rows = spark.createDataFrame([("r1", "p1", 2), ("r1", "p2", 1), ("r2", "p1", None)], "run_id string, persona_id string, at int")
    assert (O.of_run(rows).count(), O.of_run(rows, "r1").count(), O.of_run(rows, "r1", "p1").count(), O.of_run(rows, None, "p1").count()) == (3, 2, 1, 2)
    assert [r.at for r in O.in_time_order(rows, "at", "persona_id").collect()] == [1, 2, None] and [r.at for r in O.in_time_order(rows, "at", "persona_id", 1).collect()] == [1]
    jobs = spark.createDataFrame([("HK", ["a", "b", "a"], "t", {"x": "1"}), ("TW", [], "t", {})], "region string, sources array<string>, topic string, extra map<string,string>")
    known = spark.createDataFrame([("a", "HK"), ("b", "TW")], "source string, region string")
    assert sorted((r.region, r.source, r.limit, r.known) for r in O.batch_jobs(jobs, known, 5).collect()) == [("HK", "a", 5, True), ("HK", "b", 5, False)]
    one = spark.createDataFrame([("x",)], "claim string")
    changed = W.shifts(one, one, "claim")
    write_comparison(str(tmp_path / "c"), one.withColumn("side", F.lit("before")), changed, W.shift_summary(changed), {"topic": "t", "region": "HK"})
    line = spark.read.json(str(tmp_path / "c" / "comparison")).first()
    assert (line.topic, line.summary) == ("t", "1 pain points persisted.") and spark.read.json(str(tmp_path / "c" / "personas")).first().side == "before"
