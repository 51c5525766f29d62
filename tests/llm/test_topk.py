"""Exact search against plain Python."""

import math
import random

from pyspark.sql import functions as F

from voxfield.llm import topk

SCHEMA = "vec_id long, embedding array<double>, score string, rank long"


def brute(rows, k, is_query):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in ok if is_query(i)}:
        best = sorted(((-sum(x * y for x, y in zip(a, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(a)))[:k]
        out |= {(q, r + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(best)}
    return out


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "clash", 9) for i, v in rows], SCHEMA).repartition(3)
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, **kw).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows, kw.get("k", 5), lambda i: i % 5 == 0)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # many ties
    rows += [(2000 + i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(12)]  # another length
    check(spark, rows, shard=50, block=16)
    check(spark, rows, shard=10_000, k=7)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (5, None), (10, []), (15, [nan, 1.0]), (20, [inf, 1.0]), (25, [None, 1.0]), (None, [1.0, 1.0]), (3, [0.5, -0.001]), (3, [0.5, -0.001]), (4, [1e12, -1e12]), (30, [1e12, 1e13])]
    check(spark, rows)
    check(spark, [(0, [1.0])])
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0).count() == 0


def test_beyond_doubles(spark):
    """Components that the scale takes beyond a double count as the largest one."""
    top = 1.7976931348623157e308
    df = spark.createDataFrame([(0, [1e308, 0.0], "c", 1), (1, [0.0, 2.0], "c", 1), (2, [1e308, 1.0], "c", 1), (5, [0.25, 0.25], "c", 1)], SCHEMA)
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(df, F.col("vec_id") % 5 == 0).collect()}
    assert got[0, 1] == 0 and got[0, 2] == (1 << 63) - 1 and got[5, 1] == 64 * 512 and got[5, 2] == min((1 << 63) - 1, int(top))


def test_wide_numbers_are_exact():
    import numpy as np

    rng = random.Random(4)
    q, x = ([[float(rng.randint(-(1 << 40), 1 << 40)) for _ in range(3)] for _ in range(n)] for n in (3, 20))
    got = topk.tile_top(np.array([100, 101, 4]), np.array(q), np.arange(20), np.array(x), 4)
    clamp = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for i, (a, row) in enumerate(zip(q, got, strict=True)):
        want = sorted((-clamp(sum(int(u) * int(v) for u, v in zip(a, b, strict=True))), j) for j, b in enumerate(x) if i < 2 or j != 4)[:4]
        assert row == [(-s, j) for s, j in want]
