"""Connected components of links by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield.tables import release, written

SALTS = 8
EDGES = 1 << 19


def spread_join(rows: DataFrame, small: DataFrame, on: str, key: str, how: str = "left") -> DataFrame:
    """rows joined with small, which has one row for each key: rows of one key go to SALTS tasks, as a few keys may hold most rows."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    each = small.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(each, (salted[on] == each[key]) & (salted["_salt"] == each["_s"]), how).drop("_salt", "_s", key)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every EDGES links of a partition those of a star for each of their components, which say the same."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        up: dict = {}

        def find(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for batch in held:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        found = [(find(x), x) for x in up]
        ends = [pa.array([p[k] for p in found if p[0] != p[1]], held[0].schema.field(0).type) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(ends, ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= EDGES:
            yield stars(held)
            held, n = [], 0
    if held:
        yield stars(held)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of each node of a link; a component is named by its smallest node. Links that are null or lead to themselves say nothing.

    At each level every node points to the neighbour (or itself) that comes first in an order by hash, which is another at each level, and pointed-at nodes
    take the place of those that point. That leaves a part of the nodes, on paths and stars alike, so levels are as many as the logarithm of the nodes. The minimum is
    an aggregate with partial sums, joins are spread, and each level is a written table: no group of links comes together in one task. Before a level each task
    replaces the links it holds by stars, EDGES at a time."""
    kind = links.schema[a].dataType.simpleString()
    ends = links.select(F.col(a).alias("a"), F.col(b).cast(kind).alias("b")).where("a is not null and b is not null and a <> b")
    edges = written(ends.mapInArrow(_forest, f"a {kind}, b {kind}").distinct())
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(levels))).alias("h"), F.col(c).alias("n"))
        parents = written(both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least(order("a"), F.col("m"))["n"].alias("parent")))
        levels.append(parents)
        left = spread_join(edges, parents.select("node", F.col("parent").alias("pa")), "a", "node")
        right = spread_join(left.select("pa", "b"), parents.select("node", F.col("parent").alias("pb")), "b", "node")
        following = written(right.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).mapInArrow(_forest, f"a {kind}, b {kind}").distinct())
        release(edges)
        edges = following
    release(edges)
    if not levels:
        return links.select(F.col(a).alias("node"), F.col(a).alias("component")).limit(0)
    roots = levels.pop()
    while levels:  # what a level points to is looked up in the next one; each level is a part of the one before
        level = levels.pop()
        above = roots.select(F.col("node").alias("k"), F.col("parent").alias("root"))
        merged = written(spread_join(level, above, "parent", "k").select("node", F.coalesce("root", "parent").alias("parent")))
        release(level, roots)
        roots = merged
    least = roots.groupBy("parent").agg(F.min(F.least("node", "parent")).alias("component")).withColumnRenamed("parent", "k")
    out = written(spread_join(roots, least, "parent", "k").select("node", "component"))
    release(roots)
    return out
