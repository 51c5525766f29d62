"""Density clusters of vectors by an exact epsilon-join: DBSCAN whose groups, cells and clusters may be of any size.

Cells: vectors are projected on the first DIRECTIONS principal components of their group's table and cut into steps of eps, so neighbours within eps are
in the same or in touching cells. A cell's vectors are packed as blocks of at most `block` rows, with centre and radius. Touching cells meet by equal keys; of
their blocks only those go on whose centres are no further apart than both radii and eps. Each pair of blocks is one matrix product, and pairs of rows are not written out.

Blocks are dealt into tiles of TILE bytes; a task gets the blocks of two tiles once and goes through their pairs, so a block travels once for each tile that it meets and not for each
block, and no task holds more than two tiles. What is settled travels no further: rows with enough neighbours in their own tile ask no other one, and tiles whose core rows are one component
by then aren't compared again. So dense vectors cost a few copies of the input; vectors without neighbours cost one for each tile they may be near to, as exact answers need."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxfield.functions.vector import as_double, dot
from voxfield.operators.components import components, spread_join
from voxfield.tables import release, written

DIRECTIONS = 2
BLOCK = 512
TILE = 32 << 20  # bytes of the vectors of a tile


def blocks(vectors: DataFrame, groups: list[str], key: str, vector: str, eps: float, block: int = BLOCK) -> DataFrame:
    """(id, g, cell, keys, data, centre, radius): the vectors of a group and cell as matrices of at most `block` rows in the order of keys, as a written table."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(F.to_json(F.struct(*groups)).alias("g"), F.col(key).alias("key"), as_double(F.col(vector)).alias("v")).where("key is not null and size(v) > 0")
    dims = rows.select(F.max(F.size("v"))).first()[0]
    if dims is None:
        return vectors.sparkSession.createDataFrame([], f"id bigint, g string, cell array<bigint>, keys array<{vectors.schema[key].dataType.simpleString()}>, data array<double>, centre array<double>, radius double")
    axes = PCA(k=min(DIRECTIONS, dims), inputCol="x", outputCol="p").fit(rows.select(array_to_vector("v").alias("x"))).pc.toArray().T.tolist()
    cell = F.array(*[F.floor(dot(F.col("v"), F.array(*map(F.lit, a))) / eps) for a in axes])
    placed = written(rows.withColumn("cell", cell))
    sizes = placed.groupBy("g", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    sizes = sizes.select(F.struct("g", "cell").alias("k"), "parts")
    dealt = spread_join(placed.withColumn("c", F.struct("g", "cell")), sizes, "c", "k").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))

    def pack(group: pa.Table) -> pa.Table:
        group = group.take(pa.compute.sort_indices(group["key"]))
        x = np.array(group["v"].to_pylist())
        out = []
        for at in range(0, len(x), block):
            part = x[at : at + block]
            centre = part.mean(0)
            first = group["g"][0], group["cell"][0], group["key"].combine_chunks()[at : at + block]
            out.append([*first, part.ravel(), centre, float(np.sqrt(((part - centre) ** 2).sum(1).max()))])
        g, cells, keys, data, centres, radii = zip(*out, strict=True)
        return pa.table({"g": pa.array([y.as_py() for y in g]), "cell": pa.array([y.as_py() for y in cells], pa.list_(pa.int64())), "keys": pa.array([y.to_pylist() for y in keys], pa.list_(group["key"].type)), "data": pa.array(data, pa.list_(pa.float64())), "centre": pa.array(centres, pa.list_(pa.float64())), "radius": pa.array(radii)})

    kind = vectors.schema[key].dataType.simpleString()
    packed = dealt.select("g", "cell", "part", "key", "v").groupBy("g", "cell", "part").applyInArrow(pack, f"g string, cell array<bigint>, keys array<{kind}>, data array<double>, centre array<double>, radius double")
    out = written(packed.select(F.monotonically_increasing_id().alias("id"), "*"))
    release(placed)
    return out


def block_pairs(packed: DataFrame, eps: float) -> DataFrame:
    """(a, b) with a <= b: the ids of blocks that may hold neighbours, each pair once. Only cells, centres and radii are looked at."""
    head = packed.select("id", "g", "cell", "centre", "radius")
    width = len(packed.select("cell").first()[0]) if not packed.isEmpty() else 1
    steps = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in s]) for s in product((-1, 0, 1), repeat=width)])
    near = head.select("id", "g", F.col("centre").alias("c2"), F.col("radius").alias("r2"), F.explode(F.transform(steps, lambda s: F.zip_with("cell", s, lambda x, y: x + y))).alias("cell")).withColumnRenamed("id", "b")
    met = head.join(near, ["g", "cell"]).where("id <= b")
    apart = F.sqrt(F.aggregate(F.zip_with("centre", "c2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return met.where(apart <= (F.col("radius") + F.col("r2") + eps) * (1 + 1e-9)).select(F.col("id").alias("a"), "b")


class _Block:
    """A block in a task: its rows and their squares, the blocks to compare it with, and what more was sent."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        sent = {c: batch.column(c)[k].values for c in batch.schema.names if c != "id"}
        self.x = sent.pop("data").to_numpy().reshape(len(sent["keys"]), -1)
        self.square = (self.x * self.x).sum(1)
        self.to = sent.pop("to").to_pylist()
        self.sent = sent

    def near(self, rows: np.ndarray, other: _Block, others: np.ndarray, eps: float) -> np.ndarray:
        """Which of some rows and some rows of another block are within eps."""
        x, y = (b.x if len(r) == len(b.x) else b.x[r] for b, r in ((self, rows), (other, others)))
        d = x @ y.T
        d *= -2
        d += self.square[rows][:, None]
        d += other.square[others][None]
        out = d <= eps * eps
        if other is self:
            out |= rows[:, None] == others[None]
        return out


def _task(batches: Iterator[pa.RecordBatch]) -> dict[int, _Block]:
    return {block: _Block(batch, k) for batch in batches for k, block in enumerate(batch.column("id").to_pylist())}


def _pairs_of(held: dict[int, _Block]) -> Iterator[tuple[int, int]]:
    return ((a, b) for a, block in held.items() for b in block.to)


def tiled(pairs: DataFrame, packed: DataFrame, tile: int = TILE) -> DataFrame:
    """pairs with `task`, the number of their two tiles, and `apart`: 0 within a tile, 1 for tiles next to each other in a ring, else 2."""
    n, most = packed.agg(F.count("*"), F.max(F.size("data"))).first()
    tiles = max(1, -(-n * (most or 0) * 8 // tile), min(8, n // 16))
    i, j = (F.pmod(F.xxhash64(c), F.lit(tiles)) for c in "ab")
    low, high = F.least(i, j), F.greatest(i, j)
    apart = F.when(low == high, 0).when((high - low).isin(1, tiles - 1), 1).otherwise(2)
    return pairs.select("a", "b", (high * (high + 1) / 2 + low).cast("int").alias("task"), apart.alias("apart"), F.lit(tiles * (tiles + 1) // 2).alias("tasks"))


def _dealt(pairs: DataFrame, packed: DataFrame, state: DataFrame) -> DataFrame | None:
    """Blocks and their state (id and lists), each once for every task that it has pairs in, with the partners it is to be compared with; None without pairs."""
    first = pairs.first()
    if first is None:
        return None
    ends = pairs.select("task", F.col("a").alias("id"), F.col("b").alias("to")).unionByName(pairs.select("task", F.col("b").alias("id"), F.lit(None).cast("bigint").alias("to")))
    needed = ends.groupBy("task", "id").agg(F.collect_list("to").alias("to"))
    rows = needed.join(packed.select("id", "keys", "data").join(state, "id"), "id")
    return rows.repartitionById(first["tasks"], F.col("task")).drop("task")


def _counted(dealt: DataFrame, eps: float, most: int) -> DataFrame:
    """(id, pos, n): how many more rows within eps each row has. Rows that have `most` are not compared any more: below it counts are exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _task(batches)
        start = {k: b.sent["counts"].to_numpy(zero_copy_only=False).astype(np.int64) for k, b in held.items()}
        now = {k: x.copy() for k, x in start.items()}
        for a, b in _pairs_of(held):
            p, q = np.flatnonzero(now[a] < most), np.flatnonzero(now[b] < most)
            every = np.arange(len(now[a])), np.arange(len(now[b]))
            if a != b and len(p) * len(now[b]) + len(q) * len(now[a]) > len(now[a]) * len(now[b]):
                near = held[a].near(every[0], held[b], every[1], eps)
                now[a] += near.sum(1)
                now[b] += near.sum(0)
                continue
            if len(p):
                now[a][p] += held[a].near(p, held[b], every[1], eps).sum(1)
            if len(q) and a != b:
                now[b][q] += held[b].near(q, held[a], every[0], eps).sum(1)
        for k, n in now.items():
            at = np.flatnonzero(n - start[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at.astype(np.int32)), pa.array((n - start[k])[at])], ["id", "pos", "n"])

    return dealt.mapInArrow(run, "id bigint, pos int, n bigint").groupBy("id", "pos").agg(F.sum("n").alias("n"))


def _in_order(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(id, name): a column of the rows of each block in their order, nulls included."""
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(column).alias("x")))), lambda r: r["x"]).alias(name))


def neighbour_counts(pairs: DataFrame, packed: DataFrame, eps: float, most: int) -> DataFrame:
    """(id, counts): for each block the number of rows within eps of each of its rows, itself included; from `most` on it may be less than that, but not below `most`. Written."""
    zeros = packed.select("id", F.transform("keys", lambda _: F.lit(0).cast("bigint")).alias("counts"))
    own = _dealt(pairs.where("apart = 0"), packed, zeros)
    if own is None:
        return packed.sparkSession.createDataFrame([], "id bigint, counts array<bigint>")
    each = written(_counted(own, eps, most))
    state = written(_in_order(each, "n", "counts"))
    asking = state.select("id", F.exists("counts", lambda n: n < most).alias("asks"))
    others = pairs.where("apart > 0").join(asking.select(F.col("id").alias("a"), F.col("asks").alias("x")), "a").join(asking.select(F.col("id").alias("b"), F.col("asks").alias("y")), "b").where("x or y")
    more = _dealt(others, packed, state)
    if more is not None:
        both = each.unionByName(_counted(more, eps, most)).groupBy("id", "pos").agg(F.sum("n").alias("n"))
        state, before = written(_in_order(both, "n", "counts")), state
        release(before)
    release(each)
    return state


def _union(near: np.ndarray) -> np.ndarray:
    """Component numbers of rows (first the left, then the right side) by a matrix of links between the sides."""
    n, m = near.shape
    label = np.arange(n + m)
    while True:
        left = np.minimum(label[:n], np.where(near, label[None, n:], n + m).min(1, initial=n + m))
        right = np.minimum(label[n:], np.where(near, left[:, None], n + m).min(0, initial=n + m))
        new = np.concatenate([left, right])
        if (new == label).all():
            return label
        label = new


def _core_links(dealt: DataFrame, eps: float, kind: str) -> DataFrame:
    """(a, b): links of names in `of` (null for rows that aren't core) that join all names whose rows are within eps of one another in a task: a star for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = _task(batches), {}
        core, label, kept = {}, {}, None
        for k, b in held.items():
            kept = b.sent["of"].type
            names = b.sent["of"].to_pylist()
            core[k] = np.array([i for i, x in enumerate(names) if x is not None], np.int64)
            label[k] = np.array([number.setdefault(x, len(number)) for x in names if x is not None], np.int64)
        up = np.arange(len(number))

        def roots(x: np.ndarray) -> np.ndarray:
            while ((y := up[x]) != x).any():
                x = y
            return x

        for a, b in _pairs_of(held):
            for k in (a, b):
                label[k] = roots(label[k])
            x, y = label[a], label[b]
            if not len(x) or not len(y) or x.min() == x.max() == y.min() == y.max():
                continue
            near = held[a].near(core[a], held[b], core[b], eps)
            if np.count_nonzero(near) < 4096:
                i, j = np.nonzero(near)
                p, q = x[i], y[j]
            else:  # the first row of each component stands for its links
                local, ends = _union(near), np.concatenate([x, y])
                p, q = ends[np.unique(local, return_index=True)[1][np.unique(local, return_inverse=True)[1]]], ends
            code = np.unique(p[p != q] * len(up) + q[p != q])
            for u, v in zip((code // len(up)).tolist(), (code % len(up)).tolist(), strict=True):
                while up[u] != u:
                    up[u] = u = up[up[u]]
                while up[v] != v:
                    up[v] = v = up[up[v]]
                up[max(u, v)] = min(u, v)
        names, top = list(number), roots(np.arange(len(number)))
        child = np.flatnonzero(top != np.arange(len(number)))
        if len(child):
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at.tolist()], kept) for at in (top[child], child)], ["a", "b"])

    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def _borders(dealt: DataFrame, eps: float, kind: str) -> DataFrame:
    """(k, cluster): for rows that aren't core but near to core rows the smallest of their clusters (`of`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, kept = _task(batches), {}, None
        clusters = {k: b.sent["of"].to_pylist() for k, b in held.items()}
        core = {k: np.array([i for i, x in enumerate(c) if x is not None], np.int64) for k, c in clusters.items()}
        beside = {k: np.flatnonzero((b.sent["counts"].to_numpy(zero_copy_only=False) > 1) & np.array([x is None for x in clusters[k]], bool)) for k, b in held.items()}
        for a, b in _pairs_of(held):
            for one, other in ((a, b), (b, a))[: 1 + (a != b)]:
                if len(beside[one]) and len(core[other]):
                    kept = held[one].sent["keys"].type
                    for i, j in zip(*(x.tolist() for x in np.nonzero(held[one].near(beside[one], held[other], core[other], eps))), strict=True):
                        key, cluster = (one, beside[one][i]), clusters[other][core[other][j]]
                        found[key] = min(found.get(key, cluster), cluster)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([held[k].sent["keys"][int(i)].as_py() for k, i in found], kept), pa.array(list(found.values()), kept)], ["k", "cluster"])

    return dealt.mapInArrow(run, f"k {kind}, cluster {kind}").groupBy("k").agg(F.min("cluster").alias("cluster"))


def density_clusters(vectors: DataFrame, groups: list[str], key: str, vector: str, eps: float, min_points: int = 5, min_size: int = 1, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """groups, key, label, strength and core of each row of each group. A row with `min_points` rows or more within eps, itself included, is core; core rows within eps of each other
    are one cluster; another row within eps of core rows belongs to the cluster among theirs with the smallest core key. Clusters of fewer than `min_size` rows are noise. Labels number
    a group's clusters by their smallest core key from 0, noise is -1. strength: neighbours / min_points, 1 at most; 0 for noise. Keys must be unique; rows with a null key or an empty vector are noise."""
    kind = vectors.schema[key].dataType.simpleString()
    packed = blocks(vectors, groups, key, vector, eps, block)
    pairs = written(tiled(block_pairs(packed, eps), packed, tile))
    counts = neighbour_counts(pairs, packed, eps, min_points)
    points = packed.join(counts, "id").select("id", "g", F.posexplode(F.arrays_zip("keys", "counts")).alias("pos", "p"))
    points = written(points.select("id", "pos", "g", F.col("p.keys").alias("k"), F.col("p.counts").alias("n"), (F.col("p.counts") >= min_points).alias("core"), F.when(F.col("p.counts") >= min_points, F.col("p.keys")).alias("cluster")))
    for some in ("apart < 2", "apart = 2"):  # tiles in a ring first: what they have joined needs no other links
        of = written(_in_order(points, "cluster", "of"))
        heads = lambda end: of.select(F.col("id").alias(end), F.array_min("of").alias(f"{end}1"), F.array_max("of").alias(f"{end}2"))  # noqa: E731, B023
        apart = pairs.where(some).join(heads("a"), "a").join(heads("b"), "b").where("a1 is not null and b1 is not null and not (a1 = a2 and a2 = b1 and b1 = b2)")
        dealt = _dealt(apart, packed, of)
        if dealt is not None:
            links = written(_core_links(dealt, eps, kind))
            joined = components(links, "a", "b")
            named = written(spread_join(points, joined, "cluster", "node").withColumn("cluster", F.coalesce("component", "cluster")).drop("component"))
            release(points, links, joined)
            points = named
        release(of)
    member = points.where("core")
    beside = points.groupBy("id").agg(F.max(~F.col("core") & (F.col("n") > 1)).alias("open"), F.max("core").alias("has"))
    sides = [beside.select(F.col("id").alias(end), F.col("open").alias(f"{end}1"), F.col("has").alias(f"{end}2")) for end in "ab"]
    of = written(_in_order(points, "cluster", "of").join(counts, "id"))
    dealt = _dealt(pairs.join(sides[0], "a").join(sides[1], "b").where("(a1 and b2) or (b1 and a2)"), packed, of)
    if dealt is not None:
        member = member.unionByName(points.where("not core").drop("cluster").join(_borders(dealt, eps, kind), "k").select(*points.columns))
    member = written(member)
    sizes = member.groupBy("g", "cluster").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    labels = sizes.select(F.struct("g", "cluster").alias("c"), (F.row_number().over(Window.partitionBy("g").orderBy("cluster")) - 1).alias("label"))  # over clusters, not rows
    named = spread_join(member.select("k", "n", "core", F.struct("g", "cluster").alias("of")), labels, "of", "c", "inner")
    strength = F.least(F.lit(1.0), F.col("n") / min_points)
    found = named.select(F.col("k").alias("_k"), "label", strength.alias("strength"), "core")
    out = vectors.select(*groups, key).join(found, F.col(key) == F.col("_k"), "left")
    out = written(out.select(*groups, key, F.coalesce("label", F.lit(-1)).cast("int").alias("label"), F.coalesce("strength", F.lit(0.0)).alias("strength"), F.coalesce("core", F.lit(False)).alias("core")))
    release(packed, pairs, counts, points, of, member)
    return out
