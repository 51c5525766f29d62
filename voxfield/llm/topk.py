"""Exact top-k search: tiles of queries and shards, partial selection in each tile, merging of the top lists in a tree.

Vectors become integers, floor(scale * x). All vectors are dealt into shards by a hash of their id, and packed as matrices of at most
SHARD rows; the stated queries are packed as blocks of at most BLOCK rows and sent to every shard group (a query set in blocks against all rows).
A tile is one product of a block and a shard matrix: in float64 while every partial sum stays below 2^53 and so exact, else in matrices of
Python's integers. From each tile each query keeps its k best by (score, -id), by partial selection on one number that holds both.
Lists of the same query merge level by level, FAN lists at a time, until one is left.

Candidates are all rows but those with the query's own id. Vectors that are null, empty, or hold a null or non-finite component take no part, neither as queries nor as candidates;
vectors of another length than the query's are no candidates. Ties go to the smaller id. Repeated rows are candidates of their own with equal ids; a query id with
several different vectors takes its list over all of them. Scores beyond 64 bits are clamped. Null ids take no part. Other columns are not carried.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfield.llm.common import by_key, map_batches

SHARD = 1 << 15
BLOCK = 1 << 10
FAN = 8
_TOP = float(np.finfo(np.float64).max)  # finite components that the scale makes infinite count as this


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id and v array<double> of whole numbers, for the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda y: _floor(y * scale)).alias("v"))


def _floor(x: Column) -> Column:
    """floor as a double, beyond 64 bits too."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(F.greatest(F.lit(-_TOP), F.least(F.lit(_TOP), x)))


def _packed(rows: DataFrame, group: Column, most: int) -> DataFrame:
    """(g, dim, ids, data): the vectors of a group and length as matrices of at most `most` rows, in the order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group_rows in by_key(batches, "h"):
            table = group_rows.combine_chunks()
            flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
            ids = table["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            for k in range(0, len(ids), most):
                part = order[k : k + most]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([table["g"][0].as_py()], pa.int64()), pa.array([flat.shape[1]], pa.int32()), pa.array([ids[part].tobytes()], pa.binary()), pa.array([_pack(flat[part])], pa.binary())],
                    ["g", "dim", "ids", "data"],
                )

    dealt = rows.select(group.cast("long").alias("g"), F.size("v").alias("dim"), "id", "v").withColumn("h", F.xxhash64("g", "dim"))
    return map_batches(dealt.repartition("h").sortWithinPartitions("h"), run, "g bigint, dim int, ids binary, data binary")


def tile_top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """(score, id) of each query's k best of the rows, which come in the order of ids."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    bits = max(1, len(ids) - 1).bit_length()
    if bound < 2.0 ** (62 - bits) and bound < 2.0**53:
        mask, least, n, out = (1 << bits) - 1, np.iinfo(np.int64).min, min(k, len(ids)), []
        place = np.int64(mask) - np.arange(len(ids))
        step = max(1, (1 << 21) // len(ids))  # so many queries at once that a product stays at 16 MB
        for a in range(0, len(q), step):
            packed = ((q[a : a + step] @ x.T).astype(np.int64) << bits) + place
            packed[q_ids[a : a + step, None] == ids[None, :]] = least
            best = -np.sort(-np.partition(packed, len(ids) - n, axis=1)[:, len(ids) - n :], axis=1)
            out += [[(v >> bits, int(ids[mask - (v & mask)])) for v in row if v != least] for row in best.tolist()]
        return out
    # beyond 53 bits: the same products in Python's integers, fewer at once; scores beyond 64 bits are clamped
    exact = np.frompyfunc(int, 1, 1)
    q, x, out = exact(q), exact(x).T, []
    step = max(1, (1 << 16) // len(ids))
    for a in range(0, len(q), step):
        for qid, row in zip(q_ids[a : a + step].tolist(), (q[a : a + step] @ x).tolist(), strict=True):
            found = ((max(-(1 << 63), min((1 << 63) - 1, s)), -i) for s, i in zip(row, ids.tolist(), strict=True) if i != qid)
            out.append([(s, -i) for s, i in heapq.nlargest(k, found)])
    return out


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers in two bytes each where those hold them, else as doubles; the first byte says which."""
    return b"h" + x.astype(np.int16).tobytes() if np.abs(x).max(initial=0) < 1 << 15 else b"d" + x.tobytes()


def _unpack(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int16 if raw[:1] == b"h" else np.float64, offset=1).astype(np.float64).reshape(-1, dim)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), id and score of each query's k best candidates (all, if fewer)."""
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, scale)
    queries = quantised(vectors.where(is_query), id_col, vector_col, scale).distinct()
    groups = max(1, -(-vectors.count() // shard))
    slots = max(groups, spark.sparkContext.defaultParallelism)
    shards = _packed(rows, F.pmod(F.xxhash64("id"), F.lit(slots)), shard)
    # the number of blocks follows the queries; their rows are spread by id so that no task packs them all
    blocks = _packed(queries, F.pmod(F.xxhash64("id", F.lit("q")), F.lit(slots)), block)
    blocks = blocks.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")))).select(*shards.columns)
    kind = pa.list_(pa.struct([("neg", pa.int64()), ("id", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by slot and length, shards first: those are held, and each block of queries meets them."""
        here, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                g, dim, queries, ids, data = (batch.column(c)[i].as_py() for c in ("g", "dim", "queries", "ids", "data"))
                if (g, dim) != here:
                    here, held = (g, dim), []
                ids, data = np.frombuffer(ids, np.int64), _unpack(data, dim)
                if not queries:
                    held.append((ids, data))
                    continue
                for s_ids, s_data in held:
                    top = tile_top(ids, data, s_ids, s_data, k)
                    # -1 - score turns the order around and stays within 64 bits
                    lists = pa.array([[{"neg": -1 - s, "id": v} for s, v in x] for x in top], kind)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([g] * len(ids), pa.int64()), lists], ["query_id", "node", "top"])

    both = shards.withColumn("queries", F.lit(False)).unionByName(blocks.withColumn("queries", F.lit(True)))
    dealt = both.repartition(slots, "g").sortWithinPartitions("g", "dim", "queries")
    tiles = map_batches(dealt, run, "query_id bigint, node bigint, top array<struct<neg: bigint, id: bigint>>")
    wide = slots
    while True:  # one level of the tree: FAN nodes of a query become one
        wide = -(-wide // FAN)
        tiles = tiles.groupBy("query_id", F.floor(F.col("node") / FAN).alias("node")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        if wide == 1:
            break
    ranked = tiles.select("query_id", F.posexplode("top").alias("pos", "x"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias(id_col), (-1 - F.col("x.neg")).alias("score"))
