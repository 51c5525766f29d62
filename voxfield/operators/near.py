"""Near-duplicate posts: MinHash signatures choose candidates, exact Jaccard similarity of word shingles decides, components make classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfield.operators.components import components, spread_join
from voxfield.tables import release, written

BANDS, ROWS = 16, 4  # at similarity 0.85 a pair shares no band in 7 of a million cases
SHINGLES, MEMBERS = 1 << 21, 1 << 12  # of a bucket's part


def shingles(words: Column, width: int) -> Column:
    """The distinct hashes (64 bits) of runs of `width` words; fewer words are one run, none have none."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(width)), " ")))
    return F.when(n > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def _links(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that make up the components of all pairs at the threshold or above: every member outside of the largest component is compared with all others,
    so two of different components have been compared; members of the largest one need not be."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark, label, done, out = np.zeros(flat.max() + 1, bool), np.arange(len(sets)), np.zeros(len(sets), bool), []
    while True:
        largest = np.bincount(label).argmax()
        todo = np.flatnonzero(~done & (label != largest))
        if not len(todo):
            return out
        p = todo[0]
        own = flat[starts[p] : starts[p] + sizes[p]]
        mark[own] = True
        common = np.add.reduceat(mark[flat], starts)
        mark[own] = False
        near = np.flatnonzero(common >= threshold * (sizes + sizes[p] - common) - 1e-9)
        for q in near[label[near] != label[p]].tolist():
            if label[q] != label[p]:
                out.append((int(p), q))
                label[label == label[q]] = label[p]
        done[p] = True


def near_duplicates(posts: DataFrame, key: str, text: str, threshold: float = 0.85, width: int = 5, limit: int = SHINGLES, members: int = MEMBERS) -> DataFrame:
    """(key, class_id, class_size) of every post: posts whose sets of `width` lower-cased words in a row have a Jaccard similarity of `threshold` or more are linked, and
    what is linked directly or by others is a class, named by its smallest key. Posts without words are classes of their own.

    Equal texts count as one from the start. Signatures are BANDS x ROWS minima over the shingles, one aggregate; texts that share a band are candidates, buckets
    of equal members count once. A bucket of more than `limit` shingles or `members` texts is dealt into parts by a second hash and every two parts meet, so no bucket is one task or is cut.
    Within a bucket only links that hold a component together are written out, not all pairs."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    cut = posts.select(F.col(key).alias("key"), words.alias("w"))
    node = F.when(F.size("w") > 0, F.md5(F.array_join("w", " ").cast("binary")))
    ids = written(cut.select("key", node.alias("node")))
    sets = written(cut.where(F.size("w") > 0).select(node.alias("node"), shingles(F.col("w"), width).alias("s")).groupBy("node").agg(F.first("s").alias("s")))
    minima = [F.min(F.xxhash64("h", F.lit(i))).alias(f"m{i}") for i in range(BANDS * ROWS)]
    signatures = sets.select("node", F.size("s").alias("n"), F.explode("s").alias("h")).groupBy("node", "n").agg(*minima)
    keys = F.array(*[F.xxhash64(F.lit(b), *[f"m{ROWS * b + r}" for r in range(ROWS)]) for b in range(BANDS)])
    banded = written(signatures.select("node", "n", F.explode(keys).alias("band")))
    buckets = banded.groupBy("band").agg(F.count("*").alias("many"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("node")).alias("who"), F.min("node").alias("first")).where("many > 1")
    buckets = buckets.groupBy("many", "total", "who", "first").agg(F.min("band").alias("k"))
    parts = F.greatest(F.ceil(F.col("total") / limit), F.ceil(F.col("many") / members)).cast("int")
    dealt = spread_join(banded.select("node", "band"), buckets.select("k", parts.alias("parts")), "band", "k", "inner")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")
    meetings = dealt.select("node", "band", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    meetings = meetings.select("node", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def judge(group: pa.Table) -> pa.Table:
        nodes = group["node"].to_pylist()
        found = _links([np.asarray(s) for s in group["s"].to_pylist()], threshold) if len(nodes) > 1 else []
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.string()), "b": pa.array([nodes[i] for _, i in found], pa.string())})

    links = meetings.join(sets, "node").groupBy("band", "i", "j").applyInArrow(judge, "a string, b string")
    classes = components(links, "a", "b")
    named = spread_join(ids.where("node is not null"), classes.withColumnRenamed("node", "k"), "node", "k").select("key", F.coalesce("component", "node").alias("class"))
    heads = named.groupBy("class").agg(F.min("key").alias("class_id"), F.count("*").alias("class_size")).withColumnRenamed("class", "k")
    out = spread_join(named, heads, "class", "k").select(F.col("key").alias(key), "class_id", "class_size")
    empty = ids.where("node is null").select(F.col("key").alias(key), F.col("key").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"))
    out = written(out.unionByName(empty))
    release(ids, sets, banded, classes)
    return out


def without_near_duplicates(posts: DataFrame, key: str, text: str, **how) -> DataFrame:
    """The posts of the smallest key of each class. Rows that share a key are kept or dropped together with it only if their own class says so: keys should be unique."""
    heads = near_duplicates(posts, key, text, **how).where(F.col(key) == F.col("class_id")).select(key)
    return posts.join(heads, key, "left_semi")
