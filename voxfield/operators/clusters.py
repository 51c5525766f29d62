"""Neighbours, centroids, representatives, encoders of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxfield.functions.vector import as_double, cosine_distance, l2_distance, norm


def nearest(vectors: DataFrame, query: list[float], k: int, key: str, vector: str, metric: str = "l2") -> DataFrame:
    """The k nearest rows by distance (4 digits), ties by key. The query is a literal, so no task sends vectors; each keeps k rows."""
    q = F.array(*map(F.lit, query))
    d = (l2_distance if metric == "l2" else cosine_distance)(as_double(F.col(vector)), q)
    return vectors.select(key, F.round(d, 4).alias("dist")).orderBy("dist", key).limit(k)


def centroid_vectors(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): one aggregate over whole vectors, which must have one length in a group; null vectors say nothing."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = vectors.where(F.col(vector).isNotNull()).select(group, array_to_vector(as_double(F.col(vector))).alias("_v"))
    return rows.groupBy(group).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("centroid"))


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, dim, mean): the mean of each component."""
    return centroid_vectors(vectors, group, vector).select(group, F.posexplode("centroid").alias("dim", "mean"))


def representatives(vectors: DataFrame, group: str, key: str, vector: str, k: int = 5) -> DataFrame:
    """The k rows of each group nearest to its centroid (6 digits), ties by key. A group's candidates are first cut to k for each of 64 salts, so no
    task sorts a whole large group."""
    center = centroid_vectors(vectors, group, vector)
    d = vectors.join(center, group).select(group, key, F.round(l2_distance(as_double(F.col(vector)), F.col("centroid")), 6).alias("dist"))
    salted = Window.partitionBy(group, F.pmod(F.xxhash64(key), F.lit(64))).orderBy("dist", key)
    few = d.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("dist", key))).where(F.col("rank") <= k).drop("r")


def name(label: Column) -> Column:
    """cluster_007 for label 7, `noise` below 0."""
    return F.when(label < 0, "noise").otherwise(F.format_string("cluster_%03d", label))


def normalised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    v = as_double(F.col(vector))
    return vectors.select(key, F.transform(v, lambda x: F.try_divide(x, norm(v))).alias(vector))


def pooled_chunks(chunks: DataFrame, key: str, vector: str, pos: str, mode: str = "mean") -> DataFrame:
    """One vector for each post: the mean of its chunks' vectors at unit length, or (mode `last`) the last chunk's."""
    if mode == "last":
        return chunks.groupBy(key).agg(F.max_by(vector, pos).alias(vector))
    return normalised(centroid_vectors(chunks, key, vector).withColumnRenamed("centroid", vector), key, vector)


def hashing_encoder(texts: DataFrame, key: str, tokens: str, dims: int = 64) -> DataFrame:
    """A vector of hashed token counts at unit length, zeros for a text without tokens: stands in for a model where there is none. Not semantic.
    A token's place is the number in the first 8 hex digits of its MD5, modulo dims."""
    place = F.pmod(F.conv(F.substring(F.md5(F.col("t").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int")
    counts = texts.select(key, F.explode_outer(tokens).alias("t")).groupBy(key, place.alias("d")).agg(F.count("t").cast("double").alias("n"))
    entries = F.map_from_entries(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d", "n"))))
    raw = counts.groupBy(key).agg(entries.alias("m"))
    dense = raw.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0))).alias("v"))
    v = F.col("v")
    return dense.select(key, F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm(v)), F.lit(0.0))).alias("v"))


def small_guard(vectors: DataFrame, groups: list[str], least: int) -> DataFrame:
    """Rows with `path`: `single` where the group has fewer than `least` rows, else `density`."""
    sizes = vectors.groupBy(*groups).agg(F.count("*").alias("_n"))
    return vectors.join(sizes, groups).withColumn("path", F.when(F.col("_n") < least, "single").otherwise("density")).drop("_n")


def pca(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """The first principal components: stands in for UMAP, which Spark has no equal of."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(key, array_to_vector(as_double(F.col(vector))).alias("v"))
    return PCA(k=dims, inputCol="v", outputCol="p").fit(rows).transform(rows).select(key, vector_to_array("p").alias("components"))


def nearest_lsh(vectors: DataFrame, query: list[float], k: int, key: str, vector: str) -> DataFrame:
    """Approximate neighbours by random projections."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = vectors.select(key, array_to_vector(as_double(F.col(vector))).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=1.0, numHashTables=8, seed=42).fit(rows)
    return model.approxNearestNeighbors(rows, Vectors.dense(query), k).select(key, F.round("distCol", 4).alias("dist"))
