"""A stored index of inverted lists: a coarse quantiser deals vectors into lists, a search reads only the lists nearest to its query."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfield.functions.vector import as_double
from voxfield.operators.clusters import nearest

SAMPLE = 200_000  # rows the quantiser is fitted on, at most; every row is indexed
LISTS = 4096  # at most
FILES = 16  # a list's rows go to so many tasks at most, so a large list isn't one


def _vectors(rows: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).withColumn("_v", array_to_vector(as_double(F.col(vector))))


def build(vectors: DataFrame, key: str, vector: str, path: str, lists: int | None = None, seed: int = 42) -> None:
    """Fits centroids by k-means on SAMPLE rows at most, taken by a hash of the key, and writes path/model and path/lists, partitioned by list.
    lists: about the root of the number of rows, if not given. Rows without a vector are left out."""
    from pyspark.ml.clustering import KMeans

    rows = vectors.select(key, vector)
    n = rows.count()
    lists = lists or max(1, min(LISTS, round(math.sqrt(n))))
    share = max(1, -(-n // SAMPLE))
    model = KMeans(k=lists, seed=seed, featuresCol="_v", predictionCol="list", maxIter=10).fit(_vectors(rows.where(F.pmod(F.xxhash64(key), F.lit(share)) == 0), vector))
    model.write().overwrite().save(f"{path}/model")
    _put(model, rows, key, vector, path, "overwrite")


def add(vectors: DataFrame, key: str, vector: str, path: str) -> None:
    """Puts new rows into the lists of an index that is there; its centroids stay as they are."""
    from pyspark.ml.clustering import KMeansModel

    model = KMeansModel.load(f"{path}/model")
    model.setFeaturesCol("_v").setPredictionCol("list")
    _put(model, vectors.select(key, vector), key, vector, path, "append")


def _put(model, rows: DataFrame, key: str, vector: str, path: str, mode: str) -> None:
    dealt = model.transform(_vectors(rows, vector)).drop("_v")
    dealt.repartition("list", F.pmod(F.xxhash64(key), F.lit(FILES))).sortWithinPartitions("list").write.mode(mode).partitionBy("list").parquet(f"{path}/lists")


def probed(spark: SparkSession, path: str, query: list[float], probes: int) -> DataFrame:
    """The rows of the `probes` lists whose centroids are nearest to the query: a scan whose partition filter leaves out all other lists."""
    from pyspark.ml.clustering import KMeansModel

    centres = KMeansModel.load(f"{path}/model").clusterCenters()  # LISTS at most
    order = sorted(range(len(centres)), key=lambda i: (float(((centres[i] - query) ** 2).sum()), i))
    return spark.read.parquet(f"{path}/lists").where(F.col("list").isin(order[:probes]))


def knn(spark: SparkSession, path: str, query: list[float], k: int, key: str, vector: str, probes: int, metric: str = "l2") -> DataFrame:
    """The k nearest of the probed rows by distance (4 digits), ties by key. With as many probes as lists the search is exact."""
    return nearest(probed(spark, path, query, probes), query, k, key, vector, metric)
