"""Queries on vectors and clusters."""

from pyspark.sql import functions as F

from voxfield.operators import clusters as C
from voxfield.operators.textrank import STOP_EN
from voxfield.plans.catalog import query, table

#: The query vector of the searches: the unit vector of the first component and half of the second.
_Q = [1.0, 0.5] + [0.0] * 62
_QS = "list_concat([1.0::DOUBLE, 0.5], list_transform(range(62), lambda i: 0.0::DOUBLE))"
_E = "list_transform(embedding, lambda x: x::DOUBLE)"


@query("knn_l2", f"SELECT vec_id, round(list_distance({_E}, {_QS}), 4) AS dist FROM embeddings ORDER BY dist, vec_id LIMIT 10")
def knn_l2(spark, sf_dir):
    return C.nearest(table(spark, sf_dir, "embeddings"), _Q, 10, "vec_id", "embedding")


@query("knn_cosine", f"SELECT vec_id, round(1 - list_cosine_similarity({_E}, {_QS}), 4) AS dist FROM embeddings ORDER BY dist, vec_id LIMIT 10")
def knn_cosine(spark, sf_dir):
    return C.nearest(table(spark, sf_dir, "embeddings"), _Q, 10, "vec_id", "embedding", "cosine")


_CEN = f"(SELECT label, dim, avg(x) AS mean FROM (SELECT label, unnest(range(64)) AS dim, unnest({_E}) AS x FROM embeddings) GROUP BY 1, 2)"


@query("centroids", f"SELECT label, dim::INTEGER AS dim, round(mean, 6) AS mean FROM {_CEN}")
def centroids(spark, sf_dir):
    return C.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("mean", F.round("mean", 6))


@query("representatives", f"WITH c AS (SELECT label, list(mean ORDER BY dim) AS cen FROM {_CEN} GROUP BY 1), d AS (SELECT label, vec_id, round(list_distance({_E}, cen), 6) AS dist FROM embeddings JOIN c USING (label)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id)::INTEGER AS rank FROM d) WHERE rank <= 5")
def representatives(spark, sf_dir):
    return C.representatives(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@query("small_dataset_guard", "SELECT label, CASE WHEN count(*) < 50 THEN 'single' ELSE 'density' END AS path, count(*) AS n FROM embeddings GROUP BY 1")
def small_dataset_guard(spark, sf_dir):
    return C.small_guard(table(spark, sf_dir, "embeddings"), ["label"], 50).groupBy("label", "path").agg(F.count("*").alias("n"))


@query("cluster_name", "SELECT CASE WHEN label < 1 THEN 'noise' ELSE printf('cluster_%03d', label - 1) END AS cluster, count(*) AS size FROM embeddings GROUP BY 1")
def cluster_name(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(C.name(F.col("label") - 1).alias("cluster")).agg(F.count("*").alias("size"))


@query("knn_lsh")
def knn_lsh(spark, sf_dir):
    return C.nearest_lsh(table(spark, sf_dir, "embeddings"), _Q, 10, "vec_id", "embedding")


@query("pca")
def pca(spark, sf_dir):
    return C.pca(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)


@query(
    "hashing_encoder",
    f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9'']{{2,}}'), lambda w: w NOT IN ({", ".join("'" + w + "'" for w in dict.fromkeys(STOP_EN))})) AS t FROM documents),
    p AS (SELECT doc_id, list_transform(t, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64) AS p FROM t),
    v AS (SELECT doc_id, list_transform(range(64), lambda d: len(list_filter(p, lambda x: x = d))::DOUBLE) AS v FROM p)
    SELECT doc_id, list_transform(v, lambda x: round(coalesce(x / nullif(sqrt(list_sum(list_transform(v, lambda y: y * y))), 0), 0), 9)) AS v FROM v""",
)
def hashing_encoder(spark, sf_dir):
    from voxfield.operators.textrank import tokens_en

    out = C.hashing_encoder(table(spark, sf_dir, "documents").select("doc_id", tokens_en(F.col("text")).alias("t")), "doc_id", "t")
    return out.select("doc_id", F.transform("v", lambda x: F.round(x, 9)).alias("v"))


@query("chunk_pool", f"SELECT label, round(list_sum(list_transform(m, lambda x: x * x)), 6) AS squared_norm FROM (SELECT label, list_transform(cen, lambda x: x / sqrt(list_sum(list_transform(cen, lambda y: y * y)))) AS m FROM (SELECT label, list(mean ORDER BY dim) AS cen FROM {_CEN} GROUP BY 1))")
def chunk_pool(spark, sf_dir):
    from voxfield.functions.vector import dot

    pooled = C.pooled_chunks(table(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id")
    return pooled.select("label", F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("squared_norm"))
