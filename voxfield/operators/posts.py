"""Steps on posts around embedding and clustering, and the table of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfield.operators.clusters import name, pooled_chunks, representatives, small_guard
from voxfield.operators.density import density_clusters
from voxfield.operators.relations import not_seen
from voxfield.operators.textrank import chunks
from voxfield.sinks.csv import upsert

#: Frequent words of languages in Latin letters, which tell them apart where the script can't.
_WORDS = {"en": ["the", "and", "of", "to", "is"], "fr": ["le", "la", "les", "et", "des"], "de": ["der", "die", "und", "das", "ist"], "es": ["el", "los", "y", "que", "en"]}
_SCRIPTS = {"ja": "[\\x{3040}-\\x{30FF}]", "ko": "[\\x{AC00}-\\x{D7AF}]", "zh": "[\\x{4E00}-\\x{9FFF}]", "ru": "[\\x{0400}-\\x{04FF}]"}


def clustering_text(title: Column, body: Column) -> Column:
    """Title and body on lines of their own; missing parts are empty, nothing is skipped."""
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit(""))))


def language_hint(text: Column) -> Column:
    """ja, ko, zh or ru by the first script found, in this order; else en, fr, de or es by most frequent words, of equal ones the first; null below
    2 characters. A hint: it looks at letters and twenty words, and always names a language."""
    words = F.split(F.lower(text), r"[^\p{L}]+")

    def hits(known: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(known)))

    counts = F.array(*[F.struct(hits(v).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, v) in enumerate(_WORDS.items())])
    by_script = F.coalesce(*[F.when(F.rlike(text, F.lit(p)), lang) for lang, p in _SCRIPTS.items()], F.array_max(counts)["lang"])
    return F.when(F.length(F.trim(text)) >= 2, by_script)


def embed_posts(posts: DataFrame, table: DataFrame, encode: Callable[[DataFrame], DataFrame], at: Column, mode: str = "mean") -> DataFrame:
    """The embedding table after a run. posts: id, text; table: id, text_hash, vector, created_at; encode adds `vector` to chunks (id, chunk, text).
    Posts whose id and text the table has are left alone, equal texts under new ids take the vector that is there, and only the rest is cut, encoded and pooled;
    of two rows of an id the newer stays."""
    hashed = posts.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).dropDuplicates(["id"])
    new = not_seen(hashed, table, ["id", "text_hash"])
    cached = table.groupBy("text_hash").agg(F.max_by("vector", "created_at").alias("vector"))
    reused = new.join(cached, "text_hash").select("id", "text_hash", "vector")
    rest = not_seen(new, table, ["text_hash"])
    vectors = pooled_chunks(encode(chunks(rest, "id", F.coalesce("text", F.lit("")))), "id", "vector", "chunk", mode)
    fresh = vectors.join(rest.select("id", "text_hash"), "id").select("id", "text_hash", "vector")
    return upsert(table.select("id", "text_hash", "vector", "created_at"), reused.unionByName(fresh).withColumn("created_at", at), ["id"], "created_at")


def cluster_posts(vectors: DataFrame, groups: list[str], key: str, vector: str, eps: float, min_points: int, min_size: int, threshold: float = 0.0) -> DataFrame:
    """groups, key, cluster, strength and rank (1 to 5 of the representatives, else null): groups below min_size are the one cluster `single`, whose
    representatives are the first keys; the others are clustered by density (`density_clusters`), members weaker than threshold are noise."""
    guarded = small_guard(vectors, groups, min_size)
    small = guarded.where("path = 'single'").select(*groups, key, F.lit("single").alias("cluster"), F.lit(1.0).alias("strength"), vector)
    dense = density_clusters(guarded.where("path = 'density'"), groups, key, vector, eps, min_points, min_size)
    dense = dense.withColumn("label", F.when(F.col("strength") < threshold, -1).otherwise(F.col("label")))
    dense = dense.join(vectors.select(*groups, key, vector), [*groups, key]).select(*groups, key, name(F.col("label")).alias("cluster"), "strength", vector)
    every = small.unionByName(dense)
    group = F.struct(*groups, "cluster")
    ranked = representatives(dense.where("cluster <> 'noise'").select(group.alias("g"), key, vector), "g", key, vector).select(key, F.col("g.*"), F.col("rank").cast("int").alias("rank"))
    first = small.groupBy(*groups, "cluster").agg(F.slice(F.array_sort(F.collect_list(key)), 1, 5).alias("ks")).select(*groups, "cluster", F.posexplode("ks").alias("p", key))  # fewer than min_size keys a group
    ranked = ranked.select(*groups, "cluster", key, "rank").unionByName(first.select(*groups, "cluster", key, (F.col("p") + 1).alias("rank")))
    return every.join(ranked, [*groups, "cluster", key], "left").select(*groups, key, "cluster", "strength", "rank")


def in_clusters(rows: DataFrame, wanted: list[int] | None, column: str = "cluster") -> DataFrame:
    """Rows of the clusters that are wanted; None wants all."""
    return rows if wanted is None else rows.where(F.col(column).isin(wanted))


def newest_runs(runs: DataFrame, most: int | None = None) -> DataFrame:
    """Runs by id, newest first."""
    out = runs.orderBy(F.desc("run_id"))
    return out.limit(most) if most else out


def health_summary(checks: DataFrame) -> DataFrame:
    """checks (group, ok) -> passed and failed; a null is a failure."""
    ok = F.coalesce("ok", F.lit(False))
    return checks.groupBy("group").agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))


def parser_drift(expected: DataFrame, parsed: DataFrame) -> DataFrame:
    """(source, expected, parsed, drifted) from counts of rows (source, n): drifted where a source that should give rows gives none or fewer."""
    both = expected.select("source", F.col("n").alias("expected")).join(parsed.select("source", F.col("n").alias("parsed")), "source", "left").withColumn("parsed", F.coalesce("parsed", F.lit(0)))
    return both.withColumn("drifted", F.col("parsed") < F.col("expected"))


def of_run(rows: DataFrame, run_id: str | None = None, persona_id: str | None = None) -> DataFrame:
    """Rows of a run, of a persona, or of both; None wants all."""
    for column, wanted in (("run_id", run_id), ("persona_id", persona_id)):
        rows = rows if wanted is None else rows.where(F.col(column) == wanted)
    return rows


def in_time_order(posts: DataFrame, at: str, key: str, most: int | None = None) -> DataFrame:
    """Posts from the first to the last, equal times by key, those without a time last. With `most` a top-k that sorts no more than that in each task; without, a range-partitioned sort."""
    out = posts.orderBy(F.asc_nulls_last(at), key)
    return out.limit(most) if most else out


def batch_jobs(jobs: DataFrame, sources: DataFrame, limit: int = 200) -> DataFrame:
    """jobs (region, sources array, topic, extra map) as one row for each source to read: region, topic, source, limit, extra, known. `known` says whether the dimension (source, region) has it."""
    long = jobs.select("region", "topic", F.explode(F.array_distinct("sources")).alias("source"), F.lit(limit).alias("limit"), "extra")
    known = sources.select("source", "region", F.lit(True).alias("_k")).distinct()
    return long.join(known, ["source", "region"], "left").select("region", "topic", "source", "limit", "extra", F.coalesce("_k", F.lit(False)).alias("known"))
