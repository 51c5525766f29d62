"""Queries around the language-model stage."""

from pyspark.sql import functions as F

from voxfield.operators import costs as C
from voxfield.operators import diagnostics as D
from voxfield.operators import evidence as E
from voxfield.operators import synthesis as S
from voxfield.plans.catalog import ORACLES, QUERIES, query, table
from voxfield.plans.relational import _MEM, _prices, members
from voxfield.plans.textual import _EVIDENCE, representatives
from voxfield.tables import written


@query("retry_prefix", "SELECT user_id, 'Fix these errors:' || chr(10) || '1. ' || min(event_type) || chr(10) || '2. ' || max(event_type) AS prefix FROM events GROUP BY 1")
def retry_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_type").alias("a"), F.max("event_type").alias("b"))
    return rows.select("user_id", S.retry_prefix(F.array("a", "b")).alias("prefix"))


@query("resolve_placeholders", "SELECT doc_id, 'see doc_' || substr(sha256('post_' || doc_id), 1, 12) || ' and doc_' || substr(sha256('post_x'), 1, 12) AS text FROM documents")
def resolve_placeholders(spark, sf_dir):
    said = F.concat(F.lit("see <post_"), "doc_id", F.lit("> and <post_x>"))
    return table(spark, sf_dir, "documents").select("doc_id", S.resolve_placeholders(said).alias("text"))


@query("sentiment_format", "SELECT user_id, concat_ws(' ', CASE WHEN e > 0 THEN 'err:' || e END, CASE WHEN p > 0 THEN 'pur:' || p END, CASE WHEN v > 0 THEN 'vie:' || v END) AS sentiment FROM (SELECT user_id, count(*) FILTER (event_type = 'error' AND value > 90) AS e, count(*) FILTER (event_type = 'purchase' AND value > 90) AS p, count(*) FILTER (event_type = 'view' AND value > 90) AS v FROM events GROUP BY 1)")
def sentiment_format(spark, sf_dir):
    count = lambda k: F.count_if((F.col("event_type") == k) & (F.col("value") > 90))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.create_map(*[y for k in ("error", "purchase", "view") for y in (F.lit(k), count(k))]).alias("m"))
    return rows.select("user_id", S.sentiment_text(F.col("m")).alias("sentiment"))


@query("cost_gate", "SELECT cluster, cost, round(sum(cost) OVER (ORDER BY cluster ROWS UNBOUNDED PRECEDING), 6) AS spent, round(sum(cost) OVER (ORDER BY cluster ROWS UNBOUNDED PRECEDING), 6) <= 0.25 AS runs FROM (SELECT label AS cluster, count(*) / 1000.0::DOUBLE AS cost FROM embeddings GROUP BY 1)")
def cost_gate(spark, sf_dir):
    costs = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("cluster")).agg((F.count("*") / 1000.0).alias("cost"))
    return S.within_budget(costs, "cluster", "cost", 0.25)


_COST = "(e + 900) / 1e6 * 3.0 + e / 1e6 * 0.3 + e / 1e6 * 3.75 + 3700 / 1e6 * 15.0"


@query(
    "cost_estimate",
    f"""SELECT 'a' AS provider, count(*) AS clusters, sum(e)::BIGINT AS evidence_tokens, sum(e + 900)::BIGINT AS input_tokens, count(*) * 3700 AS output_tokens, round(sum({_COST}), 4) AS cost_usd
  FROM (SELECT cluster, CASE WHEN block IS NULL THEN 200 + 80 * size ELSE floor(length(block) / 3.5)::BIGINT END AS e FROM (SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY 1) LEFT JOIN ({_EVIDENCE}) USING (cluster))""",
)
def cost_estimate(spark, sf_dir):
    """From each cluster's evidence, or its size where no pack was made."""
    sizes = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("size"))
    blocks = E.evidence_block(E.evidence_pack(members(spark, sf_dir), representatives(spark, sf_dir)))
    use = C.estimated_usage(sizes.join(blocks, "cluster", "left"), "cluster", "block", "size")
    total = use.agg(F.count("*").alias("clusters"), F.sum("evidence_tokens").alias("evidence_tokens"), *[F.sum(t).alias(t) for t in C.TOKENS]).withColumn("provider", F.lit("a"))
    cost = C.usage_cost(total, _prices(spark)).select("provider", F.round("cost_usd", 4).alias("cost_usd"))
    return total.join(cost, "provider").select("provider", "clusters", "evidence_tokens", "input_tokens", "output_tokens", "cost_usd")


# every cluster numbered 3 is noise here
_GROUPED = f"(SELECT nullif(cluster, 3) AS cluster, * EXCLUDE (cluster) FROM {_MEM})"
_COUNTED = "SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY cluster), 1)::DOUBLE AS pct, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, value) AS place FROM"


def _listed(column, title, block, pct):
    n = f"({_COUNTED} (SELECT cluster, {column} AS value, count(*) AS n FROM m WHERE cluster IS NOT NULL GROUP BY ALL))"
    said = "'  - ' || value || ': ' || n" + (" || ' (' || pct || '%)'" if pct else "")
    warn = f" UNION ALL SELECT 2, cluster::VARCHAR, {block + 1}, 2 * place + 1, '    ⚠ This cluster is >80% from one source — bias risk' FROM {n} WHERE pct > 80" if pct else ""
    return f"SELECT 2, cluster::VARCHAR, {block}, 0, '**{title} distribution:**' FROM {n} WHERE place = 1 UNION ALL SELECT 2, cluster::VARCHAR, {block + 1}, 2 * place, {said} FROM {n} UNION ALL SELECT 2, cluster::VARCHAR, {block + 2}, 0, '' FROM {n} WHERE place = 1" + warn


def _put(part, block, lines, source, cluster="NULL"):
    return " UNION ALL ".join(f"SELECT {part}, {cluster}, {block}, {k}, {line} FROM {source}" for k, line in enumerate(lines) if line)


_DIAGNOSTICS = (
    _EVIDENCE.split(",\n  rest AS")[0] + f""", m AS (FROM {_GROUPED}), z AS (SELECT cluster, count(*) AS size FROM m WHERE cluster IS NOT NULL GROUP BY 1), d AS (SELECT min(size) AS low, max(size) AS high FROM z),
  t AS (SELECT count(*) AS posts, count(*) FILTER (cluster IS NULL) AS noise, count(DISTINCT cluster) AS found, round(100.0 * count(*) FILTER (cluster IS NULL) / count(*), 1)::DOUBLE AS pct FROM m),
  k AS (SELECT cluster, string_agg(term, ', ' ORDER BY rank) AS w FROM ({ORACLES['ctfidf_all']}) WHERE cluster <> 3 GROUP BY 1),
  r AS (SELECT cluster, pos, doc_id, coalesce(text, '') AS text FROM (SELECT cluster, doc_id, pos FROM reps WHERE cluster <> 3 AND pos <= 3) LEFT JOIN m USING (cluster, doc_id)), """
    + "o(part, cluster, block, pos, line) AS ("
    + " UNION ALL ".join(
        [
            _put(0, 0, ["'# Cluster Diagnostics — t (r)'", "''", "'Total posts: ' || posts", "'Clusters found: ' || found", "'Noise (unclustered): ' || noise || ' (' || pct || '%)'", "''"], "t"),
            _put(1, 0, ["'## 1. Cluster Sizes'", "''", "'Range: ' || low || ' – ' || high", "'```'"], "d"), "SELECT 1, NULL, 1, -size, '  ' || repeat('█', greatest(1, size * 40 // high)::INTEGER) || ' ' || size FROM z, d", _put(1, 2, ["'```'", "''", "'## 2. Cluster Details'", "''"], "d"),
            _put(2, 0, ["'### Cluster ' || cluster || ' — size ' || size", "''"], "z", "cluster::VARCHAR"), _put(2, 1, ["'**Keywords:** ' || w", "''"], "k", "cluster::VARCHAR"), _put(2, 2, ["'**Representative posts:**'"], "z", "cluster::VARCHAR"),
            "SELECT 2, cluster::VARCHAR, 3, pos, pos || '. `' || doc_id || '`: ' || replace(substr(text, 1, 200), chr(10), ' ') || CASE WHEN length(text) > 200 THEN '…' ELSE '' END FROM r", _put(2, 4, ["''"], "z", "cluster::VARCHAR"),
            _listed("source", "Source", 5, True), _listed("lang", "Language", 8, False),
            _put(3, 0, ["'## 3. Parameter Suggestions'", "''", "CASE WHEN pct > 40 THEN '⚠ Noise ratio is high (' || pct || '%). Consider:' WHEN pct < 5 THEN 'ℹ Noise ratio is low (' || pct || '%). Consider:' ELSE '✓ Noise ratio (' || pct || '%) is in a healthy range (5–40%).' END"], "t"),
            "SELECT 3, NULL, 0, 5, '' FROM t", "SELECT 3, NULL, 0, 3, CASE WHEN pct > 40 THEN '  - Lowering the least cluster size (current: N/A)' ELSE '  - Raising the least cluster size to produce tighter clusters' END FROM t WHERE pct > 40 OR pct < 5",
            "SELECT 3, NULL, 0, 4, CASE WHEN pct > 40 THEN '  - Lowering the outlier threshold (current: N/A)' ELSE '  - Raising the outlier threshold to be more selective' END FROM t WHERE pct > 40 OR pct < 5",
        ]
    )
    + ") SELECT part::INTEGER AS part, cluster, block::INTEGER AS block, pos::BIGINT AS pos, line FROM o"
)


@query("diagnostics", _DIAGNOSTICS)
def diagnostics(spark, sf_dir):
    named = lambda df: df.where("cluster <> 3")
    return D.report_lines(members(spark, sf_dir, "nullif(label, 3)"), named(representatives(spark, sf_dir)), named(QUERIES["ctfidf_all"](spark, sf_dir)), "t", "r")


@query("synthesize_mock", "SELECT label AS cluster, 2::INTEGER AS attempts, 0::INTEGER AS n_errors FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) GROUP BY 1")
def synthesize_mock(spark, sf_dir):
    pack = written(E.evidence_pack(members(spark, sf_dir), representatives(spark, sf_dir)))
    docs = pack.groupBy("cluster").agg(F.collect_list(F.struct(F.col("short_id").alias("doc"), F.col("snippet").alias("text"))).alias("docs"))
    packs = E.evidence_block(pack).join(docs, "cluster").select("cluster", "block", "docs")
    return S.synthesize(packs, S.quoting_client).select("cluster", "attempts", F.size("errors").alias("n_errors"))
