"""Queries of the region dimension. Documents stand in for posts: their language gives the region, the number of their source its place there."""

from pyspark.sql import functions as F

from voxfield.operators import evidence as E
from voxfield.operators import relations as R
from voxfield.operators import textrank as T
from voxfield.plans.catalog import query, table
from voxfield.plans.relational import _CATS, _MEM, members
from voxfield.plans.textual import _TERMS, _terms
from voxfield.sources import regions as G

_OF = {"en": "US", "de": "DE", "fr": "FR", "es": "ES"}
_SIZE = {r: sum(x[0] == r for x in G.parse()) for r in dict.fromkeys(x[0] for x in G.parse())}
_sql = lambda x: "[" + ", ".join(map(_sql, x)) + "]" if isinstance(x, list) else f"'{x}'" if isinstance(x, str) else str(x)
_DIM = "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql, x)) + ")" for x in G.parse()) + ") t(region, name, languages, place, source, category, priority, persona_value, journey_value, stance, default_enabled, excluded))"
_REGION = "CASE " + " ".join(f"WHEN lang = '{a}' THEN '{b}'" for a, b in _OF.items()) + " ELSE 'HK' END"
_PLACED = f"(SELECT *, number % CASE region {' '.join(f'''WHEN '{r}' THEN {_SIZE[r]}''' for r in ('HK', *_OF.values()))} END AS place FROM (SELECT {_REGION} AS region, substr(source, 4)::INTEGER AS number FROM documents))"
_POSTS = f"(SELECT d.region, d.source, n FROM (SELECT region, place, count(*) AS n FROM {_PLACED} GROUP BY 1, 2) JOIN {_DIM} d USING (region, place))"


def post_counts(spark, sf_dir):
    """(region, source, n), counted by region and place before the dimension is joined."""
    region = F.lit("HK")
    for a, b in _OF.items():
        region = F.when(F.col("lang") == a, b).otherwise(region)
    sizes = F.create_map(*[F.lit(y) for r, n in _SIZE.items() for y in (r, n)])
    rows = table(spark, sf_dir, "documents").select(region.alias("region"), F.substring("source", 4, 9).cast("int").alias("number"))
    counts = rows.groupBy("region", (F.col("number") % sizes[F.col("region")]).alias("place")).agg(F.count("*").alias("n"))
    return counts.join(G.regions(spark), ["region", "place"]).select("region", "source", "n")


@query(
    "region_sources",
    f"""WITH c AS (SELECT region, source, row_number() OVER (PARTITION BY region ORDER BY list_position({_CATS}, category), priority, place)::INTEGER AS run FROM {_DIM} WHERE NOT excluded AND default_enabled)
        SELECT region, source, category, stance, coalesce(n, 0) AS posts, run FROM {_DIM} LEFT JOIN {_POSTS} USING (region, source) LEFT JOIN c USING (region, source)""",
)
def region_sources(spark, sf_dir):
    dim = G.regions(spark)
    run = G.default_sources(dim).select("region", "source", "run")
    rows = dim.join(post_counts(spark, sf_dir), ["region", "source"], "left").join(run, ["region", "source"], "left")
    return rows.select("region", "source", "category", "stance", F.coalesce("n", F.lit(0).cast("long")).alias("posts"), "run")


@query(
    "region_listing",
    f"""SELECT region, name, languages, sources, enabled, opt_in, excluded, categories, coalesce(posts, 0)::BIGINT AS posts FROM (SELECT region, any_value(name) AS name, array_to_string(any_value(languages), ',') AS languages, count(*) AS sources,
        count(*) FILTER (NOT excluded AND default_enabled) AS enabled, count(*) FILTER (NOT excluded AND NOT default_enabled) AS opt_in, count(*) FILTER (excluded) AS excluded,
        coalesce(string_agg(DISTINCT category, ',' ORDER BY category) FILTER (NOT excluded AND default_enabled), '') AS categories FROM {_DIM} GROUP BY 1) LEFT JOIN (SELECT region, sum(n) AS posts FROM {_POSTS} GROUP BY 1) USING (region)""",
)
def region_listing(spark, sf_dir):
    posts = post_counts(spark, sf_dir).groupBy("region").agg(F.sum("n").alias("posts"))
    return G.listing(G.regions(spark)).join(posts, "region", "left").withColumn("posts", F.coalesce("posts", F.lit(0).cast("long")))


@query("region_by_category", f"SELECT p.region, category, source, n AS posts, rank FROM {_POSTS} p JOIN (SELECT region, source, category, row_number() OVER (PARTITION BY region, category ORDER BY priority, place)::INTEGER AS rank FROM {_DIM} WHERE NOT excluded) USING (region, source)")
def region_by_category(spark, sf_dir):
    dim = G.by_category(G.regions(spark), include_opt_in=True)
    return post_counts(spark, sf_dir).join(dim, ["region", "source"]).select("region", "category", "source", F.col("n").alias("posts"), "rank")


_MADE = "(SELECT lang AS region, source, n % 5 = 0 AS bad, n FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2))"


@query(
    "region_violations",
    f"""SELECT region, source, 'prohibited but runs by default' AS problem FROM {_MADE} WHERE n % 3 = 0 AND n % 2 = 0 UNION ALL SELECT region, source, 'unknown category' FROM {_MADE} WHERE bad
        UNION ALL SELECT region, source, 'persona_value outside 1 to 5' FROM {_MADE} WHERE n % 7 = 0 OR n % 7 > 5 UNION ALL SELECT region, source, 'journey_value outside 1 to 5' FROM {_MADE} WHERE n % 6 = 0""",
)
def region_violations(spark, sf_dir):
    """A dimension made from how many posts each language has of a source."""
    n = F.col("n")
    made = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("region"), "source").agg(F.count("*").alias("n"))
    return G.violations(made.select("region", "source", n.alias("place"), F.when(n % 5 == 0, "other").otherwise("forums").alias("category"), (n % 7).alias("persona_value"), (n % 6).alias("journey_value"), F.when(n % 3 == 0, "prohibited").otherwise("silent").alias("stance"), (n % 2 == 0).alias("default_enabled")))


@query("weighted_evidence", f"SELECT region, category, posts, weight, CASE WHEN sum(weight) OVER (PARTITION BY region) > 0 THEN round(weight / sum(weight) OVER (PARTITION BY region), 4) ELSE 0 END::DOUBLE AS share FROM (SELECT region, category, sum(n)::BIGINT AS posts, sum(n * persona_value)::BIGINT AS weight FROM {_POSTS} JOIN {_DIM} USING (region, source) GROUP BY 1, 2)")
def weighted_evidence(spark, sf_dir):
    return G.weigh(post_counts(spark, sf_dir), G.regions(spark))


# Clusters of the United States: each post's source is the one at its number's place.
_USM = f"(SELECT m.cluster, m.doc_id, m.lang, d.source, d.category FROM {_MEM} m JOIN {_DIM} d ON d.region = 'US' AND d.place = substr(m.source, 4)::INTEGER % {_SIZE['US']})"


def _dict(column, order):
    return f"(SELECT cluster, '{{' || string_agg('\"' || {column} || '\": ' || n, ', ' ORDER BY {order}) || '}}' AS x FROM (SELECT cluster, {column}, count(*) AS n FROM {_USM} WHERE {column} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"


def _list(x):
    return f"CASE WHEN len({x}) = 0 THEN '[]' ELSE '[' || chr(10) || '    ' || array_to_string(list_transform({x}, lambda y: '\"' || y || '\"'), ',' || chr(10) || '    ') || chr(10) || '  ]' END"


@query(
    "evidence_coverage",
    f"""WITH {_TERMS}, tot AS (SELECT term, sum(tf) AS total FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 1000), w AS (SELECT cluster, term, round(tf * (ln(3.0 / (1 + CASE WHEN total > tf THEN 2 ELSE 1 END)) + 1), 6) AS weight FROM tf JOIN tot USING (term)),
    kw AS (SELECT cluster, string_agg(term, ', ' ORDER BY rank) AS x FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS rank FROM w) WHERE rank <= 10 GROUP BY 1),
    u AS (SELECT cluster, source, any_value(category) AS category, count(*) AS n FROM {_USM} GROUP BY 1, 2),
    c AS (SELECT cluster, sum(n)::BIGINT AS size, list_sort(list(DISTINCT category)) AS p, list(source ORDER BY n DESC, source) AS used, max(n) AS top_n,
      '{{' || chr(10) || '    ' || string_agg('"' || source || '": ' || n, ',' || chr(10) || '    ' ORDER BY source) || chr(10) || '  }}' AS counts FROM u GROUP BY 1),
    b AS (SELECT *, list_sort(list_filter({_CATS}, lambda k: NOT list_contains(p, k))) AS miss, list_sort(list_filter(['social', 'video_comments', 'reviews'], lambda k: NOT list_contains(p, k))) AS gap FROM c),
    j AS (SELECT cluster, size, '{{' || chr(10) || '  "bias_warning": "' || coalesce(nullif(concat_ws('; ', CASE WHEN top_n / size > 0.7 THEN floor(top_n * 100 / size)::INTEGER || '% of evidence from a single source (' || used[1] || ')' END,
        CASE WHEN len(gap) > 0 THEN 'no ' || array_to_string(gap, '/') || ' coverage' END,
        CASE WHEN len(p) > 0 AND len(list_filter(p, lambda k: k NOT IN ('forums', 'qa', 'news_comments'))) = 0 THEN 'persona likely skews text-first / forum-native; short-form social and video voices are absent' END), ''), 'balanced coverage across categories')
      || '",' || chr(10) || '  "categories_missing": ' || {_list("miss")} || ',' || chr(10) || '  "categories_present": ' || {_list("p")} || ',' || chr(10) || '  "category_count": ' || len(p) || ',' || chr(10)
      || '  "coverage_tier": "' || CASE WHEN len(p) <= 1 THEN 'single-perspective' WHEN len(p) = 2 THEN 'limited' WHEN len(p) <= 4 THEN 'balanced' ELSE 'high' END || '",' || chr(10) || '  "doc_counts": ' || counts || ',' || chr(10) || '  "sources_used": ' || {_list("used")} || chr(10) || '}}' AS coverage FROM b)
    SELECT cluster, array_to_string(['CLUSTER METADATA', '- cluster_id: ' || cluster, '- region: US', '- size: ' || size || ' posts', '- top keywords (c-TF-IDF): ' || coalesce(kw.x, ''), '- source distribution: ' || s.x, '- language distribution: ' || l.x, '',
      'DATA SOURCE COVERAGE (deterministic; informational)', coverage, '', 'EVIDENCE PACK', ''], chr(10)) AS header FROM j LEFT JOIN kw USING (cluster) JOIN {_dict("source", "source")} s USING (cluster) JOIN {_dict("lang", "lang")} l USING (cluster)""",
)
def evidence_coverage(spark, sf_dir):
    dim = G.regions(spark).where("region = 'US'").select("place", F.col("source").alias("s"), "category")
    number = F.substring("source", 4, 9).cast("int")
    posts = members(spark, sf_dir).select("cluster", "lang", (number % _SIZE["US"]).alias("place")).join(dim, "place").select("cluster", "lang", F.col("s").alias("source"), "category")
    counts = posts.groupBy("cluster", "source", "category").agg(F.count("*").alias("n"))
    words = T.ctfidf_one_vs_rest(_terms(spark, sf_dir), "cluster")
    return E.evidence_header(posts, words, coverage=R.coverage_json(counts, "cluster"), region=F.lit("US"))
