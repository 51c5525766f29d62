"""Queries of near-duplicates, density clusters, the vector index and its tables, robots rules and cached lookups."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxfield.operators import density as D
from voxfield.operators import index as I
from voxfield.operators import lookups as L
from voxfield.operators import near as N
from voxfield.operators import personas as P
from voxfield.operators import posts as O
from voxfield.plans.catalog import query, table
from voxfield.plans.vectors import _Q
from voxfield.session import shared_folder
from voxfield.sinks.csv import read_partitions, write_partitioned

#: All pairs of different texts by shared shingles, and what is reachable over links.
_NEAR = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS MATERIALIZED (SELECT min(doc_id) AS t, ws FROM w WHERE len(ws) > 0 GROUP BY ws),
of AS (SELECT w.doc_id, coalesce(t.t, w.doc_id) AS t FROM w LEFT JOIN t ON t.ws = w.ws),
sh AS MATERIALIZED (SELECT t AS doc_id, hash(s) AS s FROM (SELECT t, unnest(list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS s FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
met AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y FROM met JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 20 * c >= 17 * (nx.n + ny.n - c)),
reach AS (SELECT t AS x, t AS y FROM of UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
class AS (SELECT x AS t, min(y) AS class_id FROM reach GROUP BY 1)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM of JOIN class USING (t)
"""


@query("near_duplicates", _NEAR)
def near_duplicates(spark, sf_dir):
    return N.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def _density(rows, least):
    """DBSCAN by all pairs: eps 1.14, 3 points. rows gives vec_id and e."""
    return f"""v AS ({rows}), p AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON list_distance(a.e, b.e) <= 1.14),
    n AS (SELECT x, count(*) AS n FROM p GROUP BY 1), core AS (SELECT x FROM n WHERE n >= 3),
    link AS (SELECT x, y FROM p WHERE x IN (SELECT x FROM core) AND y IN (SELECT x FROM core)),
    reach AS (SELECT x, x AS y FROM core UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
    c AS (SELECT x, min(y) AS cluster FROM reach GROUP BY 1),
    m AS (SELECT x, cluster FROM c UNION ALL SELECT p.x, min(cluster) FROM p JOIN c ON c.x = p.y WHERE p.x NOT IN (SELECT x FROM core) GROUP BY 1),
    s AS (SELECT cluster, (row_number() OVER (ORDER BY cluster) - 1)::INTEGER AS label FROM m GROUP BY 1 HAVING count(*) >= {least}),
    den AS (SELECT v.vec_id, v.e, coalesce(label, -1)::INTEGER AS label, CASE WHEN label IS NULL THEN 0.0 ELSE least(1.0, n / 3) END::DOUBLE AS strength, label IS NOT NULL AND n >= 3 AS core FROM v LEFT JOIN n ON n.x = v.vec_id LEFT JOIN (SELECT m.x, s.label FROM m JOIN s USING (cluster)) k ON k.x = v.vec_id)"""


_VECTORS = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings"


@query("density_cluster", f"WITH RECURSIVE {_density(_VECTORS, 3)} SELECT vec_id, label, round(strength, 6) AS strength, core FROM den")
def density_cluster(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("topic", F.lit("all"))
    return D.density_clusters(rows, ["topic"], "vec_id", "embedding", 1.14, 3, 3).select("vec_id", "label", F.round("strength", 6).alias("strength"), "core")


@query("knn_index")
def knn_index(spark, sf_dir):
    """Builds the index once in the shared folder, then searches three quarters of its lists: the vectors have no clusters, so fewer would miss neighbours."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    I.build(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", path, lists=16)
    return I.knn(spark, path, _Q, 10, "vec_id", "embedding", probes=12)


@query(
    "cluster_posts",
    f"""WITH RECURSIVE {_density(_VECTORS + " WHERE vec_id >= 7", 10)},
    cen AS (SELECT label, list(mean ORDER BY dim) AS cen FROM (SELECT label, dim, avg(y) AS mean FROM (SELECT label, unnest(range(64)) AS dim, unnest(e) AS y FROM den WHERE label >= 0) GROUP BY 1, 2) GROUP BY 1),
    rep AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY round(list_distance(e, cen), 6), vec_id)::INTEGER AS rank FROM den JOIN cen USING (label)),
    every AS (SELECT 0 AS topic, vec_id, CASE WHEN label < 0 THEN 'noise' ELSE printf('cluster_%03d', label) END AS cluster, round(strength, 6) AS strength, CASE WHEN rank <= 5 THEN rank END AS rank FROM den LEFT JOIN rep USING (vec_id)
              UNION ALL SELECT -1, vec_id, 'single', 1.0, CASE WHEN vec_id < 5 THEN vec_id + 1 END::INTEGER FROM embeddings WHERE vec_id < 7)
    SELECT * FROM every""",
)
def cluster_posts(spark, sf_dir):
    """Two topics: seven rows, which are too few to cluster, and all the others."""
    v = table(spark, sf_dir, "embeddings").withColumn("topic", F.when(F.col("vec_id") < 7, -1).otherwise(0))
    return O.cluster_posts(v, ["topic"], "vec_id", "embedding", 1.14, 3, 10, 0.1).select("topic", "vec_id", "cluster", F.round("strength", 6).alias("strength"), "rank")


@query(
    "persona_merge",
    """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    link AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON list_cosine_similarity(a.e, b.e) >= 0.4), reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
    h AS (SELECT x, min(y) AS vec_id FROM reach GROUP BY 1)
    SELECT h.vec_id, count(*) AS n_merged, count(DISTINCT label) AS n_claims FROM h JOIN v ON v.vec_id = h.x GROUP BY 1""",
)
def persona_merge(spark, sf_dir):
    """At a cosine of 0.4, as the test vectors hardly have closer ones."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.array("label").alias("claims"))
    out = P.merged_personas(rows, "vec_id", "embedding", "claims", 0.4)
    return out.select("vec_id", F.size("merged").cast("long").alias("n_merged"), F.size("claims").cast("long").alias("n_claims"))


@query("embeddings_by_topic", "SELECT vec_id, label AS topic, CASE label % 2 WHEN 0 THEN 'HK' ELSE 'US' END AS region FROM embeddings WHERE label IN (SELECT n_nationkey % 10 FROM nation WHERE n_regionkey = 2)")
def embeddings_by_topic(spark, sf_dir):
    """The vectors as a table by topic and region, of which a dimension's topics are read."""
    path = f"{shared_folder(spark)}/embeddings-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("topic"), F.when(F.col("label") % 2 == 0, "HK").otherwise("US").alias("region"), "embedding")
    write_partitioned(rows, path, ["topic", "region"])
    wanted = table(spark, sf_dir, "nation").where("n_regionkey = 2").select((F.col("n_nationkey") % 10).alias("topic"))
    return read_partitions(spark, path, wanted, ["topic"]).select("vec_id", "topic", "region")


_ROBOTS = """SELECT host, CASE k WHEN 0 THEN 'User-agent: other' || chr(10) || 'Disallow: /' WHEN 1 THEN 'User-agent: *' || chr(10) || 'Disallow: /en/1' || chr(10) || 'Disallow: /en # all' || chr(10) || 'Disallow:'
             WHEN 2 THEN 'Disallow: /fr' || chr(13) || chr(10) || 'User-Agent: Bot' || chr(10) || 'disallow: /de/2' END AS text FROM (SELECT host, (row_number() OVER (ORDER BY host) - 1) % 4 AS k FROM (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/:?#]+)', 1) AS host FROM pages))"""


@query(
    "robots_rules",
    f"""WITH f AS ({_ROBOTS}), r AS (SELECT host, unnest(CASE WHEN starts_with(text, 'User-agent: *') THEN ['/en/1', '/en'] WHEN starts_with(text, 'Disallow') THEN ['/de/2'] ELSE [] END) AS prefix FROM f),
    u AS (SELECT DISTINCT url, regexp_extract(url, '^([a-z]+://[^/:?#]+)', 1) AS host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/') AS path FROM pages)
    SELECT u.url, arg_max(prefix, length(prefix)) AS rule FROM u LEFT JOIN r ON r.host = u.host AND starts_with(u.path, r.prefix) GROUP BY 1""",
)
def robots_rules(spark, sf_dir):
    """Every fourth host has no file, the others one of three."""
    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(L.host_and_path(F.col("url"))[0].alias("host")).distinct()
    kind = (F.row_number().over(Window.orderBy("host")) - 1) % 4  # over hosts
    text = F.when(kind == 0, "User-agent: other\nDisallow: /").when(kind == 1, "User-agent: *\nDisallow: /en/1\nDisallow: /en # all\nDisallow:").when(kind == 2, "Disallow: /fr\r\nUser-Agent: Bot\ndisallow: /de/2")
    return L.robots_check(pages, "url", L.robots_rules(hosts.select("host", text.alias("text")), "host", "text", "bot"))


@query(
    "cached_lookups",
    """WITH c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'), r AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click')
    SELECT r.event_id, CASE WHEN c.ts IS NULL THEN 'miss' WHEN r.ts - c.ts <= INTERVAL 12 HOUR THEN 'hit' ELSE 'expired' END AS status, CASE WHEN r.ts - c.ts <= INTERVAL 12 HOUR THEN c.event_id END AS result FROM r ASOF LEFT JOIN c ON r.user_id = c.user_id AND r.ts >= c.ts""",
)
def cached_lookups(spark, sf_dir):
    """Clicks look up their user's last view, which lives for twelve hours."""
    events = table(spark, sf_dir, "events")
    cache = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("recorded_at"), F.col("event_id").alias("result"))
    return L.cached(events.where("event_type = 'click'").select("event_id", "user_id", "ts"), cache, "user_id", "ts", 12 * 3600).select("event_id", "status", "result")


@query("outlier_mask", f"WITH RECURSIVE {_density(_VECTORS, 3)} SELECT vec_id, CASE WHEN strength < 1 THEN -1 ELSE label END::INTEGER AS label FROM den")
def outlier_mask(spark, sf_dir):
    """Members of a cluster that are less than core become noise."""
    return density_cluster(spark, sf_dir).select("vec_id", F.when(F.col("strength") < 1, -1).otherwise(F.col("label")).alias("label"))


@query(
    "noise_pct",
    f"""WITH RECURSIVE {_density(_VECTORS, 3)}, t AS (SELECT count(*) AS total, count(*) FILTER (label < 0) AS noise FROM den)
    SELECT total, noise, round(100.0 * noise / total, 1)::DOUBLE AS noise_pct, CASE WHEN 100.0 * noise / total > 40 THEN 'high' WHEN 100.0 * noise / total < 5 THEN 'low' ELSE 'normal' END AS advice FROM t""",
)
def noise_pct(spark, sf_dir):
    out = density_cluster(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("label") < 0).alias("noise"))
    pct = F.try_divide(100.0 * F.col("noise"), F.col("total"))
    return out.select("total", "noise", F.round(pct, 1).alias("noise_pct"), F.when(pct > 40, "high").when(pct < 5, "low").otherwise("normal").alias("advice"))
