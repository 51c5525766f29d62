"""Queries of personas, journeys, embedding and runs. Stand-ins: clusters are owners, their documents the packs, events the claims (each cites none or two documents)."""

from pyspark.sql import functions as F

from voxfield.operators import personas as P
from voxfield.operators import posts as O
from voxfield.operators.relations import STAGES
from voxfield.plans.catalog import QUERIES, query, table
from voxfield.plans.relational import _MEM, _NEG, _POS, members

#: Claims cite ids below the number of vectors, which is the number of documents that packs may hold.
_N = "(SELECT count(*) FROM embeddings)"
_STAGE = "[" + ", ".join(f"'{s}'" for s in STAGES) + "]"
_C = f"(SELECT (event_id % 10)::INTEGER AS owner, {_STAGE}[event_id // 10 % 6 + 1] AS stage, event_type AS field, event_id AS pos, CASE WHEN event_id % 7 = 0 THEN []::VARCHAR[] ELSE [(event_id * 3 % {_N})::VARCHAR, (user_id % {_N})::VARCHAR] END AS cites FROM events)"
_P = f"(SELECT cluster AS owner, doc_id::VARCHAR AS doc, * FROM {_MEM})"
_X = f"(SELECT c.owner, c.stage, c.field, c.pos, c.doc, p.doc IS NOT NULL AS known FROM (SELECT owner, stage, field, pos, unnest(CASE WHEN len(cites) = 0 THEN [NULL] ELSE cites END) AS doc FROM {_C}) c LEFT JOIN {_P} p ON p.owner = c.owner AND p.doc = c.doc)"
_BAD = f"(SELECT owner, stage, field, pos, bool_or(NOT known) AS bad FROM {_X} GROUP BY ALL)"
_ERR = f"SELECT owner, stage || '.' || field || '[' || pos || '] missing evidence array' AS error FROM {_C} WHERE len(cites) = 0 UNION ALL SELECT owner, stage || '.' || field || '[' || pos || '] cites unknown doc_id ''' || doc || '''' FROM {_X} WHERE doc IS NOT NULL AND NOT known"
# Quotes: of every third document its first words, of some others' text, or blank; some of a document of another cluster.
_Q = f"(SELECT CASE WHEN doc_id % 15 = 0 THEN owner + 1 ELSE owner END AS owner, doc_id AS pos, doc, CASE doc_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'never said' ELSE substr(text, 1, 40) END AS text, CASE WHEN doc_id % 2 = 0 THEN 'u/' || doc_id ELSE '' END AS url, CASE WHEN doc_id % 5 = 0 THEN source END AS source, '' AS lang FROM {_P} WHERE doc_id % 3 = 0)"


def claims(spark, sf_dir):
    e = F.col("event_id")
    n = F.lit(table(spark, sf_dir, "embeddings").count())
    two = F.array((e * 3 % n).cast("string"), (F.col("user_id") % n).cast("string"))
    return table(spark, sf_dir, "events").select((e % 10).cast("int").alias("owner"), F.element_at(F.array(*map(F.lit, STAGES)), (F.floor(e / 10) % 6 + 1).cast("int")).alias("stage"), F.col("event_type").alias("field"), e.alias("pos"), F.when(e % 7 == 0, F.array().cast("array<string>")).otherwise(two).alias("cites"))


def pack(spark, sf_dir):
    return members(spark, sf_dir).select(F.col("cluster").alias("owner"), F.col("doc_id").cast("string").alias("doc"), "doc_id", "text", "source", F.concat(F.lit("p/"), "doc_id").alias("url"), "lang")


def quotes(spark, sf_dir):
    d = F.col("doc_id")
    text = F.when(d % 4 == 0, " ").when(d % 4 == 1, "never said").otherwise(F.substring("text", 1, 40))
    rows = pack(spark, sf_dir).where(d % 3 == 0)
    return rows.select(F.when(d % 15 == 0, F.col("owner") + 1).otherwise(F.col("owner")).alias("owner"), d.alias("pos"), "doc", text.alias("text"), F.when(d % 2 == 0, F.concat(F.lit("u/"), d)).otherwise("").alias("url"), F.when(d % 5 == 0, F.col("source")).alias("source"), F.lit("").alias("lang"))


@query("journey_errors", _ERR)
def journey_errors(spark, sf_dir):
    return P.claim_errors(claims(spark, sf_dir), pack(spark, sf_dir))


_TRIM = "trim(q.text)"
_QERR = f"CASE WHEN p.doc IS NULL THEN 'doc_id ''' || q.doc || ''' not in pack' WHEN {_TRIM} = '' THEN 'empty text_original' WHEN NOT contains(p.text, {_TRIM}) THEN 'text_original is not a verbatim substring of ' || q.doc END"
_QE = f"(SELECT q.owner, q.pos, 'representative_quotes[' || q.pos || '] ' || {_QERR} AS error FROM {_Q} q LEFT JOIN {_P} p ON p.owner = q.owner AND p.doc = q.doc)"


@query("persona_quote_errors", f"SELECT owner, pos, error FROM {_QE} WHERE error IS NOT NULL")
def persona_quote_errors(spark, sf_dir):
    return P.quote_errors(quotes(spark, sf_dir), pack(spark, sf_dir))


@query(
    "persona_errors",
    _ERR.replace("stage || '.' || ", "") + f" UNION ALL SELECT owner, error FROM {_QE} WHERE error IS NOT NULL"
    f" UNION ALL SELECT owner, 'representative_quotes: returned ' || n || ', must return at least ' || want FROM (SELECT owner, least(count(DISTINCT doc), 40) AS want, (SELECT count(*) FROM {_Q} q WHERE q.owner = p.owner) AS n FROM {_P} p GROUP BY owner) WHERE n < want",
)
def persona_errors(spark, sf_dir):
    return P.persona_errors(claims(spark, sf_dir).withColumn("stage", F.lit(None).cast("string")), quotes(spark, sf_dir), pack(spark, sf_dir), least=40)


@query("verified_claims", f"SELECT b.owner, b.stage, b.field, b.pos, CASE WHEN f.lost THEN 'unverified' ELSE 'ok' END AS coverage FROM {_BAD} b JOIN (SELECT owner, stage, field, bool_or(bad) AS lost FROM {_BAD} GROUP BY ALL) f USING (owner, stage, field) WHERE NOT b.bad")
def verified_claims(spark, sf_dir):
    return P.verified_claims(claims(spark, sf_dir), pack(spark, sf_dir)).select("owner", "stage", "field", "pos", "coverage")


@query("grounded_claims", f"SELECT x.owner, pos, count(DISTINCT doc) FILTER (known) AS n_users, round(count(DISTINCT doc) FILTER (known) / greatest(coalesce(any_value(s.n), 1), 1), 3) AS pct_of_cluster FROM {_X} x LEFT JOIN (SELECT owner, count(DISTINCT doc) AS n FROM {_P} GROUP BY 1) s USING (owner) GROUP BY x.owner, pos")
def grounded_claims(spark, sf_dir):
    return P.grounded_claims(claims(spark, sf_dir), pack(spark, sf_dir)).select("owner", "pos", "n_users", "pct_of_cluster")


@query("persona_confidence", f"SELECT owner, count(*) FILTER (lost) AS unverified_fields, greatest(0.0, round(1 - 0.1 * count(*) FILTER (lost), 6))::DOUBLE AS confidence FROM (SELECT owner, field, bool_or(bad) AS lost FROM {_BAD} GROUP BY ALL) GROUP BY 1")
def persona_confidence(spark, sf_dir):
    whole = claims(spark, sf_dir).withColumn("stage", F.lit(None).cast("string"))
    return P.persona_confidence(whole, P.verified_claims(whole, pack(spark, sf_dir)))


@query("filled_quotes", f"SELECT q.owner, q.pos, q.doc, {_TRIM} AS text, coalesce(nullif(q.source, ''), nullif(p.source, ''), '') AS source, coalesce(nullif(q.url, ''), 'p/' || p.doc_id, '') AS url, coalesce(p.lang, 'en') AS lang FROM {_Q} q LEFT JOIN {_P} p ON p.owner = q.owner AND p.doc = q.doc")
def filled_quotes(spark, sf_dir):
    return P.filled_quotes(quotes(spark, sf_dir), pack(spark, sf_dir))


@query("journey_stages", f"SELECT o.owner, s.stage, s.pos::INTEGER AS pos, coalesce(c.n, 0) AS n_cited, CASE WHEN c.n IS NULL THEN 'none' WHEN c.n < 2 THEN 'thin' ELSE 'ok' END AS coverage FROM (SELECT DISTINCT owner FROM {_P}) o, (SELECT unnest({_STAGE}) AS stage, unnest(range(6)) AS pos) s LEFT JOIN (SELECT owner, stage, count(DISTINCT doc) AS n FROM {_X} GROUP BY 1, 2) c ON c.owner = o.owner AND c.stage = s.stage")
def journey_stages(spark, sf_dir):
    return P.journey_stages(pack(spark, sf_dir), claims(spark, sf_dir))


@query("first_urls", "SELECT user_id AS owner, event_type AS doc, arg_min('e/' || event_id, event_id) AS url FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2")
def first_urls(spark, sf_dir):
    e = F.col("event_id")
    return P.first_urls(table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("doc"), e.alias("pos"), F.when(e % 3 == 0, "").otherwise(F.concat(F.lit("e/"), e)).alias("url")))


@query("card_quotes", "SELECT conv_id AS owner, turn AS pos, CASE WHEN length(text) > 200 THEN rtrim(substr(text, 1, 199)) || '…' ELSE text END AS text, '??' AS lang, '—' AS source, substr(conv_id || '-' || turn || '-0123456789', 1, 12) AS short_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 3")
def card_quotes(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("owner"), F.col("turn").alias("pos"), F.concat(F.lit("doc_"), "conv_id", F.lit("-"), "turn", F.lit("-0123456789")).alias("doc"), "text", F.lit("").alias("lang"), F.lit(None).cast("string").alias("source"))
    return P.card_quotes(rows)


@query(
    "card_chips",
    "SELECT owner, (row_number() OVER (PARTITION BY owner ORDER BY k) - 1)::INTEGER AS pos, label, value FROM (SELECT c_custkey AS owner, 1 AS k, 'Age' AS label, '20-30' AS value FROM customer WHERE c_custkey % 3 = 0"
    " UNION ALL SELECT c_custkey, 2, 'Occupation', c_mktsegment || ' · b · c' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 3, 'Region', CASE WHEN c_custkey % 5 = 0 THEN 'EN' ELSE c_mktsegment END FROM customer"
    " UNION ALL SELECT c_custkey, 4, 'Cluster size', c_nationkey || ' posts' FROM customer WHERE c_nationkey > 0)",
)
def card_chips(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    jobs = F.when(k % 2 == 0, F.array("c_mktsegment", F.lit("b"), F.lit("c"), F.lit("d")))
    return P.card_chips(c.select(k.alias("owner"), F.when(k % 3 == 0, "20-30").alias("age_range"), jobs.alias("occupations"), F.when(k % 5 == 0, "").otherwise(F.lower("c_mktsegment")).alias("region"), F.lit("en").alias("language"), F.col("c_nationkey").alias("cluster_size")))


@query("bundle", "SELECT c_custkey AS persona_id, c_mktsegment AS run_id, o_orderkey AS journey_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def bundle(spark, sf_dir):
    personas = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("persona_id"), F.col("c_mktsegment").alias("run_id"))
    return P.bundle(personas, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("persona_id"), F.col("o_orderkey").alias("journey_id")), "BUILDING")


_W = r"string_split_regex(lower(text), '[^\p{L}]+')"
_HITS = {lang: f"len(list_filter({_W}, lambda w: w IN ({', '.join(repr(x) for x in v)})))" for lang, v in O._WORDS.items()}
_TOP = f"greatest({', '.join(_HITS.values())})"


@query("language_hint", "SELECT doc_id, CASE WHEN length(trim(text)) < 2 THEN NULL " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{lang}'" for lang, p in O._SCRIPTS.items()) + " " + " ".join(f"WHEN {n} = {_TOP} THEN '{lang}'" for lang, n in _HITS.items()) + " END AS lang FROM documents")
def language_hint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", O.language_hint(F.col("text")).alias("lang"))


@query("clustering_text", "SELECT doc_id, sha256(trim(CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END || chr(10) || text)) AS hash FROM documents")
def clustering_text(spark, sf_dir):
    text = O.clustering_text(F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.cast("binary"), 256).alias("hash"))


_OLD = "(SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 = 0)"


@query("embed_posts", f"SELECT doc_id AS id, sha256(text) AS text_hash, (doc_id % 3 = 0 OR sha256(text) IN (SELECT h FROM {_OLD})) AS reused, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS created_at FROM documents")
def embed_posts(spark, sf_dir):
    """A third of the documents is in the table; the encoder gives lengths, the table holds a mark no encoder gives."""
    posts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    mark = F.array(F.lit(0.0), F.lit(-1.0))
    old = posts.where("id % 3 = 0").select("id", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"), mark.alias("vector"), F.lit(1).alias("created_at"))
    out = O.embed_posts(posts, old, lambda c: c.withColumn("vector", F.array(F.lit(1.0), F.length("text").cast("double"))), F.lit(2))
    return out.select("id", "text_hash", (F.col("vector") == mark).alias("reused"), "created_at")


@query("cluster_subset", f"SELECT doc_id, cluster FROM {_MEM} WHERE cluster IN (1, 3)")
def cluster_subset(spark, sf_dir):
    return O.in_clusters(members(spark, sf_dir).select("doc_id", "cluster"), [1, 3])


@query("newest_runs", "SELECT o_orderkey AS run_id, o_orderstatus AS status FROM orders ORDER BY 1 DESC LIMIT 20")
def newest_runs(spark, sf_dir):
    return O.newest_runs(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status")), 20)


@query("health_summary", 'SELECT source AS "group", count(*) FILTER (n_chars > 500) AS passed, count(*) FILTER (n_chars <= 500) AS failed FROM documents GROUP BY 1')
def health_summary(spark, sf_dir):
    return O.health_summary(table(spark, sf_dir, "documents").select(F.col("source").alias("group"), (F.col("n_chars") > 500).alias("ok")))


@query("parser_drift", r"SELECT source, count(*) AS expected, count(*) FILTER (length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 10) AS parsed, count(*) FILTER (length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 10) > 0 AS drifted FROM documents GROUP BY 1")
def parser_drift(spark, sf_dir):
    parsed = QUERIES["site_mobile01"](spark, sf_dir).groupBy(F.col("author").alias("source")).agg(F.count("*").alias("n"))
    return O.parser_drift(table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")), parsed)


_SCORE = f"(SELECT doc_id::VARCHAR AS doc, len(list_filter({_POS}, lambda w: contains(lower(text), w))) - len(list_filter({_NEG}, lambda w: contains(lower(text), w))) AS s FROM documents)"
_AGAINST = f"(SELECT DISTINCT owner, stage, field, pos, x.doc FROM {_X} x JOIN {_SCORE} c ON c.doc = x.doc WHERE known AND s < 0)"


def _contested(spark, sf_dir):
    """Claims with the documents they cite from their pack that speak against them."""
    from voxfield.functions.text import hits

    docs, cited = pack(spark, sf_dir), claims(spark, sf_dir)
    against = docs.where(hits(F.col("text"), _POS) < hits(F.col("text"), _NEG)).select("owner", "doc")
    rows = cited.select("owner", "stage", "field", "pos", F.explode("cites").alias("doc")).join(against, ["owner", "doc"])
    return P.contested_merge(cited, rows)


@query("contested_merge", f"SELECT c.owner, c.stage, c.field, c.pos, coalesce(string_agg(a.doc, ',' ORDER BY a.doc), '') AS contested_by FROM {_C} c LEFT JOIN {_AGAINST} a ON a.owner = c.owner AND a.stage = c.stage AND a.field = c.field AND a.pos = c.pos GROUP BY ALL")
def contested_merge(spark, sf_dir):
    return _contested(spark, sf_dir).select("owner", "stage", "field", "pos", F.array_join("contested_by", ",").alias("contested_by"))


@query(
    "contested_count",
    f"""WITH v AS (SELECT b.owner, b.stage, b.field, b.pos, f.lost FROM {_BAD} b JOIN (SELECT owner, stage, field, bool_or(bad) AS lost FROM {_BAD} GROUP BY ALL) f USING (owner, stage, field) WHERE NOT b.bad)
    SELECT v.owner, count(*) FILTER ((v.owner, stage, field, pos) IN (SELECT (owner, stage, field, pos) FROM {_AGAINST})) AS contested, coalesce(string_agg(DISTINCT field, ',' ORDER BY field) FILTER (lost), '') AS unverified FROM v GROUP BY 1""",
)
def contested_count(spark, sf_dir):
    out = P.contested_count(P.verified_claims(_contested(spark, sf_dir), pack(spark, sf_dir)))
    return out.select("owner", "contested", F.array_join("unverified", ",").alias("unverified"))


@query(
    "sentiment_rollup",
    f"""WITH m AS (SELECT x.owner, CASE WHEN s < 0 THEN 'negative' WHEN s > 0 THEN 'positive' ELSE 'neutral' END AS mood FROM {_X} x LEFT JOIN {_SCORE} c ON c.doc = x.doc WHERE known)
    SELECT o.owner, t.mood, count(m.mood) AS n, coalesce(round(100.0 * count(m.mood) / nullif((SELECT count(*) FROM m WHERE m.owner = o.owner), 0), 1), 0)::DOUBLE AS pct
    FROM (SELECT DISTINCT owner FROM m) o, (SELECT unnest(['negative', 'neutral', 'positive']) AS mood) t LEFT JOIN m ON m.owner = o.owner AND m.mood = t.mood GROUP BY 1, 2""",
)
def sentiment_rollup(spark, sf_dir):
    from voxfield.operators.relations import grounding

    docs = pack(spark, sf_dir)
    cited = claims(spark, sf_dir).select("owner", F.col("pos").alias("claim"), F.explode("cites").alias("doc")).join(docs.select("owner", "doc"), ["owner", "doc"])
    sizes = docs.groupBy(F.col("owner").alias("cluster")).agg(F.count("*").alias("size"))
    grounded = grounding(cited.withColumnRenamed("owner", "cluster"), docs.select("doc", "text"), sizes, _NEG, _POS)
    return P.sentiment_rollup(grounded.withColumnRenamed("cluster", "owner"))


_THEMES = {"praise": _POS, "anger": _NEG, "none": ["zzzzzz"], "words": ["the", "der", "le", "el"]}
_TCASE = ", ".join(f"('{k}', {v})" for k, v in _THEMES.items())


@query(
    "eval_scores",
    f"""WITH t(theme, words) AS (VALUES {_TCASE}), f AS (SELECT source AS fixture, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z0-9]+')))) AS toks FROM documents GROUP BY 1),
    h AS (SELECT fixture, theme, len(list_intersect(toks, words)) > 0 AS hit FROM f, t),
    k AS (SELECT source AS fixture, avg(CASE WHEN n <= 1 THEN 1 WHEN n = 2 THEN 2 WHEN n <= 4 THEN 3 ELSE 4 END) AS m FROM (SELECT source, lang, count(DISTINCT doc_id % 6) AS n FROM documents GROUP BY 1, 2) GROUP BY 1)
    SELECT fixture, count(*) AS expected, count(*) FILTER (hit) AS recovered, round(count(*) FILTER (hit) / count(*), 4) AS recovery_rate, coalesce(string_agg(theme, ',' ORDER BY theme) FILTER (NOT hit), '') AS unmatched, round(any_value(m), 4) AS mean_coverage FROM h JOIN k USING (fixture) GROUP BY 1""",
)
def eval_scores(spark, sf_dir):
    """Sources stand for fixtures, their documents for claims, languages for personas."""
    from voxfield.operators.relations import recovered, tier

    docs = table(spark, sf_dir, "documents")
    found = recovered(docs.withColumnRenamed("source", "fixture"), "fixture", "text", {k: (v, []) for k, v in _THEMES.items()})
    expected = docs.select(F.col("source").alias("fixture")).distinct().select("fixture", F.explode(F.array(*map(F.lit, _THEMES))).alias("theme"))
    tiers = docs.groupBy(F.col("source").alias("fixture"), "lang").agg(tier(F.countDistinct(F.col("doc_id") % 6)).alias("tier"))
    return P.eval_scores(expected, found, tiers).select("fixture", "expected", "recovered", "recovery_rate", F.array_join("unmatched", ",").alias("unmatched"), "mean_coverage")


@query("of_run", "SELECT c_custkey AS persona_id, o_orderpriority AS run_id, o_orderkey AS journey_id FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND c_custkey = (SELECT min(o_custkey) FROM orders WHERE o_orderpriority = '1-URGENT')")
def of_run(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("persona_id"), F.col("o_orderpriority").alias("run_id"), F.col("o_orderkey").alias("journey_id"))
    urgent = O.of_run(orders, "1-URGENT")
    return O.of_run(urgent, persona_id=urgent.agg(F.min("persona_id")).first()[0])


@query("in_time_order", "SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id)::INTEGER AS place FROM events ORDER BY ts, event_id LIMIT 500")
def in_time_order(spark, sf_dir):
    """The 500 earliest, numbered after the cut."""
    from pyspark.sql import Window

    first = O.in_time_order(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id", 500)
    return first.withColumn("place", F.row_number().over(Window.orderBy("ts", "event_id")))


_SAID = "(SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-d %b %Y') WHEN 2 THEN upper(strftime(o_orderdate, ' %-d %B %Y ')) WHEN 3 THEN strftime(o_orderdate, '%b %-d, %Y') WHEN 4 THEN (o_orderkey % 50) || ' Weeks ago' WHEN 5 THEN 'yesterday' ELSE 'some day' END AS said, o_orderkey % 7 AS form, date_trunc('day', o_orderdate) AS day FROM orders)"


@query("said_date", f"SELECT o_orderkey, CASE WHEN form < 4 THEN day WHEN form = 4 THEN TIMESTAMP '2026-05-01 12:00:00' - INTERVAL 7 DAY * (o_orderkey % 50) WHEN form = 5 THEN TIMESTAMP '2026-04-30 12:00:00' END AS day FROM {_SAID}")
def said_date(spark, sf_dir):
    from voxfield.functions.time import said_date as parsed

    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    forms = [F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "d MMM yyyy"), F.upper(F.concat(F.lit(" "), F.date_format(d, "d MMMM yyyy"), F.lit(" "))), F.date_format(d, "MMM d, yyyy"), F.concat(k % 50, F.lit(" Weeks ago")), F.lit("yesterday"), F.lit("some day")]
    said = F.element_at(F.array(*forms), (k % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", parsed(said, F.lit("2026-05-01 12:00:00").cast("timestamp_ntz")).alias("day"))


@query("batch_jobs", "SELECT r_name AS region, 't' AS topic, n_name AS source, 200::INTEGER AS \"limit\", c > 0 AS known FROM (SELECT r_name, n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) AS c FROM region JOIN nation ON n_regionkey = r_regionkey)")
def batch_jobs(spark, sf_dir):
    """Regions read their nations' sources; the dimension has those with a rich supplier."""
    r, n, s = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    placed = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.col("n_name").alias("source"), F.col("r_name").alias("region"))
    jobs = placed.groupBy("region").agg(F.collect_list("source").alias("sources")).select("region", F.lit("t").alias("topic"), "sources", F.create_map(F.lit("a"), F.lit("b")).alias("extra"))
    rich = s.where("s_acctbal > 9000").join(placed, F.col("s_nationkey") == F.col("n_nationkey"))
    return O.batch_jobs(jobs, rich).drop("extra")
