"""Queries of text analytics and evidence."""

from pyspark.sql import functions as F

from voxfield.functions import jsonx
from voxfield.operators import clusters as C
from voxfield.operators import evidence as E
from voxfield.operators import relations as R
from voxfield.operators import textrank as T
from voxfield.plans.catalog import query, table
from voxfield.plans.relational import _MEM, members
from voxfield.tables import written

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_EN) + "]"
_TOK = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9'']{{2,}}'), lambda w: NOT list_contains({_STOP}, w))"


@query("tokens_en", f"SELECT doc_id, len({_TOK})::INTEGER AS n_tokens, sha256(array_to_string({_TOK}, ' ')) AS tokens_sha256 FROM documents")
def tokens_en(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.tokens_en(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.sha2(F.array_join("t", " ").cast("binary"), 256).alias("tokens_sha256"))


#: Letters of the documents as kana and Han, some of them stop characters: the tables hold no such texts.
_LATIN, _CJK = "abcdefghijklmnopqrstuvwxyz", "東の京日本と語カタナ人会社さくら山川は海空道ここそこ"
_JA = "[" + ", ".join(f"'{w}'" for w in T.STOP_JA) + "]"


@query(
    "cjk_bigrams",
    f"""SELECT doc_id, len(g)::INTEGER AS n_grams, sha256(array_to_string(g, ' ')) AS grams_sha256 FROM
        (SELECT doc_id, list_filter(list_concat(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]), c), lambda w: NOT list_contains({_JA}, w)) AS g FROM
          (SELECT doc_id, list_filter(string_split(translate(lower(text), '{_LATIN}', '{_CJK}'), ''), lambda x: x >= '\u3040' AND x <= '\u9fff' AND NOT list_contains({_JA}, x)) AS c FROM documents))""",
)
def cjk_bigrams(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.cjk_grams(F.translate(F.lower("text"), _LATIN, _CJK)).alias("g"))
    return rows.select("doc_id", F.size("g").alias("n_grams"), F.sha2(F.array_join("g", " ").cast("binary"), 256).alias("grams_sha256"))


@query(
    "chunks",
    """SELECT doc_id, (s // 462)::INTEGER AS chunk, len(w[s + 1:s + 512])::INTEGER AS n_words, array_to_string(w[s + 1:s + 512], ' ') AS text
       FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 512 THEN [0] ELSE range(0, len(w), 462) END) AS s FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents))""",
)
def chunks(spark, sf_dir):
    return T.chunks(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


def _terms(spark, sf_dir):
    """(cluster, term), a row for each mention. Ids and clusters are written as a table, without their vectors: Spark then knows how small it is, and up to its threshold
    for broadcasts no text is moved or sorted to meet its cluster."""
    ids = written(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster")))
    rows = table(spark, sf_dir, "documents").join(ids, "doc_id")
    return rows.select("cluster", F.explode(T.bigrams(T.tokens_en(F.col("text")))).alias("term"))


_TERMS = f"""terms AS (SELECT cluster, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM (SELECT label AS cluster, {_TOK} AS t FROM documents JOIN embeddings ON doc_id = vec_id)),
    tf AS (SELECT cluster, term, count(*) AS tf FROM terms GROUP BY 1, 2)"""


@query("ctfidf_all", f"WITH {_TERMS}, tot AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 1000), w AS (SELECT cluster, term, round(tf * (ln((1 + (SELECT count(DISTINCT cluster) FROM terms)) / (1 + df)) + 1), 6) AS weight FROM tf JOIN tot USING (term)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term)::INTEGER AS rank FROM w) WHERE rank <= 10")
def ctfidf_all(spark, sf_dir):
    return T.ctfidf(_terms(spark, sf_dir), "cluster")


@query("ctfidf_one_vs_rest", f"WITH {_TERMS}, tot AS (SELECT term, sum(tf) AS total FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 1000), w AS (SELECT cluster, term, round(tf * (ln(3.0 / (1 + CASE WHEN total > tf THEN 2 ELSE 1 END)) + 1), 6) AS weight FROM tf JOIN tot USING (term)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term)::INTEGER AS rank FROM w) WHERE rank <= 10")
def ctfidf_one_vs_rest(spark, sf_dir):
    return T.ctfidf_one_vs_rest(_terms(spark, sf_dir), "cluster")


@query("query_expansion", "SELECT 'Alipay_' || source AS topic, unnest(range(1, 7))::INTEGER AS pos, unnest(['Alipay_' || source, 'alipay src', 'alipay src review', 'alipay src vs', 'Alipay_src ' || substr(source, 4), 'Alipay_src ' || substr(source, 4) || ' review']) AS query FROM (SELECT DISTINCT source FROM documents)")
def query_expansion(spark, sf_dir):
    topics = table(spark, sf_dir, "documents").select(F.concat(F.lit("Alipay_"), F.col("source")).alias("topic")).distinct()
    return T.expand_topics(topics, ["{topic} review", "{topic} vs", "{topic} comparison", "best {topic}"], 6)


_EV = "list_transform(embedding, lambda x: x::DOUBLE)"
_EVIDENCE = f"""WITH cen AS (SELECT label, list(mean ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) AS mean FROM (SELECT label, unnest(range(64)) AS dim, unnest({_EV}) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
  reps AS (SELECT label AS cluster, vec_id AS doc_id, row_number() OVER (PARTITION BY label ORDER BY round(list_distance({_EV}, c), 6), vec_id) AS pos FROM embeddings JOIN cen USING (label) QUALIFY pos <= 10),
  rest AS (SELECT m.cluster, m.doc_id FROM {_MEM} m ANTI JOIN reps r ON r.cluster = m.cluster AND r.doc_id = m.doc_id),
  shown AS (SELECT *, 0 AS last FROM reps UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY doc_id) AS pos, 1 AS last FROM rest) WHERE pos <= 30),
  lines AS (SELECT m.cluster, last, pos, row_number() OVER (PARTITION BY m.cluster ORDER BY last, pos) AS no, doc_id, source, lang, trim(text) AS body FROM shown JOIN {_MEM} m USING (cluster, doc_id) WHERE trim(text) <> '')
  SELECT l.cluster, count(*) AS n_docs, string_agg('[doc_' || substr(sha256(doc_id::VARCHAR), 1, 12) || '] (source: ' || source || ', lang: ' || lang || CASE WHEN last = 0 THEN ', representative #' || no ELSE '' END || ')' || chr(10) || '  ' || replace(substr(body, 1, CASE WHEN last = 0 THEN 600 ELSE 300 END), chr(10), ' ') || chr(10), chr(10) ORDER BY last, pos)
    || coalesce(any_value((SELECT chr(10) || '... and ' || (count(*) - 30) || ' more posts in this cluster (not shown)' FROM rest r WHERE r.cluster = l.cluster HAVING count(*) > 30)), '') AS block FROM lines l GROUP BY 1"""


def representatives(spark, sf_dir):
    rows = C.representatives(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 10)
    return rows.select(F.col("label").alias("cluster"), F.col("vec_id").alias("doc_id"), "rank")


@query("evidence_pack", _EVIDENCE)
def evidence_pack(spark, sf_dir):
    return E.evidence_block(E.evidence_pack(members(spark, sf_dir), representatives(spark, sf_dir)))


@query(
    "evidence_header",
    f"""WITH s AS (SELECT cluster, '{{' || string_agg('"' || source || '": ' || n, ', ' ORDER BY source) || '}}' AS x FROM (SELECT cluster, source, count(*) AS n FROM {_MEM} GROUP BY 1, 2) GROUP BY 1),
  l AS (SELECT cluster, '{{' || string_agg('"' || lang || '": ' || n, ', ' ORDER BY lang) || '}}' AS x FROM (SELECT cluster, lang, count(*) AS n FROM {_MEM} GROUP BY 1, 2) GROUP BY 1)
  SELECT cluster, 'CLUSTER METADATA' || chr(10) || '- cluster_id: ' || cluster || chr(10) || '- size: ' || (SELECT count(*) FROM {_MEM} m WHERE m.cluster = s.cluster) || ' posts' || chr(10) || '- top keywords (c-TF-IDF): one, two' || chr(10) || '- source distribution: ' || s.x || chr(10) || '- language distribution: ' || l.x AS header FROM s JOIN l USING (cluster)""",
)
def evidence_header(spark, sf_dir):
    """The keywords are two for every cluster: those of real texts are checked by the c-TF-IDF queries."""
    rows = members(spark, sf_dir)
    words = rows.select("cluster").distinct().select("cluster", F.posexplode(F.array(F.lit("one"), F.lit("two"))).alias("rank", "term"))
    return E.evidence_header(rows, words)


# Themes as an evaluation lists them: keywords and phrases.
_THEMES = {"words": (["ther", "the", "PA"], []), "phrases": ([], ["e la", "the Ch"]), "both": (["benchmark"], ["aux "]), "none": (["qqqqq"], ["never said"])}


def _theme_sql(words, phrases):
    tests = [f"len(list_intersect(regexp_extract_all(lower(text), '[a-z0-9]+'), [{', '.join(repr(w.lower()) for w in words)}])) > 0"] * bool(words) + [f"contains(lower(text), {p.lower()!r})" for p in phrases]
    return " OR ".join(tests)


@query("theme_phrases", " UNION ALL ".join(f"SELECT doc_id, '{name}' AS theme FROM documents WHERE {_theme_sql(*both)}" for name, both in _THEMES.items()))
def theme_phrases(spark, sf_dir):
    return R.recovered(table(spark, sf_dir, "documents"), "doc_id", "text", _THEMES)


_CL = "(SELECT conv_id, turn, role AS field, conv_id * 2 + turn AS cite, text FROM conversations)"


@query("persona_violations", f"SELECT c.conv_id AS owner, c.field, c.turn::BIGINT AS pos, c.field || '[' || c.turn || '] cites unknown doc ' || c.cite AS error FROM {_CL} c WHERE c.cite NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def persona_violations(spark, sf_dir):
    cites = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("owner"), F.col("role").alias("field"), F.col("turn").alias("pos"), (F.col("conv_id") * 2 + F.col("turn")).alias("doc"))
    return E.unknown_citations(cites, table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("doc")))


@query(
    "quote_violations",
    """SELECT doc_id, CASE WHEN d2 IS NULL THEN 'not in pack' WHEN trim(quote) = '' THEN 'empty' WHEN NOT contains(text, trim(quote)) THEN 'not verbatim' END AS error
       FROM (SELECT d.doc_id, p.doc_id AS d2, p.text, CASE d.doc_id % 3 WHEN 0 THEN substr(d.text, 1, 20) WHEN 1 THEN ' ' ELSE 'paraphrase' END AS quote FROM documents d LEFT JOIN (SELECT * FROM documents WHERE doc_id % 5 <> 0) p ON d.doc_id = p.doc_id)
       WHERE d2 IS NULL OR trim(quote) = '' OR NOT contains(text, trim(quote))""",
)
def quote_violations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    quotes = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 20)).when(F.col("doc_id") % 3 == 1, " ").otherwise("paraphrase").alias("quote"))
    return E.quote_errors(quotes, docs.where("doc_id % 5 <> 0").select("doc_id", "text")).select("doc_id", "error")


@query("drop_unverified", f"SELECT conv_id AS owner, field, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) > 0 AS unverified FROM (SELECT *, cite IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) AS ok FROM {_CL}) GROUP BY 1, 2")
def drop_unverified(spark, sf_dir):
    cites = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("owner"), F.col("role").alias("field"), F.col("turn").alias("pos"), (F.col("conv_id") * 2 + F.col("turn")).alias("doc"))
    return E.verified_fields(cites, table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("doc")))


@query("tolerant_json", None)
def tolerant_json(spark, sf_dir):
    k = F.col("event_id") % 4
    reply = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n```"))).when(k == 2, F.concat(F.lit("Sure "), F.col("props"), F.lit(" done"))).otherwise("no json")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(jsonx.tolerant_object(reply), "$.k", "long").alias("k"))


@query("page_title", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '(?i)<a[ ]'))::INTEGER AS n_links FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.size(F.regexp_extract_all("html", F.lit("(?i)(<a[ ])"), 1)).alias("n_links"))


@query("page_text", None)
def page_text(spark, sf_dir):
    from voxfield.sources.html import page_text as parse

    return parse(table(spark, sf_dir, "pages"), "page_id", "html")


@query("page_links", None)
def page_links(spark, sf_dir):
    from voxfield.sources.html import page_links as parse

    return parse(table(spark, sf_dir, "pages"), "page_id", "html")
