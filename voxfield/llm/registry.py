"""The queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op6_byte_bpe")
def op6_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from voxfield.llm.bpe import bpe_encode

    out = bpe_encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_secrets")
def op8_secrets(spark, sf_dir):
    from voxfield.llm.secrets import scan_secrets

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    out = scan_secrets(documents(spark, sf_dir))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("entropy"))


@query("op4_media")
def op4_media(spark, sf_dir):
    from voxfield.llm.media import store_as_media

    out = store_as_media(documents(spark, sf_dir))
    cuts = F.array_join(F.transform("clips", lambda c: F.concat_ws("-", c["start_frame"], c["end_frame"], F.format_string("%.3f", c["mean_luma"]))), ";")
    return out.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("frames="), F.col("frames"), F.lit("|clips="), cuts).alias("feature"),
    )


@query("op7_language")
def op7_language(spark, sf_dir):
    from voxfield.llm.common import is_held_out
    from voxfield.llm.langid import identify_languages, learn

    docs = documents(spark, sf_dir)
    held_out = is_held_out("doc_id", 4, 2)
    out = identify_languages(docs, learn(docs, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


@query("op10_simhash")
def op10_simhash(spark, sf_dir):
    from voxfield.llm.simhash import near_duplicates

    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _mix_sql() -> str:
    """The mix by plain SQL: all keys of a source in one sort."""
    return r"""
    WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, length(text) AS chars FROM documents),
    keyed AS (SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
              / CASE WHEN size >= 20 AND (chars - size + 1) / size BETWEEN 3 AND 12 THEN 1.0 ELSE 0.5 END AS key FROM sized),
    src AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM keyed GROUP BY source),
    lev AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
            FROM src WINDOW b AS (ORDER BY 3 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    tar AS (SELECT source, source_size, round(least(3.0 * source_size, weight * (SELECT max(level) FROM lev))::DOUBLE, 6) AS target FROM lev),
    run AS (SELECT k.doc_id, k.size, t.source_size, t.target, coalesce(floor(t.target / nullif(t.source_size, 0)), 0)::BIGINT AS epochs,
            sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
            FROM keyed k JOIN tar t ON k.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN epochs < 3 AND target - epochs * source_size > 0 AND upto - size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM run
    """


@query("op5_mixing", _mix_sql())
def op5_mixing(spark, sf_dir):
    from voxfield.llm.mixing import mix

    return mix(documents(spark, sf_dir))


_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op3_topk", _TOPK_SQL)
def op3_topk(spark, sf_dir):
    from voxfield.llm.topk import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    from voxfield.llm.common import is_held_out
    from voxfield.llm.toxicity import learn, score_toxicity

    docs, held_out = documents(spark, sf_dir), is_held_out("doc_id", 3, 1)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    out = score_toxicity(docs, learn(docs, labels))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


_SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
late AS (SELECT doc_id, i FROM win JOIN (SELECT k, min(doc_id) AS m FROM win GROUP BY k) USING (k) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM late, (SELECT unnest(range(13)) AS j)),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (d IS NULL OR d > 1) AS n_passages FROM (SELECT doc_id, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS d FROM gone) GROUP BY 1),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w) ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(n_passages, 0)::BIGINT AS n_passages FROM w LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op2_substrings", _SUBSTRING_SQL)
def op2_substrings(spark, sf_dir):
    from voxfield.llm.substring import remove_repeats

    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), F.size("removed").cast("long").alias("n_passages"))


@query("op9_language_model")
def op9_language_model(spark, sf_dir):
    from voxfield.llm.common import is_held_out
    from voxfield.llm.ngram_lm import score_texts

    docs, held_out = documents(spark, sf_dir), is_held_out("doc_id", 5, 1)
    out = score_texts(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p),
s AS (SELECT *, payload_bytes >= 100 AND page_id IS DISTINCT FROM first AS again FROM r)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM s
"""


@query("op12_warc", _WARC_SQL)
def op12_warc(spark, sf_dir):
    from voxfield.llm.warc import page_of, read_all, write_bundles

    records = read_all(write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet")), payloads=False)
    return records.select(page_of(F.col("record_id")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).cast("long").alias("refers_to"))


@query("op13_whitening")
def op13_whitening(spark, sf_dir):
    from voxfield.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: CRC-32 of the id's decimal digits by its bitwise definition; the runs by pairs of equal words and islands of neighbouring pairs.
_PERIODS_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
     xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda c, b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295) AS h FROM documents),
g AS (SELECT r, doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, h // 10 AS g FROM w),
a AS (SELECT *, CASE WHEN planted THEN g % n ELSE n END AS a FROM g),
p AS (SELECT *, CASE WHEN planted THEN 1 + (n - a) // (3 + g % 8) ELSE 1 END AS p FROM a),
d AS (SELECT r, doc_id, n, unnest(ws) AS own, unnest(range(n)) AS i, ws, a, p FROM p),
t AS (SELECT r, doc_id, n, i, CASE WHEN i < a THEN own ELSE ws[a + (i - a) % p + 1] END AS x FROM d),
pairs AS (SELECT s.r, s.i, u.i - s.i AS q FROM t s JOIN t u ON s.r = u.r AND s.x = u.x AND u.i > s.i AND u.i - s.i <= s.n // 3 WHERE s.n >= 24),
isles AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pairs) GROUP BY r, q, k HAVING count(*) >= greatest(24 - q, 2 * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM isles GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) AS k FROM runs),
sums AS (SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS said FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS said FROM t ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT g.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period, (1000 * b.length // b.period)::BIGINT AS exponent_milli,
       sha256(coalesce(s.said, '')) AS runs_sha256, sha256(coalesce(k.said, '')) AS collapsed_sha256
FROM g LEFT JOIN sums s USING (r) LEFT JOIN kept k USING (r) LEFT JOIN (SELECT * FROM best WHERE k = 1) b USING (r)
"""


@query("op11_periods", _PERIODS_SQL)
def op11_periods(spark, sf_dir):
    from voxfield.llm.periods import WORDS, find_runs, repeat_tail, strongest

    # the contract's planted runs: in a tenth of the documents the words from a on repeat p of them
    h, n = F.crc32(F.col("doc_id").cast("string")), F.regexp_count("text", F.lit(WORDS))
    sized = documents(spark, sf_dir).select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, n).alias("n"))
    placed = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    planted = placed.select("doc_id", F.when(F.col("n") > 0, repeat_tail(F.col("text"), F.col("a"), period)).otherwise(F.col("text")).alias("text"))
    out = find_runs(planted).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
