"""Personas, journeys, embedding and clustering on small cases."""

from pyspark.sql import functions as F

from voxfield.operators import personas as P
from voxfield.operators import posts as O

_CLAIM = "owner string, stage string, field string, pos int, claim string, cites array<string>"
_PACK = "owner string, doc string, text string, url string, source string, lang string"
_QUOTE = "owner string, pos int, doc string, text string, url string, source string, lang string"


def made(spark):
    claims = spark.createDataFrame([("a", None, "goals", 0, "x", ["d1"]), ("a", None, "goals", 1, "y", ["d1", "d9"]), ("a", None, "pains", 0, "z", []), ("a", None, "pains", 1, "z", None), ("b", "Use", "emotions", 0, "w", ["d1"])], _CLAIM)
    pack = spark.createDataFrame([("a", "d1", "It is slow, very slow.", "u1", "s1", "fr"), ("a", "d2", None, None, None, None), ("b", "d3", "t", "", "", "")], _PACK)
    return claims, pack


def test_claims(spark):
    claims, pack = made(spark)
    errors = sorted(tuple(r) for r in P.claim_errors(claims, pack).collect())
    assert errors == [("a", "goals[1] cites unknown doc_id 'd9'"), ("a", "pains[0] missing evidence array"), ("a", "pains[1] missing evidence array"), ("b", "Use.emotions[0] cites unknown doc_id 'd1'")]
    kept = P.verified_claims(claims, pack)
    assert [(r.owner, r.field, r.pos, r.coverage) for r in kept.collect()] == [("a", "goals", 0, "unverified")]
    assert {r.owner: (r.unverified_fields, r.confidence) for r in P.persona_confidence(claims, kept).collect()} == {"a": (2, 0.8), "b": (1, 0.9)}
    assert sorted((r.owner, r.field, r.pos, r.n_users, r.pct_of_cluster) for r in P.grounded_claims(claims, pack).collect())[:2] == [("a", "goals", 0, 1, 0.5), ("a", "goals", 1, 1, 0.5)]


def test_quotes(spark):
    _, pack = made(spark)
    quotes = spark.createDataFrame([("a", 0, "d1", " very slow. ", "", "", ""), ("a", 1, "d1", "quick", "u9", "s9", "de"), ("a", 2, "d2", " ", "", None, None), ("a", 3, "d7", "x", "u7", "", ""), ("a", 4, "d1", "slow", "u8", "", "")], _QUOTE)
    assert [r.error for r in P.quote_errors(quotes, pack).orderBy("pos").collect()] == ["representative_quotes[1] text_original is not a verbatim substring of d1", "representative_quotes[2] empty text_original", "representative_quotes[3] doc_id 'd7' not in pack"]
    assert [r.error for r in P.persona_errors(quotes.limit(0).selectExpr("owner", "cast(null as string) stage", "'f' field", "pos", "array(doc) cites"), quotes.where("pos = 0"), pack).orderBy("owner").collect()] == ["representative_quotes: returned 1, must return at least 2", "representative_quotes: returned 0, must return at least 1"]
    assert [(r.text, r.source, r.url, r.lang) for r in P.filled_quotes(quotes, pack).orderBy("pos").collect()][:4] == [("very slow.", "s1", "u1", "fr"), ("quick", "s9", "u9", "de"), ("", "", "", "en"), ("x", "", "u7", "en")]
    assert {(r.doc, r.url) for r in P.first_urls(quotes).collect()} == {("d1", "u9"), ("d7", "u7")}
    assert [r.pos for r in P.card_quotes(quotes).orderBy("pos").collect()] == [0, 1, 2]


def test_stages(spark):
    claims, pack = made(spark)
    rows = {(r.owner, r.stage): (r.n_cited, r.coverage) for r in P.journey_stages(pack, claims).collect()}
    assert len(rows) == 12 and rows["b", "Use"] == (1, "thin") and rows["a", "Use"] == (0, "none")


def test_language_hint(spark):
    rows = spark.createDataFrame([("the cat and the dog",), ("der Hund und die Katze",), ("これは本",), ("你好世界",), ("x",), ("",), (None,), ("что это",)], "t string")
    assert [r[0] for r in rows.select(O.language_hint(rows.t)).collect()] == ["en", "de", "ja", "zh", None, None, None, "ru"]


def test_embedding_reuses_what_is_there(spark):
    posts = spark.createDataFrame([("1", "a b"), ("2", "a b"), ("3", "c"), ("4", None), ("3", "c")], "id string, text string")
    encode = lambda c: c.withColumn("vector", F.array(F.length("text").cast("double"), F.lit(1.0)))
    table = spark.createDataFrame([], "id string, text_hash string, vector array<double>, created_at int")
    one = O.embed_posts(posts.where("id <> '2'"), table, encode, F.lit(1))
    two = O.embed_posts(posts, one, encode, F.lit(2))
    rows = {r.id: (r.created_at, r.text_hash) for r in two.collect()}
    assert {k: v[0] for k, v in rows.items()} == {"1": 1, "2": 2, "3": 1, "4": 1} and rows["1"][1] == rows["2"][1]


def test_small_groups_are_one_cluster(spark):
    v = spark.createDataFrame([("t", k, [float(k), 0.0]) for k in range(7)] + [("u", 100 + k, [k % 2 * 100.0 + k / 50, k / 70]) for k in range(40)], "topic string, id int, v array<double>")
    rows = O.cluster_posts(v, ["topic"], "id", "v", 0.2, 4, 10).collect()
    small = sorted((r.id, r.cluster, r.rank) for r in rows if r.topic == "t")
    assert small == [(k, "single", k + 1 if k < 5 else None) for k in range(7)]
    of = {r.id: r.cluster for r in rows if r.topic == "u"}
    assert len(of) == 40 and len({of[100 + k] for k in range(0, 40, 2)} - {"noise"}) == 1 and {of[100], of[101]} == {"cluster_000", "cluster_001"}
    assert sorted(r.rank for r in rows if r.cluster == "cluster_000" and r.rank) == [1, 2, 3, 4, 5]


def test_drift_and_health(spark):
    n = lambda *x: spark.createDataFrame(list(x), "source string, n int")
    assert sorted(tuple(r) for r in O.parser_drift(n(("a", 2), ("b", 1)), n(("a", 2))).collect()) == [("a", 2, 2, False), ("b", 1, 0, True)]
    checks = spark.createDataFrame([("g", True), ("g", None), ("g", False)], "group string, ok boolean")
    assert [tuple(r) for r in O.health_summary(checks).collect()] == [("g", 1, 2)]
