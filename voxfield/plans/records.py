"""Queries of nested records, of two windows and of two topics. Stand-ins: conversations are owners, their turns the packs; replies are JSON made from the turns. Some cite a turn that isn't
there, some nothing, and some quotes were never said."""

from pyspark.sql import functions as F

from voxfield.operators import evidence as E
from voxfield.operators import records as R
from voxfield.operators import synthesis as S
from voxfield.operators import windows as W
from voxfield.plans.catalog import query, table
from voxfield.plans.relational import _MEM, _NEG, _POS, members
from voxfield.plans.textual import _EVIDENCE, representatives
from voxfield.tables import written

RUN = {"run_id": "r", "model": "m", "provider": "p"}
_T = "(SELECT *, conv_id || '-' || turn AS doc, trim(substr(text, 1, 20)) AS claim FROM conversations)"
_SIZE = f"(SELECT conv_id, count(*) AS size FROM {_T} GROUP BY 1)"
_MOOD = f"(SELECT doc, sign(len(list_filter({_POS}, lambda w: contains(lower(text), w))) - len(list_filter({_NEG}, lambda w: contains(lower(text), w)))) AS s FROM {_T})"
# goals of users cite their turn and the next, pain points of assistants their turn, behaviours of every fourth turn nothing
_CITED = f"""c AS (SELECT conv_id, turn, claim, 'goals' AS field, [doc, conv_id || '-' || (turn + 1)] AS cites FROM {_T} WHERE role = 'user' UNION ALL SELECT conv_id, turn, trim(substr(text, 1, 3)), 'pain_points', [doc] FROM {_T} WHERE role <> 'user'
    UNION ALL SELECT conv_id, turn, claim, 'behaviors', []::VARCHAR[] FROM {_T} WHERE turn % 4 = 1),
  x AS (SELECT conv_id, turn, field, c.doc, s FROM (SELECT *, unnest(cites) AS doc FROM c) c LEFT JOIN {_MOOD} m ON m.doc = c.doc),
  g AS (SELECT c.conv_id, c.turn, c.field, any_value(c.claim) AS claim, coalesce(bool_and(x.s IS NOT NULL) FILTER (x.doc IS NOT NULL), false) AS good, count(DISTINCT x.doc) AS n, count(*) FILTER (s < 0) AS neg, count(*) FILTER (s > 0) AS pos FROM c LEFT JOIN x USING (conv_id, turn, field) GROUP BY 1, 2, 3),
  l AS (SELECT conv_id, field, count(*) FILTER (NOT good) > 0 AS lost, string_agg(claim || '|' || n || '|' || round(n / size, 3)::DOUBLE || '|' || neg || '|' || pos, ';' ORDER BY turn) FILTER (good) AS claims FROM g JOIN {_SIZE} USING (conv_id) GROUP BY 1, 2)"""


def _turns(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", "role", "text", F.concat_ws("-", "conv_id", "turn").alias("doc"))


def _pack(spark, sf_dir):
    t = _turns(spark, sf_dir)
    pack = t.select(F.col("conv_id").alias("owner"), "doc", "text", F.concat(F.lit("c/"), "doc").alias("url"), F.col("role").alias("source"), F.lit("en").alias("lang"))
    return pack, t.groupBy(F.col("conv_id").alias("owner")).agg(F.count("*").alias("size"))


def _replies(spark, sf_dir, keys=()):
    """A persona reply for each conversation, fenced, after a line of talk."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "doc", "role", "text")))
    t = _turns(spark, sf_dir).groupBy(F.col("conv_id").alias("owner"), *keys).agg(turns.alias("t"))
    claim = lambda x, *cites, n=20: F.struct(F.substring(x["text"], 1, n).alias("claim"), F.array(*cites).cast("array<string>").alias("evidence"), F.when(x["turn"] % 3 == 0, "high").alias("severity"))
    mine = lambda keep, make: F.transform(F.filter("t", keep), make)
    body = F.struct(
        F.concat(F.lit("P "), "owner").alias("name"), mine(lambda x: x["role"] == "user", lambda x: claim(x, x["doc"], F.concat_ws("-", "owner", x["turn"] + 1))).alias("goals"),
        mine(lambda x: x["role"] != "user", lambda x: claim(x, x["doc"], n=3)).alias("pain_points"), mine(lambda x: x["turn"] % 4 == 1, lambda x: claim(x)).alias("behaviors"),
        F.transform("t", lambda x: F.struct(x["doc"].alias("doc_id"), F.when(x["turn"] % 3 == 0, "never said").otherwise(F.substring(x["text"], 3, 25)).alias("text_original"))).alias("representative_quotes"),
    )
    return t.select("owner", F.concat(F.lit("Here:\n```json\n"), F.to_json(body), F.lit("\n```")).alias("reply"))


def _personas(spark, sf_dir):
    return R.persona_records(_replies(spark, sf_dir), *_pack(spark, sf_dir), RUN, negative=_NEG, positive=_POS)


@query(
    "persona_records",
    f"""WITH {_CITED}, f AS (SELECT conv_id, unnest(['goals', 'pain_points', 'behaviors', 'motivations']) AS field FROM {_SIZE}),
  q AS (SELECT conv_id, count(*) AS n FROM {_T} WHERE turn % 3 <> 0 AND trim(substr(text, 3, 25)) <> '' GROUP BY 1), k AS (SELECT conv_id, count(*) FILTER (lost) AS lost FROM l GROUP BY 1)
  SELECT f.conv_id AS cluster_id, 'persona_' || substr(sha256(f.conv_id::VARCHAR), 1, 12) AS id, field, CASE WHEN l.lost THEN 'unverified' ELSE 'ok' END AS coverage, coalesce(claims, '') AS claims, coalesce(q.n, 0) AS quotes, round(1 - 0.1 * coalesce(k.lost, 0), 6)::DOUBLE AS confidence, size AS cluster_size
  FROM f LEFT JOIN l USING (conv_id, field) LEFT JOIN q USING (conv_id) LEFT JOIN k USING (conv_id) JOIN {_SIZE} USING (conv_id)""",
)
def persona_records(spark, sf_dir):
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in ("goals", "pain_points", "behaviors", "motivations")])
    line = lambda c: F.concat_ws("|", c["claim"], c["mentioned_by_n_users"], c["pct_of_cluster"], c["sentiment_scores"]["negative"], c["sentiment_scores"]["positive"])
    rows = _personas(spark, sf_dir).select("cluster_id", "id", F.size("representative_quotes").alias("quotes"), "confidence", "cluster_size", F.explode(fields).alias("f"))
    return rows.select("cluster_id", "id", "f.field", "f.v.coverage", F.array_join(F.transform("f.v.claims", line), ";").alias("claims"), "quotes", "confidence", "cluster_size")


_STAGES = "[" + ", ".join(f"'{s}'" for s in R.STAGES) + "]"


@query(
    "journey_records",
    f"""WITH t AS (SELECT *, {_STAGES}[turn % 6 + 1] AS stage, conv_id || '-' || (turn + 6) AS other FROM {_T}), d AS (SELECT doc FROM {_T}),
  s AS (SELECT conv_id, stage, count(*) AS entries, string_agg(claim, ';' ORDER BY turn) FILTER (other IN (FROM d)) AS frictions, count(*) FILTER (other NOT IN (FROM d)) > 0 AS lost,
    count(*) FILTER (turn < 10) AS emotions, count(*) AS n FROM t GROUP BY 1, 2)
  SELECT o.conv_id AS owner, o.stage, o.at::INTEGER AS at, CASE WHEN n IS NULL THEN 'none' WHEN n < 2 THEN 'thin' ELSE 'ok' END AS coverage, CASE WHEN lost THEN 'unverified' ELSE 'ok' END AS friction_coverage, coalesce(frictions, '') AS frictions, coalesce(emotions, 0) AS emotions
  FROM (SELECT conv_id, unnest({_STAGES}) AS stage, unnest(range(6)) AS at FROM {_SIZE}) o LEFT JOIN s USING (conv_id, stage)""",
)
def journey_records(spark, sf_dir):
    """Every turn gives its stage a friction, which cites the turn and the one six later, and an emotion as strong as the turn is late: beyond the tenth it is no valid one."""
    pack, sizes = _pack(spark, sf_dir)
    t = _turns(spark, sf_dir)
    name = F.element_at(F.array(*map(F.lit, R.STAGES)), (F.col("turn") % 6 + 1).cast("int"))
    at = t.groupBy(F.col("conv_id").alias("owner"), name.alias("stage")).agg(F.array_sort(F.collect_list(F.struct("turn", "doc", "text"))).alias("t"))
    friction = F.transform("t", lambda x: F.struct(F.substring(x["text"], 1, 20).alias("claim"), F.array(x["doc"], F.concat_ws("-", "owner", x["turn"] + 6)).alias("evidence")))
    emotion = F.transform("t", lambda x: F.struct(F.lit("e").alias("label"), ((x["turn"] + 1) / 10).alias("intensity"), F.array(x["doc"]).alias("evidence")))
    stages = at.groupBy("owner").agg(F.collect_list(F.struct("stage", friction.alias("frictions"), emotion.alias("emotions"))).alias("stages"))
    replies = stages.select("owner", F.to_json(F.struct("stages")).alias("reply"))
    people = R.persona_records(replies, pack, sizes, RUN)
    rows = R.journey_records(replies, people, pack, sizes, RUN).join(people.select(F.col("id").alias("persona_id"), F.col("cluster_id").alias("owner")), "persona_id")
    rows = rows.select("owner", F.posexplode("stages").alias("at", "s"))
    return rows.select("owner", "s.stage", "at", "s.coverage", F.col("s.frictions.coverage").alias("friction_coverage"), F.array_join(F.transform("s.frictions.claims", lambda c: c["claim"]), ";").alias("frictions"), F.size("s.emotions").alias("emotions"))


@query(
    "generated_personas",
    f"""SELECT cluster AS cluster_id, 2 AS attempts, least(n_docs, 2) AS n_users, round(least(n_docs, 2) / size, 3)::DOUBLE AS pct_of_cluster, 'ok' AS coverage, least(n_docs, 3) AS quotes
  FROM ({_EVIDENCE}) JOIN (SELECT cluster, count(*) AS size FROM {_MEM} GROUP BY 1) USING (cluster)""",
)
def generated_personas(spark, sf_dir):
    """Evidence packs of all clusters go to a client that leaves out the evidence at first, and whose second reply is right."""
    docs = members(spark, sf_dir)
    shown = written(E.evidence_pack(docs, representatives(spark, sf_dir)))
    pack = shown.select(F.col("cluster").alias("owner"), F.col("short_id").alias("doc"), F.col("snippet").alias("text"), F.lit("").alias("url"), "source", "lang")
    prompts = E.evidence_block(shown).select(F.col("cluster").alias("owner"), F.col("block").alias("prompt"))
    sizes = docs.groupBy(F.col("cluster").alias("owner")).agg(F.count("*").alias("size"))
    people, replies = R.generated_personas(prompts, pack, sizes, S.quoting_client, RUN)
    first = F.col("pain_points.claims")[0]
    rows = people.select("cluster_id", first["mentioned_by_n_users"].alias("n_users"), first["pct_of_cluster"].alias("pct_of_cluster"), F.col("pain_points.coverage").alias("coverage"), F.size("representative_quotes").alias("quotes"))
    return rows.join(replies.select(F.col("owner").alias("cluster_id"), "attempts"), "cluster_id")


# times of posts: a day of January by their number; those of conversations alike
_BEFORE, _AFTER = "2024-01-20 00:00:00", "2024-01-10 00:00:00"


def _side(key):
    """SQL: the windows that the post of a key falls in."""
    ts = f"(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * ({key} % 30))"
    return f"unnest(list_filter([CASE WHEN {ts} < TIMESTAMP '{_BEFORE}' THEN 'before' END, CASE WHEN {ts} >= TIMESTAMP '{_AFTER}' THEN 'after' END], lambda x: x IS NOT NULL)) AS side"


def _at(key):
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col(key) % 30).cast("int"))


_REPS = _EVIDENCE.split(", rest AS")[0].split(",\n  rest AS")[0]


@query(
    "window_clusters",
    _REPS + f""", w AS (SELECT cluster, doc_id, {_side('doc_id')} FROM {_MEM}), z AS (SELECT side, cluster, count(*) AS size FROM w GROUP BY 1, 2),
  i AS (SELECT z.side, z.cluster, r.doc_id, r.pos, w.doc_id IS NOT NULL AS inside FROM z JOIN reps r USING (cluster) LEFT JOIN w ON w.side = z.side AND w.cluster = z.cluster AND w.doc_id = r.doc_id),
  k AS (SELECT side, cluster, string_agg(doc_id, ',' ORDER BY pos) FILTER (inside) AS those, string_agg(doc_id, ',' ORDER BY pos) AS every FROM i GROUP BY 1, 2)
  SELECT CASE side WHEN 'before' THEN 'Before {_BEFORE[:10]}' ELSE 'After {_AFTER[:10]}' END AS label, cluster, size, coalesce(those, every, '') AS representatives FROM z LEFT JOIN k USING (side, cluster)""",
)
def window_clusters(spark, sf_dir):
    """The windows overlap by ten days."""
    before, after = (F.lit(x).cast("timestamp_ntz") for x in (_BEFORE, _AFTER))
    posts = members(spark, sf_dir).select("cluster", "doc_id", _at("doc_id").alias("ts"))
    sizes, reps = W.window_clusters(W.window_members(posts, "ts", before, after), representatives(spark, sf_dir))
    listed = reps.groupBy("side", "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("representatives"))
    label = F.when(F.col("side") == "before", W.window_label("before", before)).otherwise(W.window_label("after", after))
    return sizes.join(listed, ["side", "cluster"], "left").select(label.alias("label"), "cluster", "size", F.coalesce("representatives", F.lit("")).alias("representatives"))


_PAIN = f"(SELECT DISTINCT trim(substr(text, 1, 3)) AS claim, {_side('conv_id')} FROM {_T} WHERE role <> 'user')"


def _sides(spark, sf_dir):
    """The pain points of personas by the window that their conversation falls in, a set of claims for each."""
    before, after = (F.lit(x).cast("timestamp_ntz") for x in (_BEFORE, _AFTER))
    people = W.window_members(_personas(spark, sf_dir).withColumn("ts", _at("cluster_id")), "ts", before, after)
    return [W.pain_points(people.where(F.col("side") == side)).select("claim").distinct() for side in W.SIDES]


_SHIFTS = f"SELECT claim, CASE WHEN count(*) > 1 THEN 'persisted' WHEN min(side) = 'after' THEN 'emerged' ELSE 'resolved' END AS change FROM {_PAIN} GROUP BY 1"


@query("window_shifts", _SHIFTS)
def window_shifts(spark, sf_dir):
    return W.shifts(*_sides(spark, sf_dir), "claim")


def _said(parts):
    return "concat_ws(' ', " + ", ".join(f"CASE WHEN {n} > 0 THEN {n} || ' {words}.' END" for n, words in parts) + ")"


_CHANGES = [(f"count(*) FILTER (change = '{k}')", words) for k, words in (("emerged", "new pain points emerged"), ("resolved", "pain points resolved"), ("persisted", "pain points persisted"))]


@query("window_summary", f"SELECT {_said(_CHANGES)} AS summary FROM ({_SHIFTS})")
def window_summary(spark, sf_dir):
    return W.shift_summary(window_shifts(spark, sf_dir))


_TOPICS = f"SELECT claim, severity, CASE WHEN count(*) > 1 THEN NULL WHEN min(topic) = 0 THEN 'even' ELSE 'odd' END AS unique_to FROM (SELECT DISTINCT trim(substr(text, 1, 3)) AS claim, CASE WHEN turn % 3 = 0 THEN 'high' ELSE 'unspecified' END AS severity, conv_id % 2 AS topic FROM {_T} WHERE role <> 'user') GROUP BY 1, 2"


def _topics(spark, sf_dir):
    people = _personas(spark, sf_dir)
    return W.comparative(*[W.pain_points(people.where(F.col("cluster_id") % 2 == k)) for k in (0, 1)], "even", "odd")


@query("comparative_pain_points", _TOPICS)
def comparative_pain_points(spark, sf_dir):
    return _topics(spark, sf_dir)


_OWN = [(f"count(*) FILTER (unique_to = '{t}')", f"pain points unique to {t}") for t in ("even", "odd")]


@query("comparative_summary", f"SELECT {_said([('count(*) FILTER (unique_to IS NULL)', 'pain points shared across both topics'), *_OWN])} AS summary FROM ({_TOPICS})")
def comparative_summary(spark, sf_dir):
    return W.comparative_summary(_topics(spark, sf_dir), "even", "odd")
