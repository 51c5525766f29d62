"""Personas and journeys as nested records, built from a model's replies.

A reply is text with a JSON object in it. Its claims come out long (owner, stage, field, pos, claim, severity, cites), meet the owner's pack by document, and go back
into one record an owner: what is put together is one reply, never a cluster. Packs are as in `personas`; replies hold owner and reply, one row an owner."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfield.functions.jsonx import tolerant_object
from voxfield.functions.text import hits, short_id
from voxfield.operators import personas as P
from voxfield.operators.relations import STAGES, confidence
from voxfield.operators.synthesis import retry_prefix
from voxfield.tables import written

# The fields of claims, the words that make a mention negative or positive.
PERSONA_FIELDS = ["goals", "motivations", "pain_points", "preferred_channels", "behaviors"]
STAGE_FIELDS = ["touchpoints", "user_actions", "frictions", "opportunities"]
NEGATIVE = ["bad", "terrible", "awful", "hate", "worst", "poor", "broken", "frustrat", "annoy", "bug", "crash", "fail", "useless", "rubbish", "差", "廢", "垃圾", "爛", "煩", "討厭", "唔掂", "死", "呃錢"]
POSITIVE = ["good", "great", "excellent", "love", "best", "amazing", "awesome", "useful", "helpful", "convenient", "fast", "smooth", "好", "正", "讚", "方便", "快", "好用", "唔錯", "推薦"]

MOODS = ("negative", "neutral", "positive")
_ID = ("owner", "stage", "field", "pos")
_CLAIM = "struct<claim:string,evidence:array<string>,severity:string,mentioned_by_n_users:bigint,pct_of_cluster:double,sentiment_scores:map<string,bigint>,contested_by:array<string>>"
_EMOTION = "struct<label:string,intensity:double,evidence:array<string>>"
_QUOTE = "struct<text_original:string,text_translated:string,lang:string,source:string,url:string,doc_id:string>"


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, F.lit(path), kind)


def _items(v: Column, name: str) -> Column:
    return _get(v, f"$.{name}", "array<variant>")


def _long(rows: DataFrame, fields: list[str], *keys: str) -> DataFrame:
    """A row for each entry of each field of the object `_v`. An entry that is no object is a claim without text and evidence."""
    every = F.array(*[F.struct(F.lit(f).alias("field"), _items(F.col("_v"), f).alias("x")) for f in fields])
    entry = rows.select(*keys, F.explode(every).alias("f")).select(*keys, "f.field", F.posexplode("f.x").alias("pos", "x"))
    x, emotion = F.col("x"), F.col("field") == "emotions"
    cites = F.transform(_items(x, "evidence"), lambda c: _get(c, "$"))
    there = _get(x, "$.intensity", "variant").isNotNull()
    return entry.select(
        *keys, "field", "pos", F.trim(F.coalesce(F.when(emotion, _get(x, "$.label")).otherwise(_get(x, "$.claim")), F.lit(""))).alias("claim"), _get(x, "$.severity").alias("severity"),
        F.when(emotion, F.when(there, _get(x, "$.intensity", "double")).otherwise(0.0)).alias("intensity"), F.coalesce(cites, F.array().cast("array<string>")).alias("cites"),
    )


def _objects(replies: DataFrame) -> DataFrame:
    return replies.select("owner", tolerant_object(F.col("reply")).alias("_v"))


def reply_claims(replies: DataFrame) -> DataFrame:
    """The claims of persona replies; stage is null. Fields that are missing or no list have none."""
    return _long(_objects(replies), PERSONA_FIELDS, "owner").withColumn("stage", F.lit(None).cast("string"))


def _stages(replies: DataFrame, stages: list[str]) -> DataFrame:
    """owner, stage, at, _v: the object of every stage, of two with one name the last; null where a reply has none."""
    listed = _objects(replies).select("owner", _items(F.col("_v"), "stages").alias("_s"))
    found = lambda name: F.try_element_at(F.filter("_s", lambda s: _get(s, "$.stage") == name), F.lit(-1))
    grid = F.array(*[F.struct(F.lit(k).alias("at"), F.lit(name).alias("stage"), found(name).alias("v")) for k, name in enumerate(stages)])
    return listed.select("owner", F.explode(grid).alias("g")).select("owner", "g.stage", "g.at", F.col("g.v").alias("_v"))


def journey_claims(replies: DataFrame, stages: list[str] = STAGES) -> DataFrame:
    """The claims of journey replies by stage; an emotion is a claim with its label as text and an intensity."""
    return _long(_stages(replies, stages), [*STAGE_FIELDS, "emotions"], "owner", "stage")


def reply_quotes(replies: DataFrame) -> DataFrame:
    """owner, pos, doc, text, translated, url, source, lang of the quotes of persona replies; entries that are no object stay out."""
    rows = _objects(replies).select("owner", F.posexplode(_items(F.col("_v"), "representative_quotes")).alias("pos", "x")).where("schema_of_variant(x) like 'OBJECT<%'")
    get = lambda name: _get(F.col("x"), f"$.{name}")
    return rows.select("owner", "pos", F.coalesce(get("doc_id"), F.lit("")).alias("doc"), F.trim(F.coalesce(get("text_original"), F.lit(""))).alias("text"), get("text_translated").alias("translated"), get("url").alias("url"), get("source").alias("source"), get("lang").alias("lang"))


def checked_claims(claims: DataFrame, pack: DataFrame, sizes: DataFrame, negative: list[str] = NEGATIVE, positive: list[str] = POSITIVE) -> DataFrame:
    """claims with `good` (it cites, and only what the owner's pack has), n_users (distinct documents cited), pct_of_cluster (their share of sizes: owner, size)
    and the mentions by mood. One join by document, one aggregate; the texts stay with the pack, their mood goes along."""
    mood = F.signum(hits(F.coalesce("text", F.lit("")), positive) - hits(F.coalesce("text", F.lit("")), negative))
    said = F.struct("claim", "severity", "intensity", "cites")
    cited = claims.select(*_ID, said.alias("c"), F.explode_outer("cites").alias("doc"))
    met = cited.join(pack.select("owner", "doc", mood.alias("mood"), F.lit(True).alias("known")), ["owner", "doc"], "left").join(sizes.select("owner", "size"), "owner", "left")
    counts = F.create_map(*[y for m, k in zip(MOODS, (-1, 0, 1), strict=True) for y in (F.lit(m), F.count_if(F.col("doc").isNotNull() & (F.coalesce("mood", F.lit(0)) == k)))])
    share = F.round(F.countDistinct("doc") / F.greatest(F.coalesce(F.max("size"), F.lit(1)), F.lit(1)), 3)
    out = met.groupBy(*_ID).agg(F.any_value("c").alias("c"), F.bool_and(F.coalesce("known", F.lit(False))).alias("good"), F.countDistinct("doc").alias("n_users"), share.alias("pct_of_cluster"), counts.alias("moods"))
    return out.select(*_ID, "c.*", "good", "n_users", "pct_of_cluster", "moods")


def _in_order(there: Column, value: Column, kind: str) -> Column:
    """An aggregate: the values of rows that are there, by pos. Values hold maps, which don't sort, so positions are compared."""
    rows = F.array_sort(F.collect_list(F.when(there, F.struct("pos", value.alias("v")))), lambda a, b: a["pos"] - b["pos"])
    return F.transform(rows, lambda r: r["v"]).cast(f"array<{kind}>")


def _claim_list(field: str) -> Column:
    """An aggregate over checked claims: those of a field that are good, and `unverified` where any isn't."""
    mine = F.col("field") == field
    claim = F.struct("claim", F.col("cites").alias("evidence"), "severity", F.col("n_users").alias("mentioned_by_n_users"), "pct_of_cluster", F.col("moods").alias("sentiment_scores"), F.coalesce("contested", F.array().cast("array<string>")).alias("contested_by"))
    lost = F.coalesce(F.bool_or(mine & ~F.col("good")), F.lit(False))
    return F.struct(_in_order(mine & F.col("good"), claim, _CLAIM).alias("claims"), F.when(lost, "unverified").otherwise("ok").alias("coverage"))


_NO_CLAIMS = f"named_struct('claims', cast(array() as array<{_CLAIM}>), 'coverage', 'ok')"


def _with_contested(checked: DataFrame, contested: DataFrame | None) -> DataFrame:
    """contested (owner, field, claim, doc): what a review found against a claim of this text; of equal texts in a field the first takes it."""
    if contested is None:
        return checked.withColumn("contested", F.lit(None).cast("array<string>"))
    by = contested.groupBy("owner", "field", "claim").agg(F.array_sort(F.collect_set("doc")).alias("contested"))
    first = checked.where("good").groupBy("owner", "field", "claim").agg(F.min("pos").alias("pos"))
    return checked.join(first.join(by, ["owner", "field", "claim"]), ["owner", "field", "claim", "pos"], "left")


def persona_records(replies: DataFrame, pack: DataFrame, sizes: DataFrame, run: dict[str, str], coverage: DataFrame | None = None, contested: DataFrame | None = None, negative: list[str] = NEGATIVE, positive: list[str] = POSITIVE) -> DataFrame:
    """One record an owner. Claims with any citation that the pack lacks, or none, are left out and their field is unverified; a tenth of confidence goes for each such field.
    Quotes that aren't verbatim are left out, and take what they lack from the pack. run: run_id, model, provider. coverage (owner, coverage) is the block of the header as JSON.
    A reply without an object gives an empty record named after its owner."""
    checked = _with_contested(checked_claims(reply_claims(replies), pack, sizes, negative, positive), contested)
    lists = checked.groupBy("owner").agg(*[_claim_list(f).alias(f) for f in PERSONA_FIELDS], F.countDistinct(F.when(~F.col("good"), F.col("field"))).alias("_lost"))
    meta = pack.select("owner", "doc", F.coalesce("text", F.lit("")).alias("body"), *[F.col(c).alias(f"_{c}") for c in ("source", "url", "lang")])
    said = reply_quotes(replies).join(meta, ["owner", "doc"]).where("text <> '' and contains(body, text)")
    pick = lambda c, last: F.coalesce(F.nullif(c, F.lit("")), F.nullif(f"_{c}", F.lit("")), F.lit(last)).alias(c)
    quote = F.struct(F.col("text").alias("text_original"), F.col("translated").alias("text_translated"), pick("lang", "en"), pick("source", ""), pick("url", ""), F.col("doc").alias("doc_id"))
    quotes = said.groupBy("owner").agg(_in_order(F.lit(True), quote, _QUOTE).alias("representative_quotes"))
    v = F.col("_v")
    top = _objects(replies).select(
        "owner", F.trim(F.coalesce(_get(v, "$.name"), F.concat(F.lit("Persona "), F.col("owner").cast("string")))).alias("name"), F.trim(F.coalesce(_get(v, "$.one_liner"), F.lit(""))).alias("one_liner"),
        F.coalesce(_get(v, "$.language"), F.lit("en")).alias("language"), F.coalesce(F.to_json(_get(v, "$.demographics", "variant")), F.lit("{}")).alias("demographics"),
    )
    rows = top.join(lists, "owner", "left").join(quotes, "owner", "left").join(sizes.select("owner", "size"), "owner", "left")
    rows = rows.withColumn("_cov", F.lit(None).cast("string")) if coverage is None else rows.join(coverage.select("owner", F.col("coverage").alias("_cov")), "owner", "left")
    return rows.select(
        short_id("persona", F.col("owner")).alias("id"), F.lit(run["run_id"]).alias("run_id"), F.col("owner").alias("cluster_id"), "name", "one_liner", "language", "demographics",
        *[F.coalesce(F.col(f), F.expr(_NO_CLAIMS)).alias(f) for f in PERSONA_FIELDS], F.coalesce("representative_quotes", F.array().cast(f"array<{_QUOTE}>")).alias("representative_quotes"),
        F.coalesce("_cov", F.lit("{}")).alias("data_source_coverage"), confidence(F.coalesce("_lost", F.lit(0))).alias("confidence"), F.coalesce("size", F.lit(0)).alias("cluster_size"),
        F.lit(run.get("model", "")).alias("model"), F.lit(run.get("provider", "")).alias("provider"),
    )


def journey_records(replies: DataFrame, personas: DataFrame, pack: DataFrame, sizes: DataFrame, run: dict[str, str], stages: list[str] = STAGES, negative: list[str] = NEGATIVE, positive: list[str] = POSITIVE) -> DataFrame:
    """One record a persona, all stages in order. A stage is `none` where the reply has no object with entries for it, `thin` below two documents cited by what is kept, else ok. An emotion whose
    intensity is no number from 0 to 1 is left out, but what it cites counts. personas: records of `persona_records`."""
    grid = _stages(replies, stages).select("owner", "stage", "at", F.coalesce(F.size(_get(F.col("_v"), "$", "map<string,variant>")) > 0, F.lit(False)).alias("there"))
    checked = _with_contested(checked_claims(journey_claims(replies, stages), pack, sizes, negative, positive), None)
    emotion = (F.col("field") == "emotions") & F.col("good") & F.col("intensity").between(0, 1)
    kept = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("good"), F.col("cites")))))
    parts = checked.groupBy("owner", "stage").agg(*[_claim_list(f).alias(f) for f in STAGE_FIELDS], _in_order(emotion, F.struct(F.col("claim").alias("label"), "intensity", F.col("cites").alias("evidence")), _EMOTION).alias("emotions"), F.size(kept).alias("_n"))
    rows = grid.join(parts, ["owner", "stage"], "left")
    state = F.when(~F.col("there"), "none").when(F.coalesce("_n", F.lit(0)) < 2, "thin").otherwise("ok")
    stage = F.struct("stage", *[F.coalesce(F.col(f), F.expr(_NO_CLAIMS)).alias(f) for f in STAGE_FIELDS], F.coalesce("emotions", F.array().cast(f"array<{_EMOTION}>")).alias("emotions"), state.alias("coverage"))
    ordered = F.array_sort(F.collect_list(F.struct("at", stage.alias("v"))), lambda a, b: a["at"] - b["at"])
    whole = rows.groupBy("owner").agg(F.transform(ordered, lambda r: r["v"]).alias("stages"))
    out = personas.select(F.col("id").alias("persona_id"), F.col("cluster_id").alias("owner"), "language", "data_source_coverage").join(whole, "owner")
    return out.select(short_id("journey", F.col("persona_id")).alias("id"), F.lit(run["run_id"]).alias("run_id"), "persona_id", "language", "data_source_coverage", "stages", F.lit(run.get("model", "")).alias("model"), F.lit(run.get("provider", "")).alias("provider"))


def _asked(prompts: DataFrame, client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """prompts (owner, prompt) -> owner, reply (null where the call failed), failure. The client is made once a task; a call that fails is a row that says so."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for batch in batches:
            out = []
            for owner, prompt in zip(batch["owner"], batch["prompt"], strict=True):
                try:
                    out.append((owner, ask(prompt), None))
                except Exception as e:  # a client may fail in any way; other owners go on
                    out.append((owner, None, f"call failed: {e}"))
            yield pd.DataFrame(out, columns=["owner", "reply", "failure"])

    return prompts.select("owner", "prompt").mapInPandas(run, f"owner {prompts.schema['owner'].dataType.simpleString()}, reply string, failure string")


def replies(prompts: DataFrame, client: Callable[[], Callable[[str], str]], errors: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """owner, reply, attempts, failure: every prompt asked once, and once more, led by the list of errors, where `errors` (replies -> owner, error) finds any in the reply or the call failed.
    Both rounds are written before they are read, as a call costs money and a lost executor must not repeat those that are through. The second reply counts if there is one."""
    first = written(_asked(prompts, client))
    empty = first.where(tolerant_object(F.coalesce("reply", F.lit(""))).isNull()).select("owner", F.coalesce("failure", F.lit("the reply has no JSON object")).alias("error"))
    found = errors(first).unionByName(empty).groupBy("owner").agg(F.array_sort(F.collect_list("error")).alias("e"))
    again = prompts.join(found, "owner").select("owner", F.concat(retry_prefix(F.col("e")), F.lit("\n\n"), "prompt").alias("prompt"))
    second = written(_asked(again, client)).select("owner", F.col("reply").alias("r"), F.col("failure").alias("f"), F.lit(2).alias("n"))
    both = first.join(second, "owner", "left")
    return both.select("owner", F.coalesce("r", "reply").alias("reply"), F.coalesce("n", F.lit(1)).alias("attempts"), F.when(F.col("n").isNull(), F.col("failure")).otherwise(F.col("f")).alias("failure"))


def generated_personas(prompts: DataFrame, pack: DataFrame, sizes: DataFrame, client: Callable[[], Callable[[str], str]], run: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The records of all owners with a prompt (owner, prompt: the evidence block and the task), and the replies they come from. Packs and sizes are written once, as both
    rounds of calls, the checks and the records read them: packs hold what the prompts show, not whole clusters."""
    pack, sizes = written(pack), written(sizes)
    made = replies(prompts, client, lambda r: P.persona_errors(reply_claims(r), reply_quotes(r), pack.join(r.where("reply is not null").select("owner"), "owner", "left_semi")))
    return persona_records(made, pack, sizes, run), made


def generated_journeys(personas: DataFrame, prompts: DataFrame, pack: DataFrame, sizes: DataFrame, client: Callable[[], Callable[[str], str]], run: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The journeys of persona records: the same prompts, each followed by its persona's name and line."""
    pack, sizes, personas = written(pack), written(sizes), written(personas)
    who = personas.select(F.col("cluster_id").alias("owner"), F.concat(F.lit("\n\nPersona: "), "name", F.lit(". "), "one_liner").alias("who"))
    asked = prompts.join(who, "owner").select("owner", F.concat("prompt", "who").alias("prompt"))
    made = replies(asked, client, lambda r: P.claim_errors(journey_claims(r), pack))
    return journey_records(made, personas, pack, sizes, run), made
