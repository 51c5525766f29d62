"""Personas and journeys: checks of their claims and quotes, what is kept of them, and the views drawn from them.

Claims come long: owner, stage (null for a persona's), field, pos, claim, cites (array). Quotes: owner, pos, doc, text, url, source, lang. A
pack holds what may be cited: owner, doc, text, url, source, lang, one row for each document of an owner. Null arrays cite nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxfield.functions.text import truncate
from voxfield.operators.relations import STAGES, TIERS, confidence

_ID = ("owner", "stage", "field", "pos")


def _where() -> Column:
    return F.concat(F.concat_ws(".", "stage", "field"), F.lit("["), F.col("pos"), F.lit("]"))


def _cited(claims: DataFrame, pack: DataFrame) -> DataFrame:
    """A row for each claim and citation (one with a null doc where there is none), and whether the owner's pack has it."""
    rows = claims.select(*_ID, F.explode_outer("cites").alias("doc"))
    return rows.join(pack.select("owner", "doc", F.lit(True).alias("known")), ["owner", "doc"], "left")


def claim_errors(claims: DataFrame, pack: DataFrame) -> DataFrame:
    """(owner, error): claims without evidence, and every citation of a document that the owner's pack lacks. Stages lead the place of a journey's claims."""
    bare = claims.where(F.coalesce(F.size("cites"), F.lit(0)) <= 0).select("owner", F.concat(_where(), F.lit(" missing evidence array")).alias("error"))
    unknown = _cited(claims, pack).where("doc is not null and known is null")
    return bare.unionByName(unknown.select("owner", F.concat(_where(), F.lit(" cites unknown doc_id '"), F.col("doc"), F.lit("'")).alias("error")))


def quote_errors(quotes: DataFrame, pack: DataFrame) -> DataFrame:
    """(owner, pos, error): the first of: not in the pack, empty, not verbatim."""
    rows = quotes.select("owner", "pos", "doc", F.trim(F.coalesce("text", F.lit(""))).alias("quote")).join(pack.select("owner", "doc", F.coalesce("text", F.lit("")).alias("body"), F.lit(True).alias("known")), ["owner", "doc"], "left")
    place = F.concat(F.lit("representative_quotes["), F.col("pos"), F.lit("] "))
    problem = (
        F.when(F.col("known").isNull(), F.concat(F.lit("doc_id '"), F.coalesce("doc", F.lit("")), F.lit("' not in pack")))
        .when(F.col("quote") == "", "empty text_original")
        .when(~F.contains("body", "quote"), F.concat(F.lit("text_original is not a verbatim substring of "), F.col("doc")))
    )
    return rows.select("owner", "pos", F.concat(place, problem).alias("error")).where("error is not null")


def persona_errors(claims: DataFrame, quotes: DataFrame, pack: DataFrame, least: int = 3) -> DataFrame:
    """(owner, error): errors of claims and quotes, and too few quotes: fewer than `least`, or than the pack has documents."""
    n = quotes.groupBy("owner").agg(F.count("*").alias("n"))
    want = pack.groupBy("owner").agg(F.least(F.countDistinct("doc"), F.lit(least)).alias("want"))
    few = want.join(n, "owner", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < want")
    few = few.select("owner", F.concat(F.lit("representative_quotes: returned "), F.col("n"), F.lit(", must return at least "), F.col("want")).alias("error"))
    return claim_errors(claims, pack).unionByName(few).unionByName(quote_errors(quotes, pack).select("owner", "error"))


def verified_claims(claims: DataFrame, pack: DataFrame) -> DataFrame:
    """claims with `coverage`, less those with any error: `unverified` where the field of that owner (and stage) lost a claim, else `ok`."""
    bad = _cited(claims, pack).groupBy(*_ID).agg(F.bool_or(F.col("known").isNull()).alias("bad"))
    fields = bad.groupBy("owner", "stage", "field").agg(F.bool_or("bad").alias("lost"))
    same = lambda a, b, on: a.alias("a").join(b.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on])
    kept = same(claims, bad.where("not bad"), _ID).select("a.*")
    return same(kept, fields, ("owner", "stage", "field")).select("a.*", F.when(F.col("b.lost"), "unverified").otherwise("ok").alias("coverage"))


def grounded_claims(claims: DataFrame, pack: DataFrame) -> DataFrame:
    """claims with n_users, the distinct documents cited that the pack has, and pct_of_cluster, their share of it (3 digits)."""
    n = _cited(claims, pack).where("known").groupBy(*_ID).agg(F.countDistinct("doc").alias("n_users"))
    size = pack.groupBy("owner").agg(F.countDistinct("doc").alias("size"))
    rows = claims.alias("a").join(n.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in _ID], "left").select("a.*", F.coalesce("b.n_users", F.lit(0)).alias("n_users"))
    rows = rows.join(size, "owner", "left")
    return rows.withColumn("pct_of_cluster", F.round(F.col("n_users") / F.greatest(F.coalesce("size", F.lit(1)), F.lit(1)), 3)).drop("size")


def persona_confidence(claims: DataFrame, verified: DataFrame) -> DataFrame:
    """(owner, unverified_fields, confidence): a tenth off for each field that lost a claim, whether or not any of its claims is left."""
    before, after = (x.groupBy("owner", "stage", "field").agg(F.count("*").alias(n)) for x, n in ((claims, "had"), (verified, "has")))
    rows = before.alias("a").join(after.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("owner", "stage", "field")], "left")
    lost = rows.select("a.owner", (F.col("had") > F.coalesce("has", F.lit(0))).alias("lost"))
    return lost.groupBy("owner").agg(F.count_if("lost").alias("unverified_fields")).withColumn("confidence", confidence(F.col("unverified_fields")))


def filled_quotes(quotes: DataFrame, pack: DataFrame) -> DataFrame:
    """quotes whose empty source, url and lang come from the pack; a language that neither has is en."""
    meta = pack.select("owner", "doc", *[F.col(c).alias(f"_{c}") for c in ("source", "url", "lang")])
    pick = lambda c, last: F.coalesce(F.nullif(F.col(c), F.lit("")), F.nullif(F.col(f"_{c}"), F.lit("")), F.lit(last)).alias(c)
    return quotes.join(meta, ["owner", "doc"], "left").select("owner", "pos", "doc", F.trim("text").alias("text"), pick("source", ""), pick("url", ""), pick("lang", "en"))


def journey_stages(owners: DataFrame, claims: DataFrame) -> DataFrame:
    """(owner, stage, pos, n_cited, coverage) for every owner and stage in order: none without claims, thin below 2 documents cited, else ok."""
    grid = owners.select("owner").distinct().select("owner", F.posexplode(F.array(*map(F.lit, STAGES))).alias("pos", "stage"))
    cited = claims.select("owner", "stage", F.explode_outer("cites").alias("doc")).groupBy("owner", "stage").agg(F.countDistinct("doc").alias("n_cited"))
    n = F.col("n_cited")
    return grid.join(cited, ["owner", "stage"], "left").select("owner", "stage", "pos", F.coalesce(n, F.lit(0)).alias("n_cited"), F.when(n.isNull(), "none").when(n < 2, "thin").otherwise("ok").alias("coverage"))


def first_urls(quotes: DataFrame) -> DataFrame:
    """(owner, doc, url): of each document the address of its first quote that has one."""
    rows = quotes.where("doc <> '' and url <> ''")
    return rows.groupBy("owner", "doc").agg(F.min_by("url", "pos").alias("url"))


def card_chips(personas: DataFrame) -> DataFrame:
    """personas (owner, age_range, occupations array, region, language, cluster_size) -> (owner, pos, label, value), what is missing left out. The region stands in by language."""
    chip = lambda label, value, there: F.when(there, F.struct(F.lit(label).alias("label"), value.alias("value")))
    jobs, size = F.slice(F.coalesce("occupations", F.array().cast("array<string>")), 1, 3), F.coalesce("cluster_size", F.lit(0))
    age, region = F.coalesce("age_range", F.lit("")), F.upper(F.coalesce(F.nullif("region", F.lit("")), F.col("language")))
    chips = F.array_compact(F.array(chip("Age", age, age != ""), chip("Occupation", F.array_join(jobs, " · "), F.size(jobs) > 0), chip("Region", region, F.lit(True)), chip("Cluster size", F.concat(size.cast("string"), F.lit(" posts")), size > 0)))
    return personas.select("owner", F.posexplode(chips).alias("pos", "c")).select("owner", "pos", "c.label", "c.value")


def card_quotes(quotes: DataFrame, chars: int = 200, most: int = 3) -> DataFrame:
    """The first quotes of each owner, cut, with the language in capitals and 12 characters of the document's id."""
    first = quotes.withColumn("_r", F.row_number().over(Window.partitionBy("owner").orderBy("pos"))).where(F.col("_r") <= most)
    bare = F.regexp_replace(F.coalesce("doc", F.lit("")), "^doc_", "")
    return first.select("owner", "pos", truncate(F.col("text"), chars).alias("text"), F.upper(F.coalesce(F.nullif("lang", F.lit("")), F.lit("??"))).alias("lang"), F.coalesce(F.nullif("source", F.lit("")), F.lit("—")).alias("source"), F.substring(bare, 1, 12).alias("short_id"))


def bundle(personas: DataFrame, journeys: DataFrame, run_id: str) -> DataFrame:
    """A run's personas, in the order of their ids, each with its journey if it has one. personas: run_id, persona_id; journeys: persona_id, journey_id."""
    return personas.where(F.col("run_id") == run_id).join(journeys.select("persona_id", "journey_id"), "persona_id", "left").orderBy("persona_id", "journey_id")


def merged_personas(personas: DataFrame, key: str, vector: str, claims: str, least: float = 0.9) -> DataFrame:
    """(key, merged, claims): personas whose vectors have a cosine of `least` or more are one, and what is joined by others too; the smallest key stays, `merged` lists all keys in order and `claims` the
    distinct claims of all. At unit length a cosine is a distance, so this is the epsilon-join of `density` with every row a core. Zero and null vectors join nothing."""
    from voxfield.operators.clusters import normalised
    from voxfield.operators.density import density_clusters

    unit = normalised(personas.select(key, vector), key, vector).where(F.forall(vector, lambda x: x.isNotNull()))
    labels = density_clusters(unit.withColumn("all", F.lit(0)), ["all"], key, vector, (2 * (1 - least)) ** 0.5, 1).where("label >= 0").select(F.col(key).alias("_k"), "label")
    rows = personas.join(labels, F.col(key) == F.col("_k"), "left").withColumn("_g", F.when(F.col("label").isNull(), F.col(key)))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(claims).alias("c"))))
    out = rows.groupBy("label", "_g").agg(ordered.alias("x"))
    return out.select(F.col("x")[0]["k"].alias(key), F.transform("x", lambda r: r["k"]).alias("merged"), F.array_distinct(F.flatten(F.transform("x", lambda r: F.coalesce(r["c"], F.array().cast(personas.schema[claims].dataType))))).alias(claims))


def contested_merge(claims: DataFrame, contested: DataFrame) -> DataFrame:
    """claims with `contested_by`: the documents that contested (owner, stage, field, pos, doc) has against them, each once in order; empty where there are none."""
    by = contested.groupBy(*_ID).agg(F.array_sort(F.collect_set("doc")).alias("docs"))
    joined = claims.alias("a").join(by.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in _ID], "left")
    return joined.select("a.*", F.coalesce("b.docs", F.array().cast("array<string>")).alias("contested_by"))


def contested_count(claims: DataFrame) -> DataFrame:
    """(owner, contested, unverified): how many claims have a contesting document, and the fields whose coverage is unverified, in order. claims: owner, field, contested_by, coverage."""
    lost = F.array_sort(F.collect_set(F.when(F.col("coverage") == "unverified", F.col("field"))))
    return claims.groupBy("owner").agg(F.count_if(F.size("contested_by") > 0).alias("contested"), lost.alias("unverified"))


def sentiment_rollup(claims: DataFrame, moods: tuple[str, ...] = ("negative", "neutral", "positive")) -> DataFrame:
    """(owner, mood, n, pct): the mentions of each mood over all claims of an owner, and their share of all (1 digit; 0 where there are none)."""
    sums = claims.groupBy("owner").agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in moods])
    total = sum((F.col(m) for m in moods), F.lit(0))
    long = sums.select("owner", total.alias("t"), F.explode(F.array(*[F.struct(F.lit(m).alias("mood"), F.col(m).alias("n")) for m in moods])).alias("x"))
    return long.select("owner", "x.mood", "x.n", F.coalesce(F.round(100.0 * F.try_divide(F.col("x.n"), F.col("t")), 1), F.lit(0.0)).alias("pct"))


def eval_scores(expected: DataFrame, recovered: DataFrame, coverage: DataFrame) -> DataFrame:
    """The suite's report, a row for each fixture: expected (fixture, theme), recovered (fixture, theme; any more are not counted) and coverage (fixture, tier of a persona; from single-perspective 1 to high 4,
    anything else 0) -> expected, recovered, recovery_rate (4 digits), unmatched (themes in order), mean_coverage (4 digits, null without personas)."""
    hits = recovered.select("fixture", "theme", F.lit(True).alias("hit")).distinct()
    rows = expected.distinct().join(hits, ["fixture", "theme"], "left").groupBy("fixture")
    scores = rows.agg(F.count("*").alias("expected"), F.count_if("hit").alias("recovered"), F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("theme")))).alias("unmatched"))
    rank = F.greatest(F.array_position(F.array(*map(F.lit, TIERS)), F.coalesce("tier", F.lit(""))), F.lit(0))
    means = coverage.groupBy("fixture").agg(F.round(F.avg(rank), 4).alias("mean_coverage"))
    rate = F.round(F.col("recovered") / F.col("expected"), 4)
    return scores.join(means, "fixture", "left").select("fixture", "expected", "recovered", rate.alias("recovery_rate"), "unmatched", "mean_coverage")
