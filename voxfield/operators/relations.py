"""Joins, coverage and comparison of posts, sources, claims and clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The categories of sources, the stages of a journey.
CATEGORIES = ["forums", "reviews", "social", "video_comments", "qa", "blogs", "news_comments"]
STAGES = ["Awareness", "Consideration", "Decision", "Onboarding", "Use", "Loyalty/Churn"]


def not_seen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key was not seen before."""
    return rows.join(seen.select(*keys), keys, "left_anti")


def seen_update(seen: DataFrame, rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The dedup index after a run: first and last time of each key. seen: keys, first_seen, last_seen."""
    new = rows.select(*keys, F.col(at).alias("first_seen"), F.col(at).alias("last_seen"))
    return seen.unionByName(new).groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


#: Tiers of coverage, from the lowest.
TIERS = ["single-perspective", "limited", "balanced", "high"]


def tier(n: Column) -> Column:
    return F.when(n <= 1, TIERS[0]).when(n == 2, TIERS[1]).when(n <= 4, TIERS[2]).otherwise(TIERS[3])


def coverage(counts: DataFrame, group: str) -> DataFrame:
    """counts (group, source, category or null, n) -> categories present and missing (sorted, comma-joined), how many, and their tier."""
    present = F.array_sort(F.collect_set("category"))
    out = counts.groupBy(group).agg(present.alias("p"), F.sum("n").alias("size"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, CATEGORIES)), F.col("p")))
    return out.select(group, F.array_join("p", ",").alias("categories_present"), F.array_join(missing, ",").alias("categories_missing"), F.size("p").alias("category_count"), tier(F.size("p")).alias("coverage_tier"))


def bias_warning(counts: DataFrame, group: str) -> DataFrame:
    """counts as for coverage -> the warnings of each group: one source above 70 %, notable gaps, forum-native text."""
    # the source with most posts; of equal ones the first by name
    out = counts.groupBy(group).agg(F.collect_set("category").alias("p"), F.sum("n").alias("size"), F.max("n").alias("top_n"), F.min(F.struct((-F.col("n")).alias("neg"), "source")).alias("top"))
    gaps = F.array_sort(F.array_except(F.array(*map(F.lit, ["social", "video_comments", "reviews"])), F.col("p")))
    text_first = (F.size("p") > 0) & (F.size(F.array_except(F.col("p"), F.array(*map(F.lit, ["forums", "qa", "news_comments"])))) == 0)
    parts = F.concat_ws(
        "; ",
        F.when(F.col("top_n") / F.col("size") > 0.7, F.concat(F.floor(F.col("top_n") * 100 / F.col("size")).cast("string"), F.lit("% of evidence from a single source ("), F.col("top.source"), F.lit(")"))),
        F.when(F.size(gaps) > 0, F.concat(F.lit("no "), F.array_join(gaps, "/"), F.lit(" coverage"))),
        F.when(text_first, F.lit("persona likely skews text-first / forum-native; short-form social and video voices are absent")),
    )
    return out.select(group, F.when(parts == "", "balanced coverage across categories").otherwise(parts).alias("bias_warning"))


def coverage_json(counts: DataFrame, group: str) -> DataFrame:
    """counts as for coverage -> (group, coverage): the coverage of each group as JSON with sorted keys, indented by two. Sources are listed by
    number of posts, then name; posts without a source count for the size alone. Letters beyond ASCII stay as they are."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    block = lambda rows, a, b: F.when(F.size(rows) == 0, a + b).otherwise(F.concat(F.lit(f"{a}\n    "), F.array_join(rows, ",\n    "), F.lit(f"\n  {b}")))
    known = F.when(F.col("source").isNotNull(), F.struct((-F.col("n")).alias("neg"), "source"))
    used = F.array_sort(F.collect_list(known))
    by_name = F.array_sort(F.transform(used, lambda x: F.struct(x["source"].alias("source"), (-x["neg"]).alias("n"))))
    present = F.array_sort(F.collect_set("category"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, CATEGORIES)), present))
    parts = counts.groupBy(group).agg(
        block(F.transform(missing, quoted), "[", "]").alias("m"), block(F.transform(present, quoted), "[", "]").alias("p"), F.size(present).alias("k"),
        block(F.transform(by_name, lambda x: F.concat(quoted(x["source"]), F.lit(": "), x["n"])), "{", "}").alias("d"), block(F.transform(used, lambda x: quoted(x["source"])), "[", "]").alias("u"),
    )
    fields = [("bias_warning", quoted(F.col("bias_warning"))), ("categories_missing", F.col("m")), ("categories_present", F.col("p")), ("category_count", F.col("k").cast("string")), ("coverage_tier", quoted(tier(F.col("k")))), ("doc_counts", F.col("d")), ("sources_used", F.col("u"))]
    lines = F.concat_ws(",\n", *[F.concat(F.lit(f'  "{name}": '), x) for name, x in fields])
    both = parts.join(bias_warning(counts, group).withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")))
    return both.select(group, F.concat(F.lit("{\n"), lines, F.lit("\n}")).alias("coverage"))


def distribution(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value as text, n), nulls left out."""
    return rows.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("string").alias("value")).agg(F.count("*").alias("n"))


def as_histogram(counts: DataFrame, group: str) -> DataFrame:
    """counts (group, value, n) -> one text `value:n,...` for each group, by n descending, then by value."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col("value"), F.col("n"))))
    return counts.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["value"], x["n"])), ",").alias("histogram"))


def set_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(the columns, change): resolved, emerged or persisted; distinct rows."""
    parts = ((after.subtract(before), "emerged"), (before.subtract(after), "resolved"), (before.intersect(after), "persisted"))
    return reduce(DataFrame.unionByName, (x.withColumn("change", F.lit(c)) for x, c in parts))


def grounding(evidence: DataFrame, texts: DataFrame, sizes: DataFrame, negative: list[str], positive: list[str]) -> DataFrame:
    """evidence (claim, cluster, doc; a row for each mention) -> distinct documents, their share of the cluster, and mentions by sentiment.
    A mention of an unknown document is neutral."""
    from voxfield.functions.text import hits

    scored = texts.select("doc", (hits(F.col("text"), positive) - hits(F.col("text"), negative)).alias("s"))
    out = evidence.join(scored, "doc", "left").withColumn("s", F.coalesce("s", F.lit(0))).groupBy("claim", "cluster")
    out = out.agg(F.countDistinct("doc").alias("n_users"), F.count_if(F.col("s") < 0).alias("negative"), F.count_if(F.col("s") == 0).alias("neutral"), F.count_if(F.col("s") > 0).alias("positive"))
    return out.join(sizes, "cluster").withColumn("pct_of_cluster", F.round(F.col("n_users") / F.greatest(F.col("size"), F.lit(1)), 3)).drop("size")


def theme_matches(themes: DataFrame, theme: str, claims: DataFrame, key: str, text: str) -> DataFrame:
    """(theme, matches): how many claims share a token with the theme's text, for themes with any. Themes that share a token come as one list for it, and lists of equal
    tokens' themes are one group, so a claim's tokens become the groups it meets, each once, before themes are unfolded and counted on the map side."""
    from voxfield.functions.text import token_set

    tokens = themes.select(theme, F.explode(token_set(F.col(text))).alias("token"))
    groups = tokens.groupBy("token").agg(F.array_sort(F.collect_set(theme)).alias("themes"))
    met = claims.select(key, F.explode(token_set(F.col(text))).alias("token")).join(groups, "token").groupBy(key).agg(F.collect_set("themes").alias("sets"))
    return met.select(F.explode(F.array_distinct(F.flatten("sets"))).alias(theme)).groupBy(theme).agg(F.count("*").alias("matches"))


def confidence(unverified: Column) -> Column:
    return F.greatest(F.lit(0.0), F.round(1 - 0.1 * unverified, 6))


def recovered(claims: DataFrame, key: str, text: str, themes: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """(key, theme): the themes, each its keywords and phrases, that a claim recovers: one of its [a-z0-9]+ tokens is a keyword, or it contains a phrase, in
    either case. Themes are a list of the evaluation's, so one pass over the claims does and no join."""
    from voxfield.functions.text import contains_any, token_set

    tests = []
    for theme, (words, phrases) in themes.items():
        hit = F.lit(False)
        if words:
            hit = hit | F.arrays_overlap("_tokens", F.array(*[F.lit(w.lower()) for w in words]))
        if phrases:
            hit = hit | contains_any(F.coalesce(text, F.lit("")), [p.lower() for p in phrases])
        tests.append(F.when(hit, F.lit(theme)))
    rows = claims.select(key, F.col(text), token_set(F.coalesce(text, F.lit(""))).alias("_tokens"))
    return rows.select(key, F.explode(F.array_compact(F.array(*tests))).alias("theme"))
