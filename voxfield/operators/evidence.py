"""Evidence packs and the checks of claims and quotes against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxfield.functions.text import short_id, snippet
from voxfield.tables import written


def evidence_pack(members: DataFrame, reps: DataFrame, others: int = 30) -> DataFrame:
    """members (cluster, doc_id, text, source, lang) and reps (cluster, doc_id, rank: the representatives, ten or fewer a cluster) -> the representatives by
    rank with 600 characters, then the first `others` of the rest by id with 300; empty texts take a place but no row. `hidden` counts those beyond,
    `rep_no` the representatives that have a row. Ids alone are ranked and counted, and those that are shown are written as a table, so that Spark knows how few they are:
    they cut the documents before these meet their clusters, and no other text is moved."""
    ids = members.select("cluster", "doc_id")
    chosen = reps.select("cluster", "doc_id", F.col("rank").cast("int").alias("pos")).join(ids, ["cluster", "doc_id"], "left_semi")
    rest = ids.join(reps, ["cluster", "doc_id"], "left_anti")
    few = rest.withColumn("pos", F.row_number().over(Window.partitionBy("cluster").orderBy("doc_id"))).where(F.col("pos") <= others)
    picked = chosen.withColumn("is_representative", F.lit(True)).unionByName(few.withColumn("is_representative", F.lit(False)))
    hidden = rest.groupBy("cluster").agg(F.greatest(F.count("*") - others, F.lit(0)).alias("hidden"))
    picked = written(picked.join(hidden, "cluster", "left"))
    body = F.trim(F.coalesce("text", F.lit("")))
    texts = members.join(picked.select("doc_id"), "doc_id", "left_semi").select("cluster", "doc_id", "source", "lang", body.alias("body"))
    rows = texts.join(picked, ["cluster", "doc_id"]).where("body <> ''")
    number = F.when(F.col("is_representative"), F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("is_representative"), "pos", "doc_id")))
    return rows.select(
        "cluster", "doc_id", "pos", "is_representative", number.alias("rep_no"), short_id("doc", F.col("doc_id")).alias("short_id"), F.when(F.col("is_representative"), snippet(F.col("body"), 600)).otherwise(snippet(F.col("body"), 300)).alias("snippet"),
        F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("hidden", F.lit(0)).alias("hidden"),
    )


def evidence_block(pack: DataFrame) -> DataFrame:
    """(cluster, n_docs, block): the pack of each cluster as one text of at most reps + others entries."""
    line = F.concat(F.lit("["), F.col("short_id"), F.lit("] (source: "), F.col("source"), F.lit(", lang: "), F.col("lang"), F.when(F.col("is_representative"), F.concat(F.lit(", representative #"), F.col("rep_no"))).otherwise(""), F.lit(")\n  "), F.col("snippet"), F.lit("\n"))
    entry = F.struct((~F.col("is_representative")).alias("last"), "pos", "doc_id", line.alias("line"))
    out = pack.groupBy("cluster").agg(F.count("*").alias("n_docs"), F.max("hidden").alias("hidden"), F.array_sort(F.collect_list(entry)).alias("x"))
    more = F.when(F.col("hidden") > 0, F.concat(F.lit("\n... and "), F.col("hidden"), F.lit(" more posts in this cluster (not shown)"))).otherwise("")
    return out.select("cluster", "n_docs", F.concat(F.array_join(F.transform("x", lambda y: y["line"]), "\n"), more).alias("block"))


def evidence_header(members: DataFrame, keywords: DataFrame, group: str = "cluster", coverage: DataFrame | None = None, region: Column | None = None) -> DataFrame:
    """(cluster, header): id, region where it is given, size, keywords and the distributions of source and language; with coverage (cluster, coverage: see
    `relations.coverage_json`) also that block and the line that opens the pack. keywords: cluster, term, rank."""

    def counts(column: str) -> DataFrame:
        n = members.where(F.col(column).isNotNull()).groupBy(group, column).agg(F.count("*").alias("n"))
        pairs = F.array_sort(F.collect_list(F.struct(F.concat(F.lit('"'), F.col(column), F.lit('": '), F.col("n")).alias("x"))))
        return n.groupBy(group).agg(F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: p["x"]), ", "), F.lit("}")).alias(f"_{column}"))

    words = keywords.where("rank <= 10").groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("_words"))
    out = members.groupBy(group).agg(F.count("*").alias("_size")).join(words, group, "left").join(counts("source"), group, "left").join(counts("lang"), group, "left")
    parts = [("- cluster_id: ", F.col(group)), *([] if region is None else [("- region: ", region)]), ("- size: ", F.concat(F.col("_size"), F.lit(" posts"))), ("- top keywords (c-TF-IDF): ", F.coalesce("_words", F.lit(""))), ("- source distribution: ", F.coalesce("_source", F.lit("{}"))), ("- language distribution: ", F.coalesce("_lang", F.lit("{}")))]
    lines = [F.lit("CLUSTER METADATA"), *[F.concat(F.lit(a), b) for a, b in parts]]
    if coverage is not None:
        out = out.join(coverage, group, "left")
        lines += [F.lit(""), F.lit("DATA SOURCE COVERAGE (deterministic; informational)"), F.coalesce("coverage", F.lit("{}")), F.lit(""), F.lit("EVIDENCE PACK"), F.lit("")]
    return out.select(group, F.concat_ws("\n", *lines).alias("header"))


def unknown_citations(cites: DataFrame, known: DataFrame) -> DataFrame:
    """cites (owner, field, pos, doc) -> an error for each that known (doc) lacks."""
    where = F.concat(F.col("field"), F.lit("["), F.col("pos"), F.lit("] cites unknown doc "), F.col("doc"))
    return cites.join(known, "doc", "left_anti").select("owner", "field", "pos", where.alias("error"))


def quote_errors(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """quotes (doc_id, quote) against texts (doc_id, text): not in pack, empty, or not verbatim. The join is on the id; no text is compared with another's quotes."""
    rows = quotes.join(texts.withColumn("_known", F.lit(True)), "doc_id", "left")
    trimmed = F.trim(F.coalesce("quote", F.lit("")))
    error = F.when(F.col("_known").isNull(), "not in pack").when(trimmed == "", "empty").when(~F.coalesce(F.contains("text", trimmed), F.lit(False)), "not verbatim")
    return rows.withColumn("error", error).where(F.col("error").isNotNull()).drop("_known", "text")


def verified_fields(cites: DataFrame, known: DataFrame) -> DataFrame:
    """How many claims of each field stay, and whether the field lost any."""
    ok = cites.join(known.withColumn("_ok", F.lit(True)), "doc", "left").withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    return ok.groupBy("owner", "field").agg(F.count_if("_ok").alias("kept"), (F.count_if(~F.col("_ok")) > 0).alias("unverified"))
