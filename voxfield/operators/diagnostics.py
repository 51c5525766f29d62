"""A report on clusters in Markdown, as rows that sort into it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxfield.functions.text import bar
from voxfield.tables import written

#: The columns that lines sort by: part of the report, cluster, block of the cluster, place in the block.
ORDER = ["part", "cluster", "block", "pos"]


def _lines(rows: DataFrame, part: int, block: int, line: Column, pos: Column | int = 0, cluster: Column | None = None) -> DataFrame:
    key = F.lit(None).cast("string") if cluster is None else cluster.cast("string")
    return rows.select(F.lit(part).alias("part"), key.alias("cluster"), F.lit(block).alias("block"), (F.lit(pos) if isinstance(pos, int) else pos).cast("long").alias("pos"), line.alias("line"))


def _several(rows: DataFrame, part: int, block: int, lines: list[Column | str], cluster: Column | None = None) -> DataFrame:
    """Lines of every row in the order given, those that are null left out."""
    texts = F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
    place = [*rows.columns, F.posexplode(texts).alias("_p", "_line")]
    return _lines(rows.select(*place).where("_line is not null"), part, block, F.col("_line"), F.col("_p"), cluster)


def _counts(clustered: DataFrame, column: str) -> DataFrame:
    """(cluster, value, n, pct, place): how often each value occurs, by number, then value."""
    n = clustered.where(F.col(column).isNotNull()).groupBy("cluster", F.col(column).alias("value")).agg(F.count("*").alias("n"))
    group = Window.partitionBy("cluster")
    return n.select("cluster", "value", "n", F.round(100.0 * F.col("n") / F.sum("n").over(group), 1).alias("pct"), F.row_number().over(group.orderBy(F.desc("n"), "value")).alias("place"))


def report_lines(members: DataFrame, reps: DataFrame, keywords: DataFrame, topic: str, region: str, least: object = "N/A", threshold: object = "N/A", dominant: float = 80.0) -> DataFrame:
    """The report on members (cluster, doc_id, source, lang, text; a null cluster is noise): sizes, ten keywords, three snippets of 200 characters, sources with a warning beyond `dominant` percent,
    languages, and advice from the share of noise. reps: cluster, doc_id, rank; keywords: cluster, term, rank. What is counted is a row a cluster and value. Only the texts of representatives are fetched: their ids are written as a table,
    so that Spark knows how few they are, and cut the documents before these meet their clusters."""
    clustered = members.where("cluster is not null")
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("size"))
    total = members.agg(F.count("*").alias("posts"), F.count_if(F.col("cluster").isNull()).alias("noise"), F.countDistinct("cluster").alias("found"))
    total = total.withColumn("pct", F.coalesce(F.round(F.try_divide(100.0 * F.col("noise"), F.col("posts")), 1), F.lit(0.0)))
    ends = sizes.agg(F.min("size").alias("low"), F.max("size").alias("high"))
    some, pct, c = F.col("low").isNotNull(), F.col("pct"), F.col("cluster")
    fence = F.when(some, "```")

    head = _several(total, 0, 0, [f"# Cluster Diagnostics — {topic} ({region})", "", F.concat(F.lit("Total posts: "), "posts"), F.concat(F.lit("Clusters found: "), "found"), F.concat(F.lit("Noise (unclustered): "), "noise", F.lit(" ("), pct.cast("string"), F.lit("%)")), ""])
    scale = _several(ends, 1, 0, ["## 1. Cluster Sizes", "", F.when(some, F.concat(F.lit("Range: "), "low", F.lit(" – "), "high")).otherwise("No clusters found — all posts classified as noise."), fence])
    bars = sizes.join(F.broadcast(ends), F.col("size") <= F.col("high"))  # one row
    bars = _lines(bars, 1, 1, F.concat(F.lit("  "), bar(F.col("size"), F.col("high")), F.lit(" "), "size"), -F.col("size"))
    closed = _several(ends, 1, 2, [fence, "", "## 2. Cluster Details", ""])

    titles = _several(sizes, 2, 0, [F.concat(F.lit("### Cluster "), c.cast("string"), F.lit(" — size "), "size"), ""], c)
    terms = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"])
    words = _several(keywords.where("rank <= 10").groupBy("cluster").agg(F.array_join(terms, ", ").alias("w")), 2, 1, [F.concat(F.lit("**Keywords:** "), "w"), ""], c)
    few = written(reps.where("rank <= 3").select("cluster", "doc_id", "rank"))
    texts = members.join(few.select("doc_id"), "doc_id", "left_semi").select("cluster", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shown = few.join(texts, ["cluster", "doc_id"], "left")
    cut = F.concat(F.replace(F.substring("text", 1, 200), F.lit("\n"), F.lit(" ")), F.when(F.length("text") > 200, "…").otherwise(""))
    posts = _lines(shown, 2, 3, F.concat("rank", F.lit(". `"), F.col("doc_id").cast("string"), F.lit("`: "), F.coalesce(cut, F.lit(""))), F.col("rank"), c)
    around = [_several(sizes, 2, 2, ["**Representative posts:**"], c), _several(sizes, 2, 4, [""], c)]

    def listed(column: str, title: str, block: int, warn: bool) -> list[DataFrame]:
        n = _counts(clustered, column)
        said = F.concat(F.lit("  - "), "value", F.lit(": "), "n", *([F.lit(" ("), pct.cast("string"), F.lit("%)")] if warn else []))
        rows = [_several(n.where("place = 1"), 2, block, [f"**{title} distribution:**"], c), _lines(n, 2, block + 1, said, 2 * F.col("place"), c), _several(n.where("place = 1"), 2, block + 2, [""], c)]
        if warn:
            rows.append(_lines(n.where(pct > dominant), 2, block + 1, F.lit(f"    ⚠ This cluster is >{dominant:g}% from one source — bias risk"), 2 * F.col("place") + 1, c))
        return rows

    share = lambda before, after: F.concat(F.lit(before), pct.cast("string"), F.lit(after))
    high, low = pct > 40, pct < 5
    advice = [
        F.when(high, share("⚠ Noise ratio is high (", "%). Consider:")).when(low, share("ℹ Noise ratio is low (", "%). Consider:")).otherwise(share("✓ Noise ratio (", "%) is in a healthy range (5–40%).")),
        F.when(high, f"  - Lowering the least cluster size (current: {least})").when(low, "  - Raising the least cluster size to produce tighter clusters"),
        F.when(high, f"  - Lowering the outlier threshold (current: {threshold})").when(low, "  - Raising the outlier threshold to be more selective"),
    ]
    parts = [head, scale, bars, closed, titles, words, *around, posts, *listed("source", "Source", 5, True), *listed("lang", "Language", 8, False), _several(total, 3, 0, ["## 3. Parameter Suggestions", "", *advice, ""])]
    return reduce(DataFrame.unionByName, parts)


def write_report(lines: DataFrame, path: str) -> None:
    """The lines in order as text, one file."""
    lines.orderBy(*[F.asc_nulls_first(c) for c in ORDER]).select("line").coalesce(1).write.mode("overwrite").text(path)
