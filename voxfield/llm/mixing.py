"""Mixing sources to target weights, in DataFrame operations alone.

Sizes are words. Sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share the total of all sizes; a
target stops at CAP times its source's size and the excess goes to the others by weight until none is above. With
targets min(CAP * size, level * weight) that is the level at which they add up to the total, found by one window over the sources.

A source takes floor(target / size) complete epochs of all its documents. The rest is taken fractionally by
Efraimidis-Spirakis sampling: each document has the key -ln(u) / quality, u from a hash of its id, so a reread gives the same
key; in the order of the keys documents enter while the middle of their words lies within the budget left, which ends at most half a document off it.

A source may hold a third of all rows, so its keys aren't sorted in one task: keys fall into bins by a monotone function (about BIN
documents each); a window over the bins' sums finds the bin in which the budget ends, the documents of earlier bins enter, those of
later ones don't, and only the documents of that bin are sorted, in a task for each source.

Nulls: a null text has size 0; a null source is a source, the last; a null id has the key of the empty string. Rows with the same id and size
are alike: which of them is taken doesn't show in the result. No rows, or only empty ones: targets 0. Other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxfield.llm.common import store

CAP = 3
BIN = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for texts of 20 words or more whose words have 3 to 12 characters on average, else 0.5."""
    mean = F.try_divide(F.length(text) - size + 1, size)
    return F.when(F.coalesce((size >= 20) & mean.between(3, 12), F.lit(False)), 1.0).otherwise(0.5)


def sampling_key(id_: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of the md5 of the id's text."""
    bits = F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """sources (source, source_size, ...) with target. One row a source: the windows see as many rows as there are sources."""
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    weighed = sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    by_ratio = Window.orderBy(F.col("source_size") * cap / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    below, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    # if the sources before one are at their caps, the others share this level; it rises up to the first one under its cap, then falls
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * cap).over(below), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    first = weighed.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    return first.withColumn("target", F.round(F.coalesce(F.least(F.col("source_size") * cap, F.col("level") * F.col("weight")), F.lit(0.0)).cast("double"), 6)).drop("level", "weight")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs with the columns _id, _source, _size and _key."""
    size = word_count(F.col(text_col))
    sized = docs.withColumns({"_id": F.col(id_col), "_source": F.col(source_col), "_size": size})
    return sized.withColumn("_key", sampling_key(F.col("_id"), quality_weight(F.col(text_col), F.col("_size"))))


def _dealt(sized: DataFrame, cap: int, bin_rows: int) -> tuple[DataFrame, DataFrame]:
    """sized (id, source, size, key) -> rows with source_size, target, epochs and extra (is the row taken fractionally), and the plan by
    source: target, epochs, left, docs, end_bin and before."""
    sources = store(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), cap))
    part = sources.withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)))
    part = part.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    rows = sized.join(part, sized["source"].eqNullSafe(part["source"])).drop(part["source"])
    rows = rows.withColumn("bin", _bin(F.col("key"), F.col("docs"), bin_rows))
    sums = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0))).where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("words") > F.col("left")))
    ends = store(ends.select(F.col("source").alias("end_source"), F.col("bin").alias("end_bin"), "before"))
    rows = rows.join(ends, F.col("source").eqNullSafe(F.col("end_source")), "left")
    cut = rows.where(F.col("bin") == F.col("end_bin"))
    order = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumn("extra", F.col("before") + F.sum("size").over(order) - F.col("size") / 2 <= F.col("left"))
    rest = rows.where(F.col("end_bin").isNull() | (F.col("bin") != F.col("end_bin"))).withColumn("extra", (F.col("left") > 0) & (F.col("end_bin").isNull() | (F.col("bin") < F.col("end_bin"))))
    return rest.unionByName(cut), part.join(ends, F.col("source").eqNullSafe(F.col("end_source")), "left").drop("end_source")


def _bin(key: Column, docs: Column, bin_rows: int) -> Column:
    """Even bins for keys of weight 1; other weights shift rows between bins but keep the order."""
    return F.floor((1 - F.exp(-key)) * F.ceil(docs / bin_rows))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = CAP, bin_rows: int = BIN) -> DataFrame:
    """id, size, source_size, target and taken (words, repeats counted), a row for each document."""
    # one pass over the texts; what follows reads four narrow columns
    sized = store(_sized(docs, id_col, text_col, source_col).select(*[F.col("_" + c).alias(c) for c in ("id", "source", "size", "key")]))
    rows, _ = _dealt(sized, cap, bin_rows)
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (_times(cap) * F.col("size")).cast("long").alias("taken"))


def _times(cap: int) -> Column:
    return F.when(F.col("extra") & (F.col("epochs") < cap), F.col("epochs") + 1).otherwise(F.col("epochs"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = CAP, bin_rows: int = BIN) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; documents without words aren't taken. All columns stay.

    Rows are taken in the order of (key, id, size), so the fractional part of a source is known by the last row taken: texts are
    compared with that and not exchanged. Of rows that equal that last one, as many as the mix takes are taken, by the hash of the text."""
    sized = store(_sized(docs, id_col, text_col, source_col).select(*[F.col("_" + c).alias(c) for c in ("id", "source", "size", "key")]))
    rows, part = _dealt(sized, cap, bin_rows)
    alike = rows.where(F.col("bin") == F.col("end_bin")).groupBy("source", "key", "id", "size").agg(F.count_if("extra").alias("some"), F.count("*").alias("all"))
    last = alike.where("some > 0").groupBy("source").agg(F.max(F.struct("key", "id", "size", "some", "all")).alias("last"))
    plan = part.join(last, part["source"].eqNullSafe(last["source"]), "left").drop(last["source"])
    plan = store(plan.select(F.col("source").alias("_plan_source"), *[F.col(c).alias("_" + c) for c in ("docs", "epochs", "left", "end_bin", "last")]))
    bare = _sized(docs, id_col, text_col, source_col).where("_size > 0")
    met = bare.join(plan, F.col("_source").eqNullSafe(F.col("_plan_source"))).withColumn("_bin", _bin(F.col("_key"), F.col("_docs"), bin_rows))
    here, end = F.struct("_key", "_id", "_size"), F.struct("_last.key", "_last.id", "_last.size")
    early = F.col("_end_bin").isNull() | (F.col("_bin") < F.col("_end_bin"))
    # struct comparison puts nulls first, as the sort does
    inside = (F.col("_bin") == F.col("_end_bin")) & F.col("_last").isNotNull() & (here <= end)
    met = met.withColumn("_extra", (F.col("_left") > 0) & F.coalesce(early | inside, F.lit(False)))
    if plan.where("_last.some < _last.all").limit(1).count():
        tied = F.coalesce((F.col("_bin") == F.col("_end_bin")) & (here == end) & (F.col("_last.some") < F.col("_last.all")), F.lit(False))
        nth = F.row_number().over(Window.partitionBy("_source").orderBy(F.xxhash64(text_col)))
        met = met.where(~tied).unionByName(met.where(tied).withColumn("_extra", nth <= F.col("_last.some")))
    times = F.when(F.col("_extra") & (F.col("_epochs") < cap), F.col("_epochs") + 1).otherwise(F.col("_epochs")).cast("int")
    met = met.withColumn("_times", times).where("_times > 0")
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)
