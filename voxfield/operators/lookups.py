"""Lookups against rules and remembered replies: robots rules of hosts, a cache whose entries live for a while."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxfield.operators.components import spread_join


def host_and_path(url: Column) -> tuple[Column, Column]:
    """scheme://host, as robots files are kept by, and the path (/ if there is none); both null for what is no address."""
    host = F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.lower(F.try_parse_url(url, F.lit("HOST"))))
    return host, F.when(host.isNotNull(), F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")))


def robots_rules(files: DataFrame, host: str, text: str, agent: str = "*") -> DataFrame:
    """(host, prefix): the disallowed prefixes for an agent, from one robots file for each host. Lines are folded in their order: agents add up over the file, and a disallow counts once `*` or the
    agent has been named. Comments and empty rules are skipped; a null file forbids nothing."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, "#.*", "")))
    parsed = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("rules"))

    def fold(state: Column, line: Column) -> Column:
        named = (line["k"] == "user-agent") & F.lower(line["v"]).isin("*", agent.lower())
        rule = state["on"] & (line["k"] == "disallow") & (line["v"] != "")
        return F.struct((state["on"] | named).alias("on"), F.when(rule, F.array_append(state["rules"], line["v"])).otherwise(state["rules"]).alias("rules"))

    return files.select(F.col(host).alias("host"), F.explode(F.array_distinct(F.aggregate(parsed, start, fold)["rules"])).alias("prefix"))


def robots_check(urls: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """(url, rule): each address once, with the longest prefix that forbids it, null if it is allowed. An address is cut at the lengths that its host's rules have, so rules meet
    equal keys: no comparison of every address with every rule. Hosts with most of the addresses are spread."""
    host, path = host_and_path(F.col(url))
    rows = urls.select(url).where(F.col(url).isNotNull()).distinct().select(url, host.alias("host"), path.alias("path"))
    lengths = rules.groupBy(F.col("host").alias("h")).agg(F.collect_set(F.length("prefix")).alias("lengths"))  # as many as a file's rules
    cut = spread_join(rows, lengths, "host", "h").select(url, "host", "path", F.explode_outer(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    keyed = cut.select(url, F.struct("host", F.expr("left(path, n)").alias("prefix")).alias("k"))
    met = spread_join(keyed, rules.select(F.struct("host", "prefix").alias("r"), F.col("prefix").alias("rule")).distinct(), "k", "r")
    return met.groupBy(url).agg(F.max_by("rule", F.length("rule")).alias("rule"))


def cached(requests: DataFrame, cache: DataFrame, key: str, at: str, ttl_s: int) -> DataFrame:
    """requests with `status` (hit, expired or miss), `result` and `recorded_at` of the newest entry of their key that isn't younger than they are; result and recorded_at only for hits, those with an
    entry of at most ttl_s seconds. cache: key, recorded_at, result; entries of one key and time should be one (`upsert`).

    An as-of join by time buckets of ttl_s: an entry can serve its own bucket and, if it is the bucket's last, the next one, so the windows that order a key's entries and
    requests hold one bucket each, not a key's whole history."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    entries = cache.select(F.col(key).alias("_k"), F.col("recorded_at").alias("_t"), F.col("result").alias("_r")).withColumn("_b", F.floor(seconds("_t") / ttl_s))
    last = entries.groupBy("_k", "_b").agg(F.max_by(F.struct("_t", "_r"), "_t").alias("x")).select("_k", "x._t", "x._r", (F.col("_b") + 1).alias("_b"))
    columns = requests.columns
    asked = requests.select(F.struct(*columns).alias("_q"), F.col(key).alias("_k"), F.col(at).alias("_o"), F.lit(1).alias("_side"), F.floor(seconds(at) / ttl_s).alias("_b"))
    held = entries.unionByName(last).select("_k", F.col("_t").alias("_o"), F.lit(0).alias("_side"), "_b", F.struct("_t", "_r").alias("_e"))
    upto = Window.partitionBy("_k", "_b").orderBy("_o", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = asked.unionByName(held, allowMissingColumns=True).withColumn("_e", F.last("_e", ignorenulls=True).over(upto)).where("_side = 1")
    first = cache.groupBy(F.col(key).alias("_f")).agg(F.min("recorded_at").alias("_first"))
    known = spread_join(seen.select("_q", "_k", "_o", "_e"), first, "_k", "_f")
    hit = F.coalesce(seconds("_o") - F.unix_micros(F.col("_e._t").cast("timestamp")) / 1_000_000 <= ttl_s, F.lit(False))
    status = F.when(hit, "hit").when(F.col("_first") <= F.col("_o"), "expired").otherwise("miss")
    return known.select(*[F.col("_q")[c].alias(c) for c in columns], status.alias("status"), F.when(hit, F.col("_e._r")).alias("result"), F.when(hit, F.col("_e._t")).alias("recorded_at"))
