"""What calls to a model cost: tokens used, and an estimate before a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens of a task's text, of a reply's frame and of the longest reply, for the two calls of a cluster.
PERSONA_TASK, JOURNEY_TASK, FRAME = 350, 450, 50
PERSONA_OUTPUT, JOURNEY_OUTPUT = 1500, 2200
CHARS_PER_TOKEN = 3.5

TOKENS = ["input_tokens", "cached_input_tokens", "cache_write_tokens", "output_tokens"]
#: The columns of a price list that go with TOKENS, in dollars a million.
PRICES = ["input_price", "cached_price", "write_price", "output_price"]


def usage_cost(usage: DataFrame, prices: DataFrame, by: str = "provider") -> DataFrame:
    """usage (by, TOKENS; nulls count nothing) -> by, the sums of TOKENS and cost_usd (6 digits; null for a provider without prices). Summed before the prices join."""
    total = usage.groupBy(by).agg(*[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TOKENS])
    cost = sum(F.col(t) / 1e6 * F.col(p) for t, p in zip(TOKENS, PRICES, strict=True))
    return total.join(prices, by, "left").select(by, *TOKENS, F.round(cost, 6).alias("cost_usd"))


def evidence_tokens(block: Column, size: Column) -> Column:
    """The tokens of a pack's text, or of a guess from the cluster's size where there is no text yet."""
    return F.coalesce(F.floor(F.length(block) / CHARS_PER_TOKEN), 200 + 80 * size).cast("long")


def estimated_usage(packs: DataFrame, key: str, block: str, size: str) -> DataFrame:
    """(key, evidence_tokens, TOKENS) of each cluster's two calls without a retry: the first pays for the evidence and writes it to the cache, the second reads it there."""
    e = F.col("evidence_tokens")
    rows = packs.select(key, evidence_tokens(F.col(block), F.col(size)).alias("evidence_tokens"))
    return rows.select(key, e, (e + PERSONA_TASK + FRAME + JOURNEY_TASK + FRAME).alias(TOKENS[0]), e.alias(TOKENS[1]), e.alias(TOKENS[2]), F.lit(PERSONA_OUTPUT + JOURNEY_OUTPUT).cast("long").alias(TOKENS[3]))
