"""Around a language-model call: prompts, checks, one retry, cost gate. The client is a parameter; offline a mock stands in."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxfield.functions.text import short_id

CLAIM_FIELDS = ("pain_points", "goals", "motivations", "behaviors", "preferred_channels")


def retry_prefix(errors: Column, most: int = 20) -> Column:
    """The errors of a reply as a numbered list, the first `most` of them."""
    lines = F.transform(F.slice(errors, 1, most), lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e))
    return F.concat(F.lit("Fix these errors:\n"), F.array_join(lines, "\n"))


def resolve_placeholders(text: Column) -> Column:
    """Each <post_...> replaced by the short id of its post."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit("<(post_[A-Za-z0-9_]+)>"), 1))
    return F.aggregate(names, text, lambda t, n: F.replace(t, F.concat(F.lit("<"), n, F.lit(">")), short_id("doc", n)))


def sentiment_text(scores: Column) -> Column:
    """A map of counts as `neg:8 neu:2`: first three letters, without zeros, by key."""
    entries = F.array_sort(F.filter(F.map_entries(scores), lambda e: e["value"] > 0))
    return F.array_join(F.transform(entries, lambda e: F.concat(F.substring(e["key"], 1, 3), F.lit(":"), e["value"])), " ")


def within_budget(costs: DataFrame, key: str, cost: str, cap: float) -> DataFrame:
    """Rows with `runs`: those whose cost, added to the costs of the rows before by key, stays within the cap. A row a cluster, not a post."""
    spent = F.sum(cost).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return costs.withColumn("spent", F.round(spent, 6)).withColumn("runs", F.col("spent") <= cap)


def _parsed(reply: str) -> dict | None:
    """The object of a reply: itself, a fenced block, or from its first brace to its last."""
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", reply, re.DOTALL)
    for part in (reply, fenced and fenced[1], reply[reply.find("{") : reply.rfind("}") + 1]):
        try:
            found = json.loads(part or "")
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def persona_errors(persona: dict | None, doc_ids: set[str], texts: dict[str, str]) -> list[str]:
    """What is not grounded in the pack: claims without evidence or with unknown documents, too few quotes, quotes that are not verbatim."""
    if persona is None:
        return ["the reply has no JSON object"]
    errors = []
    for field in CLAIM_FIELDS:
        for i, claim in enumerate(persona.get(field) or []):
            cited = claim.get("evidence") or [] if isinstance(claim, dict) else []
            errors += [f"{field}[{i}] has no evidence"] if not cited else [f"{field}[{i}] cites unknown {d}" for d in cited if d not in doc_ids]
    quotes = persona.get("representative_quotes") or []
    if len(quotes) < min(3, len(doc_ids)):
        errors.append(f"{len(quotes)} quotes, at least {min(3, len(doc_ids))} needed")
    for i, q in enumerate(quotes):
        said = (q.get("text_original") or "").strip()
        if not said or said not in texts.get(q.get("doc_id"), ""):
            errors.append(f"quote {i} is not verbatim")
    return errors


def synthesize(packs: DataFrame, client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """packs (cluster, block, docs array<struct<doc, text>>) -> cluster, reply, attempts, errors. The client is made once a task; a reply with errors is
    asked for once more with their list; a client that fails gives an error, and other clusters go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for batch in batches:
            out = []
            for cluster, block, docs in zip(batch["cluster"], batch["block"], batch["docs"], strict=True):
                texts = {d["doc"]: d["text"] for d in docs}
                reply, errors, prompt = "", [], block
                for attempt in (1, 2):
                    try:
                        reply = ask(prompt)
                        errors = persona_errors(_parsed(reply), set(texts), texts)
                    except Exception as e:  # a client may fail in any way; the row says so
                        errors = [f"call failed: {e}"]
                    if not errors:
                        break
                    prompt = "Fix these errors:\n" + "\n".join(f"{i + 1}. {e}" for i, e in enumerate(errors[:20])) + "\n\n" + block
                out.append((cluster, reply, attempt, errors))
            yield pd.DataFrame(out, columns=["cluster", "reply", "attempts", "errors"])

    return packs.mapInPandas(run, f"cluster {packs.schema['cluster'].dataType.simpleString()}, reply string, attempts int, errors array<string>")


def quoting_client() -> Callable[[str], str]:
    """A mock that quotes the first documents of a pack; its first reply to a pack lacks the evidence, so that the retry is exercised."""

    def ask(prompt: str) -> str:
        docs = re.findall(r"\[(doc_[0-9a-f]{12})\][^\n]*\n  ([^\n]*)", prompt)
        evidence = [d for d, _ in docs[:2]] if prompt.startswith("Fix") else []
        quotes = [{"doc_id": d, "text_original": t[:40]} for d, t in docs[:3]]
        return "Here:\n```json\n" + json.dumps({"pain_points": [{"claim": "slow", "evidence": evidence}], "representative_quotes": quotes}) + "\n```"

    return ask
