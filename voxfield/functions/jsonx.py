"""Column functions on JSON text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def path(json: Column, where: str, kind: str, default) -> Column:
    """The value at a path, or the default where it is absent or of another kind."""
    return F.coalesce(F.get_json_object(json, where).try_cast(kind), F.lit(default))


def tolerant_object(text: Column) -> Column:
    """The JSON object of a reply: the text itself, else a fenced block in it, else from its first brace to its last. A variant."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(F.nullif(braces, F.lit(""))))


def tolerant_array(text: Column) -> Column:
    """An array of strings of a reply: the text itself, else its first bracketed part, else its lines, without quotes and commas at the ends."""
    whole = F.from_json(text, "array<string>")
    part = F.from_json(F.regexp_extract(text, r"(?s)(\[[^\]]+\])", 1), "array<string>")
    lines = F.transform(F.split(F.trim(text), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^[\"',]+|[\"',]+$", "")))
    lines = F.filter(lines, lambda x: (x != "") & ~x.startswith("{") & ~x.startswith("["))
    return F.filter(F.coalesce(whole, part, lines), lambda x: F.coalesce(x, F.lit("")) != "")


def script_text(html: Column, kind: str) -> Column:
    """The text of the first script element with this id or type; empty if there is none."""
    return F.regexp_extract(html, rf'(?is)<script[^>]*(?:id|type)="{re.escape(kind)}"[^>]*>(.*?)</script>', 1)


def script_json(html: Column, kind: str) -> Column:
    """The JSON of the first script element with this id or type, as a variant; null if it is broken."""
    return F.try_parse_json(F.nullif(script_text(html, kind), F.lit("")))
