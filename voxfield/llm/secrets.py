"""Secret scans: fixed patterns, and Shannon entropy in a sliding window over candidate strings.

Candidates are runs of WINDOW or more characters of the alphabets of keys. Each belongs to one character class (hex, or
mixed letters and digits), and each class has its own least entropy. A window slides over the candidate; the counts of
its characters change by the one that leaves and the one that enters, and with them the sum of c*log2(c), so each step
costs the same. Windows at or above the threshold join into spans. Allow-listed candidates (words, numbers, UUIDs,
paths, repeats of a few characters) give none, and neither do spans inside one that a pattern found.

Nulls: a null text is an empty one (no spans). Offsets count code points, ends exclusive. Repeated rows give repeated
results. Other columns are not carried, except by `redact`, which keeps all and replaces the text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield.llm.common import text_blocks

WINDOW = 20
#: Least entropy in bits of a window of 20, by class.
LEAST = {"hex": 3.0, "mixed": 3.6}
KINDS = ("assign", "access", "hex", "entropy")
SPAN = "struct<kind: string, start: int, end: int>"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the same as runs of [0-9a-f]+ without those under 32
CANDIDATE = re.compile(rf"[A-Za-z0-9+/=_-]{{{WINDOW},}}")
ALLOWED = re.compile(
    r"""[A-Za-z]+ | [0-9]+ | [A-Za-z_/=+-]+ | [0-9_/=+-]+        # words, numbers, joined words
    | [0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}
    # paths and names of short parts that look like words or numbers: one case or capitalised, digits only at the end
    | (?:(?=[A-Za-z0-9]{1,15}[/_-])(?:[A-Z]?[a-z]+|[A-Z]+)?[0-9]*[/_-])+(?![A-Za-z0-9]{16})(?:[A-Z]?[a-z]+|[A-Z]+)?[0-9]*
    """,
    re.VERBOSE,
)
HEXES = re.compile(r"[0-9A-Fa-f]+")
_CLOGC = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def windows_of(text: str, least: float) -> list[tuple[int, int]]:
    """Spans of the windows of WINDOW characters whose entropy reaches least, joined where they overlap or touch."""
    counts: dict[str, int] = {}
    total, out = 0.0, []
    most = WINDOW * (math.log2(WINDOW) - least) + 1e-9  # entropy >= least is sum of c log c <= most
    for i, x in enumerate(text):
        if i >= WINDOW:
            gone = text[i - WINDOW]
            c = counts[gone]
            total += _CLOGC[c - 1] - _CLOGC[c]
            counts[gone] = c - 1
        c = counts.get(x, 0)
        total += _CLOGC[c + 1] - _CLOGC[c]
        counts[x] = c + 1
        if i >= WINDOW - 1 and total <= most:
            a = i + 1 - WINDOW
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((a, i + 1))
    return out


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by kind as in KINDS."""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    base = sorted(x[1:] for x in spans)
    starts, reach = [x[0] for x in base], list(accumulate((x[1] for x in base), max))
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if ALLOWED.fullmatch(run):
            continue
        for a, b in windows_of(run, LEAST["hex" if HEXES.fullmatch(run) else "mixed"]):
            a, b = a + m.start(), b + m.start()
            k = bisect_right(starts, a)
            if not k or reach[k - 1] < b:  # no span that begins by a reaches b
                spans.append(("entropy", a, b))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """text with each run of overlapping spans replaced by mark."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans array<struct<kind, start, end>>, a row for each document, in one pass without a shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for block in text_blocks(batches):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(x or "")] for x in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(found, kind)], ["id", "spans"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans array<{SPAN}>").withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced in the text; a null text stays null. All columns stay as they are."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text_col):
            texts = block.column(text_col).to_pylist()
            new = pa.array([x and redacted(x, find_secrets(x), mark) for x in texts], pa.string())
            yield block.set_column(block.schema.get_field_index(text_col), text_col, new)

    return docs.mapInArrow(run, schema)
