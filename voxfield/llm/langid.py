"""Language identification of spans: script ranges, per-word scores, and Viterbi with a switching penalty.

A word is a run of letters. The script of its first letter leaves as candidates the languages that were seen to use that
script. A word's score for a language is the sum of the log probabilities of its character bigrams and trigrams
(with word ends), hashed into BUCKETS. Viterbi finds the labels of the words of a text that have the greatest sum
of scores less SWITCH for each change of language, so single words don't flip and longer passages do.

Learning: counts by language over at most about `per_lang` labelled documents of each language, picked by a hash of
the id (the bound is a parameter of the classifier only). The model has BUCKETS + scripts numbers per language.

Nulls: null texts and texts without a letter are `und` with score 0; rows without a language teach nothing. No labelled
row at all: everything is `und`. Ties go to the smaller language code. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfield.llm.common import text_blocks

BUCKETS = 1 << 15
SWITCH = 8.0
PER_LANG = 3000
SPAN = "struct<start: int, end: int, lang: string>"
#: First code points of Unicode blocks and the script that starts there (0: other).
SCRIPTS = ("other", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "georgian", "hangul", "kana", "han")
_STARTS = [(0x41, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x780, 0), (0x900, 7), (0xE00, 8), (0xE80, 0), (0x10A0, 9), (0x1100, 10), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x3040, 11), (0x3100, 0), (0x3130, 10), (0x3190, 0), (0x3400, 12), (0xA000, 0), (0xA640, 3), (0xA6A0, 0), (0xA720, 1), (0xA800, 0), (0xAC00, 10), (0xD7B0, 0), (0xF900, 12), (0xFB00, 1), (0xFB07, 0), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFF00, 0), (0xFF21, 1), (0xFF5B, 0), (0xFF66, 11), (0xFFA0, 10), (0x10000, 0), (0x20000, 12), (0x32000, 0)]

_chars: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """Per code point: is it a letter, its lower case, its script. Made once a worker."""
    if not _chars:
        top = 0x110000
        letter, lower, script = np.zeros(top, bool), np.arange(top, dtype=np.uint32), np.zeros(top, np.uint8)
        for i in range(0x32000):  # no letters beyond
            x = chr(i)
            if x.isalpha():
                letter[i] = True
                y = x.lower()
                lower[i] = ord(y) if len(y) == 1 else i
        for (a, s), (b, _) in zip(_STARTS, [*_STARTS[1:], (0x32000, 0)], strict=True):
            script[a:b] = s
        _chars.update(letter=letter, lower=lower, script=script)
    return _chars


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts joined by line ends: code points (lower), word starts, ends, the text of each word, and texts' starts."""
    t = _tables()
    cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])
    is_letter = np.concatenate([[False], t["letter"][cp], [False]])
    edge = np.flatnonzero(is_letter[1:] != is_letter[:-1])
    starts, ends = edge[::2], edge[1::2]
    return t["lower"][cp], starts, ends, np.searchsorted(begin, starts, "right") - 1, begin


def grams(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigram around and the bigram from each letter, and where each word's letters begin in them."""
    size = ends - starts
    first = np.cumsum(size) - size
    at = np.repeat(starts - first, size) + np.arange(int(size.sum()))
    here = cp[at].astype(np.uint64)
    before, after = np.empty_like(here), np.empty_like(here)
    before[1:], after[:-1] = here[:-1], here[1:]
    before[first], after[first + size - 1] = 32, 32
    mult = np.uint64(0x9E3779B97F4A7C15)
    two = (here << np.uint64(21) | after) * mult
    three = (two ^ (before + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) * mult
    shift = np.uint64(64 - (BUCKETS.bit_length() - 2))  # each kind has half of the buckets
    return (two >> shift).astype(np.int32), (three >> shift).astype(np.int32) + BUCKETS // 2, first


class Model:
    """Log probabilities (bucket, language) and the scripts that each language uses."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        smooth = counts.astype(np.float64) + 0.5
        halves = [np.log(x / x.sum(0)) for x in (smooth[: BUCKETS // 2], smooth[BUCKETS // 2 :])]
        self.logp = (0.5 * np.concatenate(halves)).astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(0))
        allowed = share >= 0.001
        self.barred = np.where(allowed | ~allowed.any(1, keepdims=True), 0, -1e4).astype(np.float32)  # (script, language)

    def word_scores(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(words, languages)."""
        if not len(starts):
            return np.zeros((0, len(self.langs)), np.float32)
        out, bounds = [], [0]
        total = np.cumsum(ends - starts)
        while bounds[-1] < len(starts):  # so many letters at once that memory stays bounded
            done = total[bounds[-1] - 1] if bounds[-1] else 0
            bounds.append(max(bounds[-1] + 1, int(np.searchsorted(total, done + (1 << 21) // len(self.langs), "right"))))
        script = _tables()["script"]
        for a, b in zip(bounds, bounds[1:], strict=False):
            two, three, first = grams(cp, starts[a:b], ends[a:b])
            per = self.logp[two]
            per += self.logp[three]
            out.append(np.add.reduceat(per, first, axis=0) + self.barred[script[cp[starts[a:b]]]])
        return np.concatenate(out)


def viterbi(scores: np.ndarray, first: np.ndarray, size: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best labels of the words of many texts at once; text i has words first[i] to first[i]+size[i]."""
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    longest = int(size[0]) if len(size) else 0
    n_langs = scores.shape[1]
    live = np.searchsorted(-size, -np.arange(longest), "left")  # texts with more words than t
    stay, source = np.ones((len(scores), n_langs), bool), np.zeros(len(scores), np.int16)
    out = np.zeros(len(scores), np.int16)
    value = np.zeros((int(live[0]) if longest else 0, n_langs))
    for t in range(longest):
        k = int(live[t])
        v, at = value[:k], first[:k] + t
        if t:
            best = v.argmax(1)
            change = v[np.arange(k), best][:, None] - switch
            stay[at], source[at] = v >= change, best
            np.maximum(v, change, out=v)
        v += scores[at]
    label = np.zeros(len(value), np.int64)
    final = value.argmax(1) if len(value) else label
    known = 0
    for t in range(longest - 1, -1, -1):
        k = int(live[t])
        if k > known:
            label[known:k], known = final[known:k], k
        at, now = first[:k] + t, label[:k]
        out[at] = now
        if t:
            label[:k] = np.where(stay[at, now], now, source[at])
    return out


def learn(docs: DataFrame, train: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_lang: int = PER_LANG) -> Model:
    """Counts n-grams and scripts by language over the picked labelled rows; what comes to the driver is bounded by
    languages x (BUCKETS + scripts)."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    seen = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    langs = sorted(seen)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS), 0)))
    share = F.create_map(*[F.lit(y) for x in langs for y in (x, min(1.0, per_lang / seen[x]))])
    picked = rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("langid")), F.lit(1 << 24)) < share[F.col(lang_col)] * (1 << 24))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        script = _tables()["script"]
        for block in text_blocks(batches):
            texts, tags = block.column("text").to_pylist(), block.column("lang").to_pylist()
            for tag in set(tags):
                cp, starts, ends, _, _ = words_of([x for x, y in zip(texts, tags, strict=True) if y == tag])
                if not len(starts):
                    continue
                two, three, _ = grams(cp, starts, ends)
                into = held.setdefault(tag, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                into[:BUCKETS] += np.bincount(two, minlength=BUCKETS) + np.bincount(three, minlength=BUCKETS)
                into[BUCKETS:] += np.bincount(script[cp[starts]], minlength=len(SCRIPTS))
        for tag, x in held.items():
            some = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([tag] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(x[some])], ["lang", "k", "n"])

    counted = picked.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(count, "lang string, k int, n bigint")
    table = counted.groupBy("lang", "k").agg(F.sum("n").alias("n")).toArrow()
    all_counts = np.zeros((BUCKETS + len(SCRIPTS), len(langs)), np.int64)
    place = {x: i for i, x in enumerate(langs)}
    all_counts[table["k"].to_numpy(), [place[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
    return Model(langs, all_counts[:BUCKETS], all_counts[BUCKETS:])


def identify(model: Model, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, share of the letters that it has, spans) of each text."""
    if not texts or not model.langs:
        return [("und", 0.0, [])] * len(texts)
    cp, starts, ends, text, begin = words_of(texts)
    labels = np.zeros(0, np.int64)
    size = np.bincount(text, minlength=len(texts))
    if len(starts):
        labels = viterbi(model.word_scores(cp, starts, ends), np.cumsum(size) - size, size).astype(np.int64)
    n = len(model.langs)
    letters = np.bincount(text * n + labels, weights=ends - starts, minlength=len(texts) * n).reshape(len(texts), n)
    best, total = letters.argmax(1), letters.sum(1)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (labels[1:] != labels[:-1])
    a = np.flatnonzero(new)
    z = np.concatenate([a[1:], [len(text)]])[: len(a)] - 1
    spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for d, s, e, k in zip(text[a].tolist(), (starts[a] - begin[text[a]]).tolist(), (ends[z] - begin[text[a]]).tolist(), labels[a].tolist(), strict=True):
        spans[d].append((s, e, model.langs[k]))
    return [(model.langs[b], round(float(letters[i, b] / s), 6), spans[i]) if s else ("und", 0.0, []) for i, (b, s) in enumerate(zip(best.tolist(), total.tolist(), strict=True))]


def identify_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and spans array<struct<start, end, lang>> (code points), a row for each document; no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for block in text_blocks(batches, most=2 << 20):
            got = identify(model, [x or "" for x in block.column("text").to_pylist()])
            spans = pa.array([[{"start": a, "end": b, "lang": x} for a, b, x in s] for _, _, s in got], kind)
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), spans], ["id", "lang_pred", "score", "spans"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, spans array<{SPAN}>").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without those that have no language (`und`) or none with `least` of their letters. All columns stay."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text_col, most=2 << 20):
            got = identify(model, [x or "" for x in block.column(text_col).to_pylist()])
            yield block.filter(pa.array([x[0] != "und" and x[1] >= least for x in got]))

    return docs.mapInArrow(run, schema)
