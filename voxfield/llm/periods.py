"""Periodic runs of words: counts of matches by lag, then scans for islands at the lags that have enough.

A run is a stretch of words whose smallest period is q (words q apart are equal), of max(least, ratio * q) words at least, that no neighbouring word extends.
Such a run has max(least - q, (ratio - 1) * q) matches in a row at lag q, so a lag with fewer in the whole text has none.

Counts are exact. Words that are frequent in a text (heavy: over sqrt(2 n log2 n) times among n words) are counted by autocorrelation: the power spectra of their
places are summed and turned back by one FFT, whose values are whole numbers again after rounding. Rare (light) words are counted by the differences of all
pairs of their places up to the largest lag, for all texts of a block at once. Lags with enough matches are scanned in rising order; what runs found so far
match at multiples of their period is known and taken off a lag's count first, so a text of one repeated line costs one scan, not one for each multiple.
A stretch found at a multiple of a run's period is that run and counts once, at its smallest period.

Work is about n^1.5 for a text of n words. Memory is one block of texts (BLOCK bytes, or one longer text) and pairs of its words, PAIRS at a time.

A null text has no words; texts with fewer than `least` words have no runs. Repeated rows are judged one by one. Ids of any type, null ones too, go along. Other columns
are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfield.llm.common import as_bytes, map_batches, text_blocks

WORDS = r"[^\x20\x09-\x0D]+"
BLOCK = 2 << 20
PAIRS = 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, equal ones equal, and where each text's begin (one more at the end)."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.binary()).cast(pa.string()), ""))
    flat, ends = words.flatten(), words.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # leading and trailing white space leave empty ones
    before = np.concatenate([[0], np.cumsum(real)])
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)[real]
    return codes.astype(np.int64), before[ends]


def lag_counts(codes: np.ndarray, starts: np.ndarray, most: np.ndarray) -> list[np.ndarray]:
    """For each text the number of places i with word i = word i + q, for q from 0 to `most` (lags that aren't wanted are not counted: most is 0 for such texts)."""
    lengths = np.diff(starts)
    base = np.concatenate([[0], np.cumsum(most + 1)])
    counts = np.zeros(base[-1], np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    use = np.flatnonzero(most[doc] > 0)
    if len(use):
        doc, word, place = doc[use], codes[use], use - starts[doc[use]]
        order = np.lexsort((place, word, doc))
        doc, word, place = doc[order], word[order], place[order]
        new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])]))
        sizes = np.diff(np.append(new, len(word)))
        n = lengths[doc[new]].astype(float)
        heavy = sizes > np.sqrt(2 * n * np.log2(np.maximum(n, 2)))
        for d in np.unique(doc[new[heavy]]):
            whole = 1 << int(lengths[d] + most[d]).bit_length()
            power = np.zeros(whole // 2 + 1)
            for at, size in zip(new[heavy & (doc[new] == d)], sizes[heavy & (doc[new] == d)], strict=True):
                there = np.zeros(whole)
                there[place[at : at + size]] = 1
                f = np.fft.rfft(there)
                power += f.real**2 + f.imag**2
            counts[base[d] : base[d + 1]] += np.rint(np.fft.irfft(power, whole)[: most[d] + 1]).astype(np.int64)
        last = np.repeat(new + sizes, sizes)  # where each place's word ends
        alive, step, held, many = np.flatnonzero(~np.repeat(heavy, sizes)), 0, [], 0
        limit, slot = most[doc], base[doc]
        while len(alive):  # the pairs of each place with the step-th next one of its word
            step += 1
            alive = alive[alive + step < last[alive]]
            lag = place[alive + step] - place[alive]
            near = lag <= limit[alive]
            alive, lag = alive[near], lag[near]
            held.append(slot[alive] + lag)
            many += len(alive)
            if many >= PAIRS or not len(alive):
                np.add.at(counts, np.concatenate(held), 1)
                held, many = [], 0
    return [counts[a:b] for a, b in zip(base, base[1:], strict=False)]


def islands(codes: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches with this period that hold `least` matches in a row or more."""
    other = np.flatnonzero(codes[lag:] != codes[:-lag])
    edges = np.concatenate([[-1], other, [len(codes) - lag]])
    wide = np.flatnonzero(np.diff(edges) > least)
    return [(int(edges[k]) + 1, int(edges[k + 1]) + lag) for k in wide]


def runs_of(codes: np.ndarray, counts: np.ndarray, least: int, ratio: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and then period. counts: of lags 0 and up."""
    lags = np.arange(len(counts))
    need = np.maximum(least - lags, (ratio - 1) * lags)
    found: dict[tuple[int, int], int] = {}
    known = np.zeros(len(counts), np.int64)  # matches of runs at multiples of their periods
    for lag in np.flatnonzero((counts >= need) & (lags > 0)).tolist():
        if counts[lag] - known[lag] < need[lag]:
            continue
        for a, b in islands(codes, lag, int(need[lag])):
            if (a, b) not in found:
                found[a, b] = lag
                multiples = np.arange(2 * lag, min(len(counts), b - a), lag)
                known[multiples] += b - a - multiples
    return sorted((a, b - a, q) for (a, b), q in found.items())


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for words that some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def find_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 24, ratio: int = 3) -> DataFrame:
    """The id, n_words, runs (start, length, period; by start, then period) and collapsed: the words, joined by spaces, without those that repeat a run's first period."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text", BLOCK):
            codes, starts = word_codes(block.column("text"))
            lengths = np.diff(starts)
            counts = lag_counts(codes, starts, np.where(lengths >= least, lengths // ratio, 0))
            runs, texts = [], []
            for k, raw in enumerate(as_bytes(block.column("text"))):
                found = runs_of(codes[starts[k] : starts[k + 1]], counts[k], least, ratio) if lengths[k] >= least else []
                words = raw.split()
                if found:
                    words = [words[i] for i in np.flatnonzero(~dropped(len(words), found)).tolist()]
                runs.append([{"start": a, "length": b, "period": q} for a, b, q in found])
                texts.append(b" ".join(words))
            shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(lengths, pa.int64()), pa.array(runs, shape), pa.array(texts, pa.binary()).cast(pa.string())], names=[block.schema.names[0], "n_words", "runs", "collapsed"])

    return map_batches(docs.select(id_col, F.col(text).alias("text")), run, f"`{id_col}` {kind}, n_words bigint, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first. Null if there is none."""

    def better(best: Column, x: Column) -> Column:
        return F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)


def repeat_tail(text: Column, start: Column, period: Column) -> Column:
    """The words of a text joined by spaces, where from word `start` on the `period` words there come again and again up to the text's length."""
    words = F.regexp_extract_all(text, F.lit(f"({WORDS})"), F.lit(1))
    n, start, period = F.size(words), start.cast("int"), period.cast("int")
    times = F.ceil((n - start) / period).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, start + 1, period), times))
    return F.array_join(F.slice(F.concat(F.slice(words, 1, start), tail), 1, n), " ")
