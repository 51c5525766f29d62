"""Runs against brute force over all stretches, and counts against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from voxfield.llm import periods

SCHEMA = "doc_id long, text string, runs string, collapsed int, n_words string"


def brute(words, least=24, ratio=3):
    """Every stretch, its smallest period by trial, kept if no neighbour extends it."""
    n, out = len(words), set()
    for q in range(1, n // ratio + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, ratio * q):
                piece = words[i : j + q]
                if not any(all(x == y for x, y in zip(piece, piece[p:], strict=False)) for p in range(1, q)):
                    out.add((i, len(piece), q))
            i = max(j, i + 1)
    return sorted(out)


def kept(words, runs):
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(6)
    out = []
    for _ in range(120):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            piece = [rng.choice("abcdefg") for _ in range(rng.randint(1, 12))]
            words += piece * rng.randint(1, 9) + piece[: rng.randint(0, len(piece))] + [rng.choice("xyz") for _ in range(rng.randint(0, 4))]
        out.append(words)
    out += [["a"] * 23, ["a"] * 24, ["a", "b"] * 12, ["a", "b"] * 12 + ["a"], ["ab", "abc"] * 40 + ["ab"], list("abcdefgh") * 3, list("abcdefgh") * 2 + list("abcdefg"), ["a"] * 700, ["q"] + ["z"] * 300 + ["q"] * 300]
    out.append([rng.choice("ab") for _ in range(900)])  # heavy words only
    out.append([rng.choice(["the", *map(str, range(300))]) if rng.random() < 0.6 else "the" for _ in range(1500)])  # heavy and light
    return out


def test_like_brute_force(spark):
    rng, many = random.Random(7), texts()
    gaps = [" ", "\n", "\t ", "\r\n", "\x0b\x0c"]
    rows = [(i, rng.choice(["", " "]) + "".join(w + rng.choice(gaps) for w in words), "c", 1, "c") for i, words in enumerate(many)]
    rows += [rows[3], (None, rows[4][1], "c", 1, "c"), (9000, None, "c", 1, "c"), (9001, "", "c", 1, "c"), (9002, " \n ", "c", 1, "c"), (9003, "é x 　y\x1cz " * 30, "c", 1, "c")]
    got = {}
    for r in periods.find_runs(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    want = {}
    for i, text, *_ in rows:
        words = (text or "").encode().split()
        words = [w.decode() for w in words]
        runs = brute(words)
        want.setdefault(i, []).append((len(words), runs, kept(words, runs)))
    assert got == want
    assert sum(len(x[0][1]) for x in want.values()) > 80


def test_counts_like_all_pairs(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(periods, "PAIRS", 50)
    many = [" ".join(w) for w in texts()]
    codes, starts = periods.word_codes(pa.array(many))
    most = np.diff(starts) // 3
    for k, counts in enumerate(periods.lag_counts(codes, starts, most)):
        x = codes[starts[k] : starts[k + 1]]
        assert counts[1:].tolist() == [int((x[q:] == x[:-q]).sum()) for q in range(1, most[k] + 1)]


def test_parameters_and_strongest(spark):
    df = spark.createDataFrame([(1, "a b a b c c c c"), (2, "x y"), (3, "a b c d a b c d e f e f")], "doc_id int, text string")
    out = periods.find_runs(df, least=4, ratio=2).withColumn("best", periods.strongest(F.col("runs")))
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["best"] and tuple(r["best"]), r["collapsed"]) for r in out.collect()}
    assert got == {1: ([(0, 4, 2), (4, 4, 1)], (4, 4, 1), "a b c"), 2: ([], None, "x y"), 3: ([(0, 8, 4), (8, 4, 2)], (0, 8, 4), "a b c d e f")}


def test_repeat_tail(spark):
    df = spark.createDataFrame([(" a b\tc d e\n", 1, 2), ("a b c", 0, 5), ("a b c", 2, 1)], "text string, a int, p int")
    assert [r[0] for r in df.select(periods.repeat_tail(F.col("text"), F.col("a"), F.col("p"))).collect()] == ["a b c b c", "a b c", "a b c"]


def test_long_and_empty(spark):
    """A long text of one line costs one scan; an empty table gives no rows."""
    line = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, " ".join([line] * 4000)), (2, "a " * 300_000)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periods.find_runs(df).collect()}
    assert got == {1: [(0, 200_000, 50)], 2: [(0, 300_000, 1)]}
    assert periods.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0
