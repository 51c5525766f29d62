"""Substring dedup against plain Python."""

import random

from voxfield.llm import substring

SCHEMA = "doc_id long, text string, id long, home string"


def brute(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words, strict=True):
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                least[k] = min(least.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def longest(rows, window):
    """The last of window, 2 * window, ... words at which a window of a row starts in a row of another id."""
    words, out = [(t or "").split() for _, t in rows], [0] * len(rows)
    level = window
    while True:
        who = {}
        for (d, _), w in zip(rows, words, strict=True):
            if d is not None:
                for i in range(len(w) - level + 1):
                    who.setdefault(tuple(w[i : i + level]), set()).add(d)
        who = {k for k, x in who.items() if len(x) > 1}
        if not who:
            return out
        for n, ((d, _), w) in enumerate(zip(rows, words, strict=True)):
            if d is not None and any(tuple(w[i : i + level]) in who for i in range(len(w) - level + 1)):
                out[n] = level
        level *= 2


def check(spark, rows, window=13, levels=False, **kw):
    df = spark.createDataFrame([(d, t, 5, "clash") for d, t in rows], SCHEMA).repartition(3)
    got = substring.remove_repeats(df, window=window, **kw).select("doc_id", "n_words", "n_removed", "kept_text", "longest").collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == brute(rows, window)
    if levels:
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["longest"]) for r in got) == sorted(
            (d if d is not None else -1, len((t or "").split()), x) for (d, t), x in zip(rows, longest(rows, window), strict=True)
        )


def test_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "Ünï"]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(10, 40))) for _ in range(8)]
    rows = []
    for d in range(150):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [rng.choice(passages), " ".join(rng.choices(vocabulary, k=rng.randint(0, 15)))]
        rows.append((rng.randint(0, 10**6) if d % 5 else d, "\n ".join(text)))
    rows += rows[:3]
    check(spark, rows, block_bytes=3000, levels=True)
    check(spark, rows, part_bytes=3000)
    check(spark, rows, window=4, levels=True)


def test_edges(spark):
    long = " ".join(f"x{i % 977}" for i in range(30000))
    check(spark, [(3, None), (4, ""), (None, long), (5, long), (5, long), (5, long + " y"), (1, " ".join(long.split()[:20])), (2, "a b"), (7, "same " * 50), (9, "same " * 14), (20, "same " * 900), (21, "a b " * 700), (22, "a b " * 650)])
    assert substring.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
