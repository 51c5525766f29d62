"""Toxicity: held-out accuracy, misspellings, edges."""

import random

import numpy as np

from voxfield.llm import toxicity

BAD = ["idiot", "moron", "scum", "worthless", "pathetic"]


def corpus(rng, n):
    syllables = ["an", "the", "ti", "on", "er", "wh", "sh", "ing", "ou", "nd", "ea", "re"]
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(20, 150))]
        if i % 3 == 0:
            for _ in range(max(2, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, np.array(labels)


def test_held_out_and_misspelt():
    rng = random.Random(1)
    model = toxicity.fit(*corpus(rng, 300), 0.3, rounds=4)
    texts, labels = corpus(rng, 150)
    right = (model.scores(texts) >= 0.7).astype(int) == labels
    assert right.mean() > 0.9
    clean = "the ander onti whing erea shou ndre "
    assert model.scores([clean * 3 + "you idioot"])[0] > model.scores([clean * 3 + "you onion"])[0]
    assert model.scores([clean * 40 + "pathetic moron " + clean * 40])[0] > 0.7


def test_operator_edges(spark):
    rng = random.Random(2)
    texts, labels = corpus(rng, 120)
    docs = spark.createDataFrame([(i, x, "clash", 1) for i, x in enumerate(texts)] + [(500, None, "c", 1), (501, "", "c", 1), (502, "x " * 20_000, "c", 1), (None, "idiot", "c", 1), (3, texts[3], "c", 1)], "doc_id long, text string, score string, id long").repartition(3)
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(501, None), (502, 7), (900, 1), (0, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(got) == 124 and all(0 <= x <= 1 for x in got.values()) and got[500] == got[501] < 0.7
    again = toxicity.learn(docs.repartition(2), marks.repartition(2))
    assert np.array_equal(again.part, model.part) and again.bias == model.bias
    none = toxicity.learn(docs, marks.limit(0))
    assert none.scores(["idiot", ""]).max() < 0.7
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_forward_pass_like_plain_python():
    """Words, windows, whole text and layer, n-gram by n-gram."""
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 1, toxicity.BUCKETS), 0.25, np.array([1.1, -0.4, -0.3, 0.2]))
    mult, mask, shift = 0x9E3779B97F4A7C15, (1 << 64) - 1, 64 - (toxicity.BUCKETS.bit_length() - 1)

    def word(w):
        cp = [32, *map(ord, w), 32]
        total, n = 0.0, 0
        for i in range(len(cp)):
            h = cp[i] + 1
            for k in range(1, 5):
                if i + k >= len(cp):
                    break
                h = (h * mult & mask) ^ (h >> 29) ^ (cp[i + k] + 1)
                if k >= 2:
                    total, n = total + float(model.part[(h * mult & mask) >> shift]), n + 1
        whole = sum((c + 1) * pow(mult, j + 1, 1 << 64) for j, c in enumerate(cp)) & mask
        return (total + float(model.part[((whole ^ whole >> 31) * mult & mask) >> shift])) / (n + 1)

    for text in ("You IDIOT, go away", "one", "", "a b c d e f g h i j k", "Ünï 12x  y"):
        words = [word(w) for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()]
        n = len(words)
        best = whole = sum(words) / max(1, n)
        if n > 2:
            best = np.mean(sorted((words[i] + words[i + 1]) / 2 for i in range(n - 1))[-toxicity.TOP :])
        z = 1.1 * best - 0.4 * whole - 0.3 * np.log1p(n) + 0.2
        assert abs(model.scores([text])[0] - 1 / (1 + np.exp(-z))) < 1e-4


def test_length_alone_flags_nothing():
    rng = random.Random(4)
    model = toxicity.fit(*corpus(rng, 400), 0.3)
    clean = [" ".join("".join(rng.choices(["an", "the", "ti", "on", "er", "wh", "sh"], k=rng.randint(1, 3))) for _ in range(n)) for n in (30, 100, 1000, 5000) for _ in range(10)]
    flagged = (model.scores(clean) >= 0.7).reshape(4, 10).mean(1)
    assert flagged.max() <= 0.1


def test_repeated_ids_do_not_grow_the_sample(spark):
    texts, labels = corpus(random.Random(5), 30)
    docs = spark.createDataFrame([(i % 10, x) for i, x in enumerate(texts * 20)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels[:10])], "doc_id long, toxic int")
    model = toxicity.learn(docs, marks, per_class=10, most_chars=600)
    assert 0 <= model.scores(["a"])[0] <= 1
