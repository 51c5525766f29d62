"""Language spans: learning, Viterbi against all paths, edges."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from voxfield.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string, id long"
EN = "the quick brown fox jumps over the lazy dog and runs through the forest with all its friends from there".split()
DE = "der schnelle braune fuchs springt über den faulen hund und läuft durch den wald mit allen seinen freunden".split()
RU = "быстрая коричневая лиса прыгает через ленивую собаку и бежит по лесу со всеми своими друзьями".split()


def corpus(rng, n=60):
    return [(i, " ".join(rng.choices(words, k=25)), lang, "clash", 1) for i, (words, lang) in enumerate(zip([EN, DE, RU] * n, ["en", "de", "ru"] * n, strict=True))]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    size = np.array([4, 0, 6, 1, 6])
    scores = rng.normal(0, 2, (17, 3))
    first = np.cumsum(size) - size
    got = langid.viterbi(scores, first, size, 1.5)
    for f, n in zip(first, size, strict=True):
        value = lambda p, f=f: sum(scores[f + i, k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in itertools.pairwise(p))
        if n:
            assert np.isclose(value(got[f : f + n]), max(map(value, itertools.product(range(3), repeat=n))))


def test_learns_and_splits(spark):
    rows = corpus(random.Random(2))
    mixed = " ".join(EN) + ". " + " ".join(DE)
    edges = [(1001, None, "en", "c", 1), (1002, "", None, "c", 1), (1003, " 12 %% ", "de", "c", 1), (1004, mixed, None, "c", 1), (1005, "лес", None, "c", 1), (1006, " ".join(EN) * 2000, None, "c", 1), (None, "der hund und der wald", None, "c", 1), (1004, mixed, None, "c", 1)]
    df = spark.createDataFrame(rows + edges, SCHEMA).repartition(3)
    model = langid.learn(df, F.col("doc_id") % 4 != 2)
    assert model.langs == ["de", "en", "ru"]
    got = {r["doc_id"]: r for r in langid.identify_languages(df, model).collect()}
    assert all(got[r[0]]["lang_pred"] == r[2] for r in rows if r[0] % 4 == 2)
    assert [got[i]["lang_pred"] for i in (1001, 1002, 1003)] == ["und"] * 3 and got[1001]["score"] == 0 and got[1001]["spans"] == []
    spans = [tuple(x) for x in got[1004]["spans"]]
    assert [x[2] for x in spans] == ["en", "de"] and abs(spans[0][1] - len(" ".join(EN))) <= 8 and spans[0][0] == 0 and spans[-1][1] == len(mixed)
    assert got[1005]["lang_pred"] == "ru" and got[1006]["lang_pred"] == "en" and got[None]["lang_pred"] == "de"
    kept = {r["doc_id"] for r in langid.keep_identified(df, model).collect()}
    assert kept == {r[0] for r in rows} | {1004, 1005, 1006, None}


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "words", None, "c", 1)], SCHEMA)
    out = langid.identify_languages(df, langid.learn(df, F.lit(True))).first()
    assert out["lang_pred"] == "und" and out["score"] == 0
    assert langid.identify_languages(df.limit(0), langid.learn(df, F.lit(True))).count() == 0
