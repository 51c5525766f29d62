"""SimHash fingerprints, the trie join, classes and near copies against plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voxfield.llm import simhash

SCHEMA = "doc_id long, text string, fp long, component_id string"


def brute_fp(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 3, "clash") for d, t in rows], SCHEMA).repartition(3)


def near(rng, n, budget):
    out = set()
    for _ in range(n // 8):
        x = rng.getrandbits(64)
        for _ in range(8):
            y = x
            for b in rng.sample(range(64), rng.randint(0, budget + 1)):
                y ^= 1 << b
            out.add(y)
            x = y if rng.random() < 0.3 else x
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("budget", [1, 2, 5])
@pytest.mark.parametrize("hot", [10**6, 3])
def test_links_lose_nothing(spark, budget, hot):
    fps = near(random.Random(budget), 240, budget)
    got = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), budget, hot=hot).collect()
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    want = [(i, j) for i in range(len(fps)) for j in range(i) if bin(int(fps[i]) ^ int(fps[j])).count("1") <= budget]
    assert roots(len(fps), [(place[a], place[b]) for a, b in got]) == roots(len(fps), want)


def test_trie_splits_its_frontier():
    codes = near(random.Random(9), 200, 2)
    group = np.zeros(len(codes), np.int64)
    pairs = {(min(a, b), max(a, b)) for i, j in simhash.trie_pairs(codes, group, 2, most=8) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert pairs == {(i, j) for j in range(len(codes)) for i in range(j) if bin(int(codes[i]) ^ int(codes[j])).count("1") <= 2}


def test_near_duplicates(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 12)))
    rows = [(i, text()) for i in range(120)] + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one"), (1005, "É é"), (1006, "w " * 20000), (7, "again"), (7, "again")]
    got = {(r[0], r[1]): r[2] for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    fps = [brute_fp(t) for _, t in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    least = {r: min(d for (d, _), x in zip(rows, root, strict=True) if x == r) for r in root}
    assert got == {(d, int(np.uint64(f).view(np.int64))): least[r] for (d, _), f, r in zip(rows, fps, root, strict=True)}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.near_duplicates(frame(spark, [(None, "a b")])).first()["component_id"] is None


def test_classes_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (102, 100), (60, 3)]
    got = {r["node"]: r["root"] for r in simhash.classes(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == {*range(61), 100, 101, 102} and len({got[i] for i in range(61)}) == 1 and len({got[i] for i in (100, 101, 102)}) == 1
    assert got[0] in range(61) and got[100] in (100, 101, 102)
    assert simhash.classes(spark.createDataFrame([(5, 5)], "a long, b long")).count() == 0


def test_keep_one(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(200)) for _ in range(6)]
    rows = [(10 * i + 1, b) for i, b in enumerate(base)]
    rows += [(10 * i + 5, b + " tail") for i, b in enumerate(base)]  # near copies
    rows += [(10 * i + 7, b.upper()) for i, b in enumerate(base)]  # equal words
    rows += [(100 + i, " ".join(sorted(b.split()))) for i, b in enumerate(base)]  # the same words, other shingles
    rows += [(None, base[0]), (200, None), (200, None)]
    kept = simhash.keep_one(frame(spark, rows)).select("doc_id").collect()
    assert sorted((r[0] is None, r[0] or 0) for r in kept) == sorted([(True, 0), (False, 200)] + [(False, 10 * i + 1) for i in range(6)] + [(False, 100 + i) for i in range(6)])


@pytest.mark.parametrize("most", [1 << 22, 1000, 3])
def test_copy_classes_like_brute_force(spark, monkeypatch, most):
    """Texts with few words, shared passages, and copies with changed words around an overlap of 0.8 to 0.9."""
    links = simhash.overlap_links
    monkeypatch.setattr(simhash, "overlap_links", lambda *a: links(*a, most=most))
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)]
    notice = " ".join(rng.choices(vocabulary, k=25))
    texts = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 90, 150]))]
        texts.append(" ".join(base) + (" " + notice if rng.random() < 0.4 else ""))
        for _ in range(rng.randint(0, 5)):
            w = texts[-1 if rng.random() < 0.5 else rng.randrange(len(texts))].split()
            for _ in range(max(1, len(w) // rng.choice([40, 60, 100]))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.split() for x in texts)]
    like = {(i, j): len(a & sets[j]) / len(a | sets[j]) for i, a in enumerate(sets) for j in range(i)}
    assert sum(0.8 <= x < 0.9 for x in like.values()) > 20
    root = roots(len(texts), [p for p, x in like.items() if x >= 0.8])
    got = {r["doc_id"]: r["component_id"] for r in simhash.copy_classes(frame(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_near_copies_go_through_fingerprints(spark, monkeypatch):
    """Without the prefix filter, fingerprints alone bring a copy with a changed end and its original together; what they bring together is judged by its shingles."""
    text = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, text), (2, text + " x"), (3, "w1 w2 w3")]
    bits = [brute_fp(t, 5) for _, t in rows]
    assert (bits[0] ^ bits[1]).bit_count() <= 2
    monkeypatch.setattr(simhash, "prefix_forest", lambda marked, least: marked.select(F.col("same").alias("a"), F.col("same").alias("b")).limit(0))
    assert dict(map(tuple, simhash.copy_classes(frame(spark, rows)).collect())) == {1: 1, 2: 1, 3: 3}
    monkeypatch.setattr(simhash, "fingerprint_forest", lambda texts: texts.select(F.lit(texts.first()["same"]).alias("a"), F.col("same").alias("b")))
    assert dict(map(tuple, simhash.copy_classes(frame(spark, rows)).collect())) == {1: 1, 2: 1, 3: 3}


def test_one_id_with_several_texts(spark):
    """Other texts of an id are no copies of it; equal rows are."""
    rng = random.Random(5)
    a, b, c = (" ".join(f"w{rng.randint(0, 999)}" for _ in range(90)) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (1, a + " tail"), (2, b), (3, c), (4, c + " end"), (4, a)]
    kept = sorted((r[0], r[1]) for r in simhash.keep_one(frame(spark, rows)).select("doc_id", "text").collect())
    first = [r for r in kept if r[0] == 1]
    assert [r for r in kept if r[0] != 1] == [(3, c)] and len(first) == 2 and (1, b) in first


def test_keep_one_of_nothing(spark):
    assert simhash.keep_one(frame(spark, [])).count() == 0
    assert simhash.keep_one(frame(spark, [(None, None), (None, "x")])).count() == 2
