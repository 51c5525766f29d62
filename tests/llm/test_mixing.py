"""Mixing against plain Python: targets by repeated resharing, keys in one sort."""

import hashlib
import math
import random
import re

import pytest

from voxfield.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, target string"


def brute(rows, cap=3):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), sum(size)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = cap * total[s]
            left -= target[s]
            open_.remove(s)
    taken = {}
    for s in sources:
        target[s] = round(target.get(s, 0.0), 6)
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest, upto = target[s] - epochs * total[s], 0
        keyed = []
        for i, (d, t, x) in enumerate(rows):
            if x == s:
                u = (int(hashlib.md5(str(d if d is not None else "").encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                good = size[i] >= 20 and 3 <= (len(t) - size[i] + 1) / size[i] <= 12
                keyed.append((-math.log(u) / (1.0 if good else 0.5), d is not None, d, size[i], i))
        for _, _, _, n, i in sorted(keyed, key=lambda x: x[:4]):
            upto += n
            extra = epochs < cap and rest > 0 and upto - n / 2 <= rest
            taken[i] = n * (epochs + extra)
    return [(r[0], size[i], total[r[2]], target[r[2]], taken[i]) for i, r in enumerate(rows)]


def key(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


def check(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, s, 7, "clash") for d, t, s in rows], SCHEMA)
    got = sorted(map(tuple, mixing.mix(df, **kw).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[4] == b[4] and a[3] == pytest.approx(b[3], abs=1e-5)
    return got


def test_mix_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["word"] * rng.randint(0, 60)) + "\t\n", rng.choice(["hot", "hot", "hot", "b", "C", None, "é"])) for i in range(400)]
    got = check(spark, rows, bin_rows=16)
    assert all(r[4] <= 3 * r[1] for r in got)
    for s in {r[2] for r in got}:
        mine = [r for r in got if r[2] == s]
        assert abs(sum(r[4] for r in mine) - mine[0][3]) <= 31


def test_mix_edges(spark):
    check(spark, [(1, None, None), (2, "", "a"), (None, "one two", "b"), (2, "", "a"), (5, "x " * 5000, "c"), (5, "x " * 5000, "c")])
    check(spark, [(1, None, "a")])
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_mixed_repeats_rows(spark):
    rows = [(i, "some words of text here", "ab"[i % 2]) for i in range(40)] + [(100, None, "a")]
    df = spark.createDataFrame([(d, t, s, 7, "clash") for d, t, s in rows], SCHEMA)
    want = {r[0]: r[4] // r[1] for r in brute(rows) if r[1]}
    got = {}
    for r in mixing.mixed(df).collect():
        assert r["target"] == "clash"
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_mixed_counts_rows_that_share_an_id(spark):
    """Repeated and null ids are taken row by row, so targets are met as by `mix`."""
    rows = [(i % 7 if i % 3 else None, " ".join(["word"] * (1 + i % 5)), "abc"[i % 11 % 3]) for i in range(300)]
    df = spark.createDataFrame([(d, t, s, 7, "clash") for d, t, s in rows], SCHEMA)
    for bins in (4096, 16):
        want, got = {}, {}
        for (d, t, s), r in zip(rows, brute(rows), strict=True):
            want[d, t, s] = want.get((d, t, s), 0) + r[4] // r[1]
        for r in mixing.mixed(df, bin_rows=bins).collect():
            got[r["doc_id"], r["text"], r["source"]] = got.get((r["doc_id"], r["text"], r["source"]), 0) + 1
        assert got == {k: n for k, n in want.items() if n}
