"""Whitening against exact sums and numpy's eigenvectors."""

import math
import random
from fractions import Fraction

import numpy as np

from voxfield.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n string, whitened string, x int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", "c", 1) for i, v in rows], SCHEMA).repartition(3)


def check(spark, rows, most=16, tol=1e-8):
    """Compares with a fit in fractions; components of equal eigenvalues don't occur in the cases."""
    ok = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in ok})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    exact = [[Fraction(n * x[j] - sums[j], n) for j in range(d)] for x in fit]
    cov = np.array([[float(sum(a[i] * a[j] for a in exact) / n) for j in range(d)] for i in range(d)])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(most, int((e > e[0] * 1e-12).sum()))
    trace = float(sum(sum(a * a for a in row) for row in exact) / n)
    got = {}
    for r in whitening.whiten(frame(spark, rows), most=most).collect():
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    want = {}
    for i, x in ok:
        want.setdefault((i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))), []).append(x)
    assert got.keys() == want.keys()
    signs = {}
    for key, xs in want.items():
        assert got[key].keys() == set(range(1, k + 1))
        for c, found in got[key].items():
            assert len(found) == len(xs) and all(r["n"] == n and r["identity_error"] < 1e-6 for r in found)
            assert all(abs(r["explained"] / (e[c - 1] / trace) - 1) < 1e-9 for r in found)
            for r in found:
                w = [sum(float(Fraction(n * a - s, n)) * v[j, c - 1] for j, (a, s) in enumerate(zip(x, sums, strict=True))) / math.sqrt(e[c - 1]) for x in xs]
                near = min(w, key=lambda y: abs(abs(y) - abs(r["whitened"])))
                assert abs(abs(near) - abs(r["whitened"])) < tol
                if abs(near) > 1e-3:
                    assert signs.setdefault(c, near * r["whitened"] > 0) == (near * r["whitened"] > 0)


def test_like_fractions(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 / (1 + j)) for j in range(6)]) for i in range(120)]
    rows += [(500 + i, rows[3][1]) for i in range(30)] + [rows[0]] * 2  # copies count once in the fit
    check(spark, rows)
    check(spark, rows, most=2)


def test_graded_and_deficient(spark):
    """Variances that fall by many orders, and dimensions that are constant or repeat another."""
    rng = random.Random(4)
    rows = []
    for i in range(90):
        a, b, c = rng.gauss(0, 3000), rng.gauss(0, 40), rng.gauss(0, 0.5)
        rows.append((i, [a + b, b, c, 7.25, b]))
    check(spark, rows, tol=1e-6)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (2, [2.0, 2.5]), (3, [4.0, -1.0]), (None, [0.0, 0.0])]
    check(spark, [*good, (4, None), (5, []), (6, [nan, 1.0]), (7, [1.0, -inf]), (8, [None, 1.0])])
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance
    mixed = whitening.whiten(frame(spark, [*good, (10, [1.0]), (11, [2.0])])).collect()  # lengths are fitted apart
    assert {(r["vec_id"], r["n"]) for r in mixed} == {(1, 4), (2, 4), (3, 4), (None, 4), (10, 2), (11, 2)}


def test_wide_numbers(spark):
    """Deviations beyond 63 bits are null; large offsets that all share cost no digits."""
    far = [(i, [1e12 + i % 3, 0.25 * (i % 5)]) for i in range(15)]
    check(spark, far)
    got = whitening.whiten(frame(spark, [(1, [1e300]), (2, [-1e300]), (3, [0.0])])).collect()
    assert len(got) == 3 and all(r["deviation"] is None or r["deviation"] >= 0 for r in got) and any(r["deviation"] is None for r in got)
