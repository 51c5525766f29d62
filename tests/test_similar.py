"""Components, near-duplicates, density clusters and the vector index against brute force."""

import random

import numpy as np
import pytest

from voxfield.operators import near
from voxfield.operators.components import components


def roots(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(300, i) for i in range(301, 420)]
    loose = [(rng.randint(500, 900), rng.randint(500, 900)) for _ in range(220)]
    links = [*path, *star, *loose, (7, 7), (3, None)]
    df = spark.createDataFrame([*links, *path[:3]], "x int, y int")
    got = {r["node"]: r["component"] for r in components(df, "x", "y").collect()}
    want = roots(1000, [(a, b) for a, b in links if b is not None])
    assert got == {i: want[i] for a, b in links if b is not None and a != b for i in (a, b)}
    assert components(df.limit(0), "x", "y").count() == 0


def texts(rng):
    base = [" ".join(rng.choice("abcdefghijkl") + rng.choice("xyz") for _ in range(rng.randint(1, 120))) for _ in range(30)]
    out = list(base)
    for t in base[:12]:
        for _ in range(rng.randint(1, 8)):  # chains of small changes
            words = t.split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = "q" + str(rng.randint(0, 99))
            t = " ".join(words)
            out.append(t)
    return [*out, base[0].upper(), "  " + base[1] + "\n", "a b", "A  b", "a b c", "", None, " \t"]


def brute(rows, threshold=0.85):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9]
    root = roots(len(rows), links)
    return {k: (min(rows[j][0] for j in range(len(rows)) if root[j] == root[i]), root.count(root[i])) for i, (k, _) in enumerate(rows)}


@pytest.mark.parametrize("how", [{}, {"limit": 60, "members": 3}])
def test_near_duplicates_like_all_pairs(spark, how):
    """Whole buckets, and buckets that are dealt into parts."""
    rng = random.Random(2)
    rows = list(enumerate(texts(rng)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, t, "c", 1) for k, t in rows], "id long, body string, node string, key int").repartition(3)
    got = {r["id"]: (r["class_id"], r["class_size"]) for r in near.near_duplicates(df, "id", "body", **how).collect()}
    assert got == brute(rows)
    assert near.near_duplicates(df.limit(0), "id", "body").count() == 0


def test_one_template_with_many_variants(spark):
    """Links of a group of near copies are fewer than its members, and one copy stays."""
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*words[:100], f"v{k}", *words[100:]])) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, body string")
    assert [r["id"] for r in near.without_near_duplicates(df, "id", "body").collect()] == [0]
    sets = [np.array([hash(tuple(t.split()[i : i + 5])) for i in range(197)]) for _, t in rows]
    assert len(near._links(sets, 0.85)) == 599


def test_recall_of_bands(spark):
    """Pairs right at the threshold: 20 of 23 shingles in common or a little more."""
    rows = []
    for k in range(300):
        w = [f"{k}_{i}" for i in range(60)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:-4], "x", "y", "z", "u"]))]
    got = near.near_duplicates(spark.createDataFrame(rows, "id long, body string"), "id", "body")
    assert got.where("class_size = 2").count() >= 0.99 * len(rows)


def dbscan(ids, x, eps, least, min_size=1):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    n = len(x)
    root = roots(n, [(i, j) for i in range(n) for j in range(i) if core[i] and core[j] and near[i, j]])
    name = {}
    for i in range(n):
        if core[i]:
            name[root[i]] = min(name.get(root[i], ids[i]), ids[i])
    of = {}
    for i in range(n):
        if core[i]:
            of[i] = name[root[i]]
        elif (near[i] & core).any():
            of[i] = min(name[root[j]] for j in np.flatnonzero(near[i] & core))
    sizes = {c: list(of.values()).count(c) for c in of.values()}
    order = {c: k for k, c in enumerate(sorted(c for c, s in sizes.items() if s >= min_size))}
    return {ids[i]: (order.get(of.get(i), -1), bool(core[i]) and of.get(i) in order) for i in range(n)}


@pytest.mark.parametrize(("block", "dims"), [(16, 5), (8, 1)])
def test_density_like_brute_force(spark, block, dims):
    from voxfield.operators import density

    rng = np.random.default_rng(dims)
    x = np.vstack([rng.normal(c, 0.25, (70, dims)) for c in rng.uniform(-3, 3, (5, dims))] + [rng.uniform(-4, 4, (60, dims))])
    ids = rng.permutation(len(x)).tolist()
    rows = [(int(i), [float(y) for y in v], int(i) % 2, "c") for i, v in zip(ids, x, strict=True)] + [(None, [0.0] * dims, 0, "c"), (9999, [], 1, "c"), (9998, None, 1, "c")]
    df = spark.createDataFrame(rows, "id int, v array<double>, topic int, label string").repartition(3)
    got = {r["id"]: (r["topic"], r["label"], r["core"], r["strength"]) for r in density.density_clusters(df, ["topic"], "id", "v", 0.6, 5, 4, block).collect()}
    assert len(got) == len(rows) and got[None][1] == got[9999][1] == got[9998][1] == -1
    for topic in (0, 1):
        at = [k for k, i in enumerate(ids) if i % 2 == topic]
        want = dbscan([ids[k] for k in at], x[at], 0.6, 5, 4)
        assert {i: (label, core) for i, (t, label, core, _) in got.items() if t == topic and i is not None and i < 9000} == want
    assert density.density_clusters(df.limit(0), ["topic"], "id", "v", 0.6).count() == 0


def test_density_over_many_tiles(spark):
    """Tiles of four blocks, with clusters, borders and noise across them, like brute force; each block goes once to a task, however many partners it has there."""
    from voxfield.operators import density

    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.3, (90, 2)) for c in ((0, 0), (1.5, 0), (4, 4))] + [rng.uniform(-3, 6, (60, 2))])
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)], "id int, v array<double>, t int")
    got = {r["id"]: (r["label"], r["core"]) for r in density.density_clusters(df, ["t"], "id", "v", 0.4, 6, 4, 8, 4 * 8 * 2 * 8).collect()}
    assert got == dbscan(ids, x, 0.4, 6, 4)
    packed = density.blocks(df, ["t"], "id", "v", 3.0, 8)
    pairs = density.tiled(density.block_pairs(packed, 3.0), packed, 4 * 8 * 2 * 8)
    sent = density._dealt(pairs, packed, packed.select("id", "radius")).count()
    tiles, blocks = pairs.where("apart = 0").select("task").distinct().count(), packed.count()
    assert tiles > 4 and sent <= blocks * tiles < pairs.count()


def test_planted_clusters_are_found(spark):
    """Five planted groups among noise, one with half of all rows: each is one cluster by majority."""
    from voxfield.operators import density

    rng = np.random.default_rng(9)
    centres = np.linalg.qr(rng.normal(size=(32, 32)))[0][:5]
    kinds = np.repeat(np.arange(5), [600, 150, 150, 150, 150])
    x = centres[kinds] + rng.normal(0, 0.04, (len(kinds), 32))
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, kinds, strict=True))], "id int, v array<double>, kind int")
    rows = density.density_clusters(df.withColumn("t", df.id * 0), ["t"], "id", "v", 0.45, 5, 10, 64).collect()
    found = {k: {r["label"] for r in rows if kinds[r["id"]] == k} for k in range(5)}
    assert len({next(iter(s)) for s in found.values() if len(s) == 1 and -1 not in s}) == 5


def test_index_recall_and_pruning(spark, tmp_path):
    """Recall at 10 against the exact search on the test vectors and on clustered ones; only probed lists are read; added rows are found."""
    from voxfield.operators import clusters, index

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    clustered = spark.createDataFrame([(i, (centres[i % 40] + rng.normal(0, 0.3, 16)).tolist()) for i in range(2000)] + [(9999, None), (9998, [])], "vec_id long, embedding array<double>").cache()
    plain = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    for name, df, lists, probes in (("clustered", clustered, None, 4), ("plain", plain, 16, 12)):
        path = str(tmp_path / name)
        index.build(df.where("vec_id <> 7"), "vec_id", "embedding", path, lists)
        index.add(df.where("vec_id = 7"), "vec_id", "embedding", path)
        queries = [list(map(float, r["embedding"])) for r in df.where("vec_id % 101 = 7 and size(embedding) > 0").orderBy("vec_id").limit(8).collect()]
        hits = 0
        for q in queries:
            want = {r["vec_id"] for r in clusters.nearest(df.where("size(embedding) > 0"), q, 10, "vec_id", "embedding").collect()}
            hits += len(want & {r["vec_id"] for r in index.knn(spark, path, q, 10, "vec_id", "embedding", probes).collect()})
        assert hits >= 0.9 * 10 * len(queries), (name, hits)
        found = index.knn(spark, path, queries[0], 10, "vec_id", "embedding", probes)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "list#" in plan.split("PartitionFilters: [")[1].split("]")[0]
        assert found.first()["vec_id"] == 7 and found.first()["dist"] == 0.0
        assert spark.read.parquet(path + "/lists").count() == df.where("size(embedding) > 0").count()
