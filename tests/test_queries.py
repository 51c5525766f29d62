"""Every query with SQL gives what DuckDB gives; every query keeps its schema and reruns alike."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def own():
    from voxfield.plans import registry

    return registry


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return float(x) if type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(own().ORACLES))
def test_like_sql(spark, duck, name):
    df = own().QUERIES[name](spark, SF)
    relation = duck.sql(own().ORACLES[name])
    assert sorted(df.columns) == sorted(relation.columns)
    place = [list(relation.columns).index(c) for c in df.columns]
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[i]) for i in place) for r in relation.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(own().QUERIES) - set(own().ORACLES)))
def test_reruns_alike(spark, name):
    a, b = (own().QUERIES[name](spark, SF) for _ in range(2))
    assert a.dtypes == b.dtypes and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) != []


def test_entry_without_optional_parts(spark):
    import __spark_entry__

    assert set(own().QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
