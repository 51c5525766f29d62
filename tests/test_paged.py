"""The paged source asks for no more pages than a query needs."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from voxfield.sources.paged import Fixtures, PagedPosts


class Counting(Fixtures):
    """Writes down each page it is asked for."""

    def fetch(self, topic, page):
        with open(os.path.join(self.folder, "asked"), "a") as f:
            f.write(f"{topic}/{page}\n")
        return super().fetch(topic, page)


def asked(folder):
    path = os.path.join(folder, "asked")
    lines = sorted(open(path).read().split()) if os.path.exists(path) else []
    if lines:
        os.remove(path)
    return lines


@pytest.fixture
def source(spark, tmp_path):
    spark.dataSource.register(PagedPosts)
    start, client = dt.datetime(2026, 1, 10), Fixtures(str(tmp_path))
    for page in range(1, 6):  # ten posts a page, an hour apart, the newest first
        client.save("tea", page, [{"id": f"p{page}-{i}", "title": "t", "body": None, "posted_at": (start - dt.timedelta(hours=10 * (page - 1) + i)).isoformat() + "Z"} for i in range(10)])
    client.save("milk", 1, [{"id": "m", "posted_at": "2026-01-01T00:00:00Z"}])
    (tmp_path / "tea" / "page-9.json").write_text("[]")  # no sidecar
    yield lambda **o: spark.read.format("paged_posts").options(client="tests.test_paged:Counting", client_arg=str(tmp_path), **o).load(), str(tmp_path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_options(spark, source):
    load, folder = source
    assert load(topic="tea").count() == 50 and asked(folder) == [f"tea/{k}" for k in range(1, 6)]
    assert load(topic="tea", limit="25").count() == 25 and asked(folder) == ["tea/1", "tea/2", "tea/3"]
    newest = load(topic="tea", since="2026-01-09T10:00:00Z")  # 14 hours back and the bound itself
    assert newest.count() == 15 and asked(folder) == ["tea/1", "tea/2"]
    assert load(topic="none").count() == 0 and load(topic="tea", since="2027-01-01T00:00:00Z").count() == 0 and asked(folder) == []


def test_filters(spark, source):
    load, folder = source
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    late = F.lit(dt.datetime(2026, 1, 9, 15, tzinfo=dt.timezone.utc))
    rows = load(pushdown="true").where((F.col("topic") == "tea") & (F.col("posted_at") >= late)).collect()
    assert len(rows) == 10 and {r["page"] for r in rows} == {1} and asked(folder) == ["tea/1"]
    assert [r["id"] for r in load(pushdown="true").where("topic = 'milk'").collect()] == ["m"] and asked(folder) == ["milk/1"]
