"""Bundles against plain Python: whole files through a stream reader, seeking by index, roles of equal payloads."""

import hashlib
import io
import random
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from voxfield.llm import warc

SCHEMA = "page_id long, url string, html string, first string, digest string, copies int, d int, data string, bundle string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "c", "c", 1, 2, "c", "c") for i, u, h in rows], SCHEMA).repartition(3)


def pages():
    rng = random.Random(5)
    long = "".join(chr(rng.choice([97, 98, 233, 0x4E00, 10, 13])) for _ in range(9000))
    twice, thrice = "x" * 100, "é" * 60
    rows = [(i, f"http://a.example/{i}", f"<p>{i}</p>" * (i % 40)) for i in range(200)]
    rows += [(300, None, twice), (299, "", twice), (301, "http://b\r\nWARC-Type: x", twice), (302, "u", thrice), (400, "u", thrice), (500, "u", long), (499, "u", long)]
    rows += [(600, "u", "short"), (601, "u", "short"), (602, "u", None), (603, "u", ""), (None, "u", twice), (None, "u", "n" * 200), (700, "t", "tie" * 50), (700, "t", "tie" * 50), (701, "t", "tie" * 50)]
    return rows + [(1000 + i, "hot", "hot" * 50) for i in range(300)]


def wanted(rows):
    least = {}
    for i, _, h in rows:
        b = (h or "").encode()
        least[b] = min(least.get(b, float("inf")), float("inf") if i is None else i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = None if least[b] == float("inf") else least[b]
        again = len(b) >= 100 and i != first
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def got(records):
    return sorted(((None if (p := r["page"]) is None else int(p), r["payload_bytes"], r["payload_digest"], r["record_type"], None if r["to"] is None else int(r["to"])) for r in records), key=str)


def with_pages(df):
    return df.withColumn("page", warc.page_of(F.col("record_id"))).withColumn("to", warc.page_of(F.col("refers_to")))


def test_write_and_read(spark, tmp_path):
    rows = pages()
    bundles = warc.write_bundles(frame(spark, rows), frame=3000, bundle=4000)
    records = with_pages(warc.read_all(bundles)).collect()
    assert got(records) == wanted(rows)
    by_id = {i: h for i, _, h in rows}
    for r in records:
        if r["record_type"] == "response" and r["page"] is not None:
            assert bytes(r["payload"]) == (by_id[int(r["page"])] or "").encode()
        else:
            assert r["record_type"] == "response" or r["payload"] is None
    assert {r["url"] for r in records if r["page"] in ("299", "300")} == {None} and [r["url"] for r in records if r["page"] == "301"] == ["http://b%0D%0AWARC-Type:%20x"]

    # whole files through a plain stream reader, which passes over the seek table; every frame stands alone
    for f in warc.export(bundles, str(tmp_path)).collect():
        data = open(f["path"], "rb").read()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        frames = warc.read_seek_table(data)
        assert len(data) == f["bytes"] and b"".join(warc.read_frame(data, x) for x in frames) == whole
        at, seen = 0, 0
        while at < len(whole):
            fields, _, at = warc.parse_record(whole, at)
            seen += 1
        assert fields["warc-record-id"] and seen >= 2 and struct.unpack("<I", data[-4:])[0] == 0x8F92EAB1
    assert len({r["bundle"] for r in bundles.select("bundle").collect()}) == bundles.count() > 3

    ids = spark.createDataFrame([("urn:page:500",), ("urn:page:499",), ("urn:page:7",), ("urn:page:700",), ("urn:page:none",), ("urn:page:7",)], "record_id string")
    found = warc.fetch(bundles, ids).collect()
    assert sorted(r["record_id"] for r in found) == ["urn:page:499", "urn:page:500", "urn:page:7", "urn:page:700", "urn:page:700"]
    assert [bytes(r["payload"]).decode() for r in found if r["record_id"] == "urn:page:7"] == ["<p>7</p>" * 7]
    assert warc.index(bundles).count() == len(rows)


def test_damage_is_noticed(spark):
    data = bytearray(warc.write_bundles(frame(spark, [(1, "u", "abc" * 100)])).first()["data"])
    spoiled = bytes(data[:-20]) + bytes([data[-20] ^ 1]) + bytes(data[-19:])  # in the seek table
    with pytest.raises(ValueError):
        [warc.read_frame(spoiled, f) for f in warc.read_seek_table(spoiled)]
    with pytest.raises(ValueError):
        warc.read_seek_table(b"no table here, but long enough")


def test_empty(spark):
    bundles = warc.write_bundles(frame(spark, []))
    assert bundles.count() == 0 and warc.read_all(bundles).count() == 0
