"""WARC archives as seekable Zstandard bundles: records in independent frames, a seek table at the end, and an index from record ids to offsets within frames.

Writing. Payloads are hashed; of equal payloads of `least` bytes or more the one with the smallest id is written as a `response`, the others as `revisit`
records that refer to it and hold no payload; shorter ones are all responses. Which payloads repeat is decided by an aggregate over hashes alone; its result,
one row for each repeated payload, is stored and joined back, the hashes of many rows by broadcast (`join_hot`), so a payload that a third of the pages share
is no hot key. Each task then packs its records into frames of about `frame` bytes (a larger record is a frame of its own), compresses each on its own
and closes a bundle at about `bundle` compressed bytes with the seek table, a skippable frame as the public seekable format defines it. A bundle is one row
of the result: `data` is the whole file, `records` its index (id, frame, offset in the frame, length); the index is read without the data. Bundles are written
as a table by Spark's committer, so a task that is run again leaves no second copy, and any file system that Spark writes to will do; `export` writes the files.

Reading. `read_all` decodes frame by frame through the seek tables, checks each frame's checksum and parses the records; `fetch` looks record ids up
in the index and decodes only the frames that hold them.

A revisit's block is its HTTP head, whose Content-Length is the full payload's. Rows that share the smallest id of equal payloads are all responses. A null
id comes after all others. A record id is `<urn:page:ID>`, `<urn:page>` for a null id; rows with one id share it, and `fetch` returns them all. A null payload
is empty; a null or empty address is left out; white space and control characters in an address are percent-encoded. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield.llm.common import join_hot, map_batches, store

#: Fixed values of the seekable format and of WARC.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME = 1 << 20
BUNDLE = 8 << 20
DATE = "1970-01-01T00:00:00Z"
RECORD = "struct<record_id: string, frame: int, offset: bigint, length: bigint>"
READ = "record_id string, record_type string, refers_to string, url string, payload binary, payload_bytes bigint, payload_digest string"


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """The closing skippable frame of frames (compressed bytes, plain bytes, checksum)."""
    body = b"".join(struct.pack("<III", *f) for f in frames) + struct.pack("<IBI", len(frames), CHECKSUMS, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int, int | None]]:
    """(start, compressed bytes, plain bytes, checksum or None) of each frame."""
    if len(data) < 17:
        raise ValueError("too short for a seek table")
    n, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    wide = 12 if flags & CHECKSUMS else 8
    at = len(data) - 9 - n * wide
    if magic != SEEKABLE or at < 8 or struct.unpack_from("<II", data, at - 8) != (SKIPPABLE, n * wide + 9):
        raise ValueError("no seek table at the end")
    out, start = [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", data, at + k * wide)
        out.append((start, packed, plain, struct.unpack_from("<I", data, at + k * wide + 8)[0] if wide == 12 else None))
        start += packed
    if start != at - 8:
        raise ValueError("the seek table doesn't match the frames")
    return out


def read_frame(data: bytes, frame: tuple[int, int, int, int | None]) -> bytes:
    import zstandard

    start, packed, plain, check = frame
    out = zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=plain)
    if len(out) != plain or check not in (None, xxhash.xxh64_intdigest(out) & 0xFFFFFFFF):
        raise ValueError("a frame's length or checksum is wrong")
    return out


class Bundle:
    """Collects records into frames, and frames into one file with an index."""

    def __init__(self, name: str, frame: int, date: str):
        import zstandard

        self.name, self.most, self.packer = name, frame, zstandard.ZstdCompressor(level=3)
        self.data, self.frames, self.index, self.open = bytearray(), [], [], bytearray()
        info = b"software: voxfield\r\nformat: WARC File Format 1.1\r\n"
        self._put(f"urn:bundle:{name}", _record("warcinfo", f"urn:bundle:{name}", date, [("Content-Type", "application/warc-fields"), ("WARC-Filename", f"{name}.warc.zst")], info), listed=False)

    def _put(self, record_id: str, record: bytes, listed: bool = True) -> None:
        if self.open and len(self.open) + len(record) > self.most:
            self._close_frame()
        if listed:
            self.index.append({"record_id": record_id, "frame": len(self.frames), "offset": len(self.open), "length": len(record)})
        self.open += record
        if len(self.open) >= self.most:
            self._close_frame()

    def put(self, record_id: str, record: bytes) -> None:
        self._put(record_id, record)

    def _close_frame(self) -> None:
        packed = self.packer.compress(bytes(self.open))
        self.frames.append((len(packed), len(self.open), xxhash.xxh64_intdigest(bytes(self.open)) & 0xFFFFFFFF))
        self.data += packed
        self.open = bytearray()

    def closed(self) -> bytes:
        if self.open:
            self._close_frame()
        return bytes(self.data) + seek_table(self.frames)


def _record(kind: str, record_id: str, date: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def record_urn(page: object) -> str:
    return "urn:page" if page is None else f"urn:page:{quote(str(page), safe='')}"


def page_record(page: object, url: str | None, payload: bytes, digest: str, first: object, revisit: bool, date: str) -> bytes:
    """A response, or a revisit of the page `first`."""
    fields = [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url:
        fields.insert(0, ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_urn(first)}>")]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record("revisit" if revisit else "response", record_urn(page), date, fields, head if revisit else head + payload)


def roles(pages: DataFrame, id_col: str, payload: str, least: int) -> DataFrame:
    """pages with `digest`, and `first`: the id whose payload a row repeats, in a struct, null for responses."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    hashed = pages.withColumn("digest", F.sha2(body, 256)).withColumn("bytes", F.length(body))
    keyed = hashed.where(F.col("bytes") >= least).groupBy("digest").agg(F.min(id_col).alias("first"), F.count("*").alias("copies"))
    again = store(keyed.where("copies > 1").select(F.col("digest").alias("d"), "first", "copies"))
    total = again.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    joined = join_hot(hashed, again, "digest", "d", "copies", total)
    later = F.col("d").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("first"))
    return joined.select(id_col, "url", payload, "digest", F.when(later, F.struct("first")).alias("first"))


def write_bundles(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, frame: int = FRAME, bundle: int = BUNDLE, date: str = DATE) -> DataFrame:
    """bundle string, data binary and records array<struct<record_id, frame, offset, length>>, stored in the shared folder."""
    dealt = roles(pages.select(F.col(id_col).alias("page"), F.col(url).alias("url"), F.col(payload).alias("payload")), "page", "payload", least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, task = 0, TaskContext.get().partitionId()

        def full(b: Bundle) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"bundle": b.name, "data": b.closed(), "records": b.index}], schema)

        b = None
        for batch in batches:
            for i in range(batch.num_rows):
                page, address, text, digest, first = (batch.column(c)[i].as_py() for c in ("page", "url", "payload", "digest", "first"))
                b = b or Bundle(f"{task:06d}-{made:05d}", frame, date)
                b.put(record_urn(page), page_record(page, address, (text or "").encode(), digest, first and first["first"], first is not None, date))
                if len(b.data) >= bundle:
                    yield full(b)
                    b, made = None, made + 1
        if b:
            yield full(b)

    schema = pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("records", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))])
    return store(map_batches(dealt, run, f"bundle string, data binary, records array<{RECORD}>"), "none")


def parse_record(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The named fields (lower-case names), the block, and where the record ends."""
    end = raw.index(b"\r\n\r\n", at)
    first, *lines = raw[at:end].decode("utf-8").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("no WARC record here")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    start = end + 4
    stop = start + int(fields["content-length"])
    if raw[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    return fields, raw[start:stop], stop + 4


def _parsed(fields: dict[str, str], block: bytes) -> dict | None:
    """A row of READ; None for records other than responses and revisits. A response whose payload doesn't match its digest is an error."""
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
    digest = fields["warc-payload-digest"].partition(":")[2]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload doesn't match its digest")
    return {
        "record_id": fields["warc-record-id"].strip("<>"), "record_type": kind, "refers_to": fields.get("warc-refers-to", "").strip("<>") or None, "url": fields.get("warc-target-uri"),
        "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": digest,
    }


_ROWS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def read_all(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """A row of READ for each page record of the bundles' data. payloads=False decodes and checks the payloads but doesn't return them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("data"):
                data = cell.as_py()
                for frame in read_seek_table(data):
                    raw, at, rows = read_frame(data, frame), 0, []
                    while at < len(raw):
                        fields, block, at = parse_record(raw, at)
                        row = _parsed(fields, block)
                        if row:
                            rows.append(row if payloads else row | {"payload": None})
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _ROWS)

    return map_batches(bundles.select("data"), run, READ)


def index(bundles: DataFrame) -> DataFrame:
    """record_id, bundle, frame, offset and length of each record; reads no data."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("r.record_id", "bundle", "r.frame", "r.offset", "r.length")


def fetch(bundles: DataFrame, record_ids: DataFrame) -> DataFrame:
    """A row of READ for each record whose id is in record_ids (record_id): only the bundles that hold one are read, and of those only such frames decoded.
    The join's rows are places in bundles, 8 bytes and a few; the data of a bundle comes once."""
    wanted = index(bundles).join(record_ids.select("record_id").distinct(), "record_id", "left_semi")
    places = wanted.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset", "length")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, found in zip(batch.column("data"), batch.column("places"), strict=True):
                data, rows, here, raw = cell.as_py(), [], None, b""
                table = read_seek_table(data)
                for p in sorted(found.as_py(), key=lambda p: (p["frame"], p["offset"])):
                    if p["frame"] != here:
                        here, raw = p["frame"], read_frame(data, table[p["frame"]])
                    fields, block, _ = parse_record(raw[p["offset"] : p["offset"] + p["length"]])
                    rows.append(_parsed(fields, block))
                yield pa.RecordBatch.from_pylist(rows, _ROWS)

    return map_batches(bundles.select("bundle", "data").join(places, "bundle").select("data", "places"), run, READ)


def page_of(urn):
    """The page id in a record id (column), as text; null for the record of a null id."""
    return F.url_decode(F.substring_index(F.when(urn.contains("urn:page:"), urn), ":", -1))


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle as folder/<bundle>.warc.zst and returns (bundle, path, bytes). The folder must be mounted on all machines. A file gets its name when
    it is whole, so a task that runs again replaces it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        for batch in batches:
            for name, cell in zip(batch.column("bundle").to_pylist(), batch.column("data"), strict=True):
                path, data = f"{folder}/{name}.warc.zst", cell.as_py()
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, path)
                yield pa.RecordBatch.from_pylist([{"bundle": name, "path": path, "bytes": len(data)}])

    return map_batches(bundles.select("bundle", "data"), run, "bundle string, path string, bytes bigint")

