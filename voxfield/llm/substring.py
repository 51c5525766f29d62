"""Substring dedup: removes passages of 13 words or more that a document with a smaller id has too, by level-wise doubling.

Levels: windows of 7 words first, then of 13 (two windows of 7 that share a word), then of 26, 52 and so on. At each level only
candidates are compared, and only windows that repeat go on: a window of the next length is a candidate if the two windows of this
length that make it up both start in several documents. The levels end when no candidate survives. The windows of 13 words say what is
removed; the last level that a window of a document survives is its `longest`.

Exchange at a level: documents are dealt into blocks of BLOCK bytes of text, which are stored once. A block sends each distinct hash of its
candidates once to the part of the hash, in sorted order by gaps; the part finds out which hashes several blocks, or several documents of
one, have, and what is the smallest id, and answers each block with a bit or two for each hash. So a passage that a third of all
documents share costs a few bytes for each block, parts are even, and no group is ever collected. The hash of a window twice as
long comes from the hashes of its halves, so only the first levels read the texts. Whole texts are exchanged by hash along with the
windows of 7 words: of equal texts only that of the least id is a candidate, its copies are removed whole.

Hashes: 48 bits tell windows of 7 words apart (an error only keeps a candidate), 64 bits those of 13 and more: among w such windows
a wrong match is expected w * w / 2**65 times, as among whole texts.

Memory: a block when asking; a part of about PART bytes when answering. Parts are as many as the words need.

Nulls: a null text has no words. A document with a null id neither removes nor loses words. Rows with the same id don't remove
from each other; each is judged by its own words. An id must be a number or null. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield.llm.common import _cut, _gaps, _join, _sorted, as_bytes, by_key, shuffle_width, split_keys, store, text_blocks

WINDOW = 13
BLOCK = 8 << 20
PART = 12 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
STATE, PLACES, LONGEST, COPIES = 0, 1, 2, 3


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(n, np.uint64), _MULT[None]
    for k in range(size):
        out += h[k : k + n] * factor
        factor = factor * _ODD
    return _mixed(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MULT
    return x ^ (x >> np.uint64(32))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _bits(x: np.ndarray) -> bytes:
    """Flags as bits; none for all false."""
    return np.packbits(x).tobytes() if x.any() else b""


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool) if raw else np.zeros(n, bool)


def _stored(ids: pa.Array, texts: list[bytes]) -> bytes:
    """A block: ids, which of them are null, sizes of the texts, the texts (compressed)."""
    raw = b"".join(texts)
    packed = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
    sizes = np.array([len(x) for x in texts], np.uint32)
    return _join(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), np.asarray(ids.is_null()).tobytes(), sizes.tobytes(), packed)


def _texts(block: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    ids, null, sizes, packed = _cut(block)
    ends = np.cumsum(np.concatenate([[0], np.frombuffer(sizes, np.uint32).astype(np.int64)])).tolist()
    raw = pa.decompress(packed, decompressed_size=ends[-1], codec="zstd", asbytes=True) if packed else b""
    return np.frombuffer(ids, np.int64), np.frombuffer(null, bool), [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class _Windows:
    """The distinct texts of a block with an id and `window` words or more: their words' hashes, and least and greatest ids."""

    def __init__(self, block: bytes, window: int):
        import xxhash

        ids, null, texts = _texts(block)
        place: dict[bytes, int] = {}
        of, rows = [], []
        for i in np.flatnonzero(~null).tolist():
            of.append(place.setdefault(texts[i], len(place)))
            rows.append(i)
        of, mine = np.array(of, np.int64), ids[rows] if rows else np.zeros(0, np.int64)
        self.low, self.high = np.full(len(place), np.iinfo(np.int64).max), np.full(len(place), np.iinfo(np.int64).min)
        np.minimum.at(self.low, of, mine)
        np.maximum.at(self.high, of, mine)
        words = [x.split() for x in place]
        self.size = np.array([len(x) if len(x) >= window else 0 for x in words], np.int64)
        digest = xxhash.xxh64_intdigest
        self.h = np.fromiter((digest(w) for x in words if len(x) >= window for w in x), np.uint64, int(self.size.sum()))
        self.first = np.cumsum(self.size) - self.size
        self.whole = np.array([digest(x) for x in place], np.uint64)

    def texts(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the whole texts that count, in order, and which texts they are."""
        some = np.flatnonzero(self.size)
        order = some[np.argsort(self.whole[some])]
        return self.whole[order], order

    def at(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, place in h) of all windows of `length` words."""
        n = np.maximum(0, self.size - length + 1)
        doc = np.repeat(np.arange(len(n)), n)
        return doc, self.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)


def _short(w: _Windows, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of the short windows, their 48-bit hashes' places among the sorted distinct ones, and those."""
    doc, at = w.at(half)
    keys, place = np.unique(rolled(w.h, half)[at] >> np.uint64(16), return_inverse=True) if len(at) else (np.zeros(0, np.uint64), at)
    return doc, at, place, keys


def _grouped(place: np.ndarray, n: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least of low and greatest of high for each of n groups, none of them empty."""
    order = np.argsort(place, kind="stable")
    first = _runs(place[order]) if len(place) else np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)


class _State:
    """The candidates of a level in a block: text, start and hash, by text and start; least and greatest ids of the texts."""

    def __init__(self, low: np.ndarray, high: np.ndarray, doc: np.ndarray, start: np.ndarray, h: np.ndarray):
        self.low, self.high, self.doc, self.start, self.h = low, high, doc, start, h

    def pack(self) -> bytes:
        used, doc = np.unique(self.doc, return_inverse=True)
        run = _runs(doc, self.start - np.arange(len(doc)))  # neighbouring windows
        size = np.diff(np.append(run, len(doc)))
        small = (x.astype(np.uint32).tobytes() for x in (used, doc[run], self.start[run], size))
        return _join(self.low[used].tobytes(), self.high[used].tobytes(), *small, self.h.tobytes())

    @classmethod
    def read(cls, raw: bytes) -> _State:
        low, high, name, doc, start, size, h = (np.frombuffer(x, t) for x, t in zip(_cut(raw), (np.int64, np.int64, *[np.uint32] * 4, np.uint64), strict=True))
        size = size.astype(np.int64)
        place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        out = cls(low, high, np.repeat(doc.astype(np.int64), size), np.repeat(start.astype(np.int64), size) + place, h)
        out.name = name
        return out

    def keys(self) -> tuple[np.ndarray, ...]:
        """Distinct hashes, each candidate's place among them, the least and greatest ids that have them, and whether several texts do."""
        keys, place = np.unique(self.h, return_inverse=True)
        least, most = _grouped(place, len(keys), self.doc, self.doc)
        return keys, place, *_grouped(place, len(keys), self.low[self.doc], self.high[self.doc]), least != most


def _sliced(block: int, cuts: list[np.ndarray], piece: Callable[..., bytes]) -> Iterator[pa.RecordBatch]:
    """Rows for the parts: a piece for each, of the ranges that the cuts give it, where any isn't empty."""
    out = []
    for part in range(len(cuts[0]) - 1):
        ranges = [(int(c[part]), int(c[part + 1])) for c in cuts]
        if any(b > a for a, b in ranges):
            out.append((part, piece(*ranges)))
    for k in range(0, len(out), 64):
        some = out[k : k + 64]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([x[1] for x in some], pa.binary())], ["part", "block", "data"])


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """True for each of n words that a window covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:n]) > 0


_ROW = "part int, block bigint, data binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK, part_bytes: int = PART) -> DataFrame:
    """id, n_words, n_removed, kept_text, removed array<struct<start, end>> (words) and longest, a row for each document. longest: the length of the
    last level at which a window of the document starts in a document with another id too (0: not even the first that counts)."""
    if not 2 <= window <= 200:
        raise ValueError("window must be from 2 to 200 words")
    half, width = (window + 1) // 2, shuffle_width(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, most=block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([_stored(block.column("id"), as_bytes(block.column("text")))], pa.binary())], ["data"])

    blocks = store(rows.mapInArrow(number, "data binary").withColumn("block", F.monotonically_increasing_id()), "uncompressed")
    # a hash and its gap take about 5 bytes, a word about 6
    stored = int(blocks.agg(F.sum(F.length("data"))).first()[0] or 0)
    parts, tasks = max(width, stored * 2 // part_bytes), max(width, stored // (2 * part_bytes))

    def ask_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                w = _Windows(data.as_py(), window)
                doc, _, place, keys = _short(w, half)
                low, high = _grouped(place, len(keys), w.low[doc], w.high[doc])
                several = low != high
                whole, text = w.texts()

                def piece(x: tuple[int, int], y: tuple[int, int]) -> bytes:
                    names = text[slice(*y)]  # noqa: B023
                    return _join(_gaps(keys[slice(*x)]), _bits(several[slice(*x)]), whole[slice(*y)].tobytes(), w.low[names].tobytes(), w.high[names].tobytes())  # noqa: B023

                yield from _sliced(block, [split_keys(keys, 48, parts), split_keys(whole, 64, parts)], piece)

    def answer_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in by_key(batches, "part"):
            cut = [_cut(x) for x in group["data"].to_pylist()]
            keys = [_sorted(x[0]) for x in cut]
            _, place, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            several = count > 1
            several[place[np.concatenate([_flags(x[1], len(k)) for x, k in zip(cut, keys, strict=True)])]] = True
            ends = np.cumsum([len(k) for k in keys])[:-1]
            # whole texts: least and greatest ids; a block whose own least is that stands for the text
            low, high = (np.concatenate([np.frombuffer(x[k], np.int64) for x in cut]) for k in (3, 4))
            _, of = np.unique(np.concatenate([np.frombuffer(x[2], np.uint64) for x in cut]), return_inverse=True)
            least, most = _grouped(of, int(of.max(initial=-1)) + 1, low, high)
            marks = np.cumsum([len(x[2]) // 8 for x in cut])[:-1]
            whole = zip(np.split(least[of], marks), np.split(most[of], marks), strict=True)
            replies = [_join(_bits(x), a.tobytes(), b.tobytes()) for x, (a, b) in zip(np.split(several[place], ends), whole, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(cut), pa.int32()), group["block"].combine_chunks(), pa.array(replies, pa.binary())], ["part", "block", "data"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                keys, _, low, high, two = _State.read(data).keys()

                def piece(x: tuple[int, int]) -> bytes:
                    mine = slice(*x)
                    names, place = np.unique(low[mine], return_inverse=True)  # noqa: B023
                    kind = np.uint16 if len(names) < 1 << 16 else np.uint32
                    return _join(_gaps(keys[mine]), names.tobytes(), place.astype(kind).tobytes(), _bits(low[mine] != high[mine]), _bits(two[mine]))  # noqa: B023

                yield from _sliced(block, [split_keys(keys, 64, parts)], piece)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in by_key(batches, "part"):
            cut = [_cut(x) for x in group["data"].to_pylist()]
            keys = [_sorted(x[0]) for x in cut]
            low = np.concatenate([np.frombuffer(x[1], np.int64)[np.frombuffer(x[2], np.uint16 if len(x[1]) < 1 << 19 else np.uint32)] for x in cut])
            apart, two = (np.concatenate([_flags(x[i], len(k)) for x, k in zip(cut, keys, strict=True)]) for i in (3, 4))
            every, place, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            least, most = _grouped(place, len(every), low, low)
            ids, texts = least != most, count > 1  # several ids, and several texts: a text and its copies are one
            ids[place[apart]] = True
            texts[place[two]] = True
            several = ids & texts
            ends = np.cumsum([len(k) for k in keys])[:-1]
            replies = [_join(_bits(a), _bits(b)) for a, b in zip(np.split(low > least[place], ends), np.split(several[place], ends), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(cut), pa.int32()), group["block"].combine_chunks(), pa.array(replies, pa.binary())], ["part", "block", "data"])

    def row(block: int, kind: int, level: int, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.array([level], pa.int32()), pa.array([data], pa.binary())], ["block", "kind", "level", "data"])

    def grow_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From the answers about short windows to the candidates of `window` words."""
        for block, group in by_key(batches, "block"):
            part, data = group["part"].to_pylist(), group["data"]
            w = _Windows(data[0].as_py(), window)
            _, at, place, keys = _short(w, half)
            cuts = split_keys(keys, 48, parts)
            whole, text = w.texts()
            marks = split_keys(whole, 64, parts)
            several, low, high = np.zeros(len(keys), bool), w.low.copy(), w.high.copy()
            for p, x in zip(part[1:], data[1:], strict=True):
                bits, least, most = _cut(x.as_py())
                several[cuts[p] : cuts[p + 1]] = _flags(bits, int(cuts[p + 1] - cuts[p]))
                names = text[marks[p] : marks[p + 1]]
                low[names], high[names] = np.frombuffer(least, np.int64), np.frombuffer(most, np.int64)
            copied = np.flatnonzero(high > low)
            if len(copied):
                yield row(block, COPIES, 0, _join(copied.astype(np.uint32).tobytes(), low[copied].tobytes()))
            there = np.zeros(len(w.h) + 1, bool)
            there[at] = several[place]
            stands = w.low == low
            w.low, w.high = low, high
            doc, at = w.at(window)
            keep = there[at] & there[at + window - half] & stands[doc]
            if keep.any():
                doc, at = doc[keep], at[keep]
                yield row(block, STATE, window, _State(w.low, w.high, doc, at - w.first[doc], rolled(w.h, window)[at]).pack())

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From the answers about a level's windows to its places and to the candidates of twice the length."""
        for block, group in by_key(batches, "block"):
            part, data, level = group["part"].to_pylist(), group["data"], group["level"][0].as_py()
            s = _State.read(data[0].as_py())
            keys, place, low, *_ = s.keys()
            cuts = split_keys(keys, 64, parts)
            late, several = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
            for p, x in zip(part[1:], data[1:], strict=True):
                n = int(cuts[p + 1] - cuts[p])
                late[cuts[p] : cuts[p + 1]], several[cuts[p] : cuts[p + 1]] = (_flags(y, n) for y in _cut(x.as_py()))
            if level == window:
                gone = late[place] | (s.low[s.doc] > low[place])
                if gone.any():
                    yield row(block, PLACES, level, _join(s.name[s.doc[gone]].tobytes(), s.start[gone].astype(np.uint32).tobytes()))
            several = several[place]
            if not several.any():
                continue
            yield row(block, LONGEST, level, s.name[np.unique(s.doc[several])].tobytes())
            doc, start, h = s.doc[several], s.start[several], s.h[several]
            key = doc << 32 | start
            there = np.minimum(np.searchsorted(key, key + level), len(key) - 1)
            keep = key[there] == key + level
            if keep.any():
                nxt = _State(s.low, s.high, doc[keep], start[keep], _mixed(h[keep] * _MULT + (h[there[keep]] ^ _ODD)))
                named = _join(*_renamed(nxt, s.name))
                yield row(block, STATE, 2 * level, named)

    def dealt(asked: DataFrame, reply) -> DataFrame:
        return asked.repartitionById(parts, F.col("part")).mapInArrow(reply, _ROW)

    def met(state: DataFrame, replies: DataFrame, level: int) -> DataFrame:
        both = state.select(F.lit(-1).alias("part"), "block", "data").unionByName(replies)
        return both.withColumn("level", F.lit(level)).repartition(tasks, "block").sortWithinPartitions("block", "part")

    level = window
    replies = dealt(blocks.select("block", "data").mapInArrow(ask_short, _ROW), answer_short)
    table = store(met(blocks, replies, half).mapInArrow(grow_short, "block bigint, kind int, level int, data binary"), "uncompressed")
    found = [table]
    while True:
        state = table.where(F.col("kind") == STATE).select("block", "data")
        if not state.limit(1).count():
            break
        replies = dealt(state.mapInArrow(ask, _ROW), answer)
        new = store(met(state, replies, level).mapInArrow(grow, "block bigint, kind int, level int, data binary"), "uncompressed")
        found.append(new)
        table, level = new, 2 * level

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for _, group in by_key(batches, "block"):
            ids, null, texts = _texts(group["data"][0].as_py())
            place: dict[bytes, int] = {}
            low: list[int] = []
            for i in np.flatnonzero(~null).tolist():
                k = place.setdefault(texts[i], len(place))
                if k == len(low):
                    low.append(int(ids[i]))
                low[k] = min(low[k], int(ids[i]))
            longest, starts, copied = np.zeros(len(low), np.int32), {}, {}
            for what, level, x in zip(group["kind"].to_pylist()[1:], group["level"].to_pylist()[1:], group["data"][1:], strict=True):
                if what == LONGEST:
                    some = np.frombuffer(x.as_py(), np.uint32)
                    longest[some] = np.maximum(longest[some], level)
                elif what == COPIES:
                    names, lows = (np.frombuffer(y, t) for y, t in zip(_cut(x.as_py()), (np.uint32, np.int64), strict=True))
                    copied = dict(zip(names.tolist(), lows.tolist(), strict=True))
                else:
                    doc, start = (np.frombuffer(y, np.uint32).astype(np.int64) for y in _cut(x.as_py()))
                    cuts = _runs(doc)
                    starts |= dict(zip(doc[cuts].tolist(), np.split(start, cuts[1:]), strict=True))
            for at in range(0, len(texts), 2000):
                out: list[list] = [[], [], [], [], [], []]
                for i in range(at, min(at + 2000, len(texts))):
                    words = texts[i].split()
                    k = None if null[i] else place[texts[i]]
                    gone = np.zeros(len(words), bool)
                    if k is not None and len(words) >= window:
                        if ids[i] > copied.get(k, low[k]):
                            gone[:] = True  # a copy of a smaller id's text
                        elif k in starts:
                            gone = covered(len(words), starts[k], window)
                        if k in copied:  # all of it is in another document
                            longest[k] = max(longest[k], window << (len(words) // window).bit_length() - 1)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
                    kept = b" ".join(words if not edge else [w for w, x in zip(words, gone.tolist(), strict=True) if not x])
                    values = (None if null[i] else int(ids[i]), len(words), int(gone.sum()), kept, [{"start": a, "end": b} for a, b in edge], 0 if k is None else int(longest[k]))
                    for column, v in zip(out, values, strict=True):
                        column.append(v)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), kind, pa.int32())
                arrays = [pa.array(x, t) for x, t in zip(out, types, strict=True)]
                arrays[3] = arrays[3].cast(pa.string())
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_words", "n_removed", "kept_text", "removed", "longest"])

    both = blocks.select("block", F.lit(STATE).alias("kind"), F.lit(0).alias("level"), "data")
    for x in found:
        both = both.unionByName(x.where(F.col("kind") != STATE))
    both = both.repartition(tasks, "block").sortWithinPartitions("block", "kind")
    schema = "id bigint, n_words bigint, n_removed bigint, kept_text string, removed array<struct<start: int, end: int>>, longest int"
    return both.mapInArrow(finish, schema).withColumnRenamed("id", id_col)


def _renamed(state: _State, name: np.ndarray) -> list[bytes]:
    """The packed state with the texts' first names."""
    parts = _cut(state.pack())
    parts[2] = name[np.frombuffer(parts[2], np.uint32)].tobytes()
    return parts
