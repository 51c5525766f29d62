"""Byte-level BPE encoding and decoding over length-bucketed padded matrices.

Texts are cut by the tokenizer's pattern; the distinct pieces of a block that are not yet known go into matrices of
token ids, one row per piece, one matrix per length bucket. In each round every row merges its leftmost pair of least
rank: pair ranks come from a hash table in numpy, and the row is compacted by one column. Rows leave the matrix when no
pair can merge. Pieces beyond LONG bytes, of which a matrix would need as many rounds as bytes, each over all of them, are merged by the same
rule with a heap, so that one long run of letters costs n log n.

Nulls: a null text is an empty one (no ids). Repeated rows give repeated results; row order and partitioning do not
matter. Other columns of the input are not carried, so their names cannot clash.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield.llm.common import as_bytes, lists, text_blocks

LONG = 4096
CACHED = 24 << 20  # bytes of pieces and ids that a worker remembers before it starts again
_MULT = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open addressing from a pair of token ids to the id of their concatenation, -1 where there is none."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(10, (4 * max(1, len(pairs)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.probes = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32), 1
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        slots = self._slots(keys)
        while len(keys):  # each round fills the free slots, the rest moves one slot on
            free = self.keys[slots] == -1
            _, first = np.unique(np.where(free, slots, -1), return_index=True)
            first = first[free[first]]
            self.keys[slots[first]], self.values[slots[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, slots = keys[left], values[left], (slots[left] + 1) & self.mask
            self.probes += bool(len(keys))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MULT) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = left.shape
        keys = ((left.astype(np.int64) << 32) | right.astype(np.int64)).ravel()
        slots = self._slots(keys)
        out = np.where(self.keys[slots] == keys, self.values[slots], -1)
        rest = np.flatnonzero((out < 0) & (self.keys[slots] != -1))
        for _ in range(self.probes):
            if not len(rest):
                break
            slots[rest] = (slots[rest] + 1) & self.mask
            found = self.keys[slots[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[slots[rest[hit]]]
            rest = rest[~hit & (found != -1)]
        return out.reshape(shape)


class ByteBPE:
    """A byte-level BPE tokenizer from ranks (bytes -> id, the id being the merge rank) and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        # \s is White_Space, as in the tiktoken library; the regex module would add four control characters
        self.ranks, self.find = ranks, regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.token = [b""] * (max(ranks.values()) + 1)
        for x, i in ranks.items():
            self.token[i] = x
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        joins = ((ranks[x[:k]], ranks[x[k:]], i) for x, i in ranks.items() for k in range(1, len(x)) if x[:k] in ranks and x[k:] in ranks)
        self.joins = {(a, b): i for a, b, i in joins}
        self.pairs = PairTable(self.joins)
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0

    @classmethod
    def parse(cls, lines: bytes, pattern: str) -> ByteBPE:
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}, pattern)

    def merge_rows(self, ids: np.ndarray) -> list[tuple[int, ...]]:
        """ids: one piece a row, padded with -1. Merges every row to its end."""
        out: list[tuple[int, ...]] = [()] * len(ids)
        rows, size = np.arange(len(ids)), (ids >= 0).sum(1)
        none = np.int32(2**31 - 1)
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:])
        rank[(ids[:, 1:] < 0) | (rank < 0)] = none
        while True:
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(ids), np.int64)
            best = rank[np.arange(len(ids)), at] if rank.shape[1] else np.full(len(ids), none)
            over = best == none
            if over.any():
                for r, row, n in zip(rows[over].tolist(), ids[over].tolist(), size[over].tolist(), strict=True):
                    out[r] = tuple(row[:n])
                live = ~over
                ids, rank, rows, size, at, best = ids[live], rank[live], rows[live], size[live], at[live], best[live]
            if not len(ids):
                return out
            n, wide = np.arange(len(ids)), ids.shape[1]
            column = np.arange(wide - 1)
            ids[n, at] = best
            ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)  # compaction: the merged column goes
            rank = np.take_along_axis(rank, column[:-1] + (column[:-1] > at[:, None]), 1)
            size = size - 1
            inner = at < rank.shape[1]
            rank[n[inner], at[inner]] = none
            for c, there in ((at - 1, at > 0), (at, at < size - 1)):
                k, c = n[there], c[there]
                if len(k):
                    new = self.pairs.get(ids[k, c], ids[k, c + 1])
                    rank[k, c] = np.where(new < 0, none, new)

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same rule for one long piece: a heap of (rank, position) over a linked list."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.joins.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or self.joins.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (new := self.joins.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (new, a))
        return tuple(x for x in ids if x >= 0)

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of these pieces into `known`."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            self.held += 160 + 6 * len(raw)  # the text, its ids and the entry
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[piece] = (whole,)
            elif len(raw) > LONG:
                self.known[piece] = self.merge_long(raw)
            else:
                wide = len(raw) if len(raw) <= 16 else 1 << (len(raw) - 1).bit_length()
                buckets.setdefault(wide, []).append((piece, raw))
        for wide, rows in buckets.items():
            step = max(1, (1 << 19) // wide)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                raw = np.frombuffer(b"".join(x.ljust(wide, b"\0") for _, x in part), np.uint8).reshape(len(part), wide)
                size = np.array([len(x) for _, x in part])
                ids = np.where(np.arange(wide) < size[:, None], self.byte[raw], -1).astype(np.int32)
                self.known.update(zip((x for x, _ in part), self.merge_rows(ids), strict=True))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        cut = [self.find(x) for x in texts]
        if self.held > CACHED:
            self.known, self.held = {}, 0
        self.learn(set(chain.from_iterable(cut)) - self.known.keys())
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, x))) for x in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_loaded: dict[tuple[bytes, str], ByteBPE] = {}


def _tokenizer(packed: bytes, pattern: str) -> ByteBPE:
    """One tokenizer a worker."""
    if (packed, pattern) not in _loaded:
        _loaded.clear()
        _loaded[packed, pattern] = ByteBPE.parse(zlib.decompress(packed), pattern)
    return _loaded[packed, pattern]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, verify: bool = False) -> DataFrame:
    """id, ids array<int>, with decode=True also decoded binary, made from the ids alone, and with verify=True also exact: do the
    ids decode to the text's bytes. The driver reads the rank
    file and ships it to the tasks; its size is that of the vocabulary, whatever the input."""
    with open(ranks_path, "rb") as f:
        packed = zlib.compress(f.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(packed, pattern)
        for block in text_blocks(batches, most=2 << 20):
            ids = bpe.encode([x or "" for x in block.column("text").to_pylist()])
            sizes = [len(x) for x in ids]
            columns = [block.column("id"), lists(np.fromiter(chain.from_iterable(ids), np.int32, sum(sizes)), sizes, pa.int32())]
            names = ["id", "ids"]
            if decode or verify:
                decoded = [bpe.decode(x) for x in ids]
            if decode:
                columns.append(pa.array(decoded, pa.binary()))
                names.append("decoded")
            if verify:
                columns.append(pa.array([a == b for a, b in zip(decoded, as_bytes(block.column("text")), strict=True)]))
                names.append("exact")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded binary" * decode + ", exact boolean" * verify)
    return out.withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded binary of rows of ids; null ids decode to no bytes."""
    with open(ranks_path, "rb") as f:
        packed = zlib.compress(f.read())
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(packed, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([bpe.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], ["id", "decoded"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, decoded binary").withColumnRenamed("id", id_col)
