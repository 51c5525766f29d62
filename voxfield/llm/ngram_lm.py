"""Language-model scores: deleted interpolation of n-gram estimates, mixed by context-frequency buckets.

The model of a text is the product over its tokens (words, then one end) of

    a3[b] * c(u, v, w) / c(u, v)  +  a2[b] * c(v, w) / c(v)  +  a1[b] * c(w) / N  +  a0[b] / (V + 1)

u and v are the tokens before (ends of a text stand before its first word, so the count of a start's context is the number of training
texts). b is the bucket floor(log2(c + 1)), up to BUCKETS - 1, of c(u, v), or if that is 0 another BUCKETS by c(v). The weights of each
bucket come from expectation-maximisation on held-out counts: training documents are dealt by a hash of their id, one in DELETED is left out
of the counts while its tokens teach the weights. Scores then use the counts of all training documents. Counts are exact (64-bit hashes of
words, 48-bit ones of longer grams: among g distinct ones a share of g / 2**48 meets another) and cover all documents; nothing is capped.

Passes: (1) documents become blocks of numbered tokens, with the hashes of the block's distinct words, in a table. (2) From
each block its distinct grams of each order go, sorted and counted, to the part of their hash. A part adds up the
training counts of all blocks and sends each block the counts of what it asked for. So a frequent gram costs a number for each block, and
parts, as many as the tokens need, are even. (3) Blocks meet their answers; those left out give a histogram for the weights, then all give
scores. The driver sees N, V, and the histogram (2 * BUCKETS x BINS ** order cells at most, whatever the input).

Nulls: a null text is an empty one: only its end is a token. A null id trains. Without training tokens every count is 0, V and N are 0, base_score
follows its formula and score is 0. Rows are scored one by one, repeated or not. An id must be a number or null. Other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfield.llm.common import _cut, _gaps, _join, _sorted, as_bytes, by_key, shuffle_width, split_keys, store, text_blocks

BUCKETS = 16
BINS = 24
ORDER = 3
DELETED = 16
BLOCK = 8 << 20
ROUNDS = 50
PART = 12 << 20  # bytes that a part is asked for, about
_MULT = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
_PAIR = np.uint64((1 << 48) - 1)


def _small(x: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + zlib.compress(x.astype(kind).tobytes(), 1)


def _large(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), f"u{raw[0]}").astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Numbers up to 2**32 as byte planes, which compress apart."""
    size = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([size]) + pa.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size].T.tobytes(), codec="zstd", asbytes=True)


def _from_planes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    out[:, : raw[0]] = np.frombuffer(pa.decompress(raw[1:], decompressed_size=n * raw[0], codec="zstd", asbytes=True), np.uint8).reshape(raw[0], n).T
    return out.view("<u4")[:, 0]


def _grams(h: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For each order from 2 on, 48-bit hashes of each token after those before it; ends of a text come before its first token."""
    first = np.cumsum(sizes) - sizes
    before, x = h[tokens], h[tokens]
    for _ in range(2, order + 1):
        before = np.concatenate([before[:1], before[:-1]])
        before[first] = END
        x = (before * _MULT ^ (before >> np.uint64(31))) + x * _ODD
        x = (x ^ (x >> np.uint64(30))) * _MULT
        x ^= x >> np.uint64(27)
        yield x >> np.uint64(16)


#: The hash of a text's end.
END = np.uint64(0x5BD1E995A3C59AC3)


def _number(texts: list[bytes], train: np.ndarray, left_out: np.ndarray) -> bytes:
    """A block: hashes of its distinct words (sorted), tokens by number, tokens of each text, and which texts train or are left out."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashed = []
    for x in texts:  # the words of one text at a time
        words = x.lower().split()
        hashed.append(np.fromiter(map(digest, words), np.uint64, len(words)))
    sizes = np.array([len(x) + 1 for x in hashed], np.int64)
    end = np.array([END])
    names, tokens = np.unique(np.concatenate([y for x in hashed for y in (x, end)]), return_inverse=True)
    return _join(_gaps(names), _planes(tokens), sizes.astype(np.uint32).tobytes(), train.tobytes(), left_out.tobytes())


def _block(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    names, tokens, sizes, train, left_out = _cut(raw)
    sizes = np.frombuffer(sizes, np.uint32).astype(np.int64)
    return _sorted(names), _from_planes(tokens, int(sizes.sum())), sizes, np.frombuffer(train, bool), np.frombuffer(left_out, bool)


def _keys(raw: bytes, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each order: the block's distinct keys (sorted), counts in its training texts and in those left out of them."""
    names, tokens, sizes, train, left_out = _block(raw)
    used, gone = np.repeat(train, sizes), np.repeat(train & left_out, sizes)
    yield names, np.bincount(tokens[used], minlength=len(names)), np.bincount(tokens[gone], minlength=len(names))
    for grams in _grams(names, tokens, sizes, order):
        keys, place = np.unique(grams, return_inverse=True)
        yield keys, np.bincount(place[used], minlength=len(keys)), np.bincount(place[gone], minlength=len(keys))


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)


def buckets_of(contexts: list[np.ndarray]) -> np.ndarray:
    """The bucket of each token: by the longest context's count, or if that is 0 by the one a word shorter. contexts: longest first."""
    out = bucket(contexts[0])
    return out if len(contexts) < 2 else np.where(contexts[0] > 0, out, BUCKETS + bucket(contexts[1]))


def expectation_maximisation(est: np.ndarray, count: np.ndarray, of: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bucket, estimate) that raise the likelihood of `count` held-out tokens with estimates est (rows, estimates; the longest context
    first, the uniform one last), in buckets `of`. A bucket without any takes the weights of all tokens together."""
    k = est.shape[1]

    def climb(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        mix = start
        for _ in range(rounds):
            share = est[rows] * mix
            share *= (count[rows] / np.maximum(share.sum(1), 1e-300))[:, None]
            mix = share.sum(0) + 1e-3
            mix = mix / mix.sum()
        return mix

    whole = climb(np.arange(len(est)), np.full(k, 1 / k)) if len(est) else np.full(k, 1 / k)
    out = np.tile(whole, (2 * BUCKETS, 1))
    for b in range(2 * BUCKETS):
        rows = np.flatnonzero(of == b)
        if len(rows):
            out[b] = climb(rows, whole)
    # no context, no estimate from it
    if k > 3:
        out[BUCKETS:, 0] = 0
        out[BUCKETS, 1] = 0
    if k > 2:
        out[0, 0] = 0
        if k > 3:
            out[0, 1] = 0
    return out / out.sum(1, keepdims=True)


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK, order: int = ORDER, part_bytes: int = PART) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score, a row for each document; learns from rows where train is true. order: the
    longest grams, 1 to 3 tokens."""
    if order not in (1, 2, 3):
        raise ValueError("order must be 1, 2 or 3")
    width = shuffle_width(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    rows = rows.withColumn("left_out", F.pmod(F.xxhash64("id", F.lit("deleted")), F.lit(DELETED)) == 0)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, most=block_bytes):
            trains, left = (block.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("train", "left_out"))
            deleted = trains & left
            texts = as_bytes(block.column("text"))
            for held, some in ((True, np.flatnonzero(deleted)), (False, np.flatnonzero(~deleted))):  # blocks are left out whole or not
                if len(some):
                    ids = block.column("id").take(pa.array(some))
                    raw = _number([texts[i] for i in some], trains[some], left[some])
                    yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([raw], pa.binary())], ["held", "ids", "raw"])

    table = rows.mapInArrow(number, "held boolean, ids array<bigint>, raw binary")
    blocks = store(table.withColumn("block", F.monotonically_increasing_id()), "uncompressed")
    # a token takes two or three bytes in a block, a gram about five when asked for
    stored = int(blocks.agg(F.sum(F.length("raw"))).first()[0] or 0)
    parts, tasks = max(width, stored * 2 // part_bytes), max(width, stored // (2 * part_bytes))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "held", "raw")), strict=True):
                for kind, (keys, count, gone) in enumerate(_keys(raw, order)):
                    cuts, out = split_keys(keys, 48 if kind else 64, parts).tolist(), []
                    for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        if b > a:
                            out.append((kind * parts + part, _join(_gaps(keys[a:b]), _small(count[a:b]), _small(gone[a:b]))))
                        if len(out) == 64 or (out and part == parts - 1):
                            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([block] * len(out), pa.int64()), pa.array([held] * len(out)), pa.array([x[1] for x in out], pa.binary())], ["part", "block", "held", "asked"])
                            out = []

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in by_key(batches, "part"):
            cut = [_cut(x) for x in group["asked"].to_pylist()]
            keys = [_sorted(x[0]) for x in cut]
            every, place = np.unique(np.concatenate(keys), return_inverse=True)
            total, left = (np.bincount(place, weights=np.concatenate([_large(x[k]) for x in cut]), minlength=len(every)).astype(np.int64) for k in (1, 2))
            at, main, out, size = 0, total - left, [], 0
            # words also say how many tokens and distinct tokens there are, of all training texts and without those left out
            stats = [int(total.sum()), int((total > 0).sum()), int(main.sum()), int((main > 0).sum())] if part < parts else [0, 0, 0, 0]
            for block, held, k in zip(group["block"].to_pylist(), group["held"].to_pylist(), keys, strict=True):
                mine = place[at : at + len(k)]
                at += len(k)
                out.append((part, block, held, _join(_small(total[mine]), _small(main[mine]) if held else b""), stats))
                size += len(out[-1][3])
                stats = [0, 0, 0, 0]
                if size > 1 << 20 or at == len(place):
                    columns = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["part", "block", "held", "reply", "stats"])
                    out, size = [], 0

    asked = blocks.select("block", "held", "raw").mapInArrow(ask, "part int, block bigint, held boolean, asked binary")
    replies = store(asked.repartitionById(order * parts, F.col("part")).mapInArrow(answer, "part int, block bigint, held boolean, reply binary, stats array<bigint>"), "uncompressed")
    n, v, n_main, v_main = (x or 0 for x in replies.agg(*[F.sum(F.col("stats")[k]) for k in range(4)]).first())

    def met(held: bool | None) -> DataFrame:
        """Blocks with their replies side by side, as rows in order: the block, then its replies by part."""
        a, b = (x if held is None else x.where(F.col("held") == held) for x in (blocks, replies))
        both = a.select("block", F.lit(-1).alias("part"), F.col("raw").alias("data"), "ids").unionByName(b.select("block", "part", F.col("reply").alias("data"), F.lit(None).cast("array<bigint>").alias("ids")))
        return both.repartition(tasks, "block").sortWithinPartitions("block", "part")

    def counts(group: pa.Table, which: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """A block's sizes of texts, and for each token its counts and those of its contexts, longest grams first."""
        data = group["data"].to_pylist()
        names, tokens, sizes, *_ = _block(data[0])
        got: list[list[np.ndarray]] = [[] for _ in range(order)]
        for part, x in zip(group["part"].to_pylist()[1:], data[1:], strict=True):
            got[part // parts].append(_large(_cut(x)[which]))
        words = np.concatenate(got[0])
        first, ends = np.cumsum(sizes) - sizes, words[np.searchsorted(names, END)]
        out, contexts = [words[tokens]], []
        for k, grams in enumerate(_grams(names, tokens, sizes, order), 1):
            before = np.concatenate([out[0][:1], out[0][:-1]])
            before[first] = ends
            contexts.insert(0, before)
            out.insert(0, np.concatenate(got[k])[np.unique(grams, return_inverse=True)[1]])
        return sizes, out, contexts

    def estimates(found: list[np.ndarray], contexts: list[np.ndarray], tokens: int) -> Iterator[np.ndarray]:
        """One for each order, longest grams first; the uniform one is left to the caller."""
        yield from (c / np.maximum(1, x) for c, x in zip(found, contexts, strict=False))
        yield found[-1] / max(1, tokens)

    def of_tokens(found: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        return buckets_of(contexts) if contexts else np.ones(len(found[-1]), np.int64)

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Histogram of the tokens left out: cells of the bucket and the bins of the estimates, with how many there are and their sums."""
        total = np.zeros((2 * BUCKETS * BINS**order, 1 + order))
        for _, group in by_key(batches, "block"):
            _, found, contexts = counts(group, 1)
            est = list(estimates(found, contexts, n_main))
            cell = of_tokens(found, contexts)
            for p in est:
                cell = cell * BINS + _bin(p)
            for k, x in enumerate((np.ones(len(cell)), *est)):
                total[:, k] += np.bincount(cell, weights=x, minlength=len(total))
        some = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(total[some, k]) for k in range(1 + order)]], ["cell", "n", *sums])

    sums = [f"p{k}" for k in range(order)]
    cells = met(True).mapInArrow(held_out, ", ".join(["cell int", "n double", *[f"{c} double" for c in sums]]))
    cells = cells.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", *sums)]).orderBy("cell").toArrow()
    count = cells["n"].to_numpy()
    est = [cells[c].to_numpy() / np.maximum(1, count) for c in sums]
    mix = expectation_maximisation(np.stack([*est, np.full(len(count), 1 / (v_main + 1))], 1), count, cells["cell"].to_numpy() // BINS**order)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_key(batches, "block"):
            sizes, found, contexts = counts(group, 0)
            first, c1 = np.cumsum(sizes) - sizes, found[-1]
            base = np.log10((c1 + 0.5) / (n + 0.5 * (v + 1)))
            of = of_tokens(found, contexts)
            p = mix[of, -1] / (v + 1)
            for k, x in enumerate(estimates(found, contexts, n)):
                p += mix[of, k] * x
            whole = np.add.reduceat(np.log10(p), first) if n else np.zeros(len(sizes))
            columns = [pa.array(group["ids"][0].as_py(), pa.int64()), pa.array(sizes), pa.array(np.add.reduceat((c1 > 0).astype(np.int64), first)), pa.array(np.full(len(sizes), n, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(whole)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return met(None).mapInArrow(score, "id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").withColumnRenamed("id", id_col)


def _bin(p: np.ndarray) -> np.ndarray:
    """Powers of two, 0 for no probability."""
    return np.where(p > 0, np.clip(np.floor(-np.log2(np.maximum(p, 1e-300))), 0, BINS - 2).astype(np.int64) + 1, 0)
