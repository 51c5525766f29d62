"""SimHash near-duplicates: fingerprints, a binary-trie self-join within a Hamming budget, and connected classes.

Fingerprints come from one pass over the texts. Documents with equal fingerprints are grouped first (partial sums, so a
group of copies of any size costs a row for each task), and only distinct fingerprints are joined.

Join: 64 bits are cut into budget + 2 blocks; two fingerprints with at most `budget` differing bits agree in at least
two of them, so every linked pair meets under the key of some choice of two blocks (for a budget of 2: 4 blocks of 16
bits, 6 choices, keys of 32 bits). The fingerprints of a key are a subtree of the binary trie over the bits
with the key's blocks first. The join walks pairs of trie nodes together, level by level, adds up the bits in which they
differ and drops a pair of nodes once its sum exceeds the budget; all subtrees of a task are walked in one numpy frontier. A pair
that meets under several keys is found under each. Each task reports a spanning forest of its links instead of all, which
joins the same classes. Distinct fingerprints within the budget of one another number at most 1+64+2016, whatever the number of copies.

A key that holds more than HOT distinct fingerprints is cut again: under it the other bits are cut and chosen from in the same way,
so no group depends on a single task, and no pair is lost.

Classes: every node chooses the first one around it, links are drawn between what was chosen, until none is left; tables of each round
are written to the shared folder. Nothing is collected but whether links are left.

Nulls: a null text is an empty one: fingerprint 0, linked like any other. A null id keeps its fingerprint; component_id is the smallest
id that is not null (null if there is none). Repeated rows are repeated. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield.llm.common import _narrow, _wide, as_bytes, by_key, drop, join_hot, shuffle_width, store, text_blocks

WORDS = 3
BUDGET = 2
HOT = 20_000
MOST = 2 << 20  # shingles of a component that are compared in one task
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of the XXH64 (seed 42) of a text's word shingles, repeats included; 0 for a text without words."""
    import xxhash

    cut = text.lower().split()  # bytes: A-Z only, and exactly the white space of the contract
    if not cut:
        return 0
    joined = memoryview(b" ".join(cut))
    size = np.fromiter(map(len, cut), np.int64, len(cut))
    starts = np.cumsum(size + 1) - size - 1
    ends = starts + size
    if len(cut) > words:
        starts, ends = starts[: len(cut) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
    out, n = 0, len(h)
    for k in range(8):  # eight counters at once, in the bytes of a word
        lanes = (h >> np.uint64(k)) & _LANES
        whole = np.add.reduceat(lanes, np.arange(0, n, 255)).view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
        for byte in np.flatnonzero(2 * whole > n).tolist():
            out |= 1 << (8 * byte + k)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id and fp (the 64 bits as a signed long); no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            found = np.array([fingerprint(x, words) for x in as_bytes(block.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def trie_pairs(codes: np.ndarray, groups: np.ndarray, budget: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of the codes of one group that differ in at most `budget` bits. codes are sorted within
    groups, and distinct. A node of the trie is a range of codes; the frontier holds pairs of nodes of one level and their differing
    bits so far. Frontiers beyond `most` pairs are split, so memory stays bounded."""
    edge = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]]))
    lo, hi = edge[:-1], edge[1:]
    some = hi - lo > 1
    lo, hi = lo[some], hi[some]
    work = [(63, lo[k : k + most], hi[k : k + most], lo[k : k + most], hi[k : k + most], np.zeros(len(lo[k : k + most]), np.int8)) for k in range(0, len(lo), most)]
    while work:
        bit, a, b, c, d, bad = work.pop()
        if not len(a):
            continue
        if len(a) > most:
            h = len(a) // 2
            work += [(bit, a[h:], b[h:], c[h:], d[h:], bad[h:]), (bit, a[:h], b[:h], c[:h], d[:h], bad[:h])]
            continue
        one = (b - a == 1) & (d - c == 1)
        if one.any():  # two leaves: the rest of their bits at once
            i, j = a[one], c[one]
            i, j = i[i != j], j[i != j]
            near = np.bitwise_count(codes[i] ^ codes[j]) <= budget
            if near.any():
                yield i[near], j[near]
            a, b, c, d, bad = (x[~one] for x in (a, b, c, d, bad))
        if not len(a) or bit < 0:
            continue
        m, n = _middle(codes, a, b, bit), _middle(codes, c, d, bit)
        same = a == c
        parts = [(a, m, c, n, bad), (m, b, n, d, bad), (a, m, n, d, bad + np.int8(1)), (m[~same], b[~same], c[~same], n[~same], bad[~same] + np.int8(1))]
        parts = [tuple(x[(p[1] > p[0]) & (p[3] > p[2]) & (p[4] <= budget)] for x in p) for p in parts]
        work.append((bit - 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


def _middle(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where the codes of each range, which share the bits above, begin to have this bit."""
    lo, hi, mask = lo.copy(), hi.copy(), np.uint64(1 << bit)
    for _ in range(int((hi - lo).max()).bit_length() if len(lo) else 0):
        open_ = lo < hi
        mid = (lo + hi) >> 1
        high = (codes[np.minimum(mid, len(codes) - 1)] & mask) != 0
        hi = np.where(open_ & high, mid, hi)
        lo = np.where(open_ & ~high, mid + 1, lo)
    return lo


def _plans(bits: list[int], budget: int, agree: int = 2) -> list[list[int]]:
    """The bits of every choice of `agree` of budget + agree blocks of these bits."""
    blocks = [x.tolist() for x in np.array_split(np.array(bits), budget + agree)]
    return [sum((blocks[k] for k in c), []) for c in combinations(range(len(blocks)), agree)]


def _bits_of(fp: str, bits: list[int]):
    """SQL for these bits of a long, in place."""
    mask = sum(1 << b for b in bits)
    return F.col(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def links(distinct: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp): a forest for each task whose classes are those of all pairs
    with at most `budget` differing bits."""
    spark = distinct.sparkSession
    if budget < 1:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    plans = _plans(list(range(63, -1, -1)), budget)
    keyed = distinct.select("fp", F.posexplode(F.array(*[_bits_of("fp", x) for x in plans]))).select("fp", F.col("pos").alias("plan"), F.col("col").alias("key"))
    # a table of the hot keys only, mostly empty; every other row goes on as it is
    big = store(keyed.groupBy("plan", "key").count().where(F.col("count") > hot).select("plan", "key"))
    under = {k: [sorted(x) for x in _plans([b for b in range(63, -1, -1) if b not in set(p)], budget)] for k, p in enumerate(plans)}
    more = max(len(x) for x in under.values())
    some_hot = big.limit(1).count() > 0
    small = (keyed.join(big, ["plan", "key"], "left_anti") if some_hot else keyed).select("fp", "plan", F.lit(-1).alias("sub"), "key", F.lit(0).cast("long").alias("key2"))
    if some_hot:
        sub_key = F.array(*[F.coalesce(*[F.when(F.col("plan") == k, _bits_of("fp", x[s])) for k, x in under.items()]) for s in range(more)])
        large = keyed.join(big, ["plan", "key"], "left_semi").select("fp", "plan", "key", F.posexplode(sub_key)).select("fp", "plan", F.col("pos").alias("sub"), "key", F.col("col").alias("key2"))
        small = small.unionByName(large)
    width = shuffle_width(spark)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for _, group in by_key(batches, "g"):
            held.append(group)
            rows += group.num_rows
            if rows >= 200_000:
                yield from solve(pa.concat_tables(held))
                held, rows = [], 0
        if held:
            yield from solve(pa.concat_tables(held))

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        g, fp = t["g"].to_numpy(), t["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((fp, g))
        g, fp = g[order], fp[order]
        roots = np.arange(len(fp))
        for i, j in trie_pairs(fp, g, budget):
            roots = _merge(roots, i, j)
        child = np.flatnonzero(roots != np.arange(len(fp)))
        if len(child):
            yield pa.RecordBatch.from_arrays([pa.array(fp[roots[child]].view(np.int64)), pa.array(fp[child].view(np.int64))], ["a", "b"])

    grouped = small.select("fp", F.xxhash64("plan", "sub", "key", "key2").alias("g")).repartition(width, "g").sortWithinPartitions("g")
    return grouped.mapInArrow(join, "a bigint, b bigint")


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins the classes of links (i, j); root[x] is the least place of the class of x."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return root
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not ((up := root[root]) == root).all():
            root = up


def classes(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (a, b); root names the class: its node of least xxhash64. Each round every node takes the node
    that comes first around it, and that node's own choice; links are then drawn between what was chosen, which are far fewer, and the next
    round sees only those. At the end the choices are followed back. The order by hash makes chains of ascending ids as quick as others.
    Choices are looked up by `join_hot`, since a large class makes one choice in many rows."""
    first = lambda x: F.xxhash64(x)
    open_ = store(edges.where("a <> b").select("a", "b"))
    chosen: list[DataFrame] = []
    while open_.limit(1).count():
        both = open_.unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", first("b")).alias("m"))
        near = store(near.select("node", F.when(first("m") < first("node"), F.col("m")).otherwise(F.col("node")).alias("root")))
        up = near.groupBy(F.col("root").alias("r")).agg(F.count("*").alias("n")).join(near.select(F.col("node").alias("r"), F.col("root").alias("up")), "r")
        labels = store(join_hot(near, store(up), "root", "r", "n", near.count()).select("node", F.col("up").alias("root")))
        chosen.append(labels)
        a, b = (labels.select(F.col("node").alias(c), F.col("root").alias("r" + c)) for c in "ab")
        left = open_.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        left = store(left.distinct())
        drop(open_, near)
        open_ = left
    if not chosen:
        return open_.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = chosen.pop()
    while chosen:
        labels = chosen.pop()
        asked = labels.groupBy(F.col("root").alias("r")).agg(F.count("*").alias("n")).join(out.select(F.col("node").alias("r"), F.col("root").alias("top")), "r")
        out = store(join_hot(labels, store(asked), "root", "r", "n", labels.count()).select("node", F.coalesce("top", "root").alias("root")))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, words: int = WORDS) -> DataFrame:
    """id, fp and component_id, a row for each document."""
    rows = store(fingerprints(docs, id_col, text_col, words))
    groups = store(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    found = store(links(groups.select("fp"), budget).distinct())
    root = classes(found)
    # a fingerprint without a link is its own class and needs no further exchange
    alone = groups.join(root, groups["fp"] == root["node"], "left_anti").select("fp", F.col("rep").alias("component_id"), "n")
    member = store(groups.join(root, groups["fp"] == root["node"]).select("fp", "rep", "n", "root"))
    least = store(member.groupBy(F.col("root").alias("top")).agg(F.min("rep").alias("component_id"), F.count("*").alias("m")))
    of = join_hot(member, least, "root", "top", "m", member.count()).select("fp", "component_id", "n")
    labelled = store(alone.unionByName(of))
    drop(found, root, member, least)
    out = join_hot(rows, labelled.withColumnRenamed("fp", "f"), "fp", "f", "n", rows.count())
    return out.select(F.col("id").alias(id_col), "fp", "component_id")


class _Hashes(dict):
    """XXH64 of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(cut: list[bytes], words: int, hashes: _Hashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of `words` words; a shorter text is one run."""
    h = np.fromiter(map(hashes.__getitem__, cut), np.uint64, len(cut)) if cut else np.zeros(1, np.uint64)
    long = min(words, len(h))
    out = h[: len(h) - long + 1].copy()
    for k in range(1, long):
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - long + 1 + k]
    out = (out ^ (out >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.unique(out ^ (out >> np.uint64(29)))


def _shared(rows: DataFrame, words: int, most: int = 20_000, keep: int = 1 << 16) -> np.ndarray:
    """Hashes of shingles that several of about `most` sampled texts hold, rarest first, `keep` of the most frequent at most.
    They only order the shingles: what is found does not depend on the sample."""
    n = rows.count()
    part = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most / max(n, 1))) + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for block in text_blocks(batches):
            sets = [shingles(x.lower().split(), words, hashes) for x in as_bytes(block.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    counts = part.mapInArrow(cut, "h bigint").groupBy("h").count().where("count > 2")
    top = counts.orderBy(F.desc("count"), "h").limit(keep).toArrow()
    return top["h"].to_numpy().view(np.uint64)[::-1].copy()


def _ordered(grams: np.ndarray, by_hash: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The shingles in the order of all texts: those not shared by hash, then the shared ones from rare to frequent."""
    key = grams >> np.uint64(1)
    if len(by_hash):
        at = np.minimum(np.searchsorted(by_hash, grams), len(by_hash) - 1)
        key = np.where(by_hash[at] == grams, np.uint64(1 << 63) + place[at], key)
    key.sort()
    return key


def grow_classes(token: np.ndarray, node: np.ndarray, size: np.ndarray, pos: np.ndarray, root: np.ndarray, least: float, judge: Callable[[int, int], bool] | None = None) -> np.ndarray:
    """Joins the classes (root[node], the least node) of pairs that may overlap by `least`, and that `judge` accepts: those that share a
    token, whose sizes allow it, and whose places do: a pair that reaches it passes under the first token it shares, since nothing
    before that is common. Rows come sorted by token and size. Neighbours come first, then rows ever further apart; tokens whose rows
    have become one class are left, so a large group of copies costs about its rows. A pair is judged once."""
    new = np.concatenate([[True], token[1:] != token[:-1]])
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    k, d, judged = np.arange(len(token)), 0, set()
    while True:
        d += 1
        k = k[k + d < len(token)]
        k = k[(token[k] == token[k + d]) & (size[k] >= least * size[k + d] - 1e-9)]  # sizes grow with d: what fails stays out
        if not len(k):
            return root
        a, b = k, k + d
        rest = np.minimum(size[a] - pos[a], size[b] - pos[b])
        ok = (rest >= least / (1 + least) * (size[a] + size[b]) - 1e-9) & (root[node[a]] != root[node[b]])
        if ok.any():
            a, b = node[a[ok]], node[b[ok]]
            if judge is None:
                root = _merge(root, a, b)
            else:
                for i, j in sorted(set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)) - judged):
                    judged.add((i, j))
                    if root[i] != root[j] and judge(i, j):
                        root = _merge(root, np.array([i]), np.array([j]))
        if d & (d - 1) == 0:
            of = root[node]
            one = np.minimum.reduceat(of, starts) == np.maximum.reduceat(of, starts)
            k = k[~one[group[k]]]


def overlap_classes(sets: list[np.ndarray], least: float) -> np.ndarray:
    """The least place of the class of each of these sets, where an overlap of `least` or more links two. Candidates come from a prefix
    filter in the order of how many of the sets have a shingle."""
    n = np.array([len(x) for x in sets])
    root = np.arange(len(sets))

    def alike(i: int, j: int) -> bool:
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return both >= least * (n[i] + n[j] - both) - 1e-9

    if len(sets) == 2:
        return np.array([0, 0 if alike(0, 1) else 1])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    place, rare = rank[place], int((count == 1).sum())  # ranks below `rare` are in one set only
    tokens, nodes, where = [], [], []
    for i, x in enumerate(np.split(place, np.cumsum(n)[:-1])):
        first = np.sort(x)[: _prefix(len(x), least)]
        some = np.flatnonzero(first >= rare)
        tokens.append(first[some])
        nodes.append(np.full(len(some), i))
        where.append(some)
    token, node, pos = (np.concatenate(x) for x in (tokens, nodes, where))
    if not len(token):
        return root
    order = np.lexsort((node, n[node], token))
    token, node, pos = token[order], node[order], pos[order]
    return grow_classes(token, node, n[node], pos, root, least, alike)


def _pair_hash(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (y.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(same, n, prefix) -> a row for each shingle of a prefix."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            block = batch.slice(at, 2000)
            sets = [np.frombuffer(x, np.int64) for x in block.column("prefix").to_pylist()]
            long = np.array([len(x) for x in sets], np.int64)
            pos = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), *(pa.array(np.repeat(block.column(c).to_numpy(), long)) for c in ("same", "n")), pa.array(pos.astype(np.int32))], ["token", "same", "n", "pos"])


def _tokens(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[tuple[np.ndarray, ...]]:
    """(token, same, n, pos) of rows sorted by token, n and same, in pieces of about `most` rows that hold whole tokens; without repeats
    of a text (copies in other blocks of documents) and without tokens of one text."""

    def piece(t: pa.Table) -> tuple[np.ndarray, ...]:
        token, node, size, pos = (t[c].to_numpy() for c in ("token", "same", "n", "pos"))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, size, pos = (x[new] for x in (token, node, size, pos))
        several = np.zeros(len(token), bool)
        several[1:] = token[1:] == token[:-1]
        several[:-1] |= several[1:]
        return tuple(x[several] for x in (token, node, size, pos))

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            t = pa.Table.from_batches(held).combine_chunks()
            token = t["token"].to_numpy()
            end = int(np.searchsorted(token, token[-1]))  # the last token may go on
            if end:
                yield piece(t.slice(0, end))
            held, rows = t.slice(end).to_batches(), len(t) - end
    if held:
        yield piece(pa.Table.from_batches(held))


def _by_token(marked: DataFrame) -> DataFrame:
    rows = marked.select("same", "n", "prefix").where(F.length("prefix") > 0).mapInArrow(_spread, "token bigint, same bigint, n int, pos int")
    return rows.repartition(shuffle_width(marked.sparkSession), "token").sortWithinPartitions("token", "n", "same")


def prefix_forest(marked: DataFrame, least: float) -> DataFrame:
    """marked (same, n, prefix) -> links (a, b) whose classes are those of all pairs of texts that may overlap by `least` by the places of a
    shared prefix shingle; a forest for each piece of the shingles, so no group of texts is written out as pairs."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, same, size, pos in _tokens(batches):
            if len(token):
                names, node = np.unique(same, return_inverse=True)
                root = grow_classes(token, node, size, pos, np.arange(len(names)), least)
                child = np.flatnonzero(root != np.arange(len(names)))
                yield pa.RecordBatch.from_arrays([pa.array(names[root[child]]), pa.array(names[child])], ["a", "b"])

    return _by_token(marked).mapInArrow(meet, "a bigint, b bigint")


def prefix_pairs(marked: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """marked (same, n, prefix) and texts (same, n, last) -> pairs (x, y), x < y, of texts that may overlap by `least`, none that does is left
    out. Of the prefix that ends first in the order of the shingles, what isn't shared is in no part of the other set, so counts of the shared
    ones tell most pairs apart. The names of a pair travel from a shingle whose places allow it, elsewhere its hash and a count."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, node, size, pos in _tokens(batches):
            seen: list[tuple[np.ndarray, ...]] = []
            k, count = np.arange(len(token)), 0
            for d in range(1, len(token)):
                k = k[k + d < len(token)]
                k = k[(token[k] == token[k + d]) & (size[k] >= least * size[k + d] - 1e-9)]
                if not len(k):
                    break
                a, b = k, k + d
                rest = np.minimum(size[a] - pos[a], size[b] - pos[b])
                seen.append((np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), rest >= least / (1 + least) * (size[a] + size[b]) - 1e-9))
                count += len(a)
                if count >= 1 << 20:
                    yield counted(seen)
                    seen, count = [], 0
            if seen:
                yield counted(seen)

    def counted(seen: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        x, y, ok = (np.concatenate(c) for c in zip(*seen, strict=True))
        h = _pair_hash(x, y)
        order = np.argsort(h)
        first = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]]))
        named = np.logical_or.reduceat(ok[order], first)
        at = order[first]
        n = np.diff(np.append(first, len(h))).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(n), pa.array(x[at], mask=~named), pa.array(y[at], mask=~named)], ["h", "c", "x", "y"])

    met = _by_token(marked).mapInArrow(meet, "h bigint, c int, x bigint, y bigint")
    met = met.groupBy("h").agg(F.sum("c").alias("shared"), F.max("x").alias("x"), F.max("y").alias("y")).where("x is not null")
    x, y = (texts.select(F.col("same").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("n", "last")]) for c in "xy")
    beyond = lambda n: F.ceil(F.col(n) * least - 1e-9) - 1  # what follows a prefix
    most = F.when(F.col("last_x") <= F.col("last_y"), beyond("n_x")).otherwise(beyond("n_y")) + F.col("shared")
    need = F.ceil((F.col("n_x") + F.col("n_y")) * (least / (1 + least)) - 1e-9)
    return met.join(x, "x").join(y, "y").where(most >= need).select("x", "y")


def _weighed(of: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """(same, rep, root, large): members of classes of (node, root), and whether the class has more than `most` shingles."""
    sized = of.join(texts, of["node"] == texts["same"]).select("same", "rep", "n", "root")
    total = sized.groupBy("root").agg(F.sum("n").alias("total"))
    return store(sized.join(total, "root").select("same", "rep", "root", (F.col("total") > most).alias("large")))


def fingerprint_forest(texts: DataFrame, budget: int = BUDGET) -> DataFrame:
    """texts (same, fp) -> links (a, b) whose classes are those of all pairs of texts with fingerprints of at most `budget` differing bits."""
    heads = store(texts.groupBy("fp").agg(F.min("same").alias("head")))
    a, b = (heads.select(F.col("fp").alias(f"{c}_fp"), F.col("head").alias(c)) for c in "ab")
    apart = links(heads.select("fp"), budget).distinct().select(F.col("a").alias("a_fp"), F.col("b").alias("b_fp")).join(a, "a_fp").join(b, "b_fp").select("a", "b")
    equal = texts.select("same", F.col("fp").alias("a_fp")).join(a, "a_fp").where("same <> a").select("a", F.col("same").alias("b"))
    return apart.unionByName(equal)


def overlap_links(marked: DataFrame, texts: DataFrame, docs: DataFrame, words: int, least: float, order: Broadcast, most: int = MOST) -> DataFrame:
    """Links (a, b) of texts whose classes are those of all pairs with an overlap of `least` or more; marked (same, n, prefix), texts (same, rep,
    n, last, fp), docs (id, text), order: that of the prefixes.

    Classes of candidates from `fingerprint_forest` and `prefix_forest` meet in one task each: the sets of shingles travel once and pairs are judged there. A
    class of more than `most` shingles, as long texts make that share a passage, is parted first by `prefix_pairs`. What is larger even
    then is judged pair by pair, each with its two sets, so no task holds more. Shingles are compared by 40 bits of their hash."""
    first = _weighed(classes(fingerprint_forest(texts).unionByName(prefix_forest(marked, least))), texts, most)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        by_hash, place = order.value
        for block in text_blocks(batches, most=1 << 20):
            split = [x.lower().split() for x in as_bytes(block.column("text"))]
            right = np.flatnonzero(_same(split) == block.column("same").to_numpy()).tolist()  # an id may have other texts too
            if right:
                block = block.take(pa.array(right))
                sets = [shingles(split[i], words, hashes) for i in right]
                prefix = [_ordered(x, by_hash, place)[: _prefix(len(x), least)].tobytes() if wide else b"" for x, wide in zip(sets, block.column("large").to_pylist(), strict=True)]
                grams = [_narrow(np.unique(x >> np.uint64(24)), 5) for x in sets]
                yield pa.RecordBatch.from_arrays([block.column("root"), block.column("same"), block.column("large"), pa.array([len(x) for x in sets], pa.int32()), pa.array(prefix, pa.binary()), pa.array(grams, pa.binary())], ["root", "same", "large", "n", "prefix", "grams"])

    # by merge at every size: the texts that take part grow with the input, and so would their broadcast ids
    named = docs.join(first.select(F.col("rep").alias("id"), "same", "root", "large").hint("merge"), "id")
    sets = store(named.select("root", "same", "large", "text").mapInArrow(cut, "root bigint, same bigint, large boolean, n int, prefix binary, grams binary"))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in by_key(batches, "root"):
            found = {k: v for k, v in zip(t["same"].to_pylist(), t["grams"], strict=True)}  # equal rows are one text
            names = sorted(found)
            root = overlap_classes([_wide(found[k].as_py(), 5) for k in names], least) if len(names) > 1 else np.zeros(1, np.int64)
            child = np.flatnonzero(root != np.arange(len(names))).tolist()
            if child:
                yield pa.RecordBatch.from_arrays([pa.array([names[root[i]] for i in child], pa.int64()), pa.array([names[i] for i in child], pa.int64())], ["a", "b"])

    def solved(some: DataFrame) -> DataFrame:
        dealt = some.repartition(shuffle_width(docs.sparkSession), "root").sortWithinPartitions("root")
        return dealt.mapInArrow(together, "a bigint, b bigint")

    out = solved(sets.where("not large").select("root", "same", "grams"))
    large = sets.where("large")
    if not large.limit(1).count():
        return out
    pairs = store(prefix_pairs(large, texts, least))
    second = _weighed(classes(pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))), texts, most).withColumnRenamed("large", "still")
    parted = large.select("same", "grams").join(second.select("same", "root", "still"), "same")
    out = out.unionByName(solved(parted.where("not still").select("root", "same", "grams")))
    if not second.where("still").limit(1).count():
        return out

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [overlap_classes([_wide(a.as_py(), 5), _wide(b.as_py(), 5)], least)[1] == 0 for a, b in zip(batch.column("g"), batch.column("h"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    grams = store(parted.where("still").dropDuplicates(["same"]).select("same", "grams"))
    sides = pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))
    sides = sides.join(grams.select(F.col("same").alias("a"), F.col("grams").alias("g")), "a").join(grams.select(F.col("same").alias("b"), F.col("grams").alias("h")), "b")
    return out.unionByName(sides.select("a", "b", "g", "h").mapInArrow(apart, "a bigint, b bigint"))


def _same(split: list[list[bytes]]) -> np.ndarray:
    """A hash of all words in order, for each text."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(b" ".join(x)) for x in split], np.uint64).view(np.int64)


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Two tables. Rows (id, raw, same), a row for each document with an id: raw is the xxhash64 of its text, same that of its
    lower-cased words. Texts (same, rows, root, class_id): root names the text's class of near copies, class_id is the least id in
    it, rows the number of its rows. Texts whose sets of `words`-word shingles overlap by `least` or more are near copies, and so are chains of them.

    Candidates come from the SimHash fingerprints of the shingles, and from an exact prefix filter for what these miss (few changed words move
    half of the bits of a fingerprint of long shingles): in one order of all shingles, two sets of n and m that overlap so far share one of the first
    n - ceil(least * n) + 1 and m - ceil(least * m) + 1. Every candidate that isn't of its partner's class yet is checked by the exact
    overlap. Shared shingles come last in the order, so passages that many texts hold bring few texts together."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = _shared(rows, words)
    order = np.argsort(shared)
    sent = rows.sparkSession.sparkContext.broadcast((shared[order], order.astype(np.uint64)))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        by_hash, place = sent.value
        for block in text_blocks(batches):
            split = [x.lower().split() for x in as_bytes(block.column("text"))]
            same = _same(split)
            n, prefix, last, fp = np.zeros(len(split), np.int32), [b""] * len(split), np.zeros(len(split), np.uint64), np.zeros(len(split), np.uint64)
            done: dict[int, int] = {}
            for i, (x, k) in enumerate(zip(split, same.tolist(), strict=True)):
                if (j := done.setdefault(k, i)) < i:  # a copy within the block
                    n[i], last[i], fp[i] = n[j], last[j], fp[j]
                    continue
                grams = shingles(x, words, hashes)
                n[i] = len(grams)
                first = _ordered(grams, by_hash, place)[: _prefix(len(grams), least)]
                prefix[i], last[i] = first.tobytes(), first[-1]
                fp[i] = fingerprint(b" ".join(x), words)
            last = (last ^ np.uint64(1 << 63)).view(np.int64)  # the same order in signed numbers
            yield pa.RecordBatch.from_arrays([block.column("id"), block.column("raw"), pa.array(same), pa.array(n), pa.array(last), pa.array(fp.view(np.int64)), pa.array(prefix, pa.binary())], ["id", "raw", "same", "n", "last", "fp", "prefix"])

    kind = rows.schema["id"].dataType.simpleString()
    marked = store(rows.withColumn("raw", F.xxhash64("text")).mapInArrow(mark, f"id {kind}, raw bigint, same bigint, n int, last bigint, fp bigint, prefix binary"))
    texts = store(marked.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("rows"), F.min("n").alias("n"), F.min("last").alias("last"), F.min("fp").alias("fp")))
    near = store(overlap_links(marked, texts, rows, words, least, sent))
    of = classes(near)
    member = store(texts.join(of, texts["same"] == of["node"], "left").select("same", "rep", "rows", F.coalesce("root", "same").alias("root")))
    top = store(member.groupBy(F.col("root").alias("top")).agg(F.min("rep").alias("class_id"), F.count("*").alias("m")))
    classed = store(join_hot(member, top, "root", "top", "m", member.count()).select("same", "rows", "root", "class_id"))
    drop(near, member, top)
    return marked.select("id", "raw", "same"), classed


def _prefix(n: int, least: float) -> int:
    return n - int(np.ceil(least * n - 1e-9)) + 1


def copy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """id and component_id (the least id of the class of near copies, see `text_classes`), a row for each document with an id. An id that
    has several texts has a row for each of them."""
    rows, texts = text_classes(docs, id_col, text_col, words, least)
    out = join_hot(rows, texts.withColumnRenamed("same", "s"), "same", "s", "rows", rows.count())
    return out.select(F.col("id").alias(id_col), F.col("class_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each class of near copies: that with the smallest id (of several texts of that id in the class, that of the
    least hash; of rows that repeat both, one of them). An id that has texts of several classes stays in each class whose least id it
    is. Rows without an id stay. All columns stay."""
    rows, texts = text_classes(docs, id_col, text_col, words, least)
    total = rows.count()
    of = store(join_hot(rows, texts.withColumnRenamed("same", "s"), "same", "s", "rows", total).select("id", "raw", "root", "class_id"))
    stays = store(of.where("id = class_id").groupBy("root", "id").agg(F.min("raw").alias("raw"), F.count("*").alias("n")))
    # ids that repeat need more than the comparison with the least id: their other rows are told apart by text, then by row
    some = store(of.join(stays.where("n > 1"), ["root", "id"]).select("id", of["raw"], (of["raw"] == stays["raw"]).alias("first")).groupBy("id", "raw").agg(F.max("first").alias("first"), F.count("*").alias("n")))
    gone = of.where("id <> class_id").select("id", "raw").unionByName(some.where("not first").select("id", "raw")).distinct()
    gone = store(gone.select(F.col("id").alias("_gone_id"), F.col("raw").alias("_gone_raw")))
    raw = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    kept = docs.join(gone, (F.col(id_col) == F.col("_gone_id")) & (raw == F.col("_gone_raw")), "left_anti")
    again = store(some.where("first and n > 1").select(F.col("id").alias("_again_id"), F.col("raw").alias("_again_raw")))
    if not again.limit(1).count():
        return kept
    on = (F.col(id_col) == F.col("_again_id")) & (raw == F.col("_again_raw"))
    one = kept.join(again, on, "left_semi").withColumn("_raw", raw).dropDuplicates([id_col, "_raw"]).drop("_raw")
    return kept.join(again, on, "left_anti").unionByName(one)
