"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word (a run of letters or digits, lower-cased) is the mean of the vectors of its character 3- to 5-grams with word ends
and of the word itself, all hashed into BUCKETS rows; a text is the mean of its words; a softmax layer on SCALE times that
gives the two classes. Vectors and layer are trained together, full batch, with Adam on cross-entropy. Misspelt words share most n-grams
with their pattern, so they score without having been seen.

A text is read as a whole and in passages: the mean of all its words, and that of its TOP best windows of WINDOW words (steps of half), each
averaged on its own, so a passage counts in a long text as in a short one. After a first fit on whole texts, training goes on with such
windows; of toxic texts the DOUBT share whose best window looks least toxic sits a round out, as their labels may be wrong, and words of less than
LEAST texts are not trained, so neither is learnt by heart. Long texts have more windows and so better best ones: a logistic layer over
passage, whole and the logarithm of the number of words, fitted on the CALIBRATE share of the sample that was held back, sets that off. Since the layer is linear,
each bucket's part of the class difference is one number and scoring adds up numbers.

Learning: at most about `per_class` labelled rows of each label, picked by a hash of the id, of at most `most_chars` characters (the bounds are parameters of the classifier only).
The model is BUCKETS numbers and a bias, whatever the input. Nulls: a null text is an empty one; a text without words scores like a short one of the usual words of class 0, and so do words whose n-grams were never trained. Labels that are null or not
0 or 1 teach nothing; a document labelled several times teaches with each. With less than FEW held-back rows of a class, the best window alone decides. With labels of one class only, or none, the model is the constant share of toxic labels.
Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield.llm.common import text_blocks
from voxfield.llm.langid import _tables

BUCKETS = 1 << 17
DIM = 8
SCALE = 3.0
WINDOW = 2
HARD = 12
ROUNDS = 4
TOP = 3
LEAST = 3
DOUBT = 0.2
CALIBRATE = 0.3
FEW = 10
MOST_CHARS = 1 << 18
PER_CLASS = 1500
STEPS = 25
DECAY = 0.02
_MULT = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points (lower case) of all texts, each word with a space before and after; the size of each word so; its text."""
    t = _tables()
    if "word" not in t:
        t["word"] = t["letter"].copy()
        t["word"][48:58] = True
    cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])
    edge = np.concatenate([[False], t["word"][cp], [False]])
    edge = np.flatnonzero(edge[1:] != edge[:-1])
    starts, size = edge[::2], edge[1::2] - edge[::2] + 2
    first = np.cumsum(size) - size
    out = np.full(int(size.sum()), 32, np.uint32)
    inner = np.ones(len(out), bool)
    inner[first], inner[first + size - 1] = False, False
    out[inner] = t["lower"][cp[t["word"][cp]]]
    return out, size, np.searchsorted(begin, starts, "right") - 1


def subwords(cp: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams: (places, 4) with -1 where no n-gram begins. Columns: 3-, 4-, 5-grams, whole word (at its start)."""
    n, first = len(cp), np.cumsum(size) - size
    left = np.repeat(first + size, size) - np.arange(n)  # code points from here to the word's end
    out = np.full((n, 4), -1, np.int32)
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    h = cp.astype(np.uint64) + np.uint64(1)
    wide = np.concatenate([cp.astype(np.uint64) + np.uint64(1), np.zeros(5, np.uint64)])
    for k in range(1, 5):
        h = (h * _MULT) ^ (h >> np.uint64(29)) ^ wide[k : k + n]
        if k >= 2:
            out[:, k - 2] = np.where(left > k, (h * _MULT) >> shift, -1).astype(np.int32)
    if len(size):
        place = np.arange(n) - np.repeat(first, size)
        power = np.cumprod(np.full(int(size.max()), _MULT, np.uint64))
        whole = np.add.reduceat(wide[:n] * power[place], first)
        out[first, 3] = ((whole ^ (whole >> np.uint64(31))) * _MULT >> shift).astype(np.int32)
    return out, first


def window_starts(n: int) -> np.ndarray:
    """Where the windows of a text of n words begin: every half window, and the last ones of it."""
    return np.append(np.arange(0, n - WINDOW, max(1, WINDOW // 2)), n - WINDOW) if n > WINDOW else np.zeros(1, np.int64)


class Model:
    def __init__(self, part: np.ndarray, bias: float, layer: np.ndarray | None = None, usual: float = 0.0):
        self.part, self.bias = part.astype(np.float32), bias  # each bucket's part of the class difference
        self.usual = usual  # the mean of the words of class 0: that of a text without words
        self.layer = layer  # weights of passage, whole and length, and a constant

    def word_scores(self, cp: np.ndarray, size: np.ndarray) -> np.ndarray:
        if not len(size):
            return np.zeros(0)
        ids, first = subwords(cp, size)
        padded = np.concatenate([self.part, np.zeros(1, np.float32)])  # -1 is the last
        total = np.add.reduceat(padded[ids].sum(1, dtype=np.float64), first)
        p = size.astype(np.int64)
        return total / (np.maximum(p - 2, 0) + np.maximum(p - 3, 0) + np.maximum(p - 4, 0) + 1)

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text: the mean of its TOP best windows, the mean of its words, the logarithm of 1 + their number."""
        cp, size, text = tokens(texts)
        words = self.word_scores(cp, size)
        count = np.bincount(text, minlength=len(texts))
        begin = np.cumsum(count) - count
        upto = np.concatenate([[0.0], np.cumsum(words)])
        whole = (upto[begin + count] - upto[begin]) / np.maximum(1, count)
        whole[count == 0] = self.usual
        best = whole.copy()
        for i in np.flatnonzero(count > WINDOW).tolist():
            a = begin[i] + window_starts(int(count[i]))
            each = (upto[a + WINDOW] - upto[a]) / WINDOW
            best[i] = np.sort(each)[-TOP:].mean()
        return np.stack([best, whole, np.log1p(count)], 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of class 1 for each text."""
        x = self.features(texts)
        z = SCALE * x[:, 0] + self.bias if self.layer is None else x @ self.layer[:3] + self.layer[3]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Weights and constant of a logistic layer, by Newton steps; class 1 weighs as the root of how much rarer it is."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    rows = np.c_[(x - mean) / spread, np.ones(len(x))]
    weight = np.where(y == 1, max(1.0, (y == 0).sum() / (y == 1).sum()) ** 0.5, 1.0)
    w = np.zeros(rows.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = (rows * (weight * p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(w))
        w -= np.linalg.solve(slope, rows.T @ (weight * (p - y)) + ridge * w)
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def _sums(values: np.ndarray, starts: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of runs of values, put at rows of an (n, dim) array."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(starts):
        out[rows] = np.add.reduceat(values, starts, axis=0)
    return out


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return starts, keys[starts]


class _Trainer:
    """The words of the sample as sequences of numbers, and vectors and layer that are trained on units of them."""

    def __init__(self, texts: list[str], seed: int):
        number: dict[str, int] = {}
        words, docs = [], []
        for k in range(0, len(texts), 200):
            cp, _, text = tokens(texts[k : k + 200])
            words.append(np.array([number.setdefault(x, len(number)) for x in cp.tobytes().decode("utf-32-le", "surrogatepass").split()], np.int32))
            docs.append(text + k)
        self.words, docs = np.concatenate(words), np.concatenate(docs)
        self.count = np.bincount(docs, minlength=len(texts))
        self.begin = np.cumsum(self.count) - self.count
        self.often = np.bincount(np.unique(docs.astype(np.int64) << 32 | self.words) & 0xFFFFFFFF, minlength=len(number))
        cp, size, _ = tokens(list(number))
        ids, self.first = subwords(cp, size)
        flat = ids.reshape(-1)
        at = np.concatenate([self.first, [len(cp)]]) * 4
        upto = np.concatenate([[0], np.cumsum(flat >= 0)])
        self.grams, self.gram_at = flat[flat >= 0], upto[at]  # the n-grams of word w are grams[gram_at[w]:gram_at[w + 1]]
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.touched = np.zeros(BUCKETS, bool)
        self.layer, self.bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)

    def word_scores(self) -> np.ndarray:
        part = np.where(self.touched, self.vectors @ (self.layer[:, 1] - self.layer[:, 0]), 0)
        return (np.add.reduceat(part[self.grams], self.gram_at[:-1]) / np.diff(self.gram_at))[self.words]

    def unit_scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0.0], np.cumsum(self.word_scores())])
        return (upto[b] - upto[a]) / np.maximum(1, b - a)

    def windows(self, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, last+1) of each document's most[i] best windows."""
        upto = np.concatenate([[0.0], np.cumsum(self.word_scores())])
        out = []
        for i, (a, n) in enumerate(zip(self.begin.tolist(), self.count.tolist(), strict=True)):
            starts = window_starts(n) + a
            ends = np.minimum(starts + WINDOW, a + n)
            value = (upto[ends] - upto[starts]) / np.maximum(1, ends - starts)
            out += [(i, starts[j], ends[j]) for j in np.argsort(-value, kind="stable")[: most[i]].tolist()]
        return tuple(np.array(x, np.int64) for x in zip(*out, strict=True))

    def train(self, a: np.ndarray, b: np.ndarray, labels: np.ndarray, steps: int, least: int) -> None:
        """Adam on the units words[a[i]:b[i]]; only words of `least` documents or more are trained."""
        size = b - a
        unit = np.repeat(np.arange(len(a)), size)
        word = self.words[np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        keep = self.often[word] >= least
        pairs, times = np.unique(unit[keep].astype(np.int64) << 32 | word[keep], return_counts=True)
        d_of, (vocabulary, v_of) = pairs >> 32, np.unique(pairs & 0xFFFFFFFF, return_inverse=True)
        weight = (times / np.maximum(1, size)[d_of]).astype(np.float32)[:, None]
        spans = self.gram_at[vocabulary + 1] - self.gram_at[vocabulary]
        w_of = np.repeat(np.arange(len(vocabulary)), spans)
        used, b_of = np.unique(self.grams[np.repeat(self.gram_at[vocabulary] - (np.cumsum(spans) - spans), spans) + np.arange(int(spans.sum()))], return_inverse=True)
        share = (1.0 / np.maximum(1, spans)).astype(np.float32)[:, None]
        back, turn = np.argsort(b_of, kind="stable"), np.argsort(v_of, kind="stable")
        w_runs, b_runs, d_runs, v_runs = _runs(w_of), _runs(b_of[back]), _runs(d_of), _runs(v_of[turn])
        self.touched[used] = True
        vectors, layer, bias = self.vectors[used], self.layer, self.bias
        truth = np.eye(2, dtype=np.float32)[labels]
        balance = (0.5 / np.maximum(1, np.bincount(labels, minlength=2))).astype(np.float32)[labels][:, None]
        state = [[np.zeros_like(x), np.zeros_like(x)] for x in (vectors, layer, bias)]
        for step in range(1, steps + 1):
            of_words = _sums(vectors[b_of], *w_runs, len(vocabulary)) * share
            of_units = _sums(of_words[v_of] * weight, *d_runs, len(a))
            z = SCALE * of_units @ layer + bias
            z = np.exp(z - z.max(1, keepdims=True))
            error = (z / z.sum(1, keepdims=True) - truth) * balance
            g_units = SCALE * error @ layer.T
            g_words = _sums(g_units[d_of[turn]] * weight[turn], *v_runs, len(vocabulary)) * share
            grads = [_sums(g_words[w_of[back]], *b_runs, len(used)), SCALE * of_units.T @ error, error.sum(0)]
            for x, g, (m, v), rate in zip((vectors, layer, bias), grads, state, (0.05, 0.02, 0.05), strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x *= 1 - rate * DECAY
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        self.vectors[used] = vectors


def fit(texts: list[str], labels: np.ndarray, prior: float, rounds: int = ROUNDS, seed: int = 7) -> Model:
    """Trains vectors and layer together: first on whole texts, then in rounds on the windows that the model so far scores
    highest (one of each toxic text, HARD of each other one), which is what scoring looks at. Then fits the layer over passage, whole and length."""
    labels = labels.astype(np.int64)
    p = min(max(prior, 1e-3), 1 - 1e-3)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    back = np.random.default_rng(seed).random(len(labels)) < CALIBRATE
    if min(np.bincount(labels[back], minlength=2)) < FEW or labels[~back].min() == labels[~back].max():
        back[:] = False
    some = np.flatnonzero(~back)
    t, y = _Trainer([texts[i] for i in some], seed), labels[some]
    least = LEAST if len(some) >= 50 * LEAST else 1
    t.train(t.begin, t.begin + t.count, y, STEPS, least)
    for _ in range(rounds):
        doc, a, b = t.windows(np.where(y == 1, 1, HARD))
        score = t.unit_scores(a, b)
        sure = (y[doc] == 0) | (score >= np.quantile(score[y[doc] == 1], DOUBT))
        t.train(a[sure], b[sure], y[doc][sure], STEPS, least)
    # n-grams that were never trained count like the usual word of class 0, not like one between the classes
    of_words, clean = t.word_scores(), np.repeat(y == 0, t.count)
    usual = float(of_words[clean].mean()) if clean.any() else 0.0
    part, bias = np.where(t.touched, t.vectors @ (t.layer[:, 1] - t.layer[:, 0]), usual), float(t.bias[1] - t.bias[0])
    bare = Model(part, bias, None, usual)
    if not back.any():
        return bare
    return Model(part, bias, logistic(bare.features([texts[i] for i in np.flatnonzero(back)]), labels[back]), usual)


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> Model:
    """Trains on at most about per_class rows of each label of `labels` (id, label), which holds the rows that may teach."""
    rows = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    seen = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not seen:
        return fit([], np.zeros(0), 0.0)
    share = F.create_map(*[F.lit(x) for y, n in seen.items() for x in (y, min(1.0, per_class / n))])
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 24)) < share[F.col("y")] * (1 << 24))
    # the picked ids number about 2 * per_class, whatever the input, so they are sent to the texts; ids that repeat don't make the sample larger
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.length("text") <= most_chars)
    got = texts.join(F.broadcast(picked), "id").select("id", "text", "y").orderBy(F.xxhash64("id", "text", "y")).limit(3 * per_class).toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["id"][i].as_py(), got["text"][i].as_py(), got["y"][i].as_py()))
    texts, y = got["text"].to_pylist(), got["y"].to_pylist()
    return fit([texts[i] for i in order], np.array([y[i] for i in order]), seen.get(1, 0) / sum(seen.values()))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1), a row for each document; no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, most=1 << 20):
            got = model.scores([x or "" for x in block.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(got, pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
