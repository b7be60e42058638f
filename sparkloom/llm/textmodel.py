"""Hashed word and character n-gram logistic regression, trained on a bounded labelled sample and calibrated.

A text's features are the shares of its hashed n-grams: character 3-grams (bytes), words, and word pairs, each
family in its own range of one weight table. A linear score over such shares is the mean weight of a text's
n-grams, so texts are scored by a gather and a sum over segments, without building feature vectors.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import common, workers

#: log2 of the hashed features of each family.
FAMILY_BITS = (12, 12, 12)
#: Bytes of text that are hashed at once.
SLICE_BYTES = 500_000
#: Labelled rows of each class that training uses at most, and the share of them held out for calibration.
SAMPLE_PER_CLASS = 1500
HELD_OUT = 4
#: N-grams without weight that every text is given, so that a few n-grams don't decide alone.
HELD_BACK = (30, 6, 6)
#: A text with fewer bytes than a 3-gram has no character features; one without words no word features.
_M1, _M2, _M3 = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Stretches of the array of up to `limit` bytes, one text at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield texts[at:stop]
        at, done = stop, int(sizes[stop - 1])


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last ends); nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of every word: what stands between ASCII white space or the ends of a text."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    solid = ~space
    before = np.empty(n, bool)
    if n:
        before[0] = True
        before[1:] = space[:-1]
    begin = np.flatnonzero(solid & (before | edge[:n]))
    after = np.empty(n, bool)
    if n:
        after[-1] = True
        after[:-1] = space[1:]
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    return begin, end, np.searchsorted(bounds, begin, "right") - 1


#: Random numbers for a byte at each place of a word; places further on use them anew.
_PLACES = 256
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, (_PLACES, 256), np.uint64, endpoint=False).reshape(-1)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit tabulation hash of each word's bytes and length."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = end - begin
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    byte = data[place + np.repeat(begin, size)]
    h = np.add.reduceat(_TABLE[(place % _PLACES << 8) | byte], first)
    return mix(h ^ size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Batch:
    """The bytes, words and word hashes of some texts, worked out once."""

    def __init__(self, texts: pa.Array):
        self.size = len(texts)
        self.data, self.bounds = raw_bytes(texts)
        self.begin, self.end, self.owner = word_spans(self.data, self.bounds)
        self.hashes = word_hashes(self.data, self.begin, self.end)

    def grams(self):
        """For each family: (feature, whether it counts, where each text's begin) of every n-gram."""
        n = len(self.data)
        if n >= 3:
            d = self.data.astype(np.uint32)
            h = (d[:-2] * _M1) ^ (d[1:-1] * _M2) ^ (d[2:] * _M3)
            h ^= h >> np.uint32(15)
            feature = (h * _M1) >> np.uint32(32 - FAMILY_BITS[0])
            ok = np.ones(n - 2, bool)
            for back in (1, 2):  # grams across two texts don't count
                at = self.bounds[1:-1] - back
                ok[at[(at >= 0) & (at < n - 2)]] = False
            yield feature, ok, np.minimum(self.bounds, n - 2)
        else:
            yield np.zeros(0, np.uint32), np.zeros(0, bool), np.zeros(self.size + 1, np.int64)
        shift = 1 << FAMILY_BITS[0]
        w, starts = self.hashes, np.searchsorted(self.begin, self.bounds)
        yield (w >> np.uint64(64 - FAMILY_BITS[1])).astype(np.uint32) + np.uint32(shift), np.ones(len(w), bool), starts
        shift += 1 << FAMILY_BITS[1]
        if len(w) > 1:
            pair = (mix(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:]) >> np.uint64(64 - FAMILY_BITS[2])).astype(np.uint32)
            pair[w[:-1] == w[1:]] = 0  # a word said twice is a feature of its own
            yield pair + np.uint32(shift), self.owner[:-1] == self.owner[1:], np.minimum(starts, len(pair))
        else:
            yield np.zeros(0, np.uint32), np.zeros(0, bool), np.zeros(self.size + 1, np.int64)


DIMENSIONS = sum(1 << b for b in FAMILY_BITS)


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def vectors(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse features (indices, shares) of each text."""
    found: list[list] = [[] for _ in range(len(texts))]
    for (feature, ok, starts), held_back in zip(Batch(texts).grams(), HELD_BACK):
        for i in range(len(texts)):
            lo, hi = int(starts[i]), int(starts[i + 1])
            own = feature[lo:hi][ok[lo:hi]]
            if len(own):
                index, count = np.unique(own, return_counts=True)
                found[i].append((index.astype(np.int32), (count / (len(own) + held_back)).astype(np.float32)))
    empty = (np.zeros(0, np.int32), np.zeros(0, np.float32))
    return [tuple(np.concatenate(x) for x in zip(*f)) if f else empty for f in found]


@dataclass
class TextModel:
    """weights over the families, bias, and the calibration: probability = sigmoid(slope * score + offset)."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, batch: Batch) -> np.ndarray:
        s = np.full(batch.size, self.bias)
        for (feature, ok, starts), held_back in zip(batch.grams(), HELD_BACK):
            value = self.weights[feature]
            if not ok.all():
                value[~ok] = 0
            s += segment_sums(value, starts) / np.maximum(segment_sums(ok, starts) + held_back, 1)
        return s

    def log_odds(self, batch: Batch) -> np.ndarray:
        """Calibrated log odds of label 1 for each text of the batch."""
        return self.slope * self.scores(batch) + self.offset


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 250) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent; y is 0 or 1."""
    n, d = x.shape
    norms = np.einsum("ij,ij->i", x, x)
    w, b = np.zeros(d, np.float32), 0.0
    v, c, t = w.copy(), b, 1.0
    weight = weight / weight.sum()
    # The curvature is at most a quarter of the largest weighted row norm, summed.
    rate = 1.0 / (0.25 * float((weight * (norms + 1)).max() * n) + penalty)
    for _ in range(steps):
        g = (weight * (sigmoid(x @ v + c) - y)).astype(np.float32)
        w2, b2 = v - rate * (x.T @ g + penalty * v), c - rate * float(g.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2.astype(np.float32), b2, t2
        v = v.astype(np.float32)
    return w, b


def calibrate(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's two parameters by Newton steps, with his smoothed targets and the slope kept positive."""
    n1, n0 = float(weight[y == 1].sum()), float(weight[y == 0].sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * scores + b)
        r = weight * (p - target)
        q = np.maximum(weight * p * (1 - p), 1e-9)
        g = np.array([r @ scores + 1e-3 * (a - 1), r.sum()])
        h = np.array([[q @ (scores * scores) + 1e-3, q @ scores], [q @ scores, q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> tuple[list, dict[int, int]]:
    """(rows of (doc_id, class, indices, shares), labelled rows of each class).

    Only labels of the given documents count. Of each class the `per_class` documents whose ids hash lowest are taken;
    rows with a null id or label don't count. Class sizes cover all labelled ones of the given documents. Of rows with
    one doc_id the least text counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").distinct()
    at_hand = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    known = common.materialize(known.join(at_hand, "doc_id", "left_semi"), "labels-at-hand")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionAll(some)

    @F.arrow_udf("struct<i:array<int>,x:array<float>>")
    def features(text: pa.Array) -> pa.Array:
        rows = [v for part in slices(text) for v in vectors(part)]
        kind = pa.struct([("i", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))])
        return pa.array([{"i": i, "x": x} for i, x in rows], kind)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The sample is bounded by per_class, so it can be sent to every task.
    texts = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = texts.select("doc_id", "y", features("text").alias("f")).select("doc_id", "y", "f.i", "f.x").toArrow()
    out = list(zip(rows["doc_id"].to_pylist(), rows["y"].to_pylist(), (np.asarray(x.values) for x in rows["i"]), (np.asarray(x.values) for x in rows["x"])))
    return sorted(out, key=lambda r: (r[0], len(r[2]))), sizes


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS, scale: float = 30.0, penalty: float = 1e-3) -> TextModel:
    """Train on most of the sample; calibrate on the rest, weighted to the classes' sizes among all labelled ones of `docs`.

    Without labelled documents of both classes among `docs` the model knows nothing: every text gets the classes' log
    odds. If only good ones are labelled, or none, all texts are held good; if only bad ones, all are held bad.
    """
    rows, sizes = labelled_sample(docs, labels, label, per_class)
    prior = float(np.log((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1)))
    y = np.array([r[1] for r in rows], np.float64)
    if len(rows) < 2 * HELD_OUT or y.min() == y.max():
        return TextModel(np.zeros(DIMENSIONS, np.float32), 0.0, 1.0, prior)
    held = np.array([k % HELD_OUT == 0 for k in range(len(rows))])
    x = np.zeros((int((~held).sum()), DIMENSIONS), np.float32)  # only the rows to train on are made dense
    for k, row in enumerate(np.flatnonzero(~held).tolist()):
        x[k, rows[row][2]] = rows[row][3] * scale
    balance = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    w, b = fit_logistic(x, y[~held], balance[~held], penalty)
    del x
    scores = np.array([w[rows[k][2]] @ rows[k][3] * scale + b for k in np.flatnonzero(held).tolist()])
    share = np.where(y == 1, sizes.get(1, 0) / max((y == 1).sum(), 1), sizes.get(0, 0) / max((y == 0).sum(), 1))
    share = share * held.sum() / max(float(share[held].sum()), 1e-9)
    slope, offset = calibrate(scores, y[held], share[held])
    return TextModel((w * scale).astype(np.float32), float(b), slope, offset)


def log_odds_udf(model: TextModel):
    """An Arrow UDF from text to the calibrated log odds of label 1."""
    frozen = pickle.dumps(model)

    @F.arrow_udf("double")
    def log_odds(text: pa.Array) -> pa.Array:
        workers.forget()
        model = _thawed(frozen)
        out = np.concatenate([np.zeros(0), *(model.log_odds(Batch(part)) for part in slices(text))])
        workers.trim()
        return pa.array(out, pa.float64())

    return log_odds


_last: tuple[bytes, TextModel] | None = None


def _thawed(frozen: bytes) -> TextModel:
    global _last
    if _last is None or _last[0] != frozen:
        _last = (frozen, pickle.loads(frozen))
    return _last[1]
