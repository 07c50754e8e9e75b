"""Quality classifier: random-indexing word vectors, pooled, and a two-layer numpy network.

Every token has a sparse ternary index vector drawn from its hash. A token's word vector is its
index vector plus the normalised sum of the index vectors around it in the training texts. A text is the mean
of its tokens' vectors, the length of that mean, and how often its tokens repeat; a network with
one hidden layer maps that to a logit, and a temperature fitted on training rows that the
network didn't see calibrates the probability.

The model is fitted on the driver from at most ``MAX_TRAIN`` labelled documents and ``MAX_BYTES`` of their texts
(the lowest hashes of doc_id, a documented bound); every row of the input is scored, over its whole text.

Defined results: a null or empty text is a text without tokens and gets that vector's score; rows
with a null label or id aren't learned from; without any labelled row every score is 0.5;
repeated rows get equal scores, and a long text is pooled whole, some tokens at a time; ties in the order of the sample
go by id; an empty table gives no rows. The result has its own columns only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import hash_spans, map_texts, mix, text_bytes

#: Most labelled rows that a model is fitted on.
MAX_TRAIN = 5000
#: Most bytes of text that a model is fitted on.
MAX_BYTES = 64 << 20
DIM = 32
BUCKETS = 1 << 15
NONZERO = 4
CONTEXT = 2
HIDDEN = 32
CUT = 0.7

_KIND = np.full(256, 2, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = 1


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (runs of ASCII punctuation, or of what is neither that nor white space) and,
    by row, the number of its first one (one more than rows)."""
    raw, offsets = text_bytes(column)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = _KIND[raw]
    change = np.flatnonzero(np.diff(kind)) + 1
    edges = np.unique(np.concatenate([[0], change, offsets[offsets < len(raw)], [len(raw)]]))
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    return hash_spans(raw, starts, ends), np.searchsorted(starts, offsets)


def index_vectors() -> np.ndarray:
    """One sparse ternary vector for each bucket, from the bucket's number alone."""
    out = np.zeros((BUCKETS, DIM), np.float32)
    bucket = np.arange(BUCKETS)
    for k in range(NONZERO):
        h = mix(bucket.astype(np.uint64) * np.uint64(NONZERO) + np.uint64(k + 1))
        np.add.at(out, (bucket, (h % np.uint64(DIM)).astype(int)), np.where(h >> np.uint64(63), 1, -1).astype(np.float32))
    return out


def word_vectors(bucket: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Index vectors plus contexts gathered over the training tokens."""
    index = index_vectors()
    context = np.zeros_like(index)
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    for away in range(1, CONTEXT + 1):
        near = row[away:] == row[:-away]
        left, right = bucket[:-away][near], bucket[away:][near]
        for d in range(DIM):
            context[:, d] += np.bincount(left, index[right, d], BUCKETS)
            context[:, d] += np.bincount(right, index[left, d], BUCKETS)
    size = np.linalg.norm(context, axis=1, keepdims=True)
    return index + np.where(size > 0, context / np.maximum(size, 1e-9) * np.sqrt(NONZERO), 0).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features by row: the mean vector, its length, the share of distinct tokens, the largest token's
    share, and the logarithm of the number of tokens."""
    hashes, bounds = tokens(column)
    n = np.diff(bounds)
    out = np.zeros((len(n), DIM + 4), np.float32)
    bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    rows = np.flatnonzero(n)
    at = 0
    while at < len(rows):  # so many tokens at a time that their vectors stay small
        stop = max(at + 1, int(np.searchsorted(bounds[rows + 1], bounds[rows[at]] + 100_000, side="right")))
        part = rows[at:stop]
        lo, hi = bounds[part[0]], bounds[part[-1] + 1]
        if len(part) == 1 and hi - lo > 100_000:
            total = sum(vectors[bucket[i : min(i + 100_000, hi)]].sum(0) for i in range(lo, hi, 100_000))
            out[part[0], :DIM] = total / (hi - lo)
        else:
            out[part, :DIM] = np.add.reduceat(vectors[bucket[lo:hi]], bounds[part] - lo, axis=0) / n[part][:, None]
        at = stop
    row = np.repeat(np.arange(len(n)), n)
    key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    of = (key[begin] >> np.uint64(40)).astype(np.int64)
    many = np.diff(np.append(begin, len(key)))
    distinct = np.bincount(of, minlength=len(n))
    largest = np.zeros(len(n), np.int64)
    np.maximum.at(largest, of, many)
    some = np.maximum(n, 1)
    out[:, DIM] = np.linalg.norm(out[:, :DIM], axis=1)
    out[:, DIM + 1] = distinct / some
    out[:, DIM + 2] = largest / some
    out[:, DIM + 3] = np.log1p(n)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: list
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((features - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, column: pa.Array) -> np.ndarray:
        return _sigmoid(self.logits(pooled(column, self.vectors)).astype(np.float64) / self.temperature)


def _network(x: np.ndarray, y: np.ndarray, steps: int = 600, seed: int = 5) -> list:
    """Two layers, trained by Adam on the cross-entropy with a little weight decay."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, steps + 1):
        pick = rng.integers(0, len(x), min(len(x), 512))
        xb, yb = x[pick], y[pick]
        h = np.tanh(xb @ w[0] + w[1])
        g = (_sigmoid(h @ w[2] + w[3]) - yb) / len(xb)
        back = np.outer(g, w[2]) * (1 - h * h)
        grads = [xb.T @ back + 1e-4 * w[0], back.sum(0), h.T @ g + 1e-4 * w[2], g.sum()]
        for k, grad in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            w[k] = w[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w


def train(texts: pa.Array | list, labels: list[int]) -> Model:
    """Fit vectors, network and temperature. Every fifth row only calibrates the temperature."""
    vectors = index_vectors()
    if not len(texts):
        zero = np.zeros(DIM + 4, np.float32)
        return Model(vectors, zero, zero + 1, [np.zeros((DIM + 4, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0], 1.0)
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    parts = [column.slice(k, 256) for k in range(0, len(column), 256)]  # few texts at a time on the driver
    buckets, counts = [], []
    for part in parts:
        hashes, bounds = tokens(part)
        buckets.append((hashes % np.uint64(BUCKETS)).astype(np.int32))
        counts.append(np.diff(bounds))
    vectors = word_vectors(np.concatenate(buckets), np.concatenate([[0], np.cumsum(np.concatenate(counts))]))
    x, y = np.concatenate([pooled(part, vectors) for part in parts]), np.array(labels, np.float64)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    spare = np.arange(len(x)) % 5 == 4
    z = ((x - mean) / scale).astype(np.float64)
    model = Model(vectors, mean, scale, _network(z[~spare], y[~spare]), 1.0)
    if spare.any():
        logits = model.logits(x[spare]).astype(np.float64)
        tried = np.exp(np.linspace(-1.5, 2.5, 81))
        loss = [-np.mean(np.where(y[spare] == 1, np.log(_sigmoid(logits / t) + 1e-12), np.log(1 - _sigmoid(logits / t) + 1e-12))) for t in tried]
        model.temperature = float(tried[int(np.argmin(loss))])
    return model


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from labelled documents outside the held-out quarter: those with the lowest hashes of their ids, ``max_train``
    rows and ``MAX_BYTES`` of text at most. Of several labels of an id the lowest counts, of several texts one of them."""
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).filter("__id is not null and __y in (0, 1)")
    known = known.filter(~held_out(F.col("__id")))
    known = known.groupBy("__id").agg(F.min("__y").alias("__y"))
    # ids of documents that have a label, so that labels of other documents take no place; texts are only measured here
    sizes = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("__size"))
    sizes = sizes.groupBy("__id").agg(F.max("__size").alias("__size"))
    ids = known.join(sizes, "__id").withColumn("__h", F.xxhash64("__id")).orderBy("__h", "__id").limit(max_train)
    # over max_train rows at most
    so_far = Window.orderBy("__h", "__id").rowsBetween(Window.unboundedPreceding, 0)
    ids = ids.withColumn("__so_far", F.sum("__size").over(so_far)).filter(F.col("__so_far") <= MAX_BYTES).select("__id", "__y", "__h")
    # 24 bytes a row, so the broadcast is bounded
    text = F.col(text_col).cast("string").alias("__text")
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), text).join(F.broadcast(ids), "__id").dropDuplicates(["__id"])
    got = rows.select("__h", "__id", "__text", "__y").orderBy("__h", "__id").limit(max_train).toArrow()
    return train(got.column("__text").combine_chunks(), got.column("__y").to_pylist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = sent.value.scores(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = map_texts(rows, work, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
