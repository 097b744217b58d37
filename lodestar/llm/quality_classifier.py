"""Quality classifier on random-indexing word vectors.

Word vectors. Every word falls in one of ``BUCKETS`` hash buckets; each bucket
has a sparse random index vector (a few +1 and -1 among ``DIMENSIONS``), and a
bucket's context vector is the sum of the index vectors of its neighbours over
the whole corpus. Every task adds up its own matrix and emits it in
slices; slices are summed per slice number. The matrix has a fixed size, so it
can be collected and broadcast whatever the corpus holds.

Documents. A text's vector pools its words' unit vectors, frequent
words weighing less: mean and spread per dimension, with a few plain counts. A
two-layer network in numpy is fitted on a bounded, documented sample of labelled
rows (``sample_rows``, the lowest by hash of the id); a temperature fitted on a
fifth of the sample that the network never saw calibrates its probabilities.

Cases: null, empty and wordless texts have the zero vector and get the network's
score of it; with no label every score is 0.5, with one class only its
smoothed rate; repeated rows are scored alike; rows without an id are scored and
never learned from; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, HashedWords, hashed_space_words, mixed, text_column
from .language import remainder

BUCKETS = 1 << 14
DIMENSIONS = 64
ENTRIES = 4          # non-zero entries of an index vector
REACH = 2            # neighbours on each side
SLICES = 64
SAMPLE_ROWS = 20_000
HIDDEN = 32
_BATCH_WORDS = 400_000


def bucket(words: HashedWords) -> np.ndarray:
    return (words.hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's non-zero entries, from a hash."""
    h = mixed(np.arange(1, BUCKETS * ENTRIES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(BUCKETS, ENTRIES)
    return (h % np.uint64(DIMENSIONS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


class Contexts:
    """Sums of neighbours' index vectors, and word counts, by bucket."""

    def __init__(self):
        self.places, self.signs = index_vectors()
        self.total = np.zeros((BUCKETS, DIMENSIONS + 1), np.float64)
        self.waiting: list[np.ndarray] = []
        self.n = 0

    def add(self, buckets: np.ndarray) -> None:
        """One document; REACH empty places keep documents apart."""
        self.waiting += [buckets, np.full(REACH, -1, np.int64)]
        self.n += len(buckets)
        if self.n >= _BATCH_WORDS:
            self.flush()

    def flush(self) -> None:
        if not self.n:
            return
        b = np.concatenate(self.waiting)
        flat = np.zeros(BUCKETS * DIMENSIONS)
        for distance in range(1, REACH + 1):
            left, right = b[:-distance], b[distance:]
            both = (left >= 0) & (right >= 0)
            left, right = left[both], right[both]
            for entry in range(ENTRIES):
                for one, other in ((left, right), (right, left)):
                    flat += np.bincount(one * DIMENSIONS + self.places[other, entry], self.signs[other, entry], len(flat))
        self.total[:, :DIMENSIONS] += flat.reshape(BUCKETS, DIMENSIONS)
        self.total[:, DIMENSIONS] += np.bincount(b[b >= 0], minlength=BUCKETS)
        self.waiting, self.n = [], 0


def _context_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    contexts = Contexts()
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            for words in hashed_space_words(batch.column(0).slice(at, CHUNK).to_pylist()):
                if len(words):
                    contexts.add(bucket(words))
    contexts.flush()
    yield _slices(dict(enumerate(np.split(contexts.total.astype(np.float32), SLICES))))


def _slices(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()),
                                       pa.array([p.tobytes() for p in parts.values()], pa.binary())], ["slice", "part"])


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Memory: one slice array per slice number, however many parts come."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, part in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = np.frombuffer(part.as_buffer(), np.float32).astype(np.float64)
            sums[number] = sums[number] + values if number in sums else values
    yield _slices({k: v.astype(np.float32) for k, v in sums.items()})


def word_vectors(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors, weights) by bucket, from the neighbours of every word of
    the corpus, and the corpus's own pooled mean of vectors and of their squares."""
    parts = docs.select(F.col(text)).mapInArrow(_context_slices, "slice int, part binary")
    rows = parts.repartition("slice").mapInArrow(_sum_slices, "slice int, part binary").collect()  # SLICES rows
    total = np.zeros((BUCKETS, DIMENSIONS + 1))
    height = BUCKETS // SLICES
    for r in rows:
        total[r["slice"] * height:(r["slice"] + 1) * height] = np.frombuffer(r["part"], np.float32).reshape(height, -1)
    vectors, counts = total[:, :DIMENSIONS], total[:, DIMENSIONS]
    share = counts / max(counts.sum(), 1)
    vectors = vectors / np.maximum(counts, 1)[:, None]
    vectors -= share @ vectors
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    weights = 1e-3 / (1e-3 + share)
    usual = share * weights / max((share * weights).sum(), 1e-12)
    usual = np.concatenate([usual @ vectors, usual @ (vectors * vectors)])
    return vectors.astype(np.float32), weights.astype(np.float32), usual.astype(np.float32)


N_FEATURES = 2 * DIMENSIONS + 5


USUAL_WORDS = 16


def pooled(words: HashedWords, vectors: np.ndarray, weights: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """A text's features. Its words are pooled with ``USUAL_WORDS`` average words
    of the corpus, so that a text of a few words is not taken for an odd one."""
    out = np.zeros(N_FEATURES, np.float32)
    n = len(words)
    if n:
        b, times = np.unique(bucket(words), return_counts=True)
        w = weights[b] * times
        v = vectors[b]
        own = n / (n + USUAL_WORDS)
        w *= own / w.sum()
        mean = w @ v + (1 - own) * usual[:DIMENSIONS]
        out[:DIMENSIONS] = mean
        out[DIMENSIONS:2 * DIMENSIONS] = np.sqrt(np.maximum(w @ (v * v) + (1 - own) * usual[DIMENSIONS:] - mean * mean, 0))
        lengths = words.ends - words.starts
        again = float((words.hashes[1:] == words.hashes[:-1]).mean()) if n > 1 else 0.0
        out[-5:] = np.log1p(n) / 10, lengths.mean() / 20, len(b) / n, float(np.linalg.norm(mean)), again
    return out


@dataclass
class Network:
    """tanh layer, linear output, temperature. Inputs are standardised."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.shift) * self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, seed: int = 7) -> Network:
    """Adam on the log loss; every fifth row is kept for the temperature."""
    rng = np.random.default_rng(seed)
    kept = np.arange(len(x)) % 5 == 4
    xt, yt = x[~kept].astype(np.float64), y[~kept].astype(np.float64)
    shift, scale = xt.mean(axis=0), 1 / np.maximum(xt.std(axis=0), 1e-3)
    xt = (xt - shift) * scale
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
         rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, s, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(xt))
        for at in range(0, len(order), 256):
            rows = order[at:at + 256]
            h = np.tanh(xt[rows] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - yt[rows]) / len(rows)
            back = np.outer(error, p[2]) * (1 - h * h)
            grads = [xt[rows].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ error + 1e-4 * p[2], np.array([error.sum()])]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.999 * s[i] + 0.001 * g * g
                p[i] = p[i] - 3e-3 * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(s[i] / (1 - 0.999 ** t)) + 1e-8)
    net = Network(shift, scale, p[0], p[1], p[2], float(p[3][0]))
    if kept.any():
        z, yk = net.logits(x[kept]), y[kept]
        loss = {T: np.logaddexp(0, np.where(yk == 1, -z, z) / T).mean() for T in np.geomspace(0.25, 8, 61)}
        net.temperature = float(min(loss, key=loss.get))
    return net


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
                  folds: int = 5, held_out: int = 0, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted. Learns from labels outside the held-out fold."""
    spark = docs.sparkSession
    learnable = labels.select(F.col(doc_id).alias("i"), F.col(label).alias("y")).filter(
        (remainder(F.col("i"), folds) != held_out) & F.col("y").isin(0, 1))
    sample = learnable.orderBy(F.xxhash64("i"), "i", "y").limit(sample_rows)  # bounded by the parameter
    table = word_vectors(docs, text)
    shared = spark.sparkContext.broadcast(table)

    def vector():
        table = shared.value
        return lambda texts: [(pooled(w, *table).tobytes(),) for w in hashed_space_words(texts)]

    rows = (docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(sample), "i")
            .select("i", "y", text_column(vector, "v binary", chunks=True)(F.col("t")).alias("v")).select("i", "y", "v.v").collect())
    rows = sorted(rows, key=lambda r: (str(r["i"]), r["y"], r["v"]))
    y = np.array([r["y"] for r in rows])
    net: Network | None = None
    constant = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    if len(set(y.tolist())) == 2:
        net = fit(np.array([np.frombuffer(r["v"], np.float32) for r in rows]), y)
    model = spark.sparkContext.broadcast((table, net))

    def start():
        table, net = model.value

        def chunk(texts: list[str | None]) -> list[tuple]:
            if net is None:
                return [(float(constant),)] * len(texts)
            x = np.array([pooled(w, *table) for w in hashed_space_words(texts)])
            return [(s,) for s in net.scores(x).tolist()]

        return chunk

    scored = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(remainder(F.col(doc_id), folds) == held_out, F.lit(False)).alias("held_out"),
                         text_column(start, "score double", chunks=True)(F.col(text)).alias("p"))
    return scored.select("doc_id", "held_out", F.col("p.score").alias("score"),
                         (F.col("p.score") >= threshold).cast("int").alias("predicted"))
