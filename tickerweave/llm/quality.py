"""Quality classifier: random-indexing word vectors, pooled, then a small network.

Each token has a fixed sparse random index vector. Its word vector is the sum
of the index vectors of its neighbours at every place where it stands in the
corpus, over all documents; tokens share ``rows`` hashed rows. A document is
the mean of its tokens' (normalised) word vectors. A two-layer numpy network is
trained on labelled documents, and its logits are divided by a temperature
fitted on labelled documents that training did not see.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, pieces, ready

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


class Row(dict):
    """token -> hashed row; tokens keep their case, as capitals tell something."""

    def __init__(self, rows: int):
        super().__init__()
        self.rows = rows

    def __missing__(self, token: str) -> int:
        if len(self) > 150_000:
            self.clear()
        made = self[token] = xxhash.xxh3_64_intdigest(token) % self.rows
        return made


_ROWS: dict[int, Row] = {}


def token_rows(text: str, rows: int) -> np.ndarray:
    get = alone(_ROWS.setdefault(rows, Row(rows))).__getitem__
    tokens = TOKEN.findall(text)
    return np.fromiter(map(get, tokens), np.int32, len(tokens))


def index_vectors(rows: int, dims: int, seed: int = 7, ones: int = 8) -> np.ndarray:
    """Sparse ternary vectors: ``ones`` entries of +1 or -1 each."""
    rng = np.random.default_rng(seed)
    made = np.zeros((rows, dims), np.int8)
    where = np.argsort(rng.random((rows, dims)), axis=1)[:, :ones]
    np.put_along_axis(made, where, rng.choice(np.array([-1, 1], np.int8), (rows, ones)), axis=1)
    return made


def contexts(docs: list[np.ndarray], index: np.ndarray, into: np.ndarray, window: int = 2) -> None:
    """Adds the neighbours' index vectors to each token's row of ``into``; a document's end is no neighbour."""
    pad = np.full(window, len(index) - 1, np.int32)  # the last row is all zero
    for at in range(0, len(docs), 64):
        part = docs[at : at + 64]
        flat = np.concatenate([x for d in part for x in (d, pad)] + [pad])
        real = np.flatnonzero(flat != len(index) - 1)
        for lo in range(0, len(real), 65_536):
            here = real[lo : lo + 65_536]
            around = np.zeros((len(here), index.shape[1]), np.int16)
            for o in range(1, window + 1):
                around += index[flat[here + o]]
                around += index[flat[here - o]]
            rows = flat[here]
            order = np.argsort(rows, kind="stable")
            r = rows[order]
            first = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1])
            into[r[first]] += np.add.reduceat(around[order], first, axis=0, dtype=np.int32)


def word_vectors(docs: DataFrame, rows: int, dims: int, window: int = 2) -> np.ndarray:
    """[rows, dims] over all documents: sums by task, then by row across tasks. Its size is fixed by the parameters."""

    def work(batches):
        index = np.vstack([index_vectors(rows, dims), np.zeros((1, dims), np.int8)])
        total = np.zeros((rows + 1, dims), np.int32)
        for batch in pieces(batches):
            contexts([token_rows(t, rows) for t in batch.column(0).to_pylist() if t], index, total, window)
        block = 64  # rows go out in blocks
        for b in range(0, rows, block):
            part = total[b : b + block]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part[: rows - b].astype(np.int64).tobytes()], pa.binary())], ["b", "v"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.int64) for v in table.column("v").to_pylist())
        return pa.table({"b": table.column("b")[:1], "v": pa.array([total.tobytes()], pa.binary())})

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(work, "b int, v binary").groupBy("b").applyInArrow(add, "b int, v binary")
    made = np.zeros((rows, dims))
    for r in sums.collect():
        v = np.frombuffer(bytes(r.v), np.int64).reshape(-1, dims)
        made[r.b : r.b + len(v)] = v
    norm = np.linalg.norm(made, axis=1, keepdims=True)
    return (made / np.maximum(norm, 1.0)).astype(np.float32)


def pool(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector; zeros for a text without tokens."""
    ids = token_rows(text, len(vectors)) if text else ()
    if not len(ids):
        return np.zeros(vectors.shape[1], np.float32)
    total = np.zeros(vectors.shape[1], np.float64)
    for at in range(0, len(ids), 4096):
        total += vectors[ids[at : at + 4096]].sum(axis=0, dtype=np.float64)
    return (total / len(ids)).astype(np.float32)


class Network:
    """Two layers, tanh between them, trained with Adam on the weighted log loss; probabilities calibrated by a temperature."""

    def __init__(self, dims: int, hidden: int = 32, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = np.zeros(dims), np.ones(dims), 1.0
        self.w = [rng.normal(0, dims**-0.5, (dims, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.w
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d[0]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> "Network":
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        rng, z = np.random.default_rng(seed), (x - self.mean) / self.scale
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for at in range(0, len(z), batch):
                xb, yb = z[order[at : at + batch]], y[order[at : at + batch]]
                a, b, c, d = self.w
                h = np.tanh(xb @ a + b)
                g = (1.0 / (1.0 + np.exp(-np.clip(h @ c + d[0], -50, 50))) - yb) / len(xb)
                back = np.outer(g, c) * (1 - h * h)
                grads = [xb.T @ back + decay * a, back.sum(axis=0), h.T @ g + decay * c, np.array([g.sum()])]
                step += 1
                for i, gr in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * gr
                    v[i] = 0.999 * v[i] + 0.001 * gr * gr
                    self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "Network":
        """The temperature of least log loss on held-out rows, by golden-section search on its logarithm."""
        if not len(x):
            return self
        z = self.logits(x)

        def loss(u):
            s = z / np.exp(u)
            return float(np.mean(np.logaddexp(0, s) - y * s))

        lo, hi, r = -3.0, 3.0, (5**0.5 - 1) / 2
        for _ in range(50):
            a, b = hi - r * (hi - lo), lo + r * (hi - lo)
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        self.temperature = float(np.exp((lo + hi) / 2))
        return self


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(doc_id, quality, text) of at most ``max_labelled`` labelled documents (by hash of the id); several labels give their largest, several rows of a doc_id their smallest text."""
    one = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.min("text").alias("text"))
    )


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, max_labelled: int = 8_000) -> Network:
    """The network: four fifths of the labelled rows train it, the others calibrate it. Without two classes it answers with the share of the one there is (0.5 without any)."""
    dims = vectors.shape[1]
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def work(batches):
        for batch in pieces(batches):
            v = [pool(t, shared.value).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(batch.column("quality").to_pylist(), pa.int32()), pa.array(v, pa.binary())], ["doc_id", "quality", "v"])

    got = labelled(docs, labels, max_labelled).select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(work, "doc_id long, quality int, v binary").orderBy("doc_id").collect()
    net = Network(dims)
    y = np.array([float(r.quality > 0) for r in got])
    if len(set(y.tolist())) < 2:
        net.w[2][:] = 0
        net.w[3][0] = {(): 0.0, (0.0,): -4.0, (1.0,): 4.0}[tuple(set(y.tolist()))]
        return net
    x = np.stack([np.frombuffer(bytes(r.v), np.float32) for r in got]).astype(np.float64)
    held = np.arange(len(y)) % 5 == 4
    return net.fit(x[~held], y[~held]).calibrate(x[held], y[held])


def quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = 1 << 14, dims: int = 64, max_labelled: int = 8_000
) -> DataFrame:
    """(doc_id, p_quality, keep) for every row of ``docs``; keep: p_quality >= threshold.

    Null and empty texts have probability 0 and are not kept; null doc_ids
    stay; repeated rows are scored each; other columns are not read; empty
    tables give an empty one (without labels every text gets 0.5).
    ``max_labelled`` bounds the labelled rows that train the network; word
    vectors are gathered over all documents.
    """
    spark = ready(docs.sparkSession)
    vectors = word_vectors(docs, rows, dims)
    net = train(docs, labels, vectors, max_labelled)
    shared = spark.sparkContext.broadcast((vectors, net))

    def work(batches):
        vectors, net = shared.value
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            x = np.stack([pool(t, vectors) for t in texts]).astype(np.float64) if texts else np.zeros((0, dims))
            p = np.where([bool(t) for t in texts], net.predict(x), 0.0) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array(p >= threshold, pa.bool_())], ["doc_id", "p_quality", "keep"])

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows_.mapInArrow(work, "doc_id long, p_quality double, keep boolean")
