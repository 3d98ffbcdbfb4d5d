"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of which only the whole has a label. Every passage is encoded; a
gated attention (Ilse et al., "Attention-based deep multiple instance learning", 2018) learns from
document labels how much each counts; the weighted mean of the encodings is scored.

Training uses at most `sample` labelled rows, those with the least hash of doc_id. The
features of every passage of theirs, not their texts, come to the driver. Scoring covers every passage of every text.

Defined results: a null or empty text is one passage of zeros and gets a score; repeated rows get
equal scores; labels that disagree for a doc_id count as their mean; without labels every score is
0.5, with labels of one value all lean to it; ties in the hash of doc_id go to the least doc_id; texts of any length
are read whole, in slices; an empty table gives no rows; other columns are ignored, whatever they are called. Neither labels nor lang, source or
doc_id enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.passages import SIZE, features


class AttentionMil:
    """p = sigmoid(w . z + c), z = sum a_k h_k, h = tanh(W x + b), a = softmax(u . (tanh(V h) * sigmoid(G h)))."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        init = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {"W": init(SIZE, hidden), "b": np.zeros(hidden), "V": init(hidden, gate), "G": init(hidden, gate), "u": init(gate, 1)[:, 0], "w": np.zeros(hidden), "c": np.zeros(1)}
        self.mean, self.dev = np.zeros(SIZE), np.ones(SIZE)

    def _forward(self, x: np.ndarray, first: np.ndarray, bag: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["G"], -30, 30)))
        e = (t * g) @ p["u"]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return h, t, g, a, z, z @ p["w"] + p["c"]

    def fit(self, bags: list[np.ndarray], y: np.ndarray, rounds: int = 500, rate: float = 0.01, decay: float = 1e-4) -> AttentionMil:
        if not bags:
            return self
        x = np.concatenate(bags).astype(float)
        sizes = np.array([len(b) for b in bags])
        first, bag = np.append(0, np.cumsum(sizes)[:-1]), np.repeat(np.arange(len(bags)), sizes)
        self.mean, self.dev = x.mean(0), x.std(0) + 0.02
        x = np.clip((x - self.mean) / self.dev, -8, 8)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, rounds + 1):
            p = self.p
            h, t, g, a, z, s = self._forward(x, first, bag)
            ds = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) / len(y)
            dz = ds[:, None] * p["w"]
            dh = a[:, None] * dz[bag]
            da = (h * dz[bag]).sum(1)
            de = a * (da - np.add.reduceat(a * da, first)[bag])
            dtg = de[:, None] * p["u"]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            dh += dt @ p["V"].T + dg @ p["G"].T
            dx = dh * (1 - h * h)
            grad = {"W": x.T @ dx, "b": dx.sum(0), "V": h.T @ dt, "G": h.T @ dg, "u": ((t * g) * de[:, None]).sum(0), "w": z.T @ ds, "c": np.array([ds.sum()])}
            for k, d in grad.items():
                d = d + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray) -> float:
        """Probability of label 1 for a document's passages."""
        x = np.clip((x - self.mean) / self.dev, -8, 8)
        s = self._forward(x, np.zeros(1, int), np.zeros(len(x), int))[-1][0]
        return float(1 / (1 + np.exp(-np.clip(s, -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = 3000, label_col: str = "quality") -> AttentionMil:
    """Fits on at most `sample` labelled rows with `usable`, a condition on doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & usable)
    chosen = marked.groupBy("doc_id").agg(F.avg(F.col(label_col)).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, y, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.append({"d": d, "y": y, "x": features(text).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("d", pa.int64()), ("y", pa.float64()), ("x", pa.binary())]))

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y", F.col("doc_id").cast("long").alias("d"))
    rows = found.mapInArrow(run, "d long, y double, x binary").limit(sample).collect()
    rows.sort(key=lambda r: (r["d"], r["x"]))
    return AttentionMil().fit([np.frombuffer(r["x"], np.float32).reshape(-1, SIZE) for r in rows], np.array([r["y"] for r in rows]))


SCORES = pa.schema([("score", pa.float64())])


def scored(docs: DataFrame, model: AttentionMil, keep: list[str], name: str = "score") -> DataFrame:
    """The columns `keep` of docs with the score, from the whole text, in a column `name`."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([shared.value.score(features(t)) for t in b.to_pylist()], pa.float64())

    return docs.select(*(docs[f"`{c}`"] for c in keep), score(F.col("text")).alias(name))
