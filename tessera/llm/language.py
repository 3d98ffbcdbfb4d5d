"""Language identification by nearest centroids.

A text is the normalised TF-IDF vector of its byte n-grams (1 to 3 bytes within words, hashed).
Each language has a few centroids, found by spherical k-means over its training texts; the text's
language is that of the centroid with the greatest cosine. A text whose distance to it exceeds what
all but the furthest training texts of that language show, widened by a margin, is rejected.

Training uses at most `per_lang` rows of each language, those with the least hash of doc_id, and at most `most` in
all: where the languages are so many, each has the same number of rows, and where a column holds yet more different
values, those of the most rows are learned. The rows' hashed counts, not their texts, come to the driver.

Defined results: a null text, or one without a letter, is `und`, score 0 and rejected; equal
cosines go to the first language by name; without training rows everything is `und`; repeated rows
get equal results; texts of any length are read whole, in slices; an empty table gives no rows; other columns are
ignored, whatever they are called. Neither lang, source nor
doc_id enter a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.hashing import LOWER

SIZE = 1 << 13
_LETTER = np.zeros(256, np.uint32)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[0x80:] = np.arange(0x80, 256)
_SLICE = 1 << 20
_ASCII = re.compile("[A-Za-z]")


def counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams of letters; all else separates words."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(LOWER), np.uint8)
    out = np.zeros(SIZE, np.int64)
    for at in range(0, len(data), _SLICE):  # slices overlap by the two bytes a trigram needs
        b = _LETTER[data[max(0, at - 2) : at + _SLICE]]
        skip = min(at, 2)
        two = b[1:] + (b[:-1] << np.uint32(8))
        three = b[2:] + (b[1:-1] << np.uint32(8)) + (b[:-2] << np.uint32(16))
        for grams, n in ((b, 1), (two, 2), (three, 3)):
            fresh = max(0, skip - (n - 1))
            x = (grams[fresh:] + np.uint32(n << 24)) * np.uint32(0x9E3779B1)
            x ^= x >> np.uint32(15)
            out += np.bincount((x * np.uint32(0x85EBCA6B)) >> np.uint32(19), minlength=SIZE)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII.search(text)) or any(c.isalpha() for c in text))


class Centroids:
    """Several unit centroids for each language, with the cosine below which it rejects."""

    def __init__(self, rows: list[tuple[str, np.ndarray]], clusters: int = 4, sharpness: float = 25.0, margin: float = 0.3):
        self.sharpness = sharpness
        self.langs = sorted({lang for lang, _ in rows})
        df = np.zeros(SIZE)
        for _, c in rows:
            df += c > 0
        self.idf = np.log((1 + len(rows)) / (1 + df)) + 0.1
        self.points, owner, self.floor = np.zeros((0, SIZE), np.float32), [], {}
        points = []
        for k, lang in enumerate(self.langs):
            x = np.array([self.vector(c) for name, c in rows if name == lang])
            m = min(clusters, len(x))
            centre = [x.mean(0)]
            while len(centre) < m:  # the text furthest from the centres so far
                centre.append(x[(x @ np.array(centre).T).max(1).argmin()])
            centre = np.array(centre)
            for _ in range(12):
                centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
                home = (x @ centre.T).argmax(1)
                centre = np.array([x[home == j].mean(0) if (home == j).any() else centre[j] for j in range(m)])
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
            near = (x @ centre.T).max(1)
            self.floor[lang] = float(np.quantile(near, 0.01) * margin)
            points.append(centre)
            owner += [k] * m
        if points:
            self.points = np.concatenate(points).astype(np.float32)
        self.owner = np.array(owner, int)

    def vector(self, c: np.ndarray) -> np.ndarray:
        v = np.log1p(c) * self.idf
        return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        near = self.points @ self.vector(counts(text))
        best = np.array([near[self.owner == k].max() for k in range(len(self.langs))])
        k = int(best.argmax())
        score = 1 / np.exp(self.sharpness * (best - best[k])).sum()
        return self.langs[k], float(score), bool(best[k] < self.floor[self.langs[k]])


def training_ids(docs: DataFrame, usable: Column, per_lang: int, most: int) -> DataFrame:
    """(doc_id, lang) of at most `most` rows, the first `per_lang` of each language at most by the hash of doc_id.

    A language's rows are thinned by their hash before they are ranked, to about four times what is wanted, so
    that no task ranks all rows of a language that a third of them have.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & usable).select("doc_id", "lang").distinct()
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(most)
    share = (F.xxhash64("doc_id") / 2.0**64 + 0.5) * F.col("rows")  # the least hash of n rows is about 1 here
    near = rows.join(F.broadcast(sizes), "lang").where(share <= 4 * per_lang + 100)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    first = near.withColumn("n", place).where(F.col("n") <= per_lang)
    return first.orderBy("n", F.desc("rows"), "lang").limit(most).select("doc_id", "lang")


def learn(docs: DataFrame, usable: Column, per_lang: int = 500, most: int = 20_000) -> Centroids:
    """Fits on at most `per_lang` rows of each language and `most` in all with `usable`, a condition on doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    ids = training_ids(docs, usable, per_lang, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, lang in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if has_letter(text):
                    c = counts(text)
                    at = np.flatnonzero(c)
                    out.append({"lang": lang, "at": at.astype(np.uint16).tobytes(), "n": c[at].astype(np.uint32).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("lang", pa.string()), ("at", pa.binary()), ("n", pa.binary())]))

    # `most` ids at most
    found = docs.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).select("text", "lang").mapInArrow(run, "lang string, at binary, n binary").limit(most).collect()
    rows = []
    for r in sorted(found, key=lambda r: (r["lang"], r["at"], r["n"])):
        c = np.zeros(SIZE, np.int64)
        c[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.uint32)
        rows.append((r["lang"], c))
    return Centroids(rows)


def identified(docs: DataFrame, model: Centroids, keep: list[str], name: str = "language") -> DataFrame:
    """The columns `keep` of docs with struct<lang, score, rejected>, from the whole text, in a column `name`."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    @F.arrow_udf("struct<lang: string, score: double, rejected: boolean>")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([dict(zip(("lang", "score", "rejected"), shared.value.predict(t), strict=True)) for t in b.to_pylist()], kind)

    return docs.select(*(docs[f"`{c}`"] for c in keep), identify(F.col("text")).alias(name))
