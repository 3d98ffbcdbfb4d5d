"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs.

A text's units are its paragraphs (lines), long ones cut where a word's hash says so, which puts the
cuts of equal passages at equal places. Each unit's 64-bit digest, numbered when it recurs, goes to three cells
that keep a count, an xor of digests and an xor of check values. Two versions' sketches subtract cell by
cell, units in common cancel, and peeling cells that hold a single digest recovers those that differ
(Goodrich and Mitzenmacher, "Invertible Bloom lookup tables", 2011). When cells are left unpeeled, both
sketches are made anew with more cells and other hashes: at first as many as an estimate of the difference asks for,
from the parities of the digests that fall in each of a few hundred places; then twice as many each time.

Likeness is the Jaccard ratio that the recovered difference implies: 1 for equal texts, 0 for nothing in common.

Defined results: a null text is an empty one, two empty texts have likeness 1; a doc_id of null comes
last in order; rows of one doc_id are ordered by text, and repeated rows follow each other; a lone document is its own
next; texts of any length are read whole; an empty table gives no rows; other columns are ignored, whatever they are
called.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.hashing import mix, sequence_hashes, words_and_lines

_U = np.uint64
#: Cells of a fingerprint; a unit ends after a word whose hash is 0 modulo CUT, or with its line.
CELLS, CUT = 24, 16


def units(text: str) -> np.ndarray:
    """Distinct digests of a text's units; the n-th recurrence of a unit has a digest of its own."""
    words, lines = words_and_lines(text.encode("utf-8", "surrogatepass"))
    n = len(words)
    if not n:
        return words
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_or(lines[1:] != lines[:-1], words[:-1] % _U(CUT) == 0, out=last[:-1])
    ends = np.flatnonzero(last) + 1
    h = np.sort(sequence_hashes(words, np.append(0, ends[:-1]), ends))
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    at = np.arange(len(h))
    return mix(h + (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64) * _U(0xA24BAED4963EE407))


_CHECK = _U(0x8CB92BA72F3D8DD7)


@lru_cache(1024)
def _layout(cells: int) -> tuple[np.ndarray, np.uint64, np.ndarray]:
    """Seeds of the three cell hashes and of the check, cells in a third, and where the thirds begin."""
    seeds = [(cells * 4 + j) * 0x9FB21C651E98DF25 & (1 << 64) - 1 for j in range(3)]
    return np.array([[x] for x in [*seeds, 0]], np.uint64), _U(cells // 3), np.array([[0], [cells // 3], [cells // 3 * 2]])


class Sketch:
    """Cells of counts, digests and checks; their number seeds the hashes."""

    def __init__(self, keys: np.ndarray, cells: int = CELLS):
        self.size = cells
        self.count = np.zeros(cells, np.int64)
        self.key, self.check = np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
        if len(keys):
            self._put(keys, np.ones(len(keys), np.int64))

    def _put(self, keys: np.ndarray, signs: np.ndarray) -> None:
        seeds, third, offsets = _layout(self.size)
        h = np.empty((4, len(keys)), np.uint64)
        h[:3] = keys
        h[3] = keys ^ _CHECK
        h += seeds
        h = mix(h)
        at = ((h[:3] % third).astype(np.int64) + offsets).ravel()
        np.add.at(self.count, at, np.concatenate((signs, signs, signs)))
        np.bitwise_xor.at(self.key, at, np.concatenate((keys, keys, keys)))
        np.bitwise_xor.at(self.check, at, np.concatenate((h[3], h[3], h[3])))

    def text(self, n: int) -> str:
        """The fingerprint as text: units, then the cells."""
        return f"{n}:" + base64.b64encode(self.count.astype("<i2").tobytes() + self.key.astype("<u8").tobytes() + self.check.astype("<u4").tobytes()).decode()

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(np.zeros(0, np.uint64), self.size)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Digests only in the first and only in the second text; None if cells are left over."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            pure = np.flatnonzero(np.abs(self.count) == 1)
            if not len(pure):
                break
            pure = pure[mix(self.key[pure] ^ _CHECK) == self.check[pure]]
            if not len(pure):
                break
            keys, first = np.unique(self.key[pure], return_index=True)
            signs = self.count[pure][first]
            self._put(keys, -signs)
            found.append((keys, signs))
        if self.count.any() or self.key.any():
            return None
        keys, signs = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in ((0, np.uint64), (1, np.int64)))
        return keys[signs > 0], keys[signs < 0]


#: Places whose parities estimate a difference.
PLACES = 512


def parities(keys: np.ndarray) -> np.ndarray:
    """Whether an odd number of digests falls in each place."""
    return np.bincount((keys >> _U(55)).astype(np.int64), minlength=PLACES) & 1


def estimate(a: np.ndarray, b: np.ndarray) -> int:
    """About how many digests differ, by parities alone; where these tell nothing, as many as there are."""
    odd = np.count_nonzero(parities(a) != parities(b))
    most = len(a) + len(b)
    return most if odd > 0.45 * PLACES else min(most, int(-PLACES / 2 * np.log(1 - 2 * odd / PLACES)) + 1)


def difference(a: np.ndarray, b: np.ndarray, first: tuple[Sketch, Sketch] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The digests that differ, by sketches alone. After a failure, sketches of cells for the estimated
    difference; after another, twice as many cells, and so on."""
    cells = CELLS
    while True:
        x, y = first if first and cells == CELLS else (Sketch(a, cells), Sketch(b, cells))
        found = x.minus(y).peel()
        if found is not None:
            return found
        cells = 2 * cells if cells > CELLS else max(2 * CELLS, 3 * (estimate(a, b) // 2 + 4))


def likeness(a: np.ndarray, b: np.ndarray, first: tuple[Sketch, Sketch] | None = None) -> float:
    if not len(a) and not len(b):
        return 1.0
    only_a, only_b = difference(a, b, first)
    differ = len(only_a) + len(only_b)
    common = (len(a) + len(b) - differ) / 2
    return common / (common + differ)


LOWEST = -(1 << 63)
OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def in_order(docs: DataFrame, rows_per_run: int = 2048, most_runs: int = 1 << 17) -> tuple[DataFrame, int]:
    """Every document once, texts compressed, in runs of descending doc_id, each run ended by the head of the next.

    (run, head, key, z): runs are ranges of doc_id, in one partition each and sorted there, so a task
    sees each document's successor without a global window. Only the bounds of runs and the
    greatest key of each, 2 * `most_runs` numbers at most, come to the driver; beyond rows_per_run * most_runs
    documents (268 million) runs are longer, which a task reads as a stream that holds two documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"), "text")
    n = rows.count()
    runs = max(1, min(most_runs, n // rows_per_run))
    bounds = sorted({int(x) for x in rows.stat.approxQuantile("key", [i / runs for i in range(1, runs)], 0.1 / runs)}) if runs > 1 else []

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}
        for b in batches:
            for k in b.column(0).to_pylist():
                r = bisect_right(bounds, k)
                top[r] = max(k, top.get(r, LOWEST))
        yield pa.RecordBatch.from_pylist([{"run": r, "k": k} for r, k in top.items()], schema=pa.schema([("run", pa.int64()), ("k", pa.int64())]))

    tops = {r["run"]: r["k"] for r in rows.select("key").mapInArrow(greatest, "run long, k long").groupBy("run").agg(F.max("k").alias("k")).collect()}
    order = sorted(tops)
    ends = {tops[r]: order[(i + 1) % len(order)] for i, r in enumerate(order)}  # a run's head closes the run above it
    dealt = pa.schema([("run", pa.int64()), ("head", pa.bool_()), ("key", pa.int64()), ("z", pa.binary()), ("size", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for b in batches:
            out = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                row = {"run": bisect_right(bounds, k), "head": False, "key": k, "z": codec.compress(data, asbytes=True), "size": len(data)}
                out.append(row)
                if k in ends:
                    out.append(row | {"run": ends[k], "head": True})
            yield pa.RecordBatch.from_pylist(out, schema=dealt)

    moved = rows.mapInArrow(deal, "run long, head boolean, key long, z binary, size long")
    return moved.repartition("run").sortWithinPartitions("run", "head", F.desc("key"), "z"), runs


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows of OUT: each document, its edited text (see the query) and its successor compared by sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        last, out, done = None, [], None
        for b in batches:
            for r, head, key, z, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if done == r:  # rows after the first head of a run repeat its doc_id
                    continue
                text = codec.decompress(z, size, asbytes=True).decode("utf-8", "surrogatepass") if size else ""
                keys = units(text)
                now = (key, text, keys, Sketch(keys))
                if last is not None:
                    out.append(compare(last, now))
                    if len(out) >= 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), OUT, strict=True)], schema=OUT)
                        out = []
                last = None if head else now
                done = r if head else None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), OUT, strict=True)], schema=OUT)

    return in_order(docs)[0].mapInArrow(run, OUT_DDL)


def compare(doc: tuple, after: tuple) -> tuple:
    key, text, keys, sketch = doc
    n = len(text)
    edited = text[: n - n // 3] + after[1][: n // 3]
    new = units(edited)
    new_sketch = Sketch(new)
    return (
        None if key == LOWEST else key, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), sketch.text(len(keys)), new_sketch.text(len(new)),
        likeness(keys, new, (sketch, new_sketch)), likeness(keys, after[2], (sketch, after[3])),
    )
