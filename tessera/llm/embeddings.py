"""Near-duplicate vectors by PCA-ordered, tiled comparison.

Unit vectors are rotated to their principal axes. Whatever the rotation, the product of two of them is that
of their leading coordinates plus a rest that the product of their suffix norms bounds. Tiles of
vectors are compared by leading coordinates with the suffix norm as one more, so a single matrix product
gives every pair's bound; pairs that cannot reach the threshold stop there, and the others accumulate more
coordinates. Bounds only rule out, with some slack; what is left is decided on the vectors as they came:
a . b / sqrt((a . a) (b . b)) in double precision, and within a rounding error of the threshold by sums in the
order of the components. Tiles are ranges of the first coordinate: two whose ranges lie further apart than
vectors that link can be are never brought together. A task holds a strip of neighbouring tiles, more of them the more
tiles there are for each task, and the tiles that its strip meets pass by one at a time.

Equal vectors are one class with a multiplicity, so copies are not expanded into pairs. Links are
counted, never listed; of each pair of tiles only a spanning forest of its links leaves the task.

The driver holds the principal axes, from at most `sample` vectors, and four numbers for each TILE vectors.

Defined results: a vector that is null, zero, holds null or non-finite components, or has another length
than most, links with nothing; a pair whose cosine is the threshold itself links; a null vec_id links with
nothing; ids that recur are rows of their own with one component; an empty table gives no rows; other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, forget, small_batches, written

#: Vectors in a tile; leading coordinates of each step; rows of a tile compared at once; tiles of a strip at most.
TILE, STEPS, STRIP, HELD = 4096, (12, 32), 512, 8
#: Within this of the threshold a cosine is summed again in order; the bounds' single precision errs by less than SLACK.
NEAR, SLACK = 1e-9, 1e-4


def scaled(values: list | None, size: int) -> np.ndarray | None:
    """The vector times a power of two, which no cosine feels, so that no square is too large or too small."""
    if values is None or len(values) != size:
        return None
    try:
        x = np.array(values, np.float64)
    except (TypeError, ValueError):
        return None
    top = np.abs(x).max() if size else 0.0
    if not np.isfinite(x).all() or top == 0:
        return None
    return np.ldexp(x, -int(np.frexp(top)[1])) + 0.0


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def principal_axes(vectors: DataFrame, size: int, sample: int = 4096) -> np.ndarray:
    """Axes by descending variance of at most `sample` vectors, those with the least hash of vec_id.

    Any orthogonal axes give the same links; the sample only decides how early pairs stop.
    """
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(sample).collect()
    x = [unit(u) for r in rows if (u := scaled(r[0], size)) is not None]
    if not x:
        return np.eye(size)
    values, axes = np.linalg.eigh(np.array(x).T @ np.array(x))
    return axes[:, np.argsort(-values, kind="stable")]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the components of the links (a, b), roots left out."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    """The k leading coordinates and the norm of the rest."""
    return np.concatenate((x[:, :k], np.sqrt((x[:, k:] ** 2).sum(1, keepdims=True))), axis=1).astype(np.float32)


class Tile:
    def __init__(self, ids: bytes, copies: bytes, x: bytes, axes: np.ndarray):
        self.ids, self.copies = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64)
        self.x = np.frombuffer(x, np.float64).reshape(-1, len(axes))
        self.square = (self.x * self.x).cumsum(1)[:, -1]
        turned = unit(self.x) @ axes
        self.low, self.high = turned[:, 0].min(), turned[:, 0].max()
        self.ahead = [_ahead(turned, min(k, len(axes))) for k in STEPS]


def decided(a: Tile, b: Tile, i: np.ndarray, j: np.ndarray, cosine: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs link, of which the cosine is known but for rounding."""
    links = cosine >= threshold
    close = np.flatnonzero(np.abs(cosine - threshold) < NEAR)
    for at in range(0, len(close), 1 << 15):
        k = close[at : at + (1 << 15)]
        dots = (a.x[i[k]] * b.x[j[k]]).cumsum(1)[:, -1]
        links[k] = dots / np.sqrt(a.square[i[k]] * b.square[j[k]]) >= threshold
    return links


def compare(a: Tile, b: Tile, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that link, strip by strip of a; within one tile each pair once."""
    for at in range(0, len(a.ids), STRIP):
        rows = slice(at, at + STRIP)
        bound = a.ahead[0][rows] @ b.ahead[0].T
        hit = bound >= threshold - SLACK
        n = np.count_nonzero(hit)
        if a is b:
            hit &= np.arange(len(b.ids))[None, :] > (at + np.arange(len(hit)))[:, None]
        if n > hit.size // 16:  # a crowd: a full product costs less than picking pairs
            cosine = a.x[rows] @ b.x.T / np.sqrt(a.square[rows, None] * b.square[None, :])
            hit &= cosine >= threshold - NEAR
            i, j = np.nonzero(hit)
            cosine = cosine[i, j]
        else:
            i, j = np.nonzero(hit)
            for k in range(1, len(STEPS)):
                keep = np.einsum("ij,ij->i", a.ahead[k][at + i], b.ahead[k][j]) >= threshold - SLACK
                i, j = i[keep], j[keep]
            cosine = np.einsum("ij,ij->i", a.x[at + i], b.x[j]) / np.sqrt(a.square[at + i] * b.square[j])
        keep = decided(a, b, at + i, j, cosine, threshold)
        if keep.any():
            yield at + i[keep], j[keep]


FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    lengths = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("s")).count().orderBy(F.desc("count"), F.desc("s")).first()
    size = lengths["s"] if lengths else 0
    axes = spark.sparkContext.broadcast(principal_axes(vectors, size))
    told = pa.schema([("vec_id", pa.int64()), ("x", pa.binary()), ("lead", pa.float64())])

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = scaled(e, size)
                out.append({"vec_id": i, "x": None if x is None else x.tobytes(), "lead": None if x is None else float(unit(x) @ axes.value[:, 0])})
            yield pa.RecordBatch.from_pylist(out, schema=told)

    x = written(vectors.mapInArrow(rotate, "vec_id long, x binary, lead double"), "vectors")
    classes = written(x.where("x is not null and vec_id is not null").groupBy("x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("lead").alias("lead")), "classes")
    n = classes.count()
    tiles = max(1, -(-n // TILE))
    cuts = np.unique(classes.stat.approxQuantile("lead", [i / tiles for i in range(1, tiles)], 0.1 / tiles)) if tiles > 1 else np.zeros(0)

    @F.arrow_udf("int")
    def ranged(lead: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, lead.to_numpy(zero_copy_only=False)), pa.int32())

    # a tile for equal first coordinates would have no bound, so ranges with too many are split by hash
    held = classes.withColumn("range", ranged("lead"))
    rows = sorted(held.groupBy("range").agg(F.count("*").alias("n"), F.min("lead").alias("lo"), F.max("lead").alias("hi")).collect())
    number = np.zeros(len(cuts) + 2, np.int64)  # tiles of each range, then the first of them
    for r in rows:
        number[r["range"] + 1] = -(-r["n"] // (2 * TILE))
    first = np.cumsum(number)
    low, high = (np.repeat([r[k] for r in rows], [number[r["range"] + 1] for r in rows]) for k in (2, 3))
    parts = len(low)
    span = int(min(HELD, max(1, parts // (4 * spark.sparkContext.defaultParallelism))))  # tiles of a strip

    @F.arrow_udf("int")
    def tiled(ranges: pa.Array, hashes: pa.Array) -> pa.Array:
        r, h = ranges.to_numpy(zero_copy_only=False), hashes.to_numpy(zero_copy_only=False)
        return pa.array(first[r] + h % np.maximum(number[r + 1], 1), pa.int32())

    far = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    def strips(tile: int) -> np.ndarray:
        """Strips that a tile goes to: its own, and of two strips of tiles in reach one does the work; neighbours take turns."""
        own = tile // span
        met = np.unique(np.flatnonzero((low <= high[tile] + far) & (high >= low[tile] - far)) // span)
        return met[(met == own) | ((met < own) == ((met + own) % 2 == 0))]

    blocks = held.withColumn("tile", tiled("range", F.xxhash64("rep"))).groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("rep", "copies", "x"))).alias("rows"))
    packed = pa.schema([("strip", pa.int32()), ("other", pa.bool_()), ("tile", pa.int32()), ("ids", pa.binary()), ("copies", pa.binary()), ("x", pa.binary())])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, rows in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = rows.values
                ids, copies = (np.array(v.field(k).to_pylist(), np.int64).tobytes() for k in (0, 1))
                x = b"".join(v.field(2).to_pylist())
                for s in strips(t).tolist():
                    yield pa.RecordBatch.from_pylist([{"strip": s, "other": s != t // span, "tile": t, "ids": ids, "copies": copies, "x": x}], schema=packed)

    count = -(-parts // span)
    dealt = blocks.mapInArrow(block, "strip int, other boolean, tile int, ids binary, copies binary, x binary").repartition(max(1, count), "strip").sortWithinPartitions("strip", "other", "tile")

    def matched(own: Tile, there: Tile) -> pa.RecordBatch:
        links = np.zeros(len(own.ids), np.int64), np.zeros(len(there.ids), np.int64)
        children, roots = [], []
        for i, j in compare(own, there, threshold):
            links[0][:] += np.bincount(i, there.copies[j], len(own.ids)).astype(np.int64)
            links[1][:] += np.bincount(j, own.copies[i], len(there.ids)).astype(np.int64)
            c, r = forest(own.ids[i], there.ids[j])
            children.append(c)
            roots.append(r)
        ids = np.concatenate((own.ids, there.ids, *children))
        counts = np.concatenate((*links, *(np.zeros(len(c), np.int64) for c in children)))
        root = np.concatenate((own.ids, there.ids, *roots))
        some = (counts > 0) | (root != ids)
        return pa.RecordBatch.from_arrays([pa.array(v[some]) for v in (ids, counts, root)], schema=FOUND)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[Tile] = []
        strip = None
        for batch in batches:
            for k in range(batch.num_rows):
                s, other, _, *data = (batch.column(c)[k].as_py() for c in range(6))
                there = Tile(*data, axes.value)
                if s != strip:
                    strip, own = s, []
                if not other:  # a strip's own tiles sort first
                    own.append(there)
                for tile in own:
                    if there.low <= tile.high + far and tile.low <= there.high + far:
                        yield matched(tile, there)

    small_batches(spark, 1)  # a row is a tile
    found = written(dealt.mapInArrow(work, "id long, links long, root long"), "links")
    small_batches(spark)
    components = connected_components(found.where("id <> root").select("id", "root"), "vectors")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("x", "rep", "copies").join(links, F.col("rep") == F.col("id"), "left").drop("id").join(components, F.col("rep") == F.col("node"), "left").drop("node")
    out = x.join(known, "x", "left")
    return out.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "rep", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "rep", "vec_id"), F.lit(True)).alias("kept"),
    )
