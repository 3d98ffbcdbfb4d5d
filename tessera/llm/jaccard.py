"""N-gram Jaccard join by a token-group matrix.

Similar documents are partitioned into groups first. Of two sets that link, any common order of the shingles has
one in both prefixes: a set's first n - ceil(t n) + 1 shingles of n (the prefix filter). The order is by the exact
number of documents that hold a shingle, the rarest first, so that a passage which many documents share comes last,
and connects only sets made mostly of such passages; a shingle that one document holds connects nothing and is not
sent on. Sets connect by a shingle only where their sizes are of one class or neighbouring ones, which all sets
that link are. Documents that any chain of such shingles connects are one candidate group: every link lies within
a group.

The numbers come by two shuffles in proportion to the input, without a table that every task would hold. Texts lie
in shards, rows of about SHARD shingles. A shard sends its distinct shingles, sorted, to the ranges that they fall
in; a range counts them over all shards and answers each with one byte a shingle in the order in which they came;
the answers meet the shard again, which then knows its documents' prefixes.

Within a group, documents lie in blocks of bounded size, and those in small groups of BUNDLE in the order of
their least shingle. The token-group matrix holds the union of each bundle's shingles; how many of a
query's shingles a bundle holds bounds its overlap with each member; only bundles whose bound qualifies are
opened, and their members compared exactly. Documents already connected are not compared again.

Equal sets are one class from the start, prefixes are thinned to one entry for each shard before they
are shuffled, and no step lists the pairs of a group. A group of several blocks is joined by the blocks'
largest classes; then only what lies outside the largest is compared with the other blocks, or, where that is
most of the group, each block with half of them.

Defined results: a null text, or one without words, has no shingles and is a component by itself; a null
doc_id links with nothing; rows that repeat a doc_id are compared by each one's text; of equal sizes and ties in
the order nothing depends; a text of any length is taken whole; an empty table gives no rows; other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, forget, small_batches, written
from tessera.llm.hashing import mix, shingle_set

_U = np.uint64
#: Documents and shingles of a block; documents of a bundle, a row of the matrix.
BLOCK, BLOCK_TOKENS, BUNDLE = 1024, 1_000_000, 32
#: Rows of four numbers that are sent to every executor at most; beyond them texts are shuffled to their groups.
BROADCAST_ROWS = 300_000
#: Shingles of a shard, and those that a range counts at once.
SHARD, RANGE = 1_000_000, 2_000_000


def prefix(n: int, percent: int) -> int:
    """How many of a set's shingles, the first in any common order, meet those of each set that links with it."""
    return n - -(-n * percent // 100) + 1


def size_class(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Numbers of classes such that the sizes of two sets that link are in one class or in neighbouring ones."""
    return np.floor(np.log(np.maximum(sizes, 1)) / np.log(100 / percent) + 1e-9).astype(np.int32)


def grade(n: np.ndarray) -> np.ndarray:
    """Counts as single bytes of the same order: exact below 128, then eight steps for each doubling."""
    return np.where(n < 128, n, np.minimum(255, 128 + 8 * (np.log2(np.maximum(n, 128)) - 7))).astype(np.uint8)


class Segment:
    """Sorted shingles of one shard in one range, cut to 48 bits, with the number of the shard's documents that hold each.

    Two shingles of the same 48 bits count together, which only moves them in the order, the same for all.
    """

    @staticmethod
    def pack(tokens: np.ndarray, counts: np.ndarray) -> bytes:
        high, low = (tokens >> _U(48)).astype(np.uint16), (tokens >> _U(16)).astype(np.uint32)
        rest = np.concatenate((high, np.minimum(counts, 65535).astype(np.uint16))).tobytes()
        return pa.Codec("zstd").compress(rest, asbytes=True) + low.tobytes()

    @staticmethod
    def unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.frombuffer(data[len(data) - 4 * n :], np.uint32)
        rest = np.frombuffer(pa.Codec("zstd").decompress(data[: len(data) - 4 * n], 4 * n, asbytes=True), np.uint16)
        return rest[:n].astype(np.uint64) << _U(32) | low, rest[n:].astype(np.int64)


def range_of(tokens: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each shingle, of equal width; by the upper 32 bits, so what counts together is in one range."""
    return ((tokens >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that name a set."""
    a, b = (int(mix(tokens ^ _U(s)).sum(dtype=np.uint64)) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
    return tuple(x - (1 << 64) if x >> 63 else x for x in (a, b))


def thin(keys: np.ndarray, sizes: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each key and size class, that of its least node; and the (node, least) edges of the others."""
    order = np.lexsort((nodes, sizes, keys))
    keys, sizes, nodes = keys[order], sizes[order], nodes[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (sizes[1:] != sizes[:-1])
    least = nodes[np.flatnonzero(first)][np.cumsum(first) - 1]
    other = nodes != least
    edges = np.unique(np.stack((nodes[other], least[other]), axis=1), axis=0)
    return keys[first], sizes[first], nodes[first], edges


def meeting(keys: np.ndarray, sizes: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Edges between the nodes of a key in one size class or in neighbouring ones."""
    keys, sizes, nodes, edges = thin(keys, sizes, nodes)
    near = np.flatnonzero((keys[1:] == keys[:-1]) & (sizes[1:] - sizes[:-1] == 1) & (nodes[1:] != nodes[:-1]))
    return np.concatenate((edges, np.stack((nodes[near + 1], nodes[near]), axis=1)))


class Linker:
    """Exact comparison of documents in one block, and of queries with them, by the token-group matrix."""

    def __init__(self, sets: list[np.ndarray], labels: list[int], percent: int):
        self.percent = percent
        self.size = np.array([len(s) for s in sets])
        self.label = np.array(labels)
        tokens, inverse, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        ends = np.append(0, np.cumsum(self.size))
        self.sets = [inverse[ends[i] : ends[i + 1]] for i in range(len(sets))]
        order = np.argsort(np.array([s[0] for s in sets]), kind="stable")  # the least shingle
        self.bundles = [order[i : i + BUNDLE] for i in range(0, len(order), BUNDLE)]
        home = np.empty(len(sets), np.int64)
        home[order] = np.arange(len(order)) // BUNDLE
        pairs = np.unique(inverse * len(self.bundles) + np.repeat(home, self.size))  # the matrix's ones, by token
        self.row, self.column = np.searchsorted(pairs, np.arange(len(tokens) + 1) * len(self.bundles)), pairs % len(self.bundles)
        self.tokens, self.shared = tokens, seen > 1
        self.mark = np.zeros(len(tokens), bool)

    def bound(self, query: np.ndarray) -> np.ndarray:
        """How many of a query's shingles each bundle holds."""
        start, count = self.row[query], self.row[query + 1] - self.row[query]
        at = np.repeat(start - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
        return np.bincount(self.column[at], minlength=len(self.bundles))

    def partners(self, query: np.ndarray, size: int, label: int, mine: int = -1) -> Iterator[int]:
        """Members that link with a query of this size, one for each label other than its own."""
        need = -(-size * self.percent // 100)
        if len(query) < need:
            return
        self.mark[query] = True
        try:
            for g in np.flatnonzero(self.bound(query) >= need):
                for k in self.bundles[g]:
                    n = self.size[k]
                    if k == mine or self.label[k] == label or min(n, size) * 100 < self.percent * max(n, size):
                        continue
                    both = np.count_nonzero(self.mark[self.sets[k]])
                    if 100 * both >= self.percent * (n + size - both):
                        yield int(k)
        finally:
            self.mark[query] = False

    def join(self, a: int, b: int) -> None:
        self.label[self.label == max(a, b)] = min(a, b)

    def within(self) -> Iterator[tuple[int, int]]:
        """Links that connect each component of the block."""
        for q in range(len(self.sets)):
            shared = self.sets[q][self.shared[self.sets[q]]]
            if len(shared) < -(-self.size[q] * self.percent // 100):
                continue
            for k in self.partners(self.sets[q], self.size[q], self.label[q], q):
                if self.label[k] != self.label[q]:
                    self.join(self.label[q], self.label[k])
                    yield q, k

    def against(self, tokens: np.ndarray, label: int) -> Iterator[int]:
        """Members of other labels that a query from elsewhere links with."""
        at = np.searchsorted(self.tokens, tokens)
        at[at == len(self.tokens)] = 0
        known = at[self.tokens[at] == tokens]
        done: set[int] = set()
        for k in self.partners(known, len(tokens), label):
            if self.label[k] not in done:
                done.add(int(self.label[k]))
                yield k


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(pairs) -> pa.RecordBatch:
    x = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], schema=EDGE)


def _text(data: bytes) -> str:
    return data.decode("utf-8", "surrogatepass")


def shards(docs: DataFrame, shingle: int) -> DataFrame:
    """Two kinds of rows, written: (doc_id, h, n, s, t) of every document, with its text's hash, number of shingles and signature;
    and (shard, ends, blob), the compressed texts of about SHARD shingles, in UTF-8, and where each ends."""
    kinds = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("s", pa.int64()), ("t", pa.int64()), ("shard", pa.int64()), ("ends", pa.binary()), ("blob", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec, number, held, texts = pa.Codec("zstd"), TaskContext.get().partitionId() << 32, 0, []

        def shard() -> pa.RecordBatch:
            nonlocal number, held
            ends = np.cumsum([len(t) for t in texts])
            row = {"shard": number, "ends": ends.astype(np.int64).tobytes(), "blob": codec.compress(b"".join(texts), asbytes=True)}
            number, held = number + 1, 0
            texts.clear()
            return pa.RecordBatch.from_pylist([row], schema=kinds)

        for b in batches:
            n, marks = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                tokens = shingle_set(text, shingle)
                n.append(len(tokens))
                marks.append(signature(tokens))
                if len(tokens) and key is not None:
                    texts.append(text.encode("utf-8", "surrogatepass"))
                    held += len(tokens)
                    if held >= SHARD:
                        yield shard()
            columns = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary()), pa.nulls(len(n), pa.binary())], schema=kinds)
        if texts:
            yield shard()

    return written(docs.mapInArrow(sign, "doc_id long, h long, n long, s long, t long, shard long, ends binary, blob binary"), "shards")


def sets_of(ends: bytes, blob: bytes, shingle: int) -> list[np.ndarray]:
    """The shingles of each text of a shard."""
    at = np.frombuffer(ends, np.int64).tolist()
    data = pa.Codec("zstd").decompress(blob, at[-1], asbytes=True)
    return [shingle_set(_text(data[i:j]), shingle) for i, j in zip([0, *at], at, strict=False)]


def frequencies(held: DataFrame, shingle: int, ranges: int, tasks: int) -> DataFrame:
    """(shard, place, grades): for each shard and range, in order, graded numbers of documents that hold its shingles; written."""
    sent = pa.schema([("place", pa.int32()), ("shard", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])
    answers = pa.schema([("shard", pa.int64()), ("place", pa.int32()), ("grades", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, ends, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tokens, counts = np.unique(np.concatenate(sets_of(ends, blob, shingle)), return_counts=True)
                cuts = np.searchsorted(range_of(tokens, ranges), np.arange(ranges + 1))
                rows = [{"place": r, "shard": shard, "n": int(j - i), "tokens": Segment.pack(tokens[i:j], counts[i:j])} for r, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j]
                yield pa.RecordBatch.from_pylist(rows, schema=sent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        rows = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for place, group in groupby(rows, key=lambda r: r[0]):
            to, tokens, counts = [], [], []
            for _, shard, n, data in group:
                t, c = Segment.unpack(data, n)
                to.append(shard)
                tokens.append(t)
                counts.append(c)
            ends = np.cumsum([len(t) for t in tokens])
            every = np.concatenate(tokens)
            order = np.argsort(every, kind="stable")
            fresh = np.append(True, every[order][1:] != every[order][:-1])
            df = np.add.reduceat(np.concatenate(counts)[order], np.flatnonzero(fresh))
            grades = np.empty(len(every), np.uint8)
            grades[order] = grade(df)[np.cumsum(fresh) - 1]
            for shard, part in zip(to, np.split(grades, ends[:-1]), strict=True):
                yield pa.RecordBatch.from_pylist([{"shard": shard, "place": place, "grades": codec.compress(part.tobytes(), asbytes=True)}], schema=answers)

    dealt = held.select("shard", "ends", "blob").mapInArrow(send, "place int, shard long, n long, tokens binary")
    dealt = dealt.repartition(tasks, "place").sortWithinPartitions("place")
    return written(dealt.mapInArrow(count, "shard long, place int, grades binary"), "grades")


def candidate_groups(held: DataFrame, shingle: int, percent: int, total: int) -> DataFrame:
    """(node, component) over the first number of signatures: the candidate groups of the shards' documents."""
    ranges = max(1, total // RANGE)
    tasks = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), ranges)
    grades = frequencies(held, shingle, ranges, tasks)
    dealt = pa.schema([("p", pa.int32()), ("edges", pa.bool_()), ("a", pa.binary()), ("b", pa.binary()), ("sizes", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, known = pa.Codec("zstd"), []
        rows = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, place, z, ends, blob in rows:
            if place is not None:  # a shard's answers sort before its texts
                known.append(z)
                continue
            sets = sets_of(ends, blob, shingle)
            tokens, home = np.unique(np.concatenate(sets), return_inverse=True)
            lengths = np.diff(np.searchsorted(range_of(tokens, ranges), np.arange(ranges + 1)))
            df = np.concatenate([np.frombuffer(codec.decompress(k, int(n), asbytes=True), np.uint8) for k, n in zip(known, lengths[lengths > 0], strict=True)])
            known.clear()
            at, keys, sizes, nodes = 0, [], [], []
            for s in sets:
                own = home[at : at + len(s)]
                at += len(s)
                first = own[np.argsort(df[own], kind="stable")[: prefix(len(s), percent)]]
                first = first[df[first] > 1]
                if len(first):
                    keys.append(tokens[first])
                    sizes.append(np.full(len(first), len(s)))
                    nodes.append(np.full(len(first), signature(s)[0]))
            if not keys:
                continue
            k, c, n, e = thin(np.concatenate(keys), size_class(np.concatenate(sizes), percent), np.concatenate(nodes))
            p = (mix(k) % _U(tasks)).astype(np.int64)
            order = np.argsort(p, kind="stable")
            k, c, n, cuts = k[order], c[order], n[order], np.searchsorted(p[order], np.arange(tasks + 1))
            out = [{"p": i, "edges": False, "a": k[cuts[i] : cuts[i + 1]].tobytes(), "b": n[cuts[i] : cuts[i + 1]].tobytes(), "sizes": c[cuts[i] : cuts[i + 1]].tobytes()} for i in range(tasks) if cuts[i] < cuts[i + 1]]
            for i in range(0, len(e), 10_000):
                part = e[i : i + 10_000]
                out.append({"p": int(part[0, 0] % tasks), "edges": True, "a": part[:, 0].tobytes(), "b": part[:, 1].tobytes(), "sizes": None})
            yield pa.RecordBatch.from_pylist(out, schema=dealt)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, group in groupby(rows, key=lambda r: r[0]):
            keys, sizes, nodes = [], [], []
            for _, edges, a, b, c in group:
                if edges:
                    yield _edges(np.stack((np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)), axis=1))
                else:
                    keys.append(np.frombuffer(a, np.uint64))
                    nodes.append(np.frombuffer(b, np.int64))
                    sizes.append(np.frombuffer(c, np.int32))
            if keys:
                yield _edges(meeting(np.concatenate(keys), np.concatenate(sizes), np.concatenate(nodes)))

    none = F.lit(None).cast("binary")
    both = grades.select("shard", "place", "grades", none.alias("ends"), none.alias("blob")).unionAll(held.select("shard", F.lit(None).cast("int"), none, "ends", "blob"))
    met = both.repartition(tasks, "shard").sortWithinPartitions("shard", F.col("place").asc_nulls_last())
    spread = met.mapInArrow(deal, "p int, edges boolean, a binary, b binary, sizes binary").repartition(tasks, "p").sortWithinPartitions("p")
    edges = written(spread.mapInArrow(meet, "a long, b long"), "edges")
    forget(grades)
    out = connected_components(edges, "candidates")
    forget(edges)
    return out


def components(docs: DataFrame, shingle: int = 5, percent: int = 80, text_hash: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of (doc_id, text): 100 * intersection >= percent * union links.

    With text_hash, a 64-bit hash of the text that tells rows of one doc_id apart, there are a column of that name and
    component, a number of the row's component (null without shingles or doc_id), which no two components share.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = F.lit(None).cast("long") if text_hash is None else text_hash
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), named.alias("h"), "text")
    both = shards(docs, shingle)
    signed, held = both.where("shard is null").select("doc_id", "h", "n", "s", "t"), both.where("shard is not null").select("shard", "ends", "blob")
    total = signed.agg(F.sum("n")).first()[0] or 0
    # a class has a number of its own, for rows of one doc_id may be of several
    classes = signed.where("n > 0 and doc_id is not null").groupBy("s", "t", "n").agg(F.min("doc_id").alias("low"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    groups = candidate_groups(held, shingle, percent, total)
    held = written(classes.join(groups, F.col("s") == F.col("node")).select("rep", "low", "s", "t", "n", F.col("component").alias("g")), "members")
    forget(groups)
    sizes = held.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"), F.count("*").alias("m")).where("m > 1").drop("m")
    held = held.join(sizes, "g").select("rep", "low", "s", "t", "g", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"))

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        at = None
        for b in batches:
            at = b.schema.get_field_index("text")
            data = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(at).to_pylist()]
            rest = [c for i, c in enumerate(b.columns) if i != at]
            names = [f.name for i, f in enumerate(b.schema) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([codec.compress(d, asbytes=True) for d in data], pa.binary()), pa.array([len(d) for d in data], pa.int64())], names=[*names, "z", "size"])

    member = "g long, blocks int, block int, rep long, s long, t long"
    if held.count() <= BROADCAST_ROWS:
        found = docs.select("doc_id", "text").join(F.broadcast(held), F.col("low") == F.col("doc_id")).select("g", "blocks", "block", "rep", "s", "t", "text")
        held = found.mapInArrow(press, f"{member}, z binary, size long")
    else:
        pressed = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(press, "doc_id long, z binary, size long")
        held = held.join(pressed, F.col("low") == F.col("doc_id")).select("g", "blocks", "block", "rep", "s", "t", "z", "size")
    shown = ["g", "block", "rep", "s", "t", "z", "size"]

    def opened(codec: pa.Codec, row: tuple) -> np.ndarray | None:
        """The set of (s, t, z, size); None where the text is another one of that doc_id."""
        s, t, z, size = row
        tokens = shingle_set(_text(codec.decompress(z, size, asbytes=True)) if size else "", shingle)
        return tokens if signature(tokens) == (s, t) else None

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        rows = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, block in groupby(rows, key=lambda r: r[:2]):
            found: dict[int, np.ndarray] = {}
            for _, _, rep, *row in block:
                if rep not in found and (tokens := opened(codec, row)) is not None:
                    found[rep] = tokens
            if len(found) > 1:
                reps = list(found)
                yield _edges([(reps[i], reps[j]) for i, j in Linker(list(found.values()), list(range(len(reps))), percent).within()])

    def blocks(rows: DataFrame) -> DataFrame:
        return rows.select(shown).repartition("g", "block").sortWithinPartitions("g", "block", "rep").mapInArrow(link, "a long, b long")

    wide = sizes.where("blocks > 1").select("g")
    if wide.isEmpty():
        near = written(blocks(held), "near")
    else:
        held = written(held, "texts")
        large = held.join(wide, "g", "left_semi")
        within = written(blocks(held), "near")
        label = connected_components(within, "blocks")
        labelled = large.join(label, large["rep"] == label["node"], "left").withColumn("label", F.coalesce("component", "rep")).drop("node", "component")
        # the largest class of each block meets those of the group's other blocks
        top = labelled.groupBy("g", "block", "label").agg(F.count("*").alias("n")).groupBy("g", "block").agg(F.max(F.struct("n", F.negative("label").alias("l"))).alias("m"))
        heads = top.select("g", F.negative("m.l").alias("rep"))
        met = large.join(heads, ["g", "rep"], "left_semi").withColumn("block", F.lit(-1))
        joined = written(within.unionAll(blocks(met)), "joined")
        forget(label)
        label = connected_components(joined, "joined")
        labelled = large.join(label, large["rep"] == label["node"], "left").withColumn("label", F.coalesce("component", "rep")).select(*shown, "blocks", "label")
        main = labelled.groupBy("g", "label").agg(F.count("*").alias("n")).groupBy("g").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all")).select("g", F.col("m.label").alias("main"), (F.col("all") > 2 * F.col("m.n")).alias("most"))
        # where most lie outside, all ask, but of two blocks one asks the other; no block asks itself again
        asked = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda to: F.when(F.col("most"), (F.col("own") < to) == ((F.col("own") + to) % 2 == 0)).otherwise(F.col("label") != F.col("main")) & (F.col("own") != to))
        outside = labelled.join(main, "g").withColumnRenamed("block", "own").withColumn("block", F.explode(asked))
        crossing = ["rep", "label", "s", "t", "z", "size"]
        both_sides = labelled.select("g", "block", F.lit(False).alias("query"), *crossing).unionAll(outside.select("g", "block", F.lit(True), *crossing))

        def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = pa.Codec("zstd")
            rows = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
            for _, block in groupby(rows, key=lambda r: r[:2]):
                reps, labels, found, linker, pairs = [], [], [], None, []
                for _, _, query, rep, mark, *row in block:
                    tokens = opened(codec, row)
                    if tokens is None:
                        continue
                    if not query:
                        reps.append(rep)
                        labels.append(mark)
                        found.append(tokens)
                        continue
                    linker = linker or (Linker(found, labels, percent) if found else None)
                    if linker:
                        pairs += [(rep, reps[k]) for k in linker.against(tokens, mark)]
                if pairs:
                    yield _edges(pairs)

        crossed = both_sides.repartition("g", "block").sortWithinPartitions("g", "block", "query", "rep").mapInArrow(across, "a long, b long")
        near = written(joined.unionAll(crossed), "near")
        for table in (label, joined, within, held):
            forget(table)
    final = connected_components(near, "final")
    forget(near)
    linked = classes.join(final, F.col("rep") == F.col("node")).select("s", "t", "n", "low", "component")
    least = linked.groupBy("component").agg(F.min("low").alias("c"))
    alone = classes.join(final, F.col("rep") == F.col("node"), "left_anti").select("s", "t", "n", F.col("low").alias("c"), F.col("rep").alias("k"))
    known = linked.join(least, "component").select("s", "t", "n", "c", F.col("component").alias("k")).unionAll(alone)
    out = signed.join(known, ["s", "t", "n"], "left")
    more = [] if text_hash is None else [F.col("h").alias("text_hash"), F.when(F.col("doc_id").isNotNull(), F.col("k")).alias("component")]
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"), *more)
