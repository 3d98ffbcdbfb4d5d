"""Vector bin packing of tokenised examples into training sequences.

Every example is a vector (tokens, segments, loss-bearing tokens) and every sequence has a limit
in each dimension. Full-length pieces make sequences of their own. What remains waits in a pool
of bounded size; a sequence is opened, and again and again takes the waiting piece that fits and
has the largest dot product with the sequence's remaining capacity. When none fits, the largest
waiting piece is cut so that its head fills what is left. Packing is local to a task: there is no
shuffle, memory holds one pool, and a task that runs again makes the same rows.

Defined results: a null text is an empty one; an empty text is one piece that holds the closing
id alone; of pieces that fit equally well the one that waits in the first place is taken; repeated rows are packed once
each; a text of any length is encoded whole and cut into sequences; an empty table gives no rows; columns other than
those named are ignored, whatever they are called.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.common import small_batches

SCHEMA = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "sequence_padding")])
DDL = ", ".join(f"{f.name} long" for f in SCHEMA)


class ByteBpe:
    """Ids of a byte-level BPE file of the tokenizers library, as little-endian unsigned 32-bit bytes.

    Text between two single spaces is encoded once and remembered, for a byte-level pre-tokenizer
    always begins a token at a lone space. Where a text has neighbouring white space around a
    space, or a special token, the whole text goes to the tokenizers library instead.
    """

    #: Entries remembered by a worker; beyond them the memory starts afresh.
    REMEMBER = 250_000
    #: Longer stretches without a space go to the library, whose merging is not quadratic.
    LONG = 512

    def __init__(self, file: bytes):
        import json

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_str(file.decode())
        self.library.no_padding()
        self.library.no_truncation()
        spec = json.loads(file)
        self.special = [x["content"] for x in spec["added_tokens"]]
        shown = ByteLevel.alphabet()
        assert len(shown) == 256
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        skip = {x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if i not in skip}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes | None] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, text: str) -> bytes:
        if len(text) > self.LONG:
            return self.whole(text)
        return array("I", self.fast.encode_ordinary(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special) or not text:
            return self.whole(text)
        first, *rest = text.split(" ")
        known = self.known
        if len(known) > self.REMEMBER:
            known.clear()
        for w in set(rest).difference(known):
            known[w] = None if not w or w[0].isspace() or w[-1].isspace() else self._piece(" " + w)
        try:
            if first and first[-1].isspace():
                raise TypeError
            return self._piece(first) + b"".join(map(known.__getitem__, rest))
        except TypeError:
            return self.whole(text)


@dataclass(frozen=True)
class Limits:
    """Limits of one sequence. tokens must be a power of two."""

    tokens: int = 1024
    segments: int = 256
    loss: int = 1024
    #: Pieces that wait in a task's pool at most.
    pool: int = 512


class Packer:
    """Takes examples one by one; rows() of SCHEMA come out as sequences fill."""

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits, self.next = limits, first_sequence
        self.size = np.zeros((limits.pool + 1, 3))  # tokens, segments, loss-bearing tokens; all 0: a free place
        self.held: list[tuple | None] = [None] * (limits.pool + 1)
        self.free = list(range(limits.pool, -1, -1))
        self.rows: list[tuple] = []
        self.scale = np.array([limits.tokens, limits.segments, limits.loss], float)

    def add(self, doc: int | None, ids: bytes, loss_from: int) -> None:
        """The ids of one example; those from position loss_from on bear loss."""
        n, at, most = len(ids) // 4, 0, min(self.limits.tokens, self.limits.loss)
        while n - at >= self.limits.tokens and self.limits.loss >= self.limits.tokens:
            self._emit([(doc, at, most, ids, n)])
            at += most
        if at < n:
            self._wait((doc, at, n - at, ids[4 * at :], n, loss_from), base=at)

    def _wait(self, piece: tuple, base: int) -> None:
        doc, start, length, ids, n, loss_from = piece
        if len(self.free) <= 1:
            self._sequence()
        k = self.free.pop()
        self.held[k] = (doc, start, length, ids, base, n, loss_from)
        self.size[k] = length, 1, max(0, start + length - max(start, loss_from))

    def _sequence(self) -> None:
        """Fills one sequence from the pool."""
        room, placed, size = self.scale.copy(), [], self.size
        while room[0] > 0 and room[1] > 0:
            fits = (size <= room).all(axis=1) & (size[:, 0] > 0)
            if fits.any():
                value = np.where(fits, (size / self.scale) @ (room / self.scale), -1.0)
                k = int(value.argmax())
                length = self.held[k][2]
            else:
                k = int(size[:, 0].argmax())
                if size[k, 0] == 0:
                    break
                doc, start, length, ids, base, n, loss_from = self.held[k]
                length = int(min(room[0], length, max(0, loss_from - start) + room[2]))
                if length <= 0:
                    break
            doc, start, whole, ids, base, n, loss_from = self.held[k]
            placed.append((doc, start, length, ids[4 * (start - base) : 4 * (start - base + length)], n))
            room -= length, 1, max(0, start + length - max(start, loss_from))
            if length == whole:
                self.held[k], size[k] = None, 0
                self.free.append(k)
            else:
                start, whole = start + length, whole - length
                self.held[k] = (doc, start, whole, ids, base, n, loss_from)
                size[k] = whole, 1, max(0, start + whole - max(start, loss_from))
        self._emit(placed, cut=True)

    def _emit(self, placed: list[tuple], cut: bool = False) -> None:
        """placed: (doc, start, length, ids, tokens of the doc); without cut, ids are the whole doc's."""
        total = sum(x[2] for x in placed)
        pad = 0 if total & (total - 1) == 0 else self.limits.tokens - total
        at = 0
        for doc, start, length, ids, n in placed:
            part = ids if cut else memoryview(ids)[4 * start : 4 * (start + length)]
            self.rows.append((doc, start, length, zlib.crc32(part), n, self.next, at, total, pad))
            at += length
        self.next += bool(placed)

    def finish(self) -> None:
        """Empties the pool. What is left at the end is cut into sequences of powers of two."""
        full = self.limits
        while (left := int(self.size[:, 0].sum())) > 0:
            if left < full.tokens:
                self.scale = np.array([1 << (left.bit_length() - 1), full.segments, full.loss], float)
            self._sequence()

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(SCHEMA))], schema=SCHEMA)


def pack(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", loss_from_col: str | None = None) -> DataFrame:
    """Rows of SCHEMA: one for each piece of each example's ids, closing id included.

    loss_from_col names the count of leading ids of an example that bear no loss (a prompt);
    without it every id does. A sequence_id holds the task's number in its upper bits.
    """
    small_batches(docs.sparkSession)
    with open(tokenizer_path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    columns = [id_col, text_col, *([loss_from_col] if loss_from_col else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = ByteBpe(file.value), array("I", [end_id]).tobytes()
        packer = Packer(limits, TaskContext.get().partitionId() << 33)
        for batch in batches:
            ids, texts, *loss = (c.to_pylist() for c in batch.columns)
            for doc, text, begin in zip(ids, texts, loss[0] if loss else [0] * len(ids), strict=True):
                packer.add(doc, encode(text or "") + end, begin or 0)
            yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select(*columns).mapInArrow(run, DDL)
