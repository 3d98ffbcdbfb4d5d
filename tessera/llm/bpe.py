"""Streaming BPE: a transducer with bounded lookahead, and an incremental decoder.

A merge (a, b) to the left of some point can be upset by text to the right only through a chain of
merges of ever earlier rank: b, or a token on b's right edge while b is still being built, joins what
follows it first; that in turn may be taken by a still earlier merge, and so on. lookahead() walks
these chains over the whole merge list and gives the longest stretch of symbols such a chain can span
(Berglund and van der Merwe, "Formalizing BPE Tokenization", 2023). So a token that ends at least
that far before the end of what has been read is final: it is emitted, and the rest is a fresh
problem. Memory is one window, whatever the length of a word. All words go through stream(), which
reads on as far as the lookahead and STEP symbols more, and emits; a worker remembers what it gave for frequent words.

A text is read in parts of about PART characters that end at white space. Each part's ids go to a running digest and to
the decoder, whose text goes to another, so no more than a part is held besides the text itself; a stretch without white
space is as long as it is.

Defined results: a null text is an empty one, which has no tokens and decodes to ""; repeated rows
give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import per_row, small_batches

#: Unicode's White_Space, which is what \s means to the tokenizer file.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols (characters of byte-level text) that suffice to make a token final; see the module."""
    rank = {m: r for r, m in enumerate(merges)}
    made: dict[str, int] = {}
    for r, (a, b) in enumerate(merges):
        made.setdefault(a + b, r)
    length = lambda t: len(t.removesuffix("</w>"))
    reach: list[int] = []
    by_left: dict[str, tuple[list[int], list[int]]] = {}  # ranks, and the greatest reach up to each
    for r, (a, b) in enumerate(merges):
        best, token, before = 0, b, r
        while True:
            ranks, tops = by_left.get(token, ([], []))
            k = bisect_left(ranks, before)
            if k:
                best = max(best, tops[k - 1])
            before = made.get(token, -1)
            if before < 0:
                break
            token = merges[before][1]
        reach.append(length(b) + best)
        ranks, tops = by_left.setdefault(a, ([], []))
        ranks.append(r)
        tops.append(max(reach[r], tops[-1] if tops else 0))
    assert len(rank) == len(merges)
    return max(reach, default=0) + max((length(a + b) for a, b in merges), default=1)


class Transducer:
    """Encodes by a BPE file of the tokenizers library with word ends (`</w>`) and white space dropped."""

    #: Words whose tokens a worker remembers, of how many characters at most; beyond them the memory starts afresh.
    REMEMBER, WORTH = 500_000, 64
    #: Symbols read beyond the lookahead between two emissions.
    STEP = 64

    def __init__(self, file: bytes, look: int | None = None):
        spec = json.loads(file)
        model = spec["model"]
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: r for r, m in enumerate(self.merges)}
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.spaced = spec.get("decoder") is None
        self.look = lookahead(self.merges) if look is None else look
        self.symbols = byte_symbols()
        self.token_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.token_of_decimal = {str(i): t for i, t in self.token_of.items()}
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
        self.white = regex.compile(f"[{WHITE}]")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        assert all("<|" in s and not self.white.search(s) for s in self.special)
        self.known: dict[str, tuple[str, str, int]] = {}  # by stretch of text
        self.seen: dict[str, tuple[str, str, int]] = {}  # by word

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE over a window: the earliest merge of the list first, from the left."""
        get, none = self.rank.get, len(self.rank)
        pairs = [get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get((symbols[i - 1], symbols[i]), none)
            if i < len(pairs):
                pairs[i] = get((symbols[i], symbols[i + 1]), none)
        return symbols

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one word's symbols, each emitted once no later symbol can change it."""
        window: list[str] = []
        full, rest = self.look + self.STEP, iter(symbols)
        while True:
            window.extend(islice(rest, full - len(window)))
            if len(window) < full:
                break
            tokens, read = self.merge(list(window)), 0
            for t in tokens:
                if read + len(t) > full - self.look:
                    break
                read += len(t)
                yield t
            del window[:read]
        yield from self.merge(window)

    def _word_symbols(self, word: str) -> Iterator[str]:
        data, symbols = word.encode("utf-8", "surrogatepass"), self.symbols
        return chain(map(symbols.__getitem__, data[:-1]), (symbols[data[-1]] + self.end,))

    def word_tokens(self, word: str) -> list[str]:
        return list(self.stream(self._word_symbols(word)))

    def _normal(self, chunk: str) -> str:
        if chunk.isascii():
            return chunk.lower()
        chunk = unicodedata.normalize("NFC", chunk)
        return "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()

    def tokens(self, chunk: str) -> Iterator[str]:
        """Tokens of a stretch of text."""
        for k, part in enumerate(self.cut.split(chunk)):
            if k % 2:
                yield part
            else:
                for m in self.words.finditer(self._normal(part)):
                    yield from self.word_tokens(m.group())

    def _id(self, token: str) -> int:
        found = self.special.get(token)
        return self.vocab[token] if found is None else found

    def _word(self, word: str) -> tuple[str, str, int]:
        found = self.seen.get(word)
        if found is None:
            tokens, vocab = self.word_tokens(word), self.vocab
            found = " ".join([str(vocab[t]) for t in tokens]), " ".join(tokens), len(tokens)
            if len(word) <= self.WORTH:
                if len(self.seen) >= self.REMEMBER:
                    self.seen.clear()
                self.seen[word] = found
        return found

    def _entry(self, chunk: str) -> tuple[str, str, int]:
        if "<|" in chunk:
            tokens = list(self.tokens(chunk))
            return " ".join([str(self._id(t)) for t in tokens]), " ".join(tokens), len(tokens)
        found = [self._word(w) for w in self.words.findall(self._normal(chunk))]
        if len(found) == 1:
            return found[0]
        return " ".join([x[0] for x in found]), " ".join([x[1] for x in found]), sum(x[2] for x in found)

    def pieces(self, text: str) -> list[tuple[str, str, int]]:
        """(decimal ids, tokens, count) of each stretch between white space, in order."""
        known = self.known
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")  # white space to str.split(), not to the file
        chunks = [c for c in regex.split(f"[{WHITE}]+", text) if c] if odd else text.split()
        own = {}
        for chunk in set(chunks).difference(known):
            own[chunk] = self._entry(chunk)
        if not own:
            return list(map(known.__getitem__, chunks))
        if len(known) + len(own) > self.REMEMBER:
            known.clear()
        known.update((c, e) for c, e in own.items() if len(c) <= self.WORTH)
        return [own.get(c) or known.get(c) or own.setdefault(c, self._entry(c)) for c in chunks]

    def parts(self, text: str, size: int) -> Iterator[str]:
        """The text in parts of about `size` characters, cut at white space, which begins no token."""
        at = 0
        while at < len(text):
            end = at + size
            if end < len(text):
                found = self.white.search(text, end)
                end = found.start() if found else len(text)
            yield text[at:end]
            at = end

    def ids(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.pieces(text) for i in ids.split()]

    def joined(self, ids: Iterable[int]) -> str:
        """What the library's decode() gives for a file without a decoder: tokens joined by spaces."""
        return " ".join(self.token_of[i] for i in ids)


class Decoder:
    """Incremental: feed() takes one token and gives the text that is certain by then.

    States are those of UTF-8: bytes of an unfinished character wait; bytes that cannot begin or
    go on with a character become U+FFFD; a word end becomes a space. With `spaced`, as for a file
    that names no decoder, tokens are joined by spaces and nothing waits.
    """

    def __init__(self, end: str = "</w>", spaced: bool = False):
        import codecs

        self.spaced, self.began = spaced, False

        self.back = {s: b for b, s in enumerate(byte_symbols())}
        self.end = end
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed_all(self, tokens: list[str]) -> str:
        if not self.spaced:
            return "".join(map(self.feed, tokens))
        out = " ".join(["", *tokens] if self.began else tokens)
        self.began = self.began or bool(tokens)
        return out

    def feed(self, token: str) -> str:
        if self.spaced:
            return self.feed_all([token])
        ends = bool(self.end) and token.endswith(self.end)
        body = token.removesuffix(self.end) if ends else token
        out = self.utf8.decode(bytes(self.back[c] for c in body))
        return out + (self.utf8.decode(b"", True) + " " if ends else "")

    def close(self) -> str:
        return self.utf8.decode(b"", True)


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("decoded_chars", pa.int64())])


#: Characters of a part.
PART = 1 << 18


def digests(bpe: Transducer, text: str, size: int = PART) -> tuple[int, str, str, int]:
    """(ids, digest of the ids, digest and length of what the decoder gives for them), part by part."""
    n, length, of_ids, of_text, decoder = 0, 0, hashlib.sha256(), hashlib.sha256(), Decoder(bpe.end, bpe.spaced)
    for part in bpe.parts(text, size):
        ids = " ".join([e[0] for e in bpe.pieces(part)])
        if not ids:
            continue
        of_ids.update((" " + ids if n else ids).encode())
        tokens = list(map(bpe.token_of_decimal.__getitem__, ids.split(" ")))
        n += len(tokens)
        shown = decoder.feed_all(tokens)
        length += len(shown)
        of_text.update(shown.encode())
    shown = decoder.close()
    of_text.update(shown.encode())
    return n, of_ids.hexdigest(), of_text.hexdigest(), length + len(shown)


_kept: dict[int, Transducer] = {}


def kept(file: bytes, look: int) -> Transducer:
    """The worker's transducer for a file, with the words it remembers from earlier tasks."""
    key = zlib.crc32(file)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Transducer(file, look)
    return _kept[key]


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text and decodes its ids; one row of digests for each. Nothing is shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    file = spark.sparkContext.broadcast((data, Transducer(data).look))

    def make():
        bpe = kept(*file.value)

        def row(doc, text):
            return doc, *digests(bpe, text or "")

        return row

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long"
    return docs.select(id_col, text_col).mapInArrow(per_row([id_col, text_col], ENCODED, make), ddl)
