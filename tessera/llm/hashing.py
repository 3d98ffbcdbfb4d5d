"""Vectorised 64-bit hashes of the words of a text and of its word shingles."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SLICE = 1 << 20
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, 2 * len(_pow))
        for name, m in (("_pow", _MUL), ("_inv", _INV)):
            x = np.full(n, m, np.uint64)
            x[0] = 1
            globals()[name] = np.cumprod(x)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in a byte array."""
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(SPACE[buf], out=inside[1:-1].view(bool))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of buf[s:e] for each span, the same wherever the bytes stand."""
    n = len(buf)
    _grow(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[buf] * _pow[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _inv[starts] + (ends - starts).astype(np.uint64))


def slices(buf: np.ndarray):
    """A byte array in parts of about a megabyte that end where a word does, so scratch memory is bounded."""
    at = 0
    while at < len(buf):
        end = min(at + _SLICE, len(buf))
        while end < len(buf) and not SPACE[buf[end]]:
            step = SPACE[buf[end : end + _SLICE]]
            end += int(step.argmax()) if step.any() else len(step)
        yield buf[at:end]
        at = end


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of all words in order."""
    out = [span_hashes(part, *spans(part)) for part in slices(np.frombuffer(data, np.uint8))]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def words_and_lines(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of the line that each stands on."""
    words, lines, line = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for part in slices(np.frombuffer(data, np.uint8)):
        starts, ends = spans(part)
        breaks = np.cumsum(part == 10)
        words.append(span_hashes(part, starts, ends))
        lines.append(line + (breaks[starts] if len(starts) else np.zeros(0, np.int64)))
        line += int(breaks[-1])
    return np.concatenate(words), np.concatenate(lines)


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[s:e], in order, for each span of an array of hashes."""
    n = len(values)
    _grow(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(mix(values) * _pow[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _inv[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text, A-Z lower-cased.

    Fewer than k words: the whole sequence is the one shingle. No words or no text: empty.
    """
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not len(words):
        return words
    n = min(k, len(words))
    last = len(words) - n + 1
    h = np.full(last, n, np.uint64)
    for i in range(n):
        h = mix(h * _U(0xD6E8FEB86659FD93) + words[i : i + last])
    return np.unique(h)
