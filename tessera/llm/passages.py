"""Shape features of the passages of a text, for the quality classifier."""

from __future__ import annotations

import numpy as np

from tessera.llm.hashing import LOWER, SPACE, mix, span_hashes, spans

#: Bytes after which a passage ends at the next white space.
PASSAGE = 600
_CLASSES = 9
_KIND = np.full(256, 8, np.uint8)  # 8: the rest of ASCII
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[SPACE] = 3
_KIND[[ord(c) for c in ".,;:'\"-()"]] = 4
_KIND[[ord(c) for c in "!?"]] = 5
_KIND[[ord(c) for c in "#$%&*@~^+=<>{}[]\\/_`"]] = 6
_KIND[ord("|")] = 8
_KIND[0x80:] = 7
LAGS = (1, 2, 3, 5, 8)
SIZE = _CLASSES + 6 + len(LAGS)


#: Bytes of a text that are worked on at once, a multiple of PASSAGE; a slice ends before a word.
SLICE = 1800 * PASSAGE


def _cuts(buf: np.ndarray) -> list[int]:
    """Where slices end: before the first word that begins at a multiple of SLICE or after it."""
    out = []
    for at in range(SLICE, len(buf), SLICE):
        if out and out[-1] >= at:
            continue
        inside = not SPACE[buf[at - 1]]  # the word there belongs to the slice before
        while at < len(buf) and not (not SPACE[buf[at]] and not inside):
            part = SPACE[buf[at : at + SLICE]]
            hit = part if inside else ~part
            step = int(hit.argmax()) if hit.any() else len(part)
            at += step
            if step < len(part):
                inside = False
        if at < len(buf):
            out.append(at)
    return out


def features(text: str | None) -> np.ndarray:
    """One row of SIZE float32 numbers for each passage; an empty text is one row of zeros.

    A long text is worked on in slices, with the same numbers as at once; memory beside the text is for a slice, or for
    the longest word.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    cuts = _cuts(np.frombuffer(data, np.uint8))
    out, before = [], np.zeros(0, np.uint64)
    for at, end in zip([0, *cuts], [*cuts, len(data)], strict=True):
        rows, before = _features(data[at:end], at, before)
        out.append(rows)
    return np.concatenate([x for x in out if len(x)] or [np.zeros((1, SIZE), np.float32)])


def _features(data: bytes, offset: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The passages that begin in a slice at `offset`; `before` holds the hashes of the last words ahead of it."""
    buf = np.frombuffer(data, np.uint8)
    starts, ends = spans(buf)
    n = len(starts)
    if not n:
        return np.zeros((0, SIZE), np.float32), before
    home = (starts + offset) // PASSAGE
    _, first, home = np.unique(home, return_index=True, return_inverse=True)
    rows = len(first)
    words = np.bincount(home, minlength=rows).astype(float)
    cuts = starts[first]
    cuts[0] = 0
    sizes = np.diff(np.append(cuts, len(buf))).astype(float)
    kinds = np.bincount(_KIND[buf].astype(np.int64) + _CLASSES * np.repeat(np.arange(rows), sizes.astype(np.int64)), minlength=rows * _CLASSES).reshape(rows, _CLASSES)
    low = data.translate(LOWER)
    h = span_hashes(np.frombuffer(low, np.uint8), starts, ends)
    key = np.sort(mix(h + home.astype(np.uint64)))
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    at = np.searchsorted(key, np.sort(key[fresh]))  # where each distinct word of a passage begins
    owner = np.empty(n, np.int64)
    order = np.argsort(mix(h + home.astype(np.uint64)), kind="stable")
    owner[:] = home[order]
    distinct = np.bincount(owner[at], minlength=rows)
    runs = np.diff(np.append(at, n))
    top = np.zeros(rows)
    np.maximum.at(top, owner[at], runs)
    length = (ends - starts).astype(float)
    out = np.zeros((rows, SIZE), np.float32)
    out[:, :_CLASSES] = kinds / sizes[:, None] * 4
    k = _CLASSES
    mean = np.bincount(home, length, rows) / words
    out[:, k] = mean / 8
    out[:, k + 1] = np.sqrt(np.maximum(0, np.bincount(home, length * length, rows) / words - mean * mean)) / 8
    out[:, k + 2] = np.log1p(words) / 5
    out[:, k + 3] = distinct / words
    out[:, k + 4] = top / words
    upper = _KIND[buf[starts]] == 1
    caps = upper & (_KIND[buf[np.maximum(ends - 2, starts)]] != 0) & (length > 1)
    out[:, k + 5] = np.bincount(home, caps, rows) / words
    every = np.concatenate((before, h))
    for j, lag in enumerate(LAGS):
        same = np.zeros(len(every))
        if len(every) > lag:
            same[lag:] = every[lag:] == every[:-lag]
        same = same[len(before) :]
        out[:, k + 6 + j] = np.bincount(home, same, rows) / words
    return out, every[-max(LAGS) :]
