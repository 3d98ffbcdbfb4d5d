"""String similarities: set ratios as expressions; edit-based ones, which Spark lacks, as Arrow UDFs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct elements; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def char3_dice(a: Column, b: Column) -> Column:
    """Dice ratio of the sets of 3-grams of strings padded by two spaces on both sides."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 2), lambda i: F.substr(F.concat(F.lit("  "), c, F.lit("  ")), i, F.lit(3))))
    x, y = grams(a), grams(b)
    return 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    m = len(mine)
    swapped = sum(x != y for x, y in zip(mine, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def _ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


def _token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    left, right = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    return max(_ratio(left, right), _ratio(both, left) if both else 0.0, _ratio(both, right) if both else 0.0)


def _pairwise(f):
    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return run


def jaro_winkler(a: Column, b: Column) -> Column:
    return _pairwise(_jaro_winkler)(a, b)


def ratio(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (|a| + |b|); 100 for two empty strings."""
    return _pairwise(_ratio)(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return _pairwise(_token_set_ratio)(a, b)
