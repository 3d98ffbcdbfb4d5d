"""Text hygiene: comparison keys, repairs and flags as column expressions.

Unicode normalisation and the skeleton's fixpoint have no built-in; they are Arrow UDFs over whole batches.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F


def _normal(form: str):
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([v if v is None or v.isascii() else unicodedata.normalize(form, v) for v in values.to_pylist()], pa.string())

    return run


def nfc(c: Column) -> Column:
    return _normal("NFC")(c)


def nfd(c: Column) -> Column:
    return _normal("NFD")(c)


def nfkc(c: Column) -> Column:
    return _normal("NFKC")(c)


def comparison_key(c: Column) -> Column:
    """Lower case; every run of anything but letters, marks and numbers is one space."""
    return F.trim(F.regexp_replace(F.lower(nfc(c)), r"[^\p{L}\p{M}\p{N}]+", " "))


def remove_joiners(c: Column) -> Column:
    return F.translate(c, "‌‍", "")


#: Letters that decomposition leaves alone, and what they fold to; fixed values.
LIGATURES = {"œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ß": "ss", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ı": "i"}


def fold_latin(c: Column) -> Column:
    """Drops the marks of Latin letters, keeps those of other scripts, unfolds ligatures."""
    out = F.regexp_replace(nfd(c), r"(?<=\p{IsLatin})\p{M}+", "")
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return nfc(out)


def fold_word(word: str) -> str:
    """fold_latin for one word in Python."""
    if word.isascii():
        return word
    bare = regex.sub(r"(?<=\p{Latin})\p{M}+", "", unicodedata.normalize("NFD", word))
    return unicodedata.normalize("NFC", "".join(LIGATURES.get(c, c) for c in bare))


def repair_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"(?:[ÂâÃ](?=[\x{80}-\x{9f}]))?[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]+", " ")


def normalize_punctuation(c: Column) -> Column:
    out = F.translate(c, "’‘‛‐‑‒–—―−º", "'''-------°")
    return F.regexp_replace(out, r"(?U)(?<!\w)([Nn])\s?°\s?(?=\d)", "$1o ")


def join_apostrophes(c: Column) -> Column:
    return F.translate(c, "'’", "")


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+", " "))


#: Legal forms that are written with dots; fixed values.
DOTTED = ("LLC", "LLP", "LP", "PLC", "PC", "PA", "SA", "SARL", "SAS", "GMBH", "AG", "BV", "NV", "PVT", "LTD", "INC", "CO")


def join_dotted_legal(c: Column) -> Column:
    """L.L.C. to LLC, where the joined form is a legal form; dotted initials stay."""
    out = c
    for form in sorted(DOTTED, key=len, reverse=True):  # S.A.R.L. is no S.A.
        out = F.regexp_replace(out, r"(?i)(?<![\p{L}\p{N}.])" + r"\.\s?".join(f"({x})" for x in form) + r"(?:\.(?![\p{L}\p{N}])|(?![\p{L}\p{N}.]))", "".join(f"${i + 1}" for i in range(len(form))))
    return out


def flags(c: Column) -> dict[str, Column]:
    return {
        "has_control": c.rlike(r"\p{Cc}"),
        "has_format": c.rlike(r"\p{Cf}"),
        "has_mojibake": c.rlike(r"[\x{80}-\x{9f}\x{1a}]"),
        "has_multispace": c.rlike(r"[ \t\n\r\f\x{0b}]{2,}"),
    }


def clean_text(c: Column, dotted: bool = False) -> tuple[Column, Column]:
    """(cleaned text, codes of the repairs that changed it, joined by commas)."""
    steps = [("nfc", nfc), ("controls", repair_controls), ("joiners", remove_joiners), ("punct", normalize_punctuation)]
    steps += [("dotted", join_dotted_legal)] * dotted + [("ws", collapse_ws)]
    now, codes = c, []
    for code, step in steps:
        new = step(now)
        codes.append(F.when(~new.eqNullSafe(now), F.lit(code)))
        now = new
    return now, F.array_join(F.array_compact(F.array(*codes)), ",")


#: Bits of a script mask, in this order; anything else with a letter sets the last.
SCRIPTS = ("Latin", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam")


def script_mask(c: Column) -> Column:
    mask = F.lit(0)
    for i, s in enumerate(SCRIPTS):
        mask = mask + F.when(c.rlike(rf"\p{{Is{s}}}"), 1 << i).otherwise(0)
    known = "".join(rf"\p{{Is{s}}}" for s in SCRIPTS)
    return (mask + F.when(c.rlike(rf"[\p{{L}}&&[^{known}]]"), 1 << len(SCRIPTS)).otherwise(0)).cast("int")


#: One pass of the phonetic skeleton over ASCII words, as (pattern, replacement); fixed values.
DIGRAPHS = [("ph", "f"), ("sh", "s"), ("ch", "c"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("jh", "j")]
SINGLES = [("w", "v"), ("z", "j"), ("q", "k"), ("y", "i"), ("x", "ks")]
COARSE = [("d", "t"), ("g", "k"), ("c", "k"), ("b", "p"), ("m", "n")]
PASSES = 4


def skeleton_steps() -> list[tuple[str, str]]:
    """A fixed number of replacements, as the registered SQL has them; a word that needs more passes differs from skeleton()."""
    doubles = [(f"{c}{c}+", c) for c in "abcdefghijklmnopqrstuvwxyz"]
    one = [*DIGRAPHS, *SINGLES, *doubles]
    vowels = [(r"([a-z])[aeiou]+", r"\1")]
    return [*one * PASSES, *vowels, *doubles, *COARSE, *doubles]


_SINGLE, _MERGE = ({ord(a): b for a, b in pairs} for pairs in (SINGLES, COARSE))
_DOUBLE, _VOWELS, _WORDS = re.compile(r"([a-z0-9])\1+"), re.compile("[aeiou]"), re.compile("[a-z0-9]+")


def skeleton_word(word: str) -> str:
    """The whole pass, vowels and coarse merges included, until nothing changes: both can form a digraph anew."""
    while True:
        new = word
        for a, b in DIGRAPHS:
            new = new.replace(a, b)
        new = _DOUBLE.sub(r"\1", new.translate(_SINGLE))
        new = new[:1] + _VOWELS.sub("", new[1:])
        new = _DOUBLE.sub(r"\1", new.translate(_MERGE))
        if new == word:
            return word
        word = new


def skeleton(c: Column) -> Column:
    """The skeletons of a text's ASCII words; anything but letters and digits parts words."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([v if v is None else " ".join(map(skeleton_word, _WORDS.findall(v.lower()))) for v in values.to_pylist()], pa.string())

    return run(c)


def let(c: Column, use) -> Column:
    """use(c) with c evaluated once: the optimizer would otherwise repeat its expression inside lambdas."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def tokens(c: Column) -> Column:
    """Distinct words of a key; an empty key has none."""
    return F.filter(F.array_distinct(F.split(c, " ")), lambda x: x != "")


def char_grams(c: Column, n: int = 3, first: int | None = 40) -> Column:
    """Distinct n-grams of the first characters of a key, or of all of them."""

    def grams(head: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(head) - n + 1, F.lit(1)))
        return F.when(F.length(head) >= n, F.array_distinct(F.transform(at, lambda i: F.substr(head, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    def of_characters(x: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(x) - n + 1, F.lit(1)))
        return F.when(F.size(x) >= n, F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(x, i, F.lit(n)), "")))).otherwise(F.array().cast("array<string>"))

    return let(F.split(c, ""), of_characters) if first is None else let(F.substring(c, 1, first), grams)


def bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring words of a key."""

    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.array_distinct(F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))

    return let(F.split(c, " "), pairs)
