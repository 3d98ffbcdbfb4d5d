"""URL filtering: a blocked Bloom filter in front of an exact hash join. DataFrame functions only.

Two kinds of entries are listed: rules, each a host with all its subdomains and a path prefix, and
canonical URLs. A URL's keys are its own canonical form and every (host suffix, path prefix) under
which a rule could be listed. Each listed key sets K bits in the 64-bit word of one block; a key
whose bits aren't all set is certainly unlisted, and only the others, the possible hits, go to the
exact join, which removes the false positives.

The filter is a table of (block, word). It is broadcast only while its number of blocks, known from
the count of entries, is within BROADCAST_BLOCKS; beyond that it is joined by block.

Defined results: a null url, or one without `://`, has an empty host and path and is allowed;
repeated rows are judged once each; an empty table, list or set of rules is fine; columns other than
those named are ignored; rules listed twice count once (a block wins over an allow).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits set for a key; keys for each block on average.
K, KEYS_PER_BLOCK = 5, 6
BROADCAST_BLOCKS = 1 << 18


def url_host(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without `www.` or `m.`, path without an ending slash."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"/+$", ""))


def _place(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), blocks)


def _bits(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(2))
    word = F.lit(0).cast("long")
    for i in range(K):
        word = word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return word


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, word): the blocked filter of a column of keys."""
    return keys.groupBy(_place(F.col(key), F.lit(blocks)).alias("block")).agg(F.bit_or(_bits(F.col(key))).alias("word"))


def maybe_listed(keys: DataFrame, key: str, words: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key may be listed: all that are, and a few that aren't."""
    if blocks <= BROADCAST_BLOCKS:
        words = F.broadcast(words)
    probe = keys.withColumn("block", _place(F.col(key), F.lit(blocks))).join(words, "block")
    return probe.where(F.col("word").bitwiseAND(_bits(F.col(key))) == _bits(F.col(key))).drop("block", "word")


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for every page.

    rules: (verdict, host, path). listed: (url) in canonical form; a page that no rule fits is
    blocked if its canonical URL is listed. Of the rules that fit, the longest wins.
    """
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    entries = rules.select(F.concat_ws(" ", "host", "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict").unionAll(
        listed.select(F.concat(F.lit("="), F.col("url")).alias("key"), F.lit(None).cast("string"), F.lit("block")).where("key is not null").distinct()
    )
    shape = entries.agg(F.count("*").alias("n")).first()
    # a number for each distinct length of a rule's path: as many as the longest path has characters at most
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]
    blocks = max(1, -(-shape["n"] // KEYS_PER_BLOCK))
    words = bloom(entries, "key", blocks)

    seen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url")).select("page_id", url_host(F.col("__url")).alias("host"), url_path(F.col("__url")).alias("path"))
    seen = seen.select("page_id", "host", "path")
    urls = seen.select("host", "path").distinct()  # a URL that a third of all pages share is judged once
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    starts = F.array_distinct(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]))
    keys = urls.select(
        "host", "path",
        F.explode(F.concat(
            F.array(F.concat(F.lit("="), canonical(F.col("host"), F.col("path")))),
            F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(starts, lambda p: p.isNotNull()), lambda p: F.concat_ws(" ", s, p)))),
        )).alias("key"),
    )
    hits = maybe_listed(keys, "key", words, blocks).join(entries, "key")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.coalesce(F.length("rule"), F.lit(-1)).alias("n"), "rule", "verdict")).alias("top"))
    return seen.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit("allow")).alias("verdict"))
