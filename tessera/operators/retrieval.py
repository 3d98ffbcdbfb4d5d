"""Candidate retrieval: equality blocks, rare-token postings and their evaluation.

Queries and targets are (id, ...) frames with a `country` wherever candidates must not cross it.
Every rank has a total order that ends in the target's id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE = ["channel", "q", "t", "rnk", "score", "blk"]


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc("t")))
    return found.withColumn("rnk", rank).where(F.col("rnk") <= k).select(*CANDIDATE)


#: Tasks that the queries of one block are dealt to, at least.
DEALT = 16


def equality_channel(name: str, queries: DataFrame, targets: DataFrame, key: Column, secondary: Column | None = None, cap: int = 100) -> DataFrame:
    """Targets with the query's non-empty key. Blocks over `cap` are ranked by the secondary similarity.

    queries have q, targets t, and both the columns that key reads; secondary reads q_* and t_* columns.
    The secondary is evaluated for oversize blocks only: they are split off before it. Without one a key has the same
    targets for all its queries, so the first `cap` are taken before the join, which bounds it. With one that holds for
    queries of the same columns, so pass only those that key and secondary read (see _by_classes).
    """
    of_q, of_t = [c for c in queries.columns if c != "q"], [c for c in targets.columns if c != "t"]
    ours = queries.select("q", key.alias("k"), F.struct(*[F.col(c).alias(f"q_{c}") for c in of_q]).alias("of_q")).where("k <> ''")
    theirs = targets.select("t", key.alias("k"), F.struct(*[F.col(c).alias(f"t_{c}") for c in of_t]).alias("of_t")).where("k <> ''")
    sizes = theirs.join(ours.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.count("*").cast("int").alias("blk"))

    def first(*by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("t"))
        return theirs.select("t", *by).withColumn("rnk", place).where(F.col("rnk") <= cap)

    if secondary is None:
        return ours.select("q", "k").join(sizes, "k").join(first("k"), "k").select(F.lit(name).alias("channel"), "q", "t", "rnk", F.lit(1.0).alias("score"), "blk").select(*CANDIDATE)
    ours = ours.withColumn("rows", F.count("*").over(Window.partitionBy("q")))
    small = first("k").join(sizes.where(F.col("blk") <= cap), "k")
    small = ours.select("q", "k", "rows").join(small, "k").select("q", "t", "rnk", F.lit(1.0).alias("score"), "blk", "rows")
    found = small.unionByName(_by_classes(ours, first("k", "of_t"), sizes.where(F.col("blk") > cap), secondary, cap)).withColumn("channel", F.lit(name))
    # a query of several rows is ranked over all of them
    return found.where(F.col("rows") == 1).select(*CANDIDATE).unionByName(_top(found.where(F.col("rows") > 1), cap))


def _by_classes(ours: DataFrame, first: DataFrame, sizes: DataFrame, secondary: Column, cap: int) -> DataFrame:
    """The best `cap` targets of each row of ours, found once for all queries of the same k and of_q.

    Targets of the same k and of_t have the same score, so of them only the first `cap` can be wanted, and of these classes
    only the `cap` best by score and first target: each class before them has a target that comes before all of theirs.
    Pairs are thus of distinct (k, of_q) and (k, of_t), whatever the number of rows; a block's queries are dealt to tasks,
    to a stated number of partitions, since few bytes here are many pairs and would be joined in one task otherwise.
    """
    spark = ours.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    classes = first.groupBy("k", "of_t").agg(F.array_sort(F.collect_list(F.struct("rnk", "t"))).alias("ts")).join(sizes, "k")
    asked = ours.select("k", "of_q").distinct().withColumn("deal", F.pmod(F.xxhash64("of_q"), F.lit(DEALT))).repartition(n, "k", "deal")
    dealt = classes.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long")))).repartition(n, "k", "deal")
    met = asked.join(dealt, ["k", "deal"])
    met = met.select("k", "of_q", "blk", "ts", "of_q.*", "of_t.*").select("k", "of_q", "blk", "ts", secondary.cast("double").alias("score"))
    one = Window.partitionBy("k", "of_q")
    met = met.withColumn("place", F.row_number().over(one.orderBy(F.desc("score"), F.col("ts")[0]["t"]))).where(F.col("place") <= cap)
    met = met.select("k", "of_q", "blk", "score", F.explode("ts.t").alias("t"))
    met = met.withColumn("rnk", F.row_number().over(one.orderBy(F.desc("score"), "t"))).where(F.col("rnk") <= cap)
    best = met.groupBy("k", "of_q", "blk").agg(F.collect_list(F.struct("t", "rnk", "score")).alias("best"))
    return ours.join(best, ["k", "of_q"]).select("q", "rows", "blk", F.explode("best").alias("b")).select("q", "b.t", "b.rnk", "b.score", "blk", "rows")


#: Rows that are sent to every executor at most; beyond that many both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def bounded(rows: DataFrame, each: int = 1) -> bool:
    """Whether `each` times the rows are within BROADCAST_ROWS, by counting no more than that."""
    most = BROADCAST_ROWS // each
    return rows.limit(most + 1).count() <= most


def postings_channel(name: str, queries: DataFrame, targets: DataFrame, tokens: Column, df_cap: int | None = 3000, rarest: int = 6, min_shared: int = 1, k: int = 100) -> DataFrame:
    """Targets that share rare tokens, scored by the sum of integer micro-IDFs.

    Only each query's rarest tokens are looked up, of these the ones in at most df_cap targets; a query that has no
    token within df_cap, or any query with df_cap None, is looked up by its rarest whatever their frequency. Sums are of
    integers, so they are exact in any order. While the queries' tokens are bounded, targets are read twice and neither
    time shuffled by token: counts combine on the map side, and the chosen tokens are broadcast.
    """
    ours = queries.select("q", F.explode(tokens).alias("tok"))
    theirs = targets.select("t", F.explode(tokens).alias("tok"))
    asked = ours.select("tok").distinct()
    counted = theirs.join(F.broadcast(asked), "tok", "left_semi") if bounded(asked) else theirs
    n = targets.agg(F.count("*").alias("n"))
    df = counted.groupBy("tok").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(n)).select("tok", "df", F.round(F.log((F.col("n") + 1) / (F.col("df") + 0.5)) * 1e6).cast("long").alias("idf"))
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("idf"), F.asc("tok")))
    chosen = ours.join(idf, "tok").withColumn("r", order).withColumn("least", F.min("df").over(Window.partitionBy("q"))).where(F.col("r") <= rarest)
    if df_cap is not None:
        chosen = chosen.where((F.col("df") <= df_cap) | (F.col("least") > df_cap))
    chosen = chosen.select("q", "tok", "idf")
    found = theirs.join(F.broadcast(chosen) if bounded(queries, rarest) else chosen, "tok")
    found = found.groupBy("q", "t").agg(F.sum("idf").alias("s"), F.count("*").cast("int").alias("blk")).where(F.col("blk") >= min_shared)
    return _top(found.select(F.lit(name).alias("channel"), "q", "t", F.col("s").cast("double").alias("score"), "blk"), k)


def union_channels(*channels: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, channels)


def within(spec: dict[str, int]) -> Column:
    """The candidates that a spec {channel: k} admits."""
    return reduce(lambda a, b: a | b, [(F.col("channel") == c) & (F.col("rnk") <= k) for c, k in spec.items()])


def evaluate(candidates: DataFrame, queries: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: links, hits, recalls, candidate counts and the oracle's macro-F0.5. queries: q; truth: q, t."""
    cand = candidates.select("q", "t").distinct()
    per = (
        queries.select("q")
        .join(truth.groupBy("q").agg(F.count("*").alias("n")), "q", "left")
        .join(cand.join(truth, ["q", "t"]).groupBy("q").agg(F.count("*").alias("h")), "q", "left")
        .join(cand.groupBy("q").agg(F.count("*").alias("c")), "q", "left")
        .na.fill(0, ["n", "h", "c"])
    )
    f = F.when((F.col("n") == 0), 1.0).when(F.col("h") == 0, 0.0).otherwise(1.25 * F.col("h") / (1.25 * F.col("h") + 0.25 * (F.col("n") - F.col("h"))))
    return per.agg(
        F.count("*").alias("queries"), F.sum("n").alias("links"), F.sum("h").alias("hits"),
        F.round(F.sum("h") / F.sum("n"), 9).alias("micro_recall"),
        F.round(F.avg(F.when(F.col("n") > 0, F.col("h") / F.col("n"))), 9).alias("macro_recall"),
        F.round(F.avg(F.when(F.col("n") > 0, (F.col("h") == F.col("n")).cast("int"))), 9).alias("all_links"),
        F.round(F.avg((F.col("c") == 0).cast("int")), 9).alias("zero_rate"),
        F.round(F.avg("c"), 9).alias("cand_mean"), F.expr("percentile(c, 0.5)").alias("cand_p50"), F.expr("percentile(c, 0.9)").alias("cand_p90"), F.max("c").alias("cand_max"),
        F.round(F.avg(f), 9).alias("oracle_f05"),
    )


def aggregate(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row for each pair: aligned lists by channel, block, the query's count, evidence and label."""
    lists = F.array_sort(F.collect_list(F.struct("channel", "score", "rnk")))
    pairs = candidates.groupBy("q", "t").agg(lists.alias("l"), F.max(F.when(F.col("channel").like("eq_%"), F.col("blk"))).alias("block"), F.count("*").cast("int").alias("n_channels"))
    pairs = pairs.withColumn("n_candidates", F.count("*").over(Window.partitionBy("q")))
    evidence = F.when(F.col("block").isNotNull() & (F.col("n_channels") > 1), "exact+").when(F.col("block").isNotNull(), "exact").when(F.col("n_channels") > 1, "multi").otherwise("single")
    return pairs.join(truth.select("q", "t", F.lit(1).alias("y")).distinct(), ["q", "t"], "left").select(
        "q", "t",
        F.array_join(F.transform("l", lambda x: x["channel"]), ",").alias("channels"),
        F.array_join(F.transform("l", lambda x: x["rnk"].cast("string")), ",").alias("ranks"),
        F.coalesce("block", F.lit(0)).alias("block"), "n_channels", "n_candidates", evidence.alias("evidence"), F.coalesce("y", F.lit(0)).alias("is_positive"),
    )


def pivot(candidates: DataFrame, channels: list[str], missing_rank: int = 101) -> DataFrame:
    """Ranks and scores of each channel side by side, and scores relative to the query's best."""
    wide = candidates.groupBy("q", "t").agg(
        *[F.coalesce(F.max(F.when(F.col("channel") == c, F.col("rnk"))), F.lit(missing_rank)).alias(f"rank_{c}") for c in channels],
        *[F.coalesce(F.max(F.when(F.col("channel") == c, F.col("score"))), F.lit(0.0)).alias(f"score_{c}") for c in channels],
    )
    best = Window.partitionBy("q")
    return wide.select("*", *[F.round(F.coalesce(F.col(f"score_{c}") / F.nullif(F.max(f"score_{c}").over(best), F.lit(0.0)), F.lit(0.0)), 9).alias(f"rel_{c}") for c in channels])


def top_by_cosine(queries: DataFrame, vectors: DataFrame, size: int, k: int = 50) -> DataFrame:
    """(q, t, score, rnk): exact top-k inner product of unit vectors.

    queries (q, v) is a stated set, checked to be within 20,000 and broadcast; each task multiplies its vectors
    in blocks and keeps k for each query, so only k rows for each query and task are shuffled.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    rows = queries.select("q", "v").limit(20_001).collect()
    if len(rows) > 20_000:
        raise ValueError("more than 20,000 queries; pass them in blocks")
    unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    shared = spark.sparkContext.broadcast(([r["q"] for r in rows], unit(np.array([r["v"] for r in rows], float).reshape(-1, size))))

    def run(batches):
        names, x = shared.value
        best = [[] for _ in names]
        for b in batches:
            ids = b.column(0).to_pylist()
            s = x @ unit(np.array(b.column(1).to_pylist(), float).reshape(-1, size)).T
            for i in range(len(names)):
                best[i] = sorted(best[i] + [(-round(v, 9), t) for v, t in zip(s[i].tolist(), ids, strict=True) if t != names[i]])[:k]
        out = [(n, t, -v) for n, r in zip(names, best, strict=True) for v, t in r]
        yield pa.RecordBatch.from_pylist([{"q": n, "t": t, "score": v} for n, t, v in out], schema=pa.schema([("q", pa.int64()), ("t", pa.int64()), ("score", pa.float64())]))

    part = vectors.select("t", "v").mapInArrow(run, "q long, t long, score double")
    return part.withColumn("rnk", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc("t")))).where(F.col("rnk") <= k)
