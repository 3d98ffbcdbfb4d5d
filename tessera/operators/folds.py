"""Deterministic folds and samples: hashes decide, never row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(salt: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(salt), key).cast("binary"), 256)


def stable_bucket(salt: str, key: Column, buckets: int = 100) -> Column:
    return F.pmod(F.conv(F.substring(digest(salt, key), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def digest_rank(df: DataFrame, key: str, salt: str, by: list[str]) -> DataFrame:
    """With r, the row's place by its key's digest among the rows equal in `by`, and n, how many these are.

    Rows are ranked within the 4096 ranges of the digest's first three digits, and each range's offset is added, so no
    task sorts a whole group.
    """
    at = digest(salt, F.col(key))
    x = df.withColumn("__digest", at).withColumn("__range", F.substring(at, 1, 3))
    sizes = x.groupBy(*by, "__range").agg(F.count("*").alias("__c"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum("__c").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")
    offsets = sizes.select(*by, "__range", before.alias("__o"), F.sum("__c").over(group).alias("n"))  # 4096 rows for each group at most
    r = F.row_number().over(Window.partitionBy(*by, "__range").orderBy("__digest", key))
    return x.withColumn("__r", r).join(offsets, [*by, "__range"]).withColumn("r", F.col("__r") + F.col("__o")).drop("__digest", "__range", "__r", "__o")


def count_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n == 1, "1").when(n == 2, "2").when(n <= 4, "3-4").otherwise("5+")


def fold_manifest(entities: DataFrame, targets: DataFrame, truth: DataFrame, salt: str = "fold") -> DataFrame:
    """entity_id, role, country, fold, stratum, match_count: 80/10/10 within strata of country and links.

    Owned targets follow their owner; unmatched ones are ranked by their own hash within the country.
    """
    counted = entities.join(truth.groupBy(F.col("q").alias("entity_id")).agg(F.count("*").alias("match_count")), "entity_id", "left").na.fill(0, ["match_count"])
    counted = counted.withColumn("stratum", F.concat_ws("|", "country", count_bucket(F.col("match_count"))))

    def fold(df: DataFrame, by: str) -> DataFrame:
        x = digest_rank(df, "entity_id", salt, [by])
        return x.withColumn("fold", F.when(F.col("r") <= F.floor(F.col("n") * 8 / 10), "dev").when(F.col("r") <= F.floor(F.col("n") * 9 / 10), "val").otherwise("holdout")).drop("r", "n")

    q = fold(counted, "stratum").select("entity_id", F.lit("query").alias("role"), "country", "fold", "stratum", "match_count")
    owned = truth.join(q.select(F.col("entity_id").alias("q"), "country", "fold"), "q").select(F.col("t").alias("entity_id"), F.lit("target").alias("role"), "country", "fold", F.lit("owned").alias("stratum"), F.lit(1).cast("long").alias("match_count"))
    free = fold(targets.join(truth.select(F.col("t").alias("entity_id")), "entity_id", "left_anti"), "country")
    free = free.select("entity_id", F.lit("target").alias("role"), "country", "fold", F.lit("free").alias("stratum"), F.lit(0).cast("long").alias("match_count"))
    return q.unionByName(owned).unionByName(free)


def with_owners(manifest: DataFrame, truth: DataFrame, sample: int = 20, salt: str = "sample") -> DataFrame:
    """The manifest with source, owner_id, assignment, and sample: held-out queries among the first of their stratum."""
    owners = truth.select(F.col("t").alias("entity_id"), F.lit("target").alias("role"), F.col("q").alias("owner_id"))
    x = digest_rank(manifest.join(owners, ["entity_id", "role"], "left"), "entity_id", salt, ["role", "stratum"]).drop("n")
    kind = F.when(F.col("role") == "query", "query").when(F.col("owner_id").isNotNull(), "owner").otherwise("unmatched")
    chosen = (F.col("role") == "query") & (F.col("r") <= sample) & (F.col("fold") != "dev")
    return x.withColumn("source", F.substring("entity_id", 2, 1).cast("int")).withColumn("assignment", kind).withColumn("sample", chosen).drop("r")


def mini_world(manifest: DataFrame, salt: str = "mini", of_100: int = 10) -> DataFrame:
    """A closed subsample of a manifest with owners: some queries by hash, all targets they own, and as many of the unmatched."""
    x = manifest.withColumn("b", stable_bucket(salt, F.col("entity_id")))
    queries = x.where((F.col("role") == "query") & (F.col("b") < of_100))
    owned = x.where("assignment = 'owner'").join(queries.select(F.col("entity_id").alias("owner_id")), "owner_id", "left_semi").select(x.columns)
    return queries.unionByName(owned).unionByName(x.where((F.col("assignment") == "unmatched") & (F.col("b") < of_100))).drop("b")


def stratified_sample(entities: DataFrame, stratum: str, size: int, salt: str = "sample") -> DataFrame:
    """Proportional, by largest remainder; within a stratum the least digests."""
    per = entities.groupBy(stratum).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("all"))
    share = per.crossJoin(F.broadcast(total)).select(stratum, F.expr(f"{size} * n div all").alias("base"), F.expr(f"({size} * n) % all").alias("rest"))
    left = share.agg((F.lit(size) - F.sum("base")).alias("left"))
    quota = share.crossJoin(F.broadcast(left)).withColumn("o", F.row_number().over(Window.orderBy(F.desc("rest"), stratum)))  # a row for each stratum
    quota = quota.select(stratum, (F.col("base") + F.when(F.col("o") <= F.col("left"), 1).otherwise(0)).alias("quota"))
    r = F.row_number().over(Window.partitionBy(stratum).orderBy(digest(salt, F.col("entity_id")), "entity_id"))
    return entities.join(F.broadcast(quota), stratum).withColumn("r", r).where("r <= quota").drop("r", "quota")


def hard_negatives(pairs: DataFrame, per_positive: int = 3, least: int = 2, salt: str = "neg") -> DataFrame:
    """All positives; negatives up to max(least, per_positive * positives) of a query, taken in turn from its slices.

    weight restores each slice's share. pairs: q, t, y, slice.
    """
    neg = pairs.where("y = 0").withColumn("rn", F.row_number().over(Window.partitionBy("q", "slice").orderBy(digest(salt, F.concat_ws(":", "q", "t")), "t")))
    turn = neg.withColumn("o", F.row_number().over(Window.partitionBy("q").orderBy("rn", "slice"))).withColumn("total", F.count("*").over(Window.partitionBy("q", "slice")))
    budget = pairs.groupBy("q").agg(F.greatest(F.lit(least), per_positive * F.sum("y")).alias("budget"))
    took = turn.join(budget, "q").where("o <= budget")
    took = took.withColumn("weight", F.round(F.col("total") / F.count("*").over(Window.partitionBy("q", "slice")), 9)).select("q", "t", "y", "slice", "weight")
    return pairs.where("y = 1").select("q", "t", "y", "slice", F.lit(1.0).alias("weight")).unionByName(took)
