"""Verification: named predicates in one scan, leakage, contracts, submissions, coverage, determinism.

Every check is a row (name, violations); a sound table has none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

S1_ID, TARGET_ID = r"^S1-[0-9]+$", r"^S[23]-[0-9]+$"
FOLDS = ("dev", "val", "holdout")


def stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def counted(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations")


def invariants(df: DataFrame, predicates: dict[str, Column | str]) -> DataFrame:
    """How many rows meet each predicate, which none should; one scan for all. A null counts as not met."""
    as_column = lambda p: F.expr(p) if isinstance(p, str) else p
    return df.agg(*[F.count_if(as_column(p)).alias(n) for n, p in predicates.items()]).unpivot([], list(predicates), "name", "violations")


def nulls(df: DataFrame) -> DataFrame:
    """Null values of every column, and null elements of every array, in one scan."""
    found: dict[str, Column] = {}
    for f in df.schema.fields:
        found[f.name] = F.col(f"`{f.name}`").isNull()
        if isinstance(f.dataType, ArrayType):
            found[f"{f.name}[]"] = F.exists(f"`{f.name}`", lambda x: x.isNull())
    return invariants(df, found)


def coverage(stored: DataFrame, source: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Rows of a derived table against its source: unique keys, equal totals, nothing lost or added, raw columns unchanged."""
    both = source.select(key, *[F.col(c).alias(f"s_{c}") for c in same], F.lit(1).alias("s")).join(stored.select(key, *same, F.lit(1).alias("d")), key, "full")
    differ = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in same], F.lit(False))
    joined = invariants(both, {"missing": F.col("d").isNull(), "added": F.col("s").isNull(), "changed": F.col("d").isNotNull() & F.col("s").isNotNull() & differ})
    repeats = stored.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    totals = stored.agg(F.count("*").alias("a")).crossJoin(source.agg(F.count("*").alias("b")))  # a row each
    return stacked([joined, counted("repeated_key", repeats), totals.select(F.lit("rows_differ").alias("name"), F.abs(F.col("a") - F.col("b")).alias("violations"))])


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with their multiplicity, in one table only."""
    return stacked([counted("only_first", a.exceptAll(b)), counted("only_second", b.exceptAll(a))])


def content_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): the sum of 48 bits of each row's SHA-256; the same in any order, no task holds the table."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    bits = F.conv(F.substring(F.sha2(line.cast("binary"), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(bits).cast("string").alias("digest"))


def reproduction(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counters that two ways of counting give differently, or only one gives: keys, first, second."""
    x, y = a.select(*keys, F.col(value).alias("first")), b.select(*keys, F.col(value).alias("second"))
    return x.join(y, keys, "full").where(~F.col("first").eqNullSafe(F.col("second")))


def leakage(manifest: DataFrame, queries: DataFrame, targets: DataFrame, truth: DataFrame, floor: tuple[int, int] = (8, 9), drift: float = 4.0, recomputed: DataFrame | None = None, stress: DataFrame | None = None) -> DataFrame:
    """The checks of a fold manifest (entity_id, role, country, fold, stratum, match_count, owner_id, assignment, sample).

    queries and targets: entity_id; truth: q, t; recomputed: entity_id and fold by another way; stress: entity_id, role, fold, group_id.
    """
    q, t = manifest.where("role = 'query'"), manifest.where("role = 'target'")
    strata = lambda rows: rows.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(F.col("fold") == "dev").alias("d"), F.count_if(F.col("fold") == "val").alias("v")).where(f"d <> n * {floor[0]} div 10 or d + v <> n * {floor[1]} div 10")

    def differs(found: DataFrame, want: DataFrame) -> DataFrame:
        a, b = found.select("entity_id"), want.select("entity_id")
        return a.join(b, "entity_id", "left_anti").unionAll(b.join(a, "entity_id", "left_anti"))

    def crossing(x: DataFrame) -> DataFrame:
        of = lambda role, n: x.where(F.col("role") == role).select(F.col("entity_id").alias(n), F.col("fold").alias(f"f{n}"))
        return truth.select("q", "t").join(of("query", "q"), "q").join(of("target", "t"), "t").where("fq <> ft")

    owner = t.select(F.col("entity_id").alias("t"), "owner_id", "assignment").join(truth.select("q", "t"), "t")
    number = q.select("fold", F.regexp_extract("entity_id", "([0-9]+)$", 1).cast("double").alias("n"))
    all_ids = number.agg(F.avg("n").alias("mu"), F.stddev_pop("n").alias("sd"))
    tracked = number.groupBy("fold").agg(F.count("*").alias("k"), F.avg("n").alias("m")).crossJoin(F.broadcast(all_ids)).where(F.abs((F.col("m") - F.col("mu")) / (F.col("sd") / F.sqrt("k"))) >= drift)
    linked = truth.groupBy(F.col("q").alias("entity_id")).agg(F.count("*").alias("links"))
    parts = [
        counted("L01 entity twice in a role", manifest.groupBy("role", "entity_id").agg(F.count("*").alias("n")).where("n > 1")),
        counted("L02 queries are not the entities", differs(q, queries)),
        counted("L03 targets are not the targets", differs(t, targets)),
        counted("L04 other fold", manifest.where(~F.coalesce(F.col("fold").isin(*FOLDS), F.lit(False)))),
        counted("L05 link across folds", crossing(manifest)),
        counted("L06 other owner", owner.where(~F.col("owner_id").eqNullSafe(F.col("q")) | ~F.col("assignment").eqNullSafe(F.lit("owner")))),
        counted("L07 linked target as unmatched", t.where("assignment = 'unmatched'").join(truth.select(F.col("t").alias("entity_id")), "entity_id", "left_semi")),
        counted("L08 strata of queries off the floor rule", strata(q)),
        counted("L09 strata of unmatched targets off the floor rule", strata(t.where("assignment = 'unmatched'"))),
        counted("L11 fold tracks the id", tracked),
        counted("L12 match count is not that of the truth", q.join(linked, "entity_id", "left").where("match_count <> coalesce(links, 0)")),
        counted("L13 fold without queries", F.broadcast(manifest.sparkSession.createDataFrame([(f,) for f in FOLDS], "fold string")).join(q.select("fold").distinct(), "fold", "left_anti")),
        counted("L14 sample outside held-out queries", manifest.where("sample and (role <> 'query' or fold = 'dev')")),
    ]
    if recomputed is not None:
        parts.append(counted("L10 fold is not reproduced", manifest.where("role = 'query' or assignment = 'unmatched'").join(recomputed.select("entity_id", F.col("fold").alias("again")), "entity_id", "left").where(~F.col("fold").eqNullSafe(F.col("again")))))
    if stress is not None:
        parts += [
            counted("L15 group in several folds", stress.where("role = 'query'").groupBy("group_id").agg(F.min("fold").alias("a"), F.max("fold").alias("b")).where("a <> b")),
            counted("L16 link across stress folds", crossing(stress)),
            counted("L17 other entities in the stress manifest", differs(stress, manifest)),
        ]
    return stacked(parts)


def candidate_leakage(candidates: DataFrame, manifest: DataFrame, fold: str) -> DataFrame:
    """Candidates (q, t) of a fold's queries: queries and targets of that fold only, no pair twice."""
    side = lambda role, n: manifest.where(F.col("role") == role).select(F.col("entity_id").alias(n), F.col("fold").alias("f"))
    strays = [counted(f"{n} outside {fold}", candidates.select(n).distinct().join(side(role, n), n, "left").where(~F.col("f").eqNullSafe(F.lit(fold)))) for role, n in (("query", "q"), ("target", "t"))]
    return stacked([*strays, counted("pair twice", candidates.groupBy("q", "t").agg(F.count("*").alias("n")).where("n > 1"))])


def contract(pairs: DataFrame) -> DataFrame:
    """Candidate pairs (s1_entity_id, candidate_entity_id, country, is_positive, sample_weight, channels, scores, ranks)."""
    aligned = lambda c: ~F.size(c).isin(0) & (F.size(c) != F.size("channels"))
    rows = invariants(pairs, {
        "bad query id": ~F.coalesce(F.col("s1_entity_id").rlike(S1_ID), F.lit(False)), "bad target id": ~F.coalesce(F.col("candidate_entity_id").rlike(TARGET_ID), F.lit(False)),
        "no country": F.coalesce(F.col("country"), F.lit("")) == "", "bad label": ~F.coalesce(F.col("is_positive").isin(-1, 0, 1), F.lit(False)), "weight not positive": ~F.coalesce(F.col("sample_weight") > 0, F.lit(False)),
        "scores not aligned": aligned("scores"), "ranks not aligned": aligned("ranks"), "channel twice": F.size(F.array_distinct("channels")) != F.size("channels"),
    })
    return rows.unionAll(counted("pair twice", pairs.groupBy("s1_entity_id", "candidate_entity_id").agg(F.count("*").alias("n")).where("n > 1")))


def submission(lists: DataFrame, required: DataFrame, valid: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """A submission (q, ids), ids joined by commas: how many queries or ids break each rule; required: q; valid: t; candidates: q, ids."""
    split = lambda x: x.select("q", F.filter(F.split(F.coalesce("ids", F.lit("")), ","), lambda i: i != "").alias("ids"))
    rows = split(lists)
    ids = rows.select("q", F.explode("ids").alias("t"))
    one = ids.select("t").distinct()
    parts = [
        counted("query on several rows", rows.groupBy("q").agg(F.count("*").alias("n")).where("n > 1")),
        counted("id twice in a list", rows.where(F.size(F.array_distinct("ids")) != F.size("ids")).select("q").distinct()),
        counted("own source as a match", one.where(F.col("t").startswith("S1-"))),
        counted("prefix of no source", one.where(~F.col("t").rlike("^S[123]-"))),
        counted("unknown id", one.where(F.col("t").rlike("^S[23]-")).join(valid.select("t"), "t", "left_anti")),
        counted("query missing", required.select("q").join(rows, "q", "left_anti")),
        counted("query not asked for", rows.select("q").distinct().join(required, "q", "left_anti")),
    ]
    if candidates is not None:
        parts.append(counted("match that is no candidate", ids.distinct().join(split(candidates).select("q", F.explode("ids").alias("t")), ["q", "t"], "left_anti")))
    return stacked(parts)


def gates(metrics: DataFrame) -> DataFrame:
    """(gate, value, passed) of one row with recall, oracle_f05 and zero_rate."""
    rules = [("recall", ">=", 0.99), ("oracle_f05", ">=", 0.97), ("zero_rate", "<=", 0.005)]  # fixed values
    return metrics.select(F.inline(F.array(*[F.struct(F.lit(f"{n} {op} {x}").alias("gate"), F.col(n).cast("double").alias("value"), F.expr(f"{n} {op} {x}").alias("passed")) for n, op, x in rules])))


def allowed_features(columns: list[str], allowed: list[str], forbidden: tuple[str, ...] = ("label", "is_positive", "entity_id", "fold", "country")) -> list[str]:
    """The columns a model may see, in the order allowed; raises for one that is forbidden or missing."""
    bad = [c for c in allowed if c in forbidden or any(c.endswith(f"_{f}") for f in forbidden)]
    if bad or set(allowed) - set(columns):
        raise ValueError(f"forbidden {bad}, missing {sorted(set(allowed) - set(columns))}")
    return list(allowed)
