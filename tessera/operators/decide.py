"""Decisions over scored pairs (q, t, p): thresholds, expected F0.5, one owner for each target, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _in_query():
    return Window.partitionBy("q").orderBy(F.desc("p"), F.asc("t"))



def ranked(pairs: DataFrame) -> DataFrame:
    """With `r`, the rank in its query, and `gap`, the leader's margin over the runner-up."""
    first, second = F.max(F.when(F.col("r") == 1, F.col("p"))), F.max(F.when(F.col("r") == 2, F.col("p")))
    all_q = Window.partitionBy("q")
    return pairs.withColumn("r", F.row_number().over(_in_query())).withColumn("gap", first.over(all_q) - F.coalesce(second.over(all_q), F.lit(0.0)))


def select_threshold(pairs: DataFrame, tau: Column | float, top_k: int, margin: float = 0.0) -> DataFrame:
    """p >= tau among the query's first top_k; nothing unless the leader's margin is enough.

    tau may be a column: ranks are over all candidates, then filtered.
    """
    return ranked(pairs).where((F.col("p") >= tau) & (F.col("r") <= top_k) & (F.col("gap") >= margin)).drop("r", "gap")


def decide_queries(pairs: DataFrame, tau: Column | float, top_k: int, margin: float = 0.0, max_card: int | None = None) -> DataFrame:
    """p >= tau first, then the first min(top_k, max_card) of what is left; nothing unless the leader's margin is enough."""
    cap = min(top_k, max_card) if max_card is not None else top_k
    left = ranked(pairs).where((F.col("p") >= tau) & (F.col("gap") >= margin)).drop("r", "gap") if margin > 0 else pairs.where(F.col("p") >= tau)
    return left.withColumn("r", F.row_number().over(_in_query())).where(F.col("r") <= cap).drop("r")


def decisions(queries: DataFrame, selected: DataFrame) -> DataFrame:
    """(q, matched): every query with its targets by descending p, an empty list without one. A pair of an unknown query fails the job."""
    lists = selected.groupBy("q").agg(F.sort_array(F.collect_list(F.struct(F.negative("p").alias("p"), "t"))).alias("l"))
    both = queries.select("q", F.lit(True).alias("known")).join(lists, "q", "full")
    refused = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("pair of an unknown query: "), F.col("q").cast("string"))).cast("long")).otherwise(F.col("q"))
    return both.select(refused.alias("q"), F.coalesce(F.col("l.t"), F.array().cast("array<long>")).alias("matched"))


def select_expected_f(pairs: DataFrame, recall: float = 1.0, top_k: int = 12, empty_bias: float = 0.0) -> DataFrame:
    """The prefix of a query with the greatest expected F0.5, if that exceeds the chance that nothing is true.

    With S the sum of the first m probabilities and T that of all over recall, a prefix is worth
    (1 - P(nothing is true)) * 1.25 S / (1.25 S + (m - S) + 0.25 max(T - S, 0)); of equal ones the shortest wins.
    """
    to_here = _in_query().rowsBetween(Window.unboundedPreceding, 0)
    x = pairs.withColumn("r", F.row_number().over(_in_query())).withColumn("tp", F.sum("p").over(to_here))
    all_q = Window.partitionBy("q")
    x = x.withColumn("total", F.greatest(F.sum("p").over(all_q) / recall, F.lit(1e-9))).withColumn("none", F.product(1 - F.col("p")).over(all_q))
    ratio = 1.25 * F.col("tp") / (1.25 * F.col("tp") + (F.col("r") - F.col("tp")) + 0.25 * F.greatest(F.col("total") - F.col("tp"), F.lit(0.0)))
    x = x.withColumn("ef", F.round((1 - F.col("none")) * ratio, 8)).where(F.col("r") <= top_k)
    best = x.groupBy("q").agg(F.max(F.struct("ef", F.negative("r").alias("m"))).alias("b"))
    return x.join(best, "q").where((F.col("r") <= F.negative("b.m")) & (F.col("b.ef") > F.round(F.col("none") + empty_bias, 8))).select("q", "t", "p")


def competitor_max(pairs: DataFrame) -> DataFrame:
    """With `comp`, the best p that another query has for the same target (0 without one)."""
    w = Window.partitionBy("t").orderBy(F.desc("p"), F.asc("q"))
    x = pairs.withColumn("o", F.row_number().over(w))
    all_t = Window.partitionBy("t")
    first, second = (F.max(F.when(F.col("o") == i, F.col("p"))).over(all_t) for i in (1, 2))
    return x.withColumn("comp", F.coalesce(F.when(F.col("o") == 1, second).otherwise(first), F.lit(0.0))).drop("o")


def one_owner(pairs: DataFrame, margin: float = 0.0, among: str = "all") -> DataFrame:
    """Drops a pair whose target another query holds with more than margin above it; ties keep both.

    With a boolean column `selected` only such pairs stay; among="selected" lets only these compete, "all" every pair.
    """
    if "selected" not in pairs.columns:
        return competitor_max(pairs).where(F.col("comp") <= F.col("p") + margin).drop("comp")
    pool = pairs.withColumn("own", F.col("p"))
    if among == "selected":
        pool = pool.withColumn("p", F.when(F.col("selected"), F.col("p")).otherwise(0.0))
    return competitor_max(pool).where(F.col("selected") & (F.col("comp") <= F.col("own") + margin)).withColumn("p", F.col("own")).drop("own", "comp", "selected")


def f05(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """1.25 TP / (1.25 TP + FP + 0.25 FN); 1 if nothing is true or predicted."""
    return F.when((n_true == 0) & (n_pred == 0), 1.0).when((n_true == 0) | (n_pred == 0), 0.0).otherwise(1.25 * tp / (1.25 * tp + (n_pred - tp) + 0.25 * (n_true - tp)))


def scored_queries(queries: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Every query with n_true, n_pred, tp and f. A pair predicted twice, or of an unknown query, fails the job."""
    marked = predicted.select("q", "t").groupBy("q", "t").agg(F.count("*").alias("c")).join(truth.select("q", "t", F.lit(1).alias("y")), ["q", "t"], "left")
    per = marked.groupBy("q").agg(F.count("*").alias("n_pred"), F.count("y").alias("tp"), F.max("c").alias("c"))
    known = queries.withColumn("known", F.lit(True))
    both = known.join(per, "q", "full").join(truth.groupBy("q").agg(F.count("*").alias("n_true")), "q", "left")
    said = lambda what: F.raise_error(F.concat(F.lit(what), F.col("q").cast("string"))).cast("long")
    n_pred = F.when(F.col("known").isNull(), said("prediction of an unknown query: ")).when(F.col("c") > 1, said("pair predicted twice, query ")).otherwise(F.coalesce("n_pred", F.lit(0)))
    rest = [c for c in queries.columns if c != "q"]
    out = both.select("q", *rest, F.coalesce("n_true", F.lit(0)).alias("n_true"), n_pred.alias("n_pred"), F.coalesce("tp", F.lit(0)).alias("tp"))
    return out.withColumn("f", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def reference_f05(truth: dict, predicted: dict, queries: list) -> float:
    """Macro-F0.5 over plain sets, for tests; refuses unknown queries, lists that repeat a target, and no queries."""
    if not queries or set(predicted) - set(queries) or any(len(set(v)) != len(list(v)) for v in predicted.values()):
        raise ValueError("no queries, unknown queries or repeated targets")
    total = 0.0
    for q in queries:
        want, got = set(truth.get(q, ())), set(predicted.get(q, ()))
        hits = len(want & got)
        total += float(not got) if not want else 1.25 * hits / (1.25 * hits + len(got - want) + 0.25 * len(want - got))
    return total / len(queries)


def policy_scores(pairs: DataFrame, queries: DataFrame, truth: DataFrame, policies: list[dict], owner: bool = False) -> DataFrame:
    """(policy, macro_f05) of policies {tau or slice: tau, top_k, margin, owner_margin} by their place, in one pass over the pairs.

    Slices are a column `slice` of pairs; a policy's "tau" holds for slices that it does not name. With owner,
    pairs that another query holds with more than owner_margin above them are not selected.
    """
    spark = pairs.sparkSession
    x = ranked(pairs).join(truth.select("q", "t", F.lit(1).alias("y")), ["q", "t"], "left")
    x = competitor_max(x) if owner else x.withColumn("comp", F.lit(0.0))
    slices = sorted({k for p in policies for k in p} - {"tau", "top_k", "margin", "owner_margin"})
    rows = [(i, s, float(p.get(s, p["tau"])), p["top_k"], float(p.get("margin", 0)), float(p.get("owner_margin", 0))) for i, p in enumerate(policies) for s in [None, *slices]]
    grid = spark.createDataFrame(rows, "policy int, of string, tau double, top_k int, margin double, owner_margin double")  # policies times slices
    own = F.when(F.col("slice").isin(slices), F.col("slice")) if slices else F.lit(None).cast("string")
    picked = x.withColumn("own", own).join(F.broadcast(grid), F.col("own").eqNullSafe(F.col("of")) & (F.col("p") >= F.col("tau")) & (F.col("r") <= F.col("top_k")) & (F.col("gap") >= F.col("margin")) & (F.col("comp") <= F.col("p") + F.col("owner_margin")))
    per = picked.groupBy("policy", "q").agg(F.count("*").alias("n_pred"), F.count("y").alias("tp"))
    base = queries.select("q").join(truth.groupBy("q").agg(F.count("*").alias("n_true")), "q", "left").na.fill(0, ["n_true"])
    nothing = F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)
    start = base.agg(F.sum(nothing).alias("e"), F.count("*").alias("n"))
    gain = per.join(base, "q").groupBy("policy").agg(F.sum(f05(F.col("tp"), F.col("n_pred"), F.col("n_true")) - nothing).alias("g"))
    all_of = spark.createDataFrame([(i,) for i in range(len(policies))], "policy int")
    return all_of.join(gain, "policy", "left").crossJoin(F.broadcast(start)).select("policy", F.round((F.coalesce("g", F.lit(0.0)) + F.col("e")) / F.col("n"), 12).alias("macro_f05"))


def search_policy(pairs: DataFrame, queries: DataFrame, truth: DataFrame, taus: list[float], tops: list[int], margins: tuple = (0.0,), owner_margins: tuple = (), slices: tuple = ()) -> tuple[dict, float]:
    """The best policy of the grid, the first of those that no other exceeds by more than 1e-12; then, slice after slice,
    the tau that improves it. The driver sees one number for each policy."""
    grid = [{"tau": a, "top_k": k, "margin": m} | ({"owner_margin": o} if owner_margins else {}) for a in taus for k in tops for m in margins for o in owner_margins or (0.0,)]

    def best_of(policies: list[dict], best: dict | None, top: float) -> tuple[dict | None, float]:
        found = {r["policy"]: r["macro_f05"] for r in policy_scores(pairs, queries, truth, policies, bool(owner_margins)).collect()}
        for i, p in enumerate(policies):
            if found[i] > top + 1e-12:
                best, top = p, found[i]
        return best, top

    if not grid:
        raise ValueError("empty policy grid")
    best, top = best_of(grid, None, -1.0)
    for s in slices:
        best, top = best_of([best | {s: a} for a in taus], best, top)
    return best, top


def policy_grid(pairs: DataFrame, queries: DataFrame, truth: DataFrame, taus: list[float], tops: list[int]) -> DataFrame:
    """Macro-F0.5 of every (tau, top_k) in one pass: each pair counts for the policies that select it."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(a, b) for a in taus for b in tops], "tau double, top_k int")  # as many rows as policies
    hit = ranked(pairs).drop("gap").join(truth.select("q", "t", F.lit(1).alias("y")), ["q", "t"], "left").where(F.col("p") >= min(taus))
    per = hit.join(F.broadcast(grid), (F.col("p") >= F.col("tau")) & (F.col("r") <= F.col("top_k"))).groupBy("tau", "top_k", "q").agg(F.count("*").alias("n_pred"), F.count("y").alias("tp"))
    base = queries.select("q").join(truth.groupBy("q").agg(F.count("*").alias("n_true")), "q", "left").na.fill(0, ["n_true"])
    empty = base.agg(F.sum(F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)).alias("e"), F.count("*").alias("n"))
    # a query without a selected pair scores as an empty prediction: start from that and correct the others
    gain = per.join(base, "q").groupBy("tau", "top_k").agg(F.sum(f05(F.col("tp"), F.col("n_pred"), F.col("n_true")) - F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)).alias("g"))
    return F.broadcast(grid).join(gain, ["tau", "top_k"], "left").crossJoin(F.broadcast(empty)).select("tau", "top_k", F.round((F.coalesce("g", F.lit(0.0)) + F.col("e")) / F.col("n"), 9).alias("macro_f05"))
