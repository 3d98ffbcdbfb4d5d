"""Registered reports and verifications: census, samples, error analysis, leakage, contracts, determinism."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import checks, decide, folds
from tessera.plans.queries import ENT, FOLD, HEX, HOL, ORACLES, PTR, RNK, SCO, TGT, TRU, UNI, _docs, _f, _holds, _per, _union, both, entities, fold_manifest, order_queries, pair_truth, query, scored, targets, truth
from tessera.sources.tables import read_parquet

# --- census and counters ----------------------------------------------------------------------------------------------
_METRICS = {"empty": "length(text) = 0", "long": "length(text) > 5000", "multi_line": "text LIKE '%\n%'", "digits": "{re}(text, '[0-9]')", "upper": "{re}(text, '[A-Z]{{3}}')"}


def _flagged(match: str) -> str:
    flags = ", ".join(f"CASE WHEN {p.format(re=match)} THEN '{n}' END" for n, p in _METRICS.items())
    return f"SELECT lang, metric, count(*) AS n FROM (SELECT coalesce(lang, '') AS lang, {'explode(array' if match == 'regexp_like' else 'unnest(['}{'(' if match == 'regexp_like' else ''}{flags}{'))' if match == 'regexp_like' else '])'} AS metric FROM documents) x WHERE metric IS NOT NULL GROUP BY lang, metric"


both("metric_counters", _flagged("regexp_like"), _flagged("regexp_matches"))


@query(" UNION ALL ".join(f"SELECT lang, '{n}' AS metric, a AS first, a AS second FROM (SELECT lang, count(*) AS a FROM documents WHERE {p.format(re='regexp_matches')} GROUP BY lang) x WHERE false" for n, p in _METRICS.items()))
def metric_reproduction(spark, d):
    """Counters by one explode against counters by one aggregate of conditions: the rows that differ."""
    from tessera.plans.queries import QUERIES

    one = QUERIES["metric_counters"](spark, d).withColumnRenamed("n", "a")
    x = _docs(spark, d).groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(*[F.count_if(F.expr(p.format(re="regexp_like"))).alias(n) for n, p in _METRICS.items()])
    return checks.reproduction(one, x.unpivot(["lang"], list(_METRICS), "metric", "a").where("a > 0"), ["lang", "metric"], "a")


both("example_rows", "SELECT lang, doc_id, r FROM (SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INT) AS r FROM documents WHERE length(text) > 1000) x WHERE r <= 3")
both("top_parts", "SELECT p_name, count(*) AS n, max(length(p_type)) AS longest FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 25")
both("hashed_sample", "SELECT c_custkey, c_name FROM customer ORDER BY sha2(CAST(concat('rep', c_custkey) AS BINARY), 256), c_custkey LIMIT 40", "SELECT c_custkey, c_name FROM customer ORDER BY sha256('rep' || c_custkey), c_custkey LIMIT 40")
both("cast_or_null", "SELECT doc_id, try_cast(regexp_extract(text, '^[^0-9]*([0-9]+)', 1) AS INT) AS first_number FROM documents", "SELECT doc_id, try_cast(nullif(regexp_extract(text, '^[^0-9]*([0-9]+)', 1), '') AS INT) AS first_number FROM documents")
both("nation_facts", "SELECT r_name, bool_or(n_nationkey % 2 = 0) AS any_even, min(n_name) = any_value(r_name) AS same, round(stddev_pop(n_nationkey), 9) AS spread FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
     "SELECT r_name, bool_or(n_nationkey % 2 = 0) AS any_even, min(n_name) = any_value(r_name) AS same, round(stddev_pop(n_nationkey), 9) AS spread FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
both("all_names", "SELECT p_name AS name FROM part UNION SELECT c_name FROM customer UNION SELECT s_name FROM supplier")
_SCRIPTS = ["Han", "Greek", "Cyrillic", "Devanagari", "Arabic", "Hiragana"]
_RUNS = "WITH c AS ({points}), m AS (SELECT script, i, i - row_number() OVER (PARTITION BY script ORDER BY i) AS run FROM c) SELECT script, min(i) AS first, max(i) AS last FROM m GROUP BY script, run"
both("script_ranges", _RUNS.format(points=" UNION ALL ".join(f"SELECT '{s}' AS script, id AS i FROM range(32, 40960) WHERE (id < 55296) AND decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE') RLIKE '\\\\p{{Is{s}}}'" for s in _SCRIPTS)),
     _RUNS.format(points=" UNION ALL ".join(f"SELECT '{s}' AS script, range AS i FROM range(32, 40960) WHERE range < 55296 AND regexp_matches(chr(range::INT), '\\p{{{s}}}')" for s in _SCRIPTS)))
del ORACLES["script_ranges"]  # the engines know different versions of Unicode

_EDGE = "SELECT lower(lang) AS lang, tok, count(*) AS df FROM (SELECT lang, unnest(list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '))) AS tok FROM documents) x GROUP BY ALL"


@query(f"WITH t AS ({_EDGE}), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), p AS (SELECT tok, sum(CASE WHEN t.lang = 'en' THEN df ELSE 0 END)::BIGINT AS n_en, sum(CASE WHEN t.lang <> 'en' THEN df ELSE 0 END)::BIGINT AS n_other FROM t GROUP BY tok), a AS (SELECT sum(CASE WHEN lang = 'en' THEN n END) AS e, sum(CASE WHEN lang <> 'en' THEN n END) AS o FROM n) SELECT short.tok AS abbreviation, long.tok AS expansion, short.n_other, long.n_en FROM p short, p long, a WHERE length(short.tok) BETWEEN 2 AND 5 AND short.n_other >= 20 AND short.n_other / o >= 4 * short.n_en / e AND long.n_en >= 20 AND length(long.tok) >= 4 AND length(long.tok) > length(short.tok) AND left(long.tok, 1) = left(short.tok, 1) AND long.tok LIKE regexp_replace(short.tok, '(.)', '\\1%', 'g')")
def abbreviation_candidates(spark, d):
    """Short tokens of other languages' texts, four times as frequent there, whose letters stand in order in a frequent English token."""
    docs = _docs(spark, d)
    toks = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), " "))
    en = F.col("lang") == "en"
    p = docs.select(en.alias("en"), F.explode(toks).alias("tok")).groupBy("tok").agg(F.count_if("en").alias("n_en"), F.count_if(~F.col("en")).alias("n_other"))
    n = docs.agg(F.count_if(en).alias("e"), F.count_if(~en).alias("o"))
    short = p.where("length(tok) between 2 and 5 and n_other >= 20").crossJoin(F.broadcast(n)).where("n_other / o >= 4 * n_en / e").select(F.col("tok").alias("abbreviation"), "n_other", F.substring("tok", 1, 1).alias("i"))
    long = p.where("n_en >= 20 and length(tok) >= 4").select(F.col("tok").alias("expansion"), "n_en", F.substring("tok", 1, 1).alias("i"))
    return short.join(long, "i").where((F.length("expansion") > F.length("abbreviation")) & F.like(F.col("expansion"), F.regexp_replace("abbreviation", "(.)", "$1%"))).select("abbreviation", "expansion", "n_other", "n_en")


@query(f"WITH t AS ({_EDGE}) SELECT tok, max(CASE WHEN df >= 30 THEN lang END) AS strongest, count(*) AS langs, sum(df)::BIGINT AS evidence, CASE WHEN sum(df) >= 100 THEN 'A' WHEN sum(df) >= 30 THEN 'B' ELSE 'C' END AS tier FROM t WHERE tok <> '' GROUP BY tok HAVING sum(df) >= 10")
def lexicon_evidence(spark, d):
    """Tokens with evidence enough for a lexicon, and their tier."""
    toks = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), " "))
    t = _docs(spark, d).select(F.lower("lang").alias("lang"), F.explode(toks).alias("tok")).where("tok <> ''").groupBy("lang", "tok").agg(F.count("*").alias("df"))
    tier = F.when(F.col("evidence") >= 100, "A").when(F.col("evidence") >= 30, "B").otherwise("C")
    return t.groupBy("tok").agg(F.max(F.when(F.col("df") >= 30, F.col("lang"))).alias("strongest"), F.count("*").alias("langs"), F.sum("df").alias("evidence")).where("evidence >= 10").withColumn("tier", tier)


# --- pairs, errors, rerankers --------------------------------------------------------------------------------------------
_Y = "CASE WHEN y.q IS NULL THEN 0 ELSE 1 END"
_LAB = f"(SELECT x.q, x.t, x.p, x.r, {_Y} AS y FROM {RNK} x LEFT JOIN {PTR} y ON y.q = x.q AND y.t = x.t)"


def _labelled(spark, d):
    return decide.ranked(scored(spark, d)).join(pair_truth(spark, d).withColumn("y", F.lit(1)), ["q", "t"], "left").na.fill(0, ["y"])


_BY_RANK = "CASE WHEN r <= 1 THEN '1' WHEN r <= 3 THEN '2-3' ELSE '4+' END"


@query(f"SELECT {_BY_RANK} AS ranks, CASE WHEN p >= 0.7 THEN 'high' WHEN p >= 0.4 THEN 'middle' ELSE 'low' END AS confidence, count(*) AS pairs, sum(y)::BIGINT AS positives, round(avg(y), 9) AS rate, count(DISTINCT q) AS queries FROM {_LAB} GROUP BY ALL")
def pair_strata(spark, d):
    conf = F.when(F.col("p") >= 0.7, "high").when(F.col("p") >= 0.4, "middle").otherwise("low")
    return _labelled(spark, d).groupBy(F.expr(_BY_RANK).alias("ranks"), conf.alias("confidence")).agg(F.count("*").alias("pairs"), F.sum("y").alias("positives"), F.round(F.avg("y"), 9).alias("rate"), F.count_distinct("q").alias("queries"))


@query(f"SELECT round(avg(n), 9) AS mean, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.99) AS p99, max(n) AS most, round(avg(pos), 9) AS positives, round(avg((pos = 0)::INT), 9) AS without FROM (SELECT q, count(*) AS n, sum(y) AS pos FROM {_LAB} GROUP BY q)")
def pairs_per_query(spark, d):
    per = _labelled(spark, d).groupBy("q").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    return per.agg(F.round(F.avg("n"), 9).alias("mean"), F.expr("percentile(n, 0.5)").alias("median"), F.expr("percentile(n, 0.99)").alias("p99"), F.max("n").alias("most"), F.round(F.avg("pos"), 9).alias("positives"), F.round(F.avg((F.col("pos") == 0).cast("int")), 9).alias("without"))


_CHOSEN = "(p >= 0.5 AND r <= 3)"


@query(f"SELECT {_BY_RANK} AS ranks, count(*) AS pairs, sum(y)::BIGINT AS positives, count_if({_CHOSEN})::BIGINT AS selected, count_if({_CHOSEN} AND y = 1)::BIGINT AS tp, count_if({_CHOSEN} AND y = 0)::BIGINT AS fp, count_if(NOT {_CHOSEN} AND y = 1)::BIGINT AS fn, count_if({_CHOSEN} AND y = 0 AND p >= 0.9)::BIGINT AS sure_fp FROM {_LAB} GROUP BY 1")
def errors_by_stratum(spark, d):
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    return _labelled(spark, d).groupBy(F.expr(_BY_RANK).alias("ranks")).agg(F.count("*").alias("pairs"), F.sum("y").alias("positives"), n(_CHOSEN, "selected"), n(f"{_CHOSEN} AND y = 1", "tp"), n(f"{_CHOSEN} AND y = 0", "fp"), n(f"NOT {_CHOSEN} AND y = 1", "fn"), n(f"{_CHOSEN} AND y = 0 AND p >= 0.9", "sure_fp"))


_SELP = f"(SELECT q, t, p FROM {RNK} WHERE p >= 0.5 AND r <= 3)"


@query(f"SELECT round(sum(CASE WHEN n_true = 0 THEN 1 - f ELSE 0 END) / count(*), 9) AS loss_without_links, round(sum(CASE WHEN n_true > 0 THEN 1 - f ELSE 0 END) / count(*), 9) AS loss_with_links, count_if(n_true = 0 AND n_pred > 0)::BIGINT AS false_alarms, sum(n_true - tp)::BIGINT AS missed, sum(n_pred - tp)::BIGINT AS wrong FROM (SELECT *, {_f('tp', 'n_pred', 'n_true')} AS f FROM {_per(_SELP)})")
def loss_decomposition(spark, d):
    s = decide.scored_queries(order_queries(spark, d), pair_truth(spark, d), decide.select_threshold(scored(spark, d), 0.5, 3).select("q", "t"))
    lost = lambda c: F.round(F.sum(F.when(F.expr(c), 1 - F.col("f")).otherwise(0.0)) / F.count("*"), 9)
    return s.agg(lost("n_true = 0").alias("loss_without_links"), lost("n_true > 0").alias("loss_with_links"), F.count_if(F.expr("n_true = 0 and n_pred > 0")).alias("false_alarms"), F.sum(F.col("n_true") - F.col("tp")).alias("missed"), F.sum(F.col("n_pred") - F.col("tp")).alias("wrong"))


_BOOTS = 40
_U = "((q * 7919 + b * 104729) % 100003) / 100003.0"
_POISSON = f"CASE WHEN {_U} < 0.36787944 THEN 0 WHEN {_U} < 0.73575888 THEN 1 WHEN {_U} < 0.91969860 THEN 2 WHEN {_U} < 0.98101184 THEN 3 ELSE 4 END"
_TIGHT = f"(SELECT q, t, p FROM {RNK} WHERE p >= 0.7 AND r <= 1)"


@query(f"WITH a AS (SELECT q, {_f('tp', 'n_pred', 'n_true')} AS f FROM {_per(_SELP)}), c AS (SELECT q, {_f('tp', 'n_pred', 'n_true')} AS f FROM {_per(_TIGHT)}), x AS (SELECT q, a.f - c.f AS diff FROM a JOIN c USING (q)), r AS (SELECT b, sum(diff * ({_POISSON})) / sum({_POISSON}) AS m FROM x, (SELECT unnest(range({_BOOTS})) AS b) GROUP BY b) SELECT round((SELECT avg(diff) FROM x), 9) AS difference, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM r")
def paired_bootstrap(spark, d):
    """Difference of two policies' macro-F0.5 with a Poisson bootstrap over queries: every query weighs 0, 1, 2 ... in each round."""
    f = lambda tau, k: decide.scored_queries(order_queries(spark, d), pair_truth(spark, d), decide.select_threshold(scored(spark, d), tau, k).select("q", "t")).select("q", "f")
    x = f(0.5, 3).join(f(0.7, 1).withColumnRenamed("f", "g"), "q").select("q", (F.col("f") - F.col("g")).alias("diff"))
    w = [F.expr(_POISSON.replace("b * 104729", f"{i} * 104729")) for i in range(_BOOTS)]
    one = x.agg(F.avg("diff").alias("mean"), F.array(*[F.sum(F.col("diff") * v) / F.sum(v) for v in w]).alias("m"))  # one pass, a number for each round
    return one.select("mean", F.explode("m").alias("m")).groupBy().agg(F.round(F.max("mean"), 9).alias("difference"), F.round(F.expr("percentile(m, 0.025)"), 9).alias("low"), F.round(F.expr("percentile(m, 0.975)"), 9).alias("high"))


@query(f"SELECT q, t, round(ln(p / (1 - p)), 9) AS logit, round(1.0 / r, 9) AS inverse_rank, CASE WHEN q % 5 = 0 THEN 'test' ELSE 'train' END AS split, o_orderpriority || ' ' || p_name AS text FROM {RNK} JOIN orders ON o_orderkey = q JOIN part ON p_partkey = t WHERE r <= 5 AND p < 1")
def reranker_rows(spark, d):
    """The first candidates of each query with the features and the text that a second model reads: a two-sided lookup."""
    o = read_parquet(spark, d, "orders").select(F.col("o_orderkey").alias("q"), "o_orderpriority")
    p = read_parquet(spark, d, "part").select(F.col("p_partkey").alias("t"), "p_name")
    x = decide.ranked(scored(spark, d)).where("r <= 5 and p < 1").join(o, "q").join(p, "t")
    return x.select("q", "t", F.round(F.log(F.col("p") / (1 - F.col("p"))), 9).alias("logit"), F.round(1.0 / F.col("r"), 9).alias("inverse_rank"), F.when(F.col("q") % 5 == 0, "test").otherwise("train").alias("split"), F.concat_ws(" ", "o_orderpriority", "p_name").alias("text"))


@query(f"SELECT flag, count(*) AS queries, round(avg(f), 9) AS macro_f05 FROM (SELECT CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'other' END AS flag, {_f('tp', 'n_pred', 'n_true')} AS f FROM {_per(_SELP)} JOIN orders ON o_orderkey = q WHERE o_orderstatus <> 'P') GROUP BY flag")
def flagged_f05(spark, d):
    o = read_parquet(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("q"), F.when(F.col("o_totalprice") > 200000, "large").otherwise("other").alias("flag"))
    s = decide.scored_queries(order_queries(spark, d), pair_truth(spark, d), decide.select_threshold(scored(spark, d), 0.5, 3).select("q", "t"))
    return s.join(o, "q").groupBy("flag").agg(F.count("*").alias("queries"), F.round(F.avg("f"), 9).alias("macro_f05"))


both("view_agreement", "SELECT count(*) AS links, round(avg(CASE WHEN c_nationkey = s_nationkey THEN 1 ELSE 0 END), 9) AS nation, round(avg(CASE WHEN substr(c_name, 10) = substr(s_name, 10) THEN 1 ELSE 0 END), 9) AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R'")


@query(f"WITH u AS {UNI}, per AS (SELECT item_id, count(DISTINCT t) AS n, count(DISTINCT channel) AS c FROM benchmark LEFT JOIN u ON q = item_id GROUP BY item_id) SELECT count(*) AS queries, count_if(n = 0)::BIGINT AS without, sum(n)::BIGINT AS candidates, max(n) AS most, count_if(c >= 2)::BIGINT AS by_two FROM per")
def candidate_coverage(spark, d):
    """What can be said of candidates without labels."""
    q = read_parquet(spark, d, "benchmark").select(F.col("item_id").alias("q"))
    per = q.join(_union(spark, d), "q", "left").groupBy("q").agg(F.count_distinct("t").alias("n"), F.count_distinct("channel").alias("c"))
    return per.agg(F.count("*").alias("queries"), F.count_if(F.col("n") == 0).alias("without"), F.sum("n").alias("candidates"), F.max("n").alias("most"), F.count_if(F.col("c") >= 2).alias("by_two"))


_TRUE = "WITH x AS (SELECT c_custkey AS q, c_nationkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer), shifted AS (SELECT a.q, b.k FROM x a JOIN x b ON b.i = (a.i + 7) % a.n)"


@query(f"{_TRUE} SELECT 'own' AS features, count(*) AS queries, count_if(c_nationkey = k)::BIGINT AS found FROM x JOIN customer ON c_custkey = q UNION ALL SELECT 'of another query', count(*), count_if(c_nationkey = k)::BIGINT FROM shifted JOIN customer ON c_custkey = q")
def negative_control(spark, d):
    """Recall with each query's own key and with that of the query seven places on: the second is chance."""
    c = read_parquet(spark, d, "customer").select(F.col("c_custkey").alias("q"), F.col("c_nationkey").alias("k"))
    own = _placed(c)
    n = own.agg(F.count("*").alias("n"))
    other = own.select(F.col("i").alias("j"), F.col("k").alias("k2"))
    moved = own.crossJoin(F.broadcast(n)).withColumn("j", (F.col("i") + 7) % F.col("n")).join(other, "j")
    count = lambda df, name, key: df.agg(F.count("*").alias("queries"), F.count_if(F.col("k") == F.col(key)).alias("found")).select(F.lit(name).alias("features"), "queries", "found")
    return count(own, "own", "k").unionAll(count(moved, "of another query", "k2"))


def _placed(c):
    """With i, the place of q among all, by ranges of 1024: each range is ranked by itself and offset."""
    from pyspark.sql import Window

    x = c.withColumn("b", F.expr("q div 1024"))
    sizes = x.groupBy("b").agg(F.count("*").alias("c"))
    offset = sizes.select("b", (F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("o"))  # a row for each 1024 ids
    r = F.row_number().over(Window.partitionBy("b").orderBy("q")) - 1
    return x.withColumn("r", r).join(offset, "b").select("q", "k", (F.col("r") + F.col("o")).alias("i"))


@query(f"WITH m AS (SELECT count(*) AS links, count_if(u.q IS NOT NULL) AS found, (SELECT round(avg((n = 0)::INT), 9) FROM (SELECT item_id, count(t) AS n FROM benchmark LEFT JOIN {UNI} z ON z.q = item_id GROUP BY item_id)) AS zero_rate FROM {HOL} h LEFT JOIN (SELECT DISTINCT q, t FROM {UNI}) u ON u.q = h.q AND u.t = h.t), v AS (SELECT round(found / links, 9) AS recall, zero_rate FROM m) SELECT 'recall >= 0.99' AS gate, recall::DOUBLE AS value, recall >= 0.99 AS passed FROM v UNION ALL SELECT 'oracle_f05 >= 0.97', recall::DOUBLE, recall >= 0.97 FROM v UNION ALL SELECT 'zero_rate <= 0.005', zero_rate, zero_rate <= 0.005 FROM v")
def retrieval_gates(spark, d):
    """The gates on recall, a stand-in for the ceiling (recall again, for queries of one link), and queries without candidates."""
    u = _union(spark, d).select("q", "t").distinct()
    links = _holds(spark, d).select("q", "t").distinct().join(u.withColumn("hit", F.lit(1)), ["q", "t"], "left").agg(F.round(F.count("hit") / F.count("*"), 9).alias("recall"))
    per = read_parquet(spark, d, "benchmark").select(F.col("item_id").alias("q")).join(u, "q", "left").groupBy("q").agg(F.count("t").alias("n")).agg(F.round(F.avg((F.col("n") == 0).cast("int")), 9).alias("zero_rate"))
    return checks.gates(links.crossJoin(per).withColumn("oracle_f05", F.col("recall")))


# --- manifests, leakage, determinism ------------------------------------------------------------------------------------
_FULL = f"(SELECT f.*, x.q AS owner_id, CASE WHEN role = 'query' THEN 'query' WHEN x.q IS NOT NULL THEN 'owner' ELSE 'unmatched' END AS assignment, role = 'query' AND fold <> 'dev' AND row_number() OVER (PARTITION BY role, stratum ORDER BY {HEX.format('sample', 'entity_id')}, entity_id) <= 20 AS sample, substr(entity_id, 2, 1)::INT AS source FROM {FOLD} f LEFT JOIN {TRU} x ON role = 'target' AND x.t = f.entity_id)"


def _full(spark, d):
    return folds.with_owners(fold_manifest(spark, d), truth(spark, d))


@query(f"SELECT * FROM {_FULL}")
def owner_manifest(spark, d):
    return _full(spark, d)


@query(f"WITH m AS (SELECT *, ('0x' || substr({HEX.format('mini', 'entity_id')}, 1, 8))::BIGINT % 100 AS b FROM {_FULL}), k AS (SELECT entity_id FROM m WHERE role = 'query' AND b < 10) SELECT entity_id, role, fold, assignment FROM m WHERE (role = 'query' AND b < 10) OR (assignment = 'owner' AND owner_id IN (SELECT entity_id FROM k)) OR (assignment = 'unmatched' AND b < 10)")
def mini_world(spark, d):
    return folds.mini_world(_full(spark, d)).select("entity_id", "role", "fold", "assignment")


_NAMES = ["L01 entity twice in a role", "L02 queries are not the entities", "L03 targets are not the targets", "L04 other fold", "L05 link across folds", "L06 other owner", "L07 linked target as unmatched", "L08 strata of queries off the floor rule",
          "L09 strata of unmatched targets off the floor rule", "L11 fold tracks the id", "L12 match count is not that of the truth", "L13 fold without queries", "L14 sample outside held-out queries", "L10 fold is not reproduced"]
_FLOOR = "SELECT count(*) FROM (SELECT stratum, count(*) AS n, count_if(fold = 'dev') AS d, count_if(fold = 'val') AS v FROM m WHERE {0} GROUP BY stratum) WHERE d <> n * 8 // 10 OR d + v <> n * 9 // 10"
_LEAK = [
    "SELECT count(*) FROM (SELECT role, entity_id FROM m GROUP BY ALL HAVING count(*) > 1)", f"SELECT count(*) FROM (SELECT entity_id FROM m WHERE role = 'query') a FULL JOIN {ENT} b USING (entity_id) WHERE a.entity_id IS NULL OR b.entity_id IS NULL",
    f"SELECT count(*) FROM (SELECT entity_id FROM m WHERE role = 'target') a FULL JOIN {TGT} b USING (entity_id) WHERE a.entity_id IS NULL OR b.entity_id IS NULL", "SELECT count(*) FROM m WHERE fold NOT IN ('dev', 'val', 'holdout')",
    f"SELECT count(*) FROM {TRU} x JOIN m a ON a.role = 'query' AND a.entity_id = x.q JOIN m b ON b.role = 'target' AND b.entity_id = x.t WHERE a.fold <> b.fold", f"SELECT count(*) FROM m JOIN {TRU} x ON x.t = entity_id WHERE role = 'target' AND (owner_id IS DISTINCT FROM x.q OR assignment <> 'owner')",
    f"SELECT count(*) FROM m WHERE assignment = 'unmatched' AND entity_id IN (SELECT t FROM {TRU} x)", _FLOOR.format("role = 'query'"), _FLOOR.format("assignment = 'unmatched'"),
    "SELECT count(*) FROM (SELECT fold, abs((avg(n) - any_value(mu)) / (any_value(sd) / sqrt(count(*)))) AS z FROM (SELECT fold, substr(entity_id, 4)::DOUBLE AS n FROM m WHERE role = 'query'), (SELECT avg(substr(entity_id, 4)::DOUBLE) AS mu, stddev_pop(substr(entity_id, 4)::DOUBLE) AS sd FROM m WHERE role = 'query') GROUP BY fold) WHERE z >= 4",
    f"SELECT count(*) FROM m LEFT JOIN (SELECT q, count(*) AS k FROM {TRU} GROUP BY q) x ON x.q = entity_id WHERE role = 'query' AND match_count <> coalesce(k, 0)", "SELECT count(*) FROM (SELECT unnest(['dev', 'val', 'holdout']) AS fold EXCEPT SELECT fold FROM m WHERE role = 'query')", "SELECT count(*) FROM m WHERE sample AND (role <> 'query' OR fold = 'dev')", "SELECT 0",
]


@query(f"WITH m AS MATERIALIZED (SELECT * FROM {_FULL}) " + " UNION ALL ".join(f"SELECT '{n}' AS name, ({s})::BIGINT AS violations" for n, s in zip(_NAMES, _LEAK, strict=True)))
def leakage_all(spark, d):
    """Every check of the manifest; L10 recomputes the folds by plain windows over whole strata."""
    from pyspark.sql import Window

    m = _full(spark, d).persist()  # read by every check
    w = Window.partitionBy("stratum", "group")
    x = m.where("role = 'query' or assignment = 'unmatched'").withColumn("group", F.when(F.col("role") == "query", F.col("stratum")).otherwise(F.col("country")))
    r, n = F.row_number().over(w.orderBy(folds.digest("fold", F.col("entity_id")), "entity_id")), F.count("*").over(w)
    again = x.withColumn("fold", F.when(r <= F.floor(n * 8 / 10), "dev").when(r <= F.floor(n * 9 / 10), "val").otherwise("holdout"))
    # unmatched targets' strata are their countries here
    by_country = m.withColumn("stratum", F.when(F.col("assignment") == "unmatched", F.col("country")).otherwise(F.col("stratum")))
    return checks.leakage(by_country, entities(spark, d), targets(spark, d), truth(spark, d), recomputed=again)


ORACLES["leakage_all"] = ORACLES["leakage_all"].replace(_FLOOR.format("assignment = 'unmatched'"), _FLOOR.format("assignment = 'unmatched'").replace("stratum", "country"))


@query(f"SELECT count(*) AS rows, sum(('0x' || substr(sha256(concat_ws('|', entity_id, role, fold, stratum)), 1, 12))::BIGINT)::VARCHAR AS digest FROM {FOLD}")
def manifest_digest(spark, d):
    return checks.content_digest(fold_manifest(spark, d), ["entity_id", "role", "fold", "stratum"])


@query("SELECT unnest(['only_first', 'only_second']) AS name, 0::BIGINT AS violations")
def determinism(spark, d):
    """The fold manifest over shuffled input against the plain one: the same rows."""
    again = folds.fold_manifest(entities(spark, d).repartition(7, "country"), targets(spark, d).orderBy(F.desc("entity_id")), truth(spark, d).repartition(3))
    return checks.same_rows(fold_manifest(spark, d), again)


@query("SELECT unnest(['missing', 'added', 'changed', 'repeated_key', 'rows_differ']) AS name, unnest([(SELECT count(*) FROM orders WHERE o_orderstatus = 'P'), 0, 0, 0, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P')])::BIGINT AS violations")
def coverage_of_parts(spark, d):
    """A table that lacks the orders in status P against its source."""
    o = read_parquet(spark, d, "orders")
    return checks.coverage(o.where("o_orderstatus <> 'P'"), o, "o_orderkey", ["o_custkey", "o_orderdate", "o_totalprice"])


@query("SELECT name, violations::BIGINT AS violations FROM (SELECT count_if(vec_id IS NULL) AS vec_id, count_if(embedding IS NULL) AS embedding, count_if(list_contains(list_transform(embedding, lambda x: x IS NULL), true)) AS \"embedding[]\", count_if(label IS NULL) AS label FROM embeddings) UNPIVOT (violations FOR name IN (vec_id, embedding, \"embedding[]\", label))")
def null_report(spark, d):
    return checks.nulls(read_parquet(spark, d, "embeddings"))


_CONTRACT = {"bad query id": "false", "bad target id": "l_orderkey % 50 = 0", "no country": "l_orderkey % 70 = 0", "bad label": "l_linenumber = 7", "weight not positive": "l_discount = 0", "scores not aligned": "l_linenumber = 5", "ranks not aligned": "l_linenumber = 6", "channel twice": "l_linenumber = 4"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count_if({c})::BIGINT AS violations FROM lineitem" for n, c in _CONTRACT.items()) + " UNION ALL SELECT 'pair twice', count(*) FROM (SELECT l_orderkey, l_partkey, l_orderkey % 50 = 0 FROM lineitem GROUP BY ALL HAVING count(*) > 1)")
def contract_report(spark, d):
    """Candidate rows made of lineitem, in which each rule is broken by some."""
    n = F.col("l_linenumber")
    x = read_parquet(spark, d, "lineitem").select(
        F.concat(F.lit("S1-"), "l_orderkey").alias("s1_entity_id"), F.concat(F.when(F.col("l_orderkey") % 50 == 0, "S1-").otherwise("S2-"), "l_partkey").alias("candidate_entity_id"), F.when(F.col("l_orderkey") % 70 == 0, "").otherwise("US").alias("country"),
        F.when(n == 7, 9).otherwise(1).alias("is_positive"), F.col("l_discount").alias("sample_weight"), F.when(n == 4, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("channels"),
        F.when(n == 5, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.5))).alias("scores"), F.when(n == 6, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("ranks"),
    )
    return checks.contract(x)


@query("SELECT unnest(['query on several rows', 'id twice in a list', 'own source as a match', 'prefix of no source', 'unknown id', 'query missing', 'query not asked for', 'match that is no candidate']) AS name, unnest([(SELECT count(*) FROM orders WHERE o_orderkey % 30 = 0), (SELECT count(*) FROM orders WHERE o_orderkey % 40 = 0 AND o_orderkey % 11 > 0), 1, 1, 1, (SELECT count(*) FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 30 <> 0), 1, (SELECT count(*) FROM orders WHERE o_orderkey % 11 > 0 AND (o_orderkey % 40 = 0 OR o_orderkey % 41 = 0)) + 3])::BIGINT AS violations")
def submission_report(spark, d):
    """Lists made of orders, in which each rule is broken by some."""
    o = read_parquet(spark, d, "orders").select(F.col("o_orderkey").alias("q"))
    ids = F.when(F.col("q") % 40 == 0, "S2-2,S2-2").when(F.col("q") % 41 == 0, "S3-3").otherwise("")
    x = o.where("q % 11 > 0").select("q", ids.alias("ids"))
    odd = o.sparkSession.createDataFrame([(-1, "S1-1,Q-1,S2-99")], "q long, ids string")
    valid = o.sparkSession.createDataFrame([("S2-2",), ("S3-3",)], "t string")
    extra = o.where("q % 30 = 0").select("q", F.lit("").alias("ids"))
    twice = extra.unionAll(extra.where("q % 11 = 0"))  # so that each of them is on two rows
    kept = x.unionAll(odd)
    return checks.submission(kept.unionAll(twice), o, valid, o.select("q", F.lit("").alias("ids")))


#: Predicates that no row may meet, by table; one scan of each.
RULES = {
    "orders": {"null key": "o_orderkey IS NULL", "null customer": "o_custkey IS NULL", "status": "o_orderstatus NOT IN ('F', 'O', 'P')", "price": "o_totalprice < 0", "priority": "o_orderpriority IS NULL OR o_orderpriority = ''", "date": "o_orderdate IS NULL"},
    "lineitem": {"null key": "l_orderkey IS NULL", "line": "l_linenumber < 1 OR l_linenumber > 7", "quantity": "l_quantity < 1 OR l_quantity > 50", "discount": "l_discount < 0 OR l_discount > 0.1", "tax": "l_tax < 0 OR l_tax > 0.08", "flag": "l_returnflag NOT IN ('A', 'N', 'R')", "status": "l_linestatus NOT IN ('F', 'O')", "price": "l_extendedprice <= 0"},
    "customer": {"null key": "c_custkey IS NULL", "name": "c_name IS NULL OR trim(c_name) <> c_name", "nation": "c_nationkey < 0 OR c_nationkey > 24", "segment": "c_mktsegment IS NULL OR upper(c_mktsegment) <> c_mktsegment", "spaces": "c_name LIKE '%  %'"},
    "part": {"null key": "p_partkey IS NULL", "name": "p_name IS NULL OR p_name = ''", "size": "p_size < 1 OR p_size > 50", "price": "p_retailprice <= 0", "brand": "p_brand NOT LIKE 'Brand#%'", "spaces": "p_type LIKE '%  %'"},
    "supplier": {"null key": "s_suppkey IS NULL", "name": "s_name IS NULL OR s_name = ''", "nation": "s_nationkey < 0 OR s_nationkey > 24", "balance": "s_acctbal < -1000"},
    "documents": {"null key": "doc_id IS NULL", "text": "text IS NULL", "length": "length(text) <> n_chars", "language": "lang IS NULL OR length(lang) <> 2", "source": "source IS NULL OR source = ''"},
    "labels": {"null key": "doc_id IS NULL", "quality": "quality NOT IN (0, 1)", "toxic": "toxic NOT IN (0, 1)"},
    "nation": {"null key": "n_nationkey IS NULL", "region": "n_regionkey NOT IN (0, 1, 2, 3, 4)", "name": "upper(n_name) <> n_name"},
    "benchmark": {"null key": "item_id IS NULL", "text": "text IS NULL OR text = ''"},
}


@query(" UNION ALL ".join(f"SELECT '{t}' AS relation, '{n}' AS name, count_if({p})::BIGINT AS violations FROM {t}" for t, rules in RULES.items() for n, p in rules.items()))
def invariants_by_table(spark, d):
    return checks.stacked([checks.invariants(read_parquet(spark, d, t), rules).select(F.lit(t).alias("relation"), "name", "violations") for t, rules in RULES.items()])


@query("SELECT unnest(['orders', 'orders', 'orders']) AS relation, unnest(['scan', 'groups', 'join']) AS reader, unnest([(SELECT count(*) FROM orders), (SELECT count(*) FROM orders), (SELECT count(*) FROM orders)]) AS rows, unnest([(SELECT sum(o_orderkey) FROM orders), (SELECT sum(o_orderkey) FROM orders), (SELECT sum(o_orderkey) FROM orders)])::BIGINT AS keys")
def three_readers(spark, d):
    """One table's rows and sum of keys read as it is, as sums of groups, and through a join that must lose nothing."""
    o = read_parquet(spark, d, "orders")
    n, k = F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys")
    groups = o.groupBy("o_orderstatus").agg(n, k).agg(F.sum("rows").alias("rows"), F.sum("keys").alias("keys"))
    joined = o.join(read_parquet(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").agg(n, k)
    return checks.stacked([x.select(F.lit("orders").alias("relation"), F.lit(name).alias("reader"), "rows", "keys") for name, x in (("scan", o.agg(n, k)), ("groups", groups), ("join", joined))])


both("verification_sample", """SELECT l_orderkey, l_linenumber, predicate FROM (SELECT *, row_number() OVER (PARTITION BY predicate ORDER BY l_orderkey, l_linenumber) AS r FROM
(SELECT l_orderkey, l_linenumber, explode(array(CASE WHEN l_discount = 0 THEN 'no discount' END, CASE WHEN l_quantity = 50 THEN 'most' END, CASE WHEN l_tax = 0 THEN 'no tax' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END)) AS predicate FROM lineitem) x WHERE predicate IS NOT NULL) y WHERE r <= 25""",
     """SELECT l_orderkey, l_linenumber, predicate FROM (SELECT *, row_number() OVER (PARTITION BY predicate ORDER BY l_orderkey, l_linenumber) AS r FROM
(SELECT l_orderkey, l_linenumber, unnest([CASE WHEN l_discount = 0 THEN 'no discount' END, CASE WHEN l_quantity = 50 THEN 'most' END, CASE WHEN l_tax = 0 THEN 'no tax' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END]) AS predicate FROM lineitem) x WHERE predicate IS NOT NULL) y WHERE r <= 25""")
