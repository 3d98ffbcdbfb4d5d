"""The registered queries of the linkage engine over the supplied tables, each with DuckDB SQL.

Customers are reference entities, orders are targets (truth: final orders of a customer), benchmark texts
query documents, and lineitem gives scored pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import records, similarity, text
from tessera.operators import decide, folds, retrieval
from tessera.sources.tables import id_lists, read_parquet, shard, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark labels".split()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def both(name: str, sql: str, duck: str | None = None) -> None:
    """A query that is one relational statement, the same in Spark SQL and, but for spelling, in DuckDB."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in sql:
                read_parquet(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = duck or sql


# --- base relations, as frames and as SQL -------------------------------------------------------------------------
def entities(spark, d):
    c, n = read_parquet(spark, d, "customer"), read_parquet(spark, d, "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")).alias("entity_id"), F.col("n_name").alias("country"))  # nation: 25 rows


def _target_id():
    return F.concat(F.lit("S"), (2 + F.col("o_orderkey") % 2).cast("string"), F.lit("-"), F.col("o_orderkey").cast("string"))


def targets(spark, d):
    o = read_parquet(spark, d, "orders").select(_target_id().alias("entity_id"), F.concat(F.lit("S1-"), F.col("o_custkey").cast("string")).alias("c"))
    return o.join(entities(spark, d).select(F.col("entity_id").alias("c"), "country"), "c").select("entity_id", "country")


def truth(spark, d):
    return read_parquet(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("S1-"), F.col("o_custkey").cast("string")).alias("q"), _target_id().alias("t"))


def scored(spark, d):
    """Scored pairs: the best p of each (order, part)."""
    return read_parquet(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("t")).agg(F.max((F.col("l_quantity") * 10 + F.col("l_linenumber")) / 520.0).alias("p"))


def pair_truth(spark, d):
    return read_parquet(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("t")).distinct()


def order_queries(spark, d):
    return read_parquet(spark, d, "orders").select(F.col("o_orderkey").alias("q"))


ENT = "(SELECT 'S1-' || c_custkey AS entity_id, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey)"
TGT = "(SELECT 'S' || (2 + o_orderkey % 2) || '-' || o_orderkey AS entity_id, country FROM orders JOIN " + ENT + " e ON e.entity_id = 'S1-' || o_custkey)"
TRU = "(SELECT 'S1-' || o_custkey AS q, 'S' || (2 + o_orderkey % 2) || '-' || o_orderkey AS t FROM orders WHERE o_orderstatus = 'F')"
SCO = "(SELECT l_orderkey AS q, l_partkey AS t, max((l_quantity * 10 + l_linenumber) / 520.0::DOUBLE) AS p FROM lineitem GROUP BY ALL)"
PTR = "(SELECT DISTINCT l_orderkey AS q, l_partkey AS t FROM lineitem WHERE l_returnflag = 'R')"
KEY = "trim(regexp_replace(lower(nfc_normalize({})), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'))"
TKEY = KEY.format("text")
HEX = "sha256('{}' || {})"
R9 = "round({}, 9)"


# --- text -----------------------------------------------------------------------------------------------------------
def _docs(spark, d):
    return spread(read_parquet(spark, d, "documents"))


@query(f"SELECT doc_id, {TKEY} AS v1_key FROM documents")
def v1_key(spark, d):
    return _docs(spark, d).select("doc_id", text.comparison_key(F.col("text")).alias("v1_key"))


@query(r"SELECT doc_id, regexp_matches(text, '\p{Cc}') AS has_control, regexp_matches(text, '\p{Cf}') AS has_format, regexp_matches(text, '[\x{80}-\x{9f}\x{1a}]') AS has_mojibake, regexp_matches(text, '[ \t\n\r\f\x0b]{2,}') AS has_multispace FROM documents")
def hygiene_flags(spark, d):
    return _docs(spark, d).select("doc_id", *[v.alias(k) for k, v in text.flags(F.col("text")).items()])


@query(r"""WITH s AS (SELECT doc_id, text AS a, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]+', ' ', 'g') AS b FROM documents),
p AS (SELECT *, translate(b, '’‘‛‐‑‒–—―−º', '''''''-------°') AS c FROM s), w AS (SELECT *, trim(regexp_replace(c, '\s+', ' ', 'g')) AS d FROM p)
SELECT doc_id, d AS cleaned, array_to_string(list_filter([CASE WHEN a <> b THEN 'controls' END, CASE WHEN b <> c THEN 'punct' END, CASE WHEN c <> d THEN 'ws' END], lambda x: x IS NOT NULL), ',') AS repairs FROM w""")
def clean_text_repairs(spark, d):
    cleaned, codes = text.clean_text(F.col("text"))
    return _docs(spark, d).select("doc_id", cleaned.alias("cleaned"), codes.alias("repairs"))


@query("SELECT doc_id, replace(replace(replace(strip_accents(text), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss') AS folded FROM documents")
def fold_latin(spark, d):
    return _docs(spark, d).select("doc_id", text.fold_latin(F.col("text")).alias("folded"))


_SAMPLES = "(VALUES (1, 'Zeta Foods'), (2, 'हिन्दी नाम'), (3, 'தமிழ் Mix'), (4, '東京'), (5, '12-34'), (6, 'বাংলা'))"
_KNOWN = "".join(rf"\p{{{s}}}" for s in text.SCRIPTS)


@query(f"SELECT i, ({' + '.join(f"CASE WHEN regexp_matches(s, '\\p{{{s}}}') THEN {1 << k} ELSE 0 END" for k, s in enumerate(text.SCRIPTS))} + CASE WHEN regexp_matches(regexp_replace(s, '[{_KNOWN}]', '', 'g'), '\\p{{L}}') THEN 1024 ELSE 0 END)::INT AS mask FROM {_SAMPLES} AS v(i, s)")
def script_mask(spark, d):
    return spark.sql(f"SELECT * FROM {_SAMPLES} AS v(i, s)").select("i", text.script_mask(F.col("s")).alias("mask"))


_SCRIPT_ROWS = f"(SELECT 'documents' AS source, doc_id::VARCHAR AS id, text AS s FROM documents UNION ALL SELECT 'part', p_partkey::VARCHAR, p_name FROM part UNION ALL SELECT 'literal', i::VARCHAR, s FROM {_SAMPLES} AS v(i, s))"


@query(f"SELECT source, id, ({' + '.join(f"CASE WHEN regexp_matches(s, '\\p{{{s}}}') THEN {1 << k} ELSE 0 END" for k, s in enumerate(text.SCRIPTS))} + CASE WHEN regexp_matches(regexp_replace(s, '[{_KNOWN}]', '', 'g'), '\\p{{L}}') THEN 1024 ELSE 0 END)::INT AS mask FROM {_SCRIPT_ROWS}")
def script_mask_all(spark, d):
    """Masks of every document, every part name and the literal strings."""
    docs = _docs(spark, d).select(F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("s"))
    names = read_parquet(spark, d, "part").select(F.lit("part"), F.col("p_partkey").cast("string"), "p_name")
    rows = docs.unionAll(names).unionAll(spark.sql(f"SELECT 'literal', cast(i AS string), s FROM {_SAMPLES} AS v(i, s)"))
    return rows.select("source", "id", text.script_mask(F.col("s")).alias("mask"))


def _skeleton_sql(c: str) -> str:
    for pattern, by in text.skeleton_steps():
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return c


@query(f"WITH n AS (SELECT DISTINCT lower(p_name) AS name FROM part) SELECT name, {_skeleton_sql('name')} AS skeleton FROM n")
def skeleton(spark, d):
    return read_parquet(spark, d, "part").select(F.lower("p_name").alias("name")).distinct().select("name", text.skeleton(F.col("name")).alias("skeleton"))


@query()
def name_features(spark, d):
    rows = [("The Zeta Foods Pvt. Ltd.", "India"), ("Limited", "US"), ("Alpha (India) LLC", "US"), ("Beta Co dba Gamma", "US"), ("www.shop.com", "US"), ("n/a", ""), ("**Delta & Sons, Inc.", "US"), ("M/s Orbit Traders", "India"), ("Éclat S.A.R.L.", "France")]
    names = read_parquet(spark, d, "part").select("p_name", F.lit("").alias("country")).distinct().unionAll(spark.createDataFrame(rows, "p_name string, country string"))
    return names.select("p_name", "country", records.name_record(F.col("p_name"), F.col("country")).alias("r")).select("p_name", "country", "r.*")


# --- addresses ------------------------------------------------------------------------------------------------------
def _address():
    return F.concat_ws(", ", F.concat(F.lpad((F.col("o_orderkey") % 97).cast("string"), 4, "0"), F.lit(" Elm St")), F.concat(F.lit("No "), (F.col("o_custkey") % 900000 + 10000).cast("string")), F.lit("CT"), F.lit("null"))


ADR = "(lpad((o_orderkey % 97)::VARCHAR, 4, '0') || ' Elm St, No ' || (o_custkey % 900000 + 10000) || ', CT, null')"


def _addresses(spark, d):
    return read_parquet(spark, d, "orders").select("o_orderkey", records.address_record(_address(), F.lit("US")).alias("a"))


@query(f"SELECT o_orderkey, (o_orderkey % 97) || ' elm street ' || (o_custkey % 900000 + 10000) || ' connecticut' AS canon, 3 AS nsegments, 1 AS null_tokens, starts_with({ADR}, '0') AS had_zero, 'high' AS confidence FROM orders")
def address_segments(spark, d):
    return _addresses(spark, d).select("o_orderkey", F.col("a.address_canon").alias("canon"), F.col("a.address_nsegments").alias("nsegments"), F.col("a.address_null_tokens").alias("null_tokens"), F.col("a.address_had_zero").alias("had_zero"), F.col("a.address_confidence").alias("confidence"))


@query("SELECT o_orderkey, (o_orderkey % 97) || ',' || (o_custkey % 900000 + 10000) AS numbers FROM orders")
def address_numbers(spark, d):
    return _addresses(spark, d).select("o_orderkey", F.array_join("a.address_numbers", ",").alias("numbers"))


@query(f"SELECT o_orderkey, array_to_string(list_sort(list_distinct(regexp_extract_all({ADR}, '\\b(\\d{{5,6}})\\b', 1))), ',') AS postal FROM orders")
def postal_candidates(spark, d):
    runs = F.expr(r"regexp_extract_all(a, '(?<![0-9])([0-9]{5}|[0-9]{6})(?![0-9])', 1)")
    return read_parquet(spark, d, "orders").select("o_orderkey", _address().alias("a")).select("o_orderkey", F.array_join(F.array_sort(F.array_distinct(runs)), ",").alias("postal"))


@query("SELECT o_orderkey, 'connecticut' AS state, 'alias' AS kind FROM orders")
def state_lookup(spark, d):
    return _addresses(spark, d).select("o_orderkey", F.col("a.address_state").alias("state"), F.col("a.address_state_kind").alias("kind"))


# --- profiles -------------------------------------------------------------------------------------------------------
both("profile_by_country", """SELECT n_name AS country, count(*) AS n, count_if(c_acctbal < 0) AS negative, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(DISTINCT c_mktsegment) AS segments, sum(length(c_name)) AS chars
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""", """SELECT n_name AS country, count(*) AS n, count_if(c_acctbal < 0)::BIGINT AS negative, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(DISTINCT c_mktsegment) AS segments, sum(length(c_name))::BIGINT AS chars
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
both("name_collisions", "SELECT count(*) AS keys, sum(n) AS rows, count_if(n > 1) AS shared, max(n) AS largest FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name) x",
     "SELECT count(*) AS keys, sum(n)::BIGINT AS rows, count_if(n > 1)::BIGINT AS shared, max(n) AS largest FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name) x")
_VIEWS = "SELECT view, count(*) AS distinct_values, {0} AS rows, {1} AS repeated FROM (SELECT view, value, count(*) AS n FROM (SELECT 'name' AS view, p_name AS value FROM part UNION ALL SELECT 'brand', p_brand FROM part UNION ALL SELECT 'type', p_type FROM part) u GROUP BY view, value) x GROUP BY view"
both("view_collisions", _VIEWS.format("sum(n)", "count_if(n > 1)"), _VIEWS.format("sum(n)::BIGINT", "count_if(n > 1)::BIGINT"))
both("label_integrity", "SELECT count(*) AS links, count(DISTINCT o_orderkey) AS targets, count_if(c_custkey IS NULL) AS orphans FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
     "SELECT count(*) AS links, count(DISTINCT o_orderkey) AS targets, count_if(c_custkey IS NULL)::BIGINT AS orphans FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
_BUCKET = "CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 4 THEN '3-4' ELSE '5+' END"
both("match_count_distribution", f"SELECT {_BUCKET} AS bucket, count(*) AS queries FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey) x GROUP BY 1")
both("ambiguous_keys", "SELECT c_mktsegment AS k, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey HAVING count(*) > 1")
both("label_taxonomy", """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN p_name = lower(p_type) THEN 'equal' WHEN l_returnflag = 'R' AND l_discount > 0.05 THEN 'conflict' WHEN l_tax = 0 THEN 'no_tax' WHEN l_quantity BETWEEN 1 AND 10 THEN 'small' ELSE 'other' END AS kind FROM lineitem JOIN part ON l_partkey = p_partkey) x GROUP BY kind""")


@query(f"WITH k AS (SELECT string_split({TKEY}, ' ') AS w FROM documents WHERE {TKEY} <> '') SELECT 'first' AS side, w[1] AS tok, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 'last', w[-1], count(*) FROM k GROUP BY ALL")
def token_census_edges(spark, d):
    w = _docs(spark, d).select(text.comparison_key(F.col("text")).alias("k")).where("k <> ''").select(F.split("k", " ").alias("w"))
    ends = w.select(F.inline(F.array(F.struct(F.lit("first").alias("side"), F.element_at("w", 1).alias("tok")), F.struct(F.lit("last").alias("side"), F.element_at("w", -1).alias("tok")))))
    return ends.groupBy("side", "tok").agg(F.count("*").alias("n"))


_TOK = f"(SELECT doc_id, lang, unnest(list_distinct(string_split({TKEY}, ' '))) AS tok FROM documents)"


@query(f"SELECT tok, count(*) AS df FROM {_TOK} WHERE tok <> '' GROUP BY tok")
def token_df(spark, d):
    return _docs(spark, d).select(F.explode(text.tokens(text.comparison_key(F.col("text")))).alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))


@query(f"WITH t AS (SELECT lang = 'en' AS en, tok FROM {_TOK} WHERE tok <> ''), n AS (SELECT count_if(lang = 'en') AS a, count_if(lang <> 'en') AS b FROM documents) SELECT tok, count_if(en)::BIGINT AS n_en, count_if(NOT en)::BIGINT AS n_other, round((count_if(en) + 1.0) / (any_value(a) + 1.0) / ((count_if(NOT en) + 1.0) / (any_value(b) + 1.0)), 6) AS lift FROM t, n GROUP BY tok HAVING count(*) >= 5")
def token_lift(spark, d):
    docs = _docs(spark, d)
    n = docs.agg(F.count_if(F.col("lang") == "en").alias("a"), F.count_if(F.col("lang") != "en").alias("b"))
    t = docs.select((F.col("lang") == "en").alias("en"), F.explode(text.tokens(text.comparison_key(F.col("text")))).alias("tok")).groupBy("tok").agg(F.count_if("en").alias("n_en"), F.count_if(~F.col("en")).alias("n_other")).where("n_en + n_other >= 5")
    return t.crossJoin(F.broadcast(n)).select("tok", "n_en", "n_other", F.round((F.col("n_en") + 1.0) / (F.col("a") + 1.0) / ((F.col("n_other") + 1.0) / (F.col("b") + 1.0)), 6).alias("lift"))


both("content_totals", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, sum(length(text)) AS chars, sum(crc32(cast(text AS binary))) AS digest FROM documents", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, sum(length(text))::BIGINT AS chars FROM documents")
del ORACLES["content_totals"]  # the digest has no counterpart
both("script_census", r"SELECT lang, count(*) AS n, count_if(text rlike '[^\\x00-\\x7f]') AS non_ascii, count_if(text rlike '\\p{IsLatin}') AS latin FROM documents GROUP BY lang",
     r"SELECT lang, count(*) AS n, count_if(regexp_matches(text, '[^\x00-\x7f]'))::BIGINT AS non_ascii, count_if(regexp_matches(text, '\p{Latin}'))::BIGINT AS latin FROM documents GROUP BY lang")

# --- folds and samples ------------------------------------------------------------------------------------------------
FOLD = f"""(WITH c AS (SELECT e.entity_id, country, count(t) AS match_count FROM {ENT} e LEFT JOIN {TRU} tr ON q = e.entity_id GROUP BY ALL),
s AS (SELECT *, country || '|' || {_BUCKET.replace('n ', 'match_count ')} AS stratum FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {HEX.format('fold', 'entity_id')}, entity_id) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM s),
qf AS (SELECT entity_id, 'query' AS role, country, CASE WHEN r <= n * 8 // 10 THEN 'dev' WHEN r <= n * 9 // 10 THEN 'val' ELSE 'holdout' END AS fold, stratum, match_count FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY {HEX.format('fold', 'entity_id')}, entity_id) AS r, count(*) OVER (PARTITION BY country) AS n FROM {TGT} g WHERE entity_id NOT IN (SELECT t FROM {TRU} x))
SELECT * FROM qf UNION ALL SELECT t, 'target', country, fold, 'owned', 1 FROM {TRU} x JOIN qf ON q = entity_id
UNION ALL SELECT entity_id, 'target', country, CASE WHEN r <= n * 8 // 10 THEN 'dev' WHEN r <= n * 9 // 10 THEN 'val' ELSE 'holdout' END, 'free', 0 FROM f)"""


@query(f"SELECT * FROM {FOLD}")
def fold_manifest(spark, d):
    return folds.fold_manifest(entities(spark, d), targets(spark, d), truth(spark, d))


@query(f"SELECT fold, role, count(*) AS n, sum(match_count)::BIGINT AS links FROM {FOLD} GROUP BY ALL")
def fold_balance(spark, d):
    return fold_manifest(spark, d).groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum("match_count").alias("links"))


@query(f"SELECT 'duplicate_entity' AS name, (SELECT count(*) - count(DISTINCT entity_id || role) FROM {FOLD})::BIGINT AS violations UNION ALL SELECT 'owner_other_fold', (SELECT count(*) FROM {TRU} x JOIN {FOLD} a ON a.entity_id = q JOIN {FOLD} b ON b.entity_id = t WHERE a.fold <> b.fold)")
def leakage_checks(spark, d):
    m, t = fold_manifest(spark, d), truth(spark, d)
    fold_of = m.select("entity_id", "fold")
    cross = t.join(fold_of.toDF("q", "fq"), "q").join(fold_of.toDF("t", "ft"), "t").agg(F.count_if(~F.col("fq").eqNullSafe(F.col("ft"))).alias("violations"))
    dup = m.agg((F.count("*") - F.count_distinct("entity_id", "role")).alias("violations"))
    return dup.select(F.lit("duplicate_entity").alias("name"), "violations").unionAll(cross.select(F.lit("owner_other_fold"), "violations"))


@query("WITH g AS (SELECT p_name AS grp, count(*) AS group_size FROM part GROUP BY p_name), r AS (SELECT *, row_number() OVER (ORDER BY sha256('stress' || grp), grp) AS r, count(*) OVER () AS n FROM g) SELECT p_partkey, grp, group_size, CASE WHEN r <= n * 8 // 10 THEN 'dev' ELSE 'test' END AS fold FROM part JOIN r ON grp = p_name")
def stress_manifest(spark, d):
    p = read_parquet(spark, d, "part").select("p_partkey", F.col("p_name").alias("grp"))
    r = folds.digest_rank(p.groupBy("grp").agg(F.count("*").alias("group_size")), "grp", "stress", [])
    return p.join(r, "grp").select("p_partkey", "grp", "group_size", F.when(F.col("r") <= F.floor(F.col("n") * 8 / 10), "dev").otherwise("test").alias("fold"))


@query(f"WITH e AS {ENT}, p AS (SELECT country, count(*) AS n FROM e GROUP BY country), s AS (SELECT country, 200 * n // (SELECT count(*) FROM e) AS base, (200 * n) % (SELECT count(*) FROM e) AS rest FROM p), o AS (SELECT *, row_number() OVER (ORDER BY rest DESC, country) AS o FROM s), k AS (SELECT country, base + CASE WHEN o <= 200 - (SELECT sum(base) FROM s) THEN 1 ELSE 0 END AS quota FROM o) SELECT entity_id, country FROM (SELECT entity_id, e.country, quota, row_number() OVER (PARTITION BY e.country ORDER BY {HEX.format('sample', 'entity_id')}, entity_id) AS r FROM e JOIN k ON e.country = k.country) WHERE r <= quota")
def stratified_sample(spark, d):
    return folds.stratified_sample(entities(spark, d), "country", 200).select("entity_id", "country")


@query(f"SELECT entity_id, (('0x' || substr({HEX.format('split', 'entity_id')}, 1, 8))::BIGINT % 100)::INT AS bucket FROM {ENT}")
def stable_bucket_split(spark, d):
    return entities(spark, d).select("entity_id", folds.stable_bucket("split", F.col("entity_id")).alias("bucket"))


# --- retrieval ----------------------------------------------------------------------------------------------------------
def _bench(spark, d):
    return read_parquet(spark, d, "benchmark").select(F.col("item_id").alias("q"), text.comparison_key(F.col("text")).alias("key"))


def _corpus(spark, d):
    return _docs(spark, d).select(F.col("doc_id").alias("t"), text.comparison_key(F.col("text")).alias("key"))


BQ = f"(SELECT item_id AS q, {TKEY} AS key FROM benchmark)"
DT = f"(SELECT doc_id AS t, {TKEY} AS key FROM documents)"
_PARTS = "(SELECT p_partkey AS id, p_name AS name, p_brand AS brand FROM part)"
_EQ = "WITH m AS (SELECT a.id AS q, b.id AS t, n AS blk, {score} AS score FROM " + _PARTS + " a JOIN (SELECT {key} AS k, count(*)::INT AS n FROM " + _PARTS + " GROUP BY 1) z ON a.{key} = k JOIN " + _PARTS + " b ON b.{key} = k) SELECT '{name}' AS channel, q, t, rnk, score, blk FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, t)::INT AS rnk FROM m) WHERE rnk <= {cap}"


def _parts(spark, d):
    return read_parquet(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))


@query(_EQ.format(name="eq_name", key="name", score="1.0::DOUBLE", cap=100))
def eq_channel_plain(spark, d):
    p = _parts(spark, d)
    return retrieval.equality_channel("eq_name", p.withColumnRenamed("id", "q"), p.withColumnRenamed("id", "t"), F.col("name"))


@query(_EQ.format(name="eq_brand", key="brand", score="CASE WHEN n > 20 THEN round(len(list_intersect(string_split(a.name, ' '), string_split(b.name, ' '))) / len(list_distinct(string_split(a.name, ' ') || string_split(b.name, ' '))), 9) ELSE 1.0::DOUBLE END", cap=20))
def eq_channel_oversize(spark, d):
    p = _parts(spark, d).select("id", "brand", F.array_sort(F.array_distinct(F.split("name", " "))).alias("words"))
    near = F.round(similarity.jaccard(F.col("q_words"), F.col("t_words")), 9)
    return retrieval.equality_channel("eq_brand", p.withColumnRenamed("id", "q"), p.withColumnRenamed("id", "t"), F.col("brand"), near, cap=20)


def _postings_sql(name: str, toks: str, cap: int, rarest: int, k: int) -> str:
    return f"""WITH o AS (SELECT DISTINCT q, tok FROM (SELECT q, unnest({toks}) AS tok FROM {BQ}) WHERE tok <> ''), h AS (SELECT DISTINCT t, tok FROM (SELECT t, unnest({toks}) AS tok FROM {DT}) WHERE tok <> ''),
i AS (SELECT tok, count(*) AS df, round(ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 0.5)) * 1e6)::BIGINT AS idf FROM h GROUP BY tok),
c AS (SELECT * FROM (SELECT q, tok, df, idf, row_number() OVER (PARTITION BY q ORDER BY idf DESC, tok) AS r, min(df) OVER (PARTITION BY q) AS least FROM o JOIN i USING (tok)) WHERE r <= {rarest} AND (df <= {cap} OR least > {cap})),
s AS (SELECT q, t, sum(idf)::DOUBLE AS score, count(*)::INT AS blk FROM c JOIN h USING (tok) GROUP BY q, t)
SELECT '{name}' AS channel, q, t, rnk, score, blk FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, t)::INT AS rnk FROM s) WHERE rnk <= {k}"""


_WORDS, _GRAMS = "string_split(key, ' ')", "list_transform(range(1, length(key) - 1), lambda i: substr(key, i, 3))"
_BI = "list_transform(range(1, len(string_split(key, ' '))), lambda i: string_split(key, ' ')[i] || ' ' || string_split(key, ' ')[i + 1])"


@query(_postings_sql("tok", _WORDS, 3000, 6, 20))
def postings_tokens(spark, d):
    return retrieval.postings_channel("tok", _bench(spark, d), _corpus(spark, d), text.tokens(F.col("key")), 3000, 6, 1, 20)


_ANY = "(SELECT count(*) FROM documents)"


@query(_postings_sql("tok", _WORDS, _ANY, 6, 20))
def postings_tokens_all(spark, d):
    """postings_tokens without a bound on a token's documents."""
    return retrieval.postings_channel("tok", _bench(spark, d), _corpus(spark, d), text.tokens(F.col("key")), None, 6, 1, 20)


@query(_postings_sql("tri", _GRAMS, 5000, 10, 20))
def postings_trigrams(spark, d):
    """The 3-grams of whole texts; char_grams' own limit of 40 characters is for names."""
    return retrieval.postings_channel("tri", _bench(spark, d), _corpus(spark, d), text.char_grams(F.col("key"), first=None), 5000, 10, 1, 20)


@query(_postings_sql("tri", _GRAMS, _ANY, 10, 20))
def postings_trigrams_all(spark, d):
    """postings_trigrams without a bound on a 3-gram's documents."""
    return retrieval.postings_channel("tri", _bench(spark, d), _corpus(spark, d), text.char_grams(F.col("key"), first=None), None, 10, 1, 20)


@query(_postings_sql("big", _BI, 3000, 6, 20))
def postings_bigrams(spark, d):
    return retrieval.postings_channel("big", _bench(spark, d), _corpus(spark, d), text.bigrams(F.col("key")), 3000, 6, 1, 20)


def _union(spark, d):
    return retrieval.union_channels(postings_tokens(spark, d), postings_trigrams(spark, d), postings_bigrams(spark, d))


UNI = f"(SELECT * FROM ({ORACLES['postings_tokens']}) UNION ALL SELECT * FROM ({ORACLES['postings_trigrams']}) UNION ALL SELECT * FROM ({ORACLES['postings_bigrams']}))"


@query(f"SELECT * FROM {UNI}")
def candidate_union(spark, d):
    return _union(spark, d)


def _runs(c, n: int):
    """Distinct runs of n words of a key."""

    def runs(w):
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
        return F.when(F.size(w) >= n, F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " ")))).otherwise(F.array().cast("array<string>"))

    return text.let(F.split(c, " "), runs)


def holders(bench: DataFrame, corpus: DataFrame) -> DataFrame:
    """(q, t) of every document that holds a benchmark text's first six words in a row (all its words, if fewer)."""
    words = F.slice(F.split("key", " "), 1, 6)
    heads = bench.where("key <> ''").select("q", F.size(words).alias("n"), F.array_join(words, " ").alias("head"))
    widths = sorted(r["n"] for r in heads.select("n").distinct().collect()) or [6]  # six at most
    runs = [corpus.select("t", F.lit(n).alias("n"), F.explode(_runs(F.col("key"), n)).alias("head")) for n in widths]
    few = retrieval.bounded(heads)
    return retrieval.union_channels(*runs).join(F.broadcast(heads) if few else heads, ["n", "head"]).select("q", "t").distinct()


def _holds(spark, d):
    """Truth for retrieval, from all documents."""
    return holders(_bench(spark, d), _corpus(spark, d))


HOL = f"(SELECT DISTINCT b.q, h.t FROM (SELECT q, array_to_string(string_split(key, ' ')[1:6], ' ') AS head FROM {BQ} WHERE key <> '') b JOIN {DT} h ON contains(' ' || h.key || ' ', ' ' || b.head || ' '))"
_EVAL = """WITH cand AS (SELECT DISTINCT q, t FROM {cand} c), tr AS {truth},
per AS (SELECT b.q, coalesce(n, 0) AS n, coalesce(h, 0) AS h, coalesce(c, 0) AS c FROM (SELECT item_id AS q FROM benchmark) b LEFT JOIN (SELECT q, count(*) AS n FROM tr GROUP BY q) x ON x.q = b.q
LEFT JOIN (SELECT q, count(*) AS h FROM cand JOIN tr USING (q, t) GROUP BY q) y ON y.q = b.q LEFT JOIN (SELECT q, count(*) AS c FROM cand GROUP BY q) z ON z.q = b.q)
SELECT {extra} count(*) AS queries, sum(n)::BIGINT AS links, sum(h)::BIGINT AS hits, round(sum(h) / sum(n), 9) AS micro_recall, round(avg(CASE WHEN n > 0 THEN h / n END), 9) AS macro_recall, round(avg(CASE WHEN n > 0 THEN (h = n)::INT END), 9) AS all_links,
round(avg((c = 0)::INT), 9) AS zero_rate, round(avg(c), 9) AS cand_mean, quantile_cont(c, 0.5) AS cand_p50, quantile_cont(c, 0.9) AS cand_p90, max(c) AS cand_max,
round(avg(CASE WHEN n = 0 THEN 1.0 WHEN h = 0 THEN 0.0 ELSE 1.25 * h / (1.25 * h + 0.25 * (n - h)) END), 9) AS oracle_f05 FROM per"""


@query(_EVAL.format(cand=f"(SELECT * FROM ({ORACLES['postings_tokens']}))", truth=HOL, extra=""))
def candidate_metrics(spark, d):
    return retrieval.evaluate(postings_tokens(spark, d), _bench(spark, d), _holds(spark, d))


@query(" UNION ALL ".join("SELECT * FROM (" + _EVAL.format(cand=f"(SELECT * FROM ({ORACLES['postings_tokens']}) WHERE rnk <= {k})", truth=HOL, extra=f"{k} AS k,") + ")" for k in (1, 5, 20)))
def candidate_curve(spark, d):
    c, q, t = postings_tokens(spark, d), _bench(spark, d), _holds(spark, d)
    return retrieval.union_channels(*[retrieval.evaluate(c.where(retrieval.within({"tok": k})), q, t).select(F.lit(k).alias("k"), "*") for k in (1, 5, 20)])


@query(f"SELECT lang AS slice, count(*) AS links, count(c.t) AS hits FROM {HOL} h JOIN documents ON doc_id = h.t LEFT JOIN (SELECT DISTINCT q, t FROM ({ORACLES['postings_tokens']})) c ON c.q = h.q AND c.t = h.t GROUP BY lang")
def missed_by_slice(spark, d):
    hit = postings_tokens(spark, d).select("q", "t", F.lit(1).alias("hit")).distinct()
    return _holds(spark, d).join(hit, ["q", "t"], "left").join(_docs(spark, d).select(F.col("doc_id").alias("t"), F.col("lang").alias("slice")), "t").groupBy("slice").agg(F.count("*").alias("links"), F.count("hit").alias("hits"))


@query(f"""WITH a AS (SELECT q, t, string_agg(channel, ',' ORDER BY channel, score, rnk) AS channels, string_agg(rnk::VARCHAR, ',' ORDER BY channel, score, rnk) AS ranks, count(*)::INT AS n_channels FROM {UNI} GROUP BY q, t)
SELECT a.q, a.t, channels, ranks, 0 AS block, n_channels, count(*) OVER (PARTITION BY a.q) AS n_candidates, CASE WHEN n_channels > 1 THEN 'multi' ELSE 'single' END AS evidence, CASE WHEN h.q IS NULL THEN 0 ELSE 1 END AS is_positive FROM a LEFT JOIN {HOL} h ON h.q = a.q AND h.t = a.t""")
def candidate_v1(spark, d):
    return retrieval.aggregate(_union(spark, d), _holds(spark, d))


_CH = ["tok", "tri", "big"]
_WIDE = "SELECT q, t, " + ", ".join(f"coalesce(max(rnk) FILTER (channel = '{c}'), 101)::INT AS rank_{c}, coalesce(max(score) FILTER (channel = '{c}'), 0.0)::DOUBLE AS score_{c}" for c in _CH) + f" FROM {UNI} GROUP BY q, t"


@query(_WIDE)
def channel_pivot(spark, d):
    return retrieval.pivot(_union(spark, d), _CH).drop(*[f"rel_{c}" for c in _CH])


@query("SELECT q, t, " + ", ".join(f"round(coalesce(score_{c} / nullif(max(score_{c}) OVER (PARTITION BY q), 0), 0), 9) AS rel_{c}" for c in _CH) + f" FROM ({_WIDE})")
def relative_scores(spark, d):
    return retrieval.pivot(_union(spark, d), _CH).select("q", "t", *[f"rel_{c}" for c in _CH])


# --- pair features --------------------------------------------------------------------------------------------------------
def _pairs(spark, d):
    p = read_parquet(spark, d, "part").select("p_partkey", F.lower("p_name").alias("n"), F.lower("p_type").alias("b"))
    return p


_AB = "(SELECT p_partkey, lower(p_name) AS n, lower(p_type) AS b FROM part)"


@query(f"SELECT p_partkey, round(len(list_intersect(list_distinct(string_split(n, ' ')), list_distinct(string_split(b, ' ')))) / len(list_distinct(string_split(n, ' ') || string_split(b, ' '))), 9) AS jaccard FROM {_AB}")
def pair_jaccard(spark, d):
    return _pairs(spark, d).select("p_partkey", F.round(similarity.jaccard(text.tokens(F.col("n")), text.tokens(F.col("b"))), 9).alias("jaccard"))


_G3 = "list_distinct(list_transform(range(1, length({0}) + 3), lambda i: substr('  ' || {0} || '  ', i, 3)))"


@query(f"SELECT p_partkey, round(2 * len(list_intersect({_G3.format('n')}, {_G3.format('b')})) / (len({_G3.format('n')}) + len({_G3.format('b')})), 9) AS dice FROM {_AB}")
def pair_char3_dice(spark, d):
    return _pairs(spark, d).select("p_partkey", F.round(similarity.char3_dice(F.col("n"), F.col("b")), 9).alias("dice"))


@query(f"SELECT p_partkey, round(jaro_winkler_similarity(n, b), 9) AS jw FROM {_AB}")
def pair_jaro_winkler(spark, d):
    return _pairs(spark, d).select("p_partkey", F.round(similarity.jaro_winkler(F.col("n"), F.col("b")), 9).alias("jw"))


@query()
def pair_edit_ratios(spark, d):
    return _pairs(spark, d).select("p_partkey", F.round(similarity.ratio(F.col("n"), F.col("b")), 6).alias("ratio"), F.round(similarity.token_set_ratio(F.col("n"), F.col("b")), 6).alias("token_set_ratio"))


@query("SELECT l_orderkey, l_linenumber, (CASE WHEN list_has_any(a, b) THEN 1 ELSE 0 END) AS shared, (CASE WHEN NOT list_has_any(a, b) THEN 1 ELSE 0 END) AS conflict FROM (SELECT l_orderkey, l_linenumber, [l_partkey % 10, l_suppkey % 10] AS a, [l_orderkey % 10, l_linenumber] AS b FROM lineitem)")
def pair_number_conflicts(spark, d):
    x = read_parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.arrays_overlap(F.array(F.col("l_partkey") % 10, F.col("l_suppkey") % 10), F.array(F.col("l_orderkey") % 10, F.col("l_linenumber").cast("long"))).alias("o"))
    return x.select("l_orderkey", "l_linenumber", F.when(F.col("o"), 1).otherwise(0).alias("shared"), F.when(~F.col("o"), 1).otherwise(0).alias("conflict"))


# --- decisions --------------------------------------------------------------------------------------------------------------
RNK = f"(SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, t) AS r FROM {SCO})"
_LEAD = f"(SELECT *, max(CASE WHEN r = 1 THEN p END) OVER (PARTITION BY q) - coalesce(max(CASE WHEN r = 2 THEN p END) OVER (PARTITION BY q), 0) AS gap FROM {RNK})"


@query(f"SELECT q, t, p FROM {_LEAD} WHERE p >= 0.5 AND r <= 3 AND gap >= 0.02")
def select_threshold(spark, d):
    return decide.select_threshold(scored(spark, d), 0.5, 3, 0.02)


@query(f"SELECT q, t, p FROM {RNK} WHERE p >= CASE WHEN t % 2 = 0 THEN 0.4 ELSE 0.7 END AND r <= 3")
def select_threshold_slice(spark, d):
    return decide.select_threshold(scored(spark, d), F.when(F.col("t") % 2 == 0, 0.4).otherwise(0.7), 3)


@query(f"SELECT q, t, p FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, t) AS r FROM {SCO} WHERE p >= CASE WHEN t % 2 = 0 THEN 0.4 ELSE 0.7 END) WHERE r <= 3")
def decide_queries(spark, d):
    return decide.decide_queries(scored(spark, d), F.when(F.col("t") % 2 == 0, 0.4).otherwise(0.7), 3)


@query(f"""WITH s AS (SELECT q, list(p ORDER BY p DESC, t) AS ps, list(t ORDER BY p DESC, t) AS ts FROM {SCO} GROUP BY q),
n AS (SELECT *, list_product(list_transform(ps, lambda v: 1 - v)) AS none, list_sum(ps) AS total FROM s),
m AS (SELECT *, unnest(range(1, least(12, len(ps)) + 1)) AS m FROM n),
v AS (SELECT *, round((1 - none) * 1.25 * list_sum(ps[1:m]) / (m + 0.25 * list_sum(ps[1:m]) + 0.25 * greatest(total - list_sum(ps[1:m]), 0)), 8) AS worth FROM m),
b AS (SELECT q, arg_min(m, (-worth, m)) AS m, max(worth) AS worth, any_value(none) AS none, any_value(ps) AS ps, any_value(ts) AS ts FROM v GROUP BY q)
SELECT q, unnest(ts[1:m]) AS t, unnest(ps[1:m]) AS p FROM b WHERE worth > round(none, 8)""")
def select_expected_f(spark, d):
    return decide.select_expected_f(scored(spark, d))


COM = f"(SELECT a.q, a.t, a.p, coalesce(CASE WHEN o = 1 THEN s ELSE f END, 0)::DOUBLE AS comp FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p DESC, q) AS o FROM {SCO}) a JOIN (SELECT t, max(CASE WHEN o = 1 THEN p END) AS f, max(CASE WHEN o = 2 THEN p END) AS s FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p DESC, q) AS o FROM {SCO}) GROUP BY t) b ON a.t = b.t)"


@query(f"SELECT * FROM {COM}")
def competitor_max(spark, d):
    return decide.competitor_max(scored(spark, d)).select("q", "t", "p", "comp")


@query(f"SELECT q, t, p FROM {COM} WHERE comp <= p")
def one_owner(spark, d):
    return decide.one_owner(scored(spark, d)).select("q", "t", "p")


def _f(tp: str, n_pred: str, n_true: str) -> str:
    return f"CASE WHEN {n_true} = 0 AND {n_pred} = 0 THEN 1.0 WHEN {n_true} = 0 OR {n_pred} = 0 THEN 0.0 ELSE 1.25 * {tp} / (1.25 * {tp} + ({n_pred} - {tp}) + 0.25 * ({n_true} - {tp})) END"


def _per(pred: str) -> str:
    return f"(SELECT o_orderkey AS q, coalesce(a, 0) AS n_true, coalesce(b, 0) AS n_pred, coalesce(c, 0) AS tp FROM orders LEFT JOIN (SELECT q, count(*) AS a FROM {PTR} GROUP BY q) x ON x.q = o_orderkey LEFT JOIN (SELECT q, count(*) AS b FROM {pred} GROUP BY q) y ON y.q = o_orderkey LEFT JOIN (SELECT q, count(*) AS c FROM {pred} JOIN {PTR} USING (q, t) GROUP BY q) z ON z.q = o_orderkey)"


_SEL = f"(SELECT q, t, p FROM {RNK} WHERE p >= 0.5 AND r <= 3)"


def _selected(spark, d):
    return decide.scored_queries(order_queries(spark, d), pair_truth(spark, d), decide.select_threshold(scored(spark, d), 0.5, 3).select("q", "t"))


@query(f"SELECT count(*) AS queries, sum(tp)::BIGINT AS tp, sum(n_pred)::BIGINT AS n_pred, sum(n_true)::BIGINT AS n_true, round(avg({_f('tp', 'n_pred', 'n_true')}), 9) AS macro_f05 FROM {_per(_SEL)}")
def macro_f05(spark, d):
    return _selected(spark, d).agg(F.count("*").alias("queries"), F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_true").alias("n_true"), F.round(F.avg("f"), 9).alias("macro_f05"))


@query(f"WITH s AS (SELECT *, {_f('tp', 'n_pred', 'n_true')} AS f FROM {_per(_SEL)} JOIN orders ON o_orderkey = q) SELECT slice, count(*) AS queries, round(avg(f), 9) AS macro_f05 FROM (SELECT f, unnest(['all', o_orderstatus, o_orderpriority]) AS slice FROM s) GROUP BY slice")
def slice_f05(spark, d):
    o = read_parquet(spark, d, "orders").select(F.col("o_orderkey").alias("q"), F.array(F.lit("all"), "o_orderstatus", "o_orderpriority").alias("s"))
    return _selected(spark, d).join(o, "q").select("f", F.explode("s").alias("slice")).groupBy("slice").agg(F.count("*").alias("queries"), F.round(F.avg("f"), 9).alias("macro_f05"))


_TAUS, _TOPS = [0.3, 0.5, 0.7], [1, 3]


@query(" UNION ALL ".join(f"SELECT {a}::DOUBLE AS tau, {b} AS top_k, round(avg({_f('tp', 'n_pred', 'n_true')}), 9) AS macro_f05 FROM {_per(f'(SELECT q, t FROM {RNK} WHERE p >= {a} AND r <= {b})')}" for a in _TAUS for b in _TOPS))
def policy_grid(spark, d):
    return decide.policy_grid(scored(spark, d), order_queries(spark, d), pair_truth(spark, d), _TAUS, _TOPS)


@query(f"SELECT round(avg({_f('tp', 'tp', 'n_true')}), 9) AS oracle_f05 FROM {_per(SCO)}")
def oracle_ceiling(spark, d):
    s = decide.scored_queries(order_queries(spark, d), pair_truth(spark, d), scored(spark, d).select("q", "t"))
    return s.agg(F.round(F.avg(decide.f05(F.col("tp"), F.col("tp"), F.col("n_true"))), 9).alias("oracle_f05"))


@query(f"SELECT o_orderkey AS q, coalesce(ids, '') AS ids FROM orders LEFT JOIN (SELECT q, string_agg(t::VARCHAR, ',' ORDER BY t::VARCHAR) AS ids FROM {_SEL} GROUP BY q) x ON x.q = o_orderkey")
def submission_lists(spark, d):
    return id_lists(order_queries(spark, d), decide.select_threshold(scored(spark, d), 0.5, 3))


@query(f"SELECT 'duplicate_pair' AS name, (SELECT count(*) - count(DISTINCT (q, t)) FROM {_SEL})::BIGINT AS violations UNION ALL SELECT 'unknown_query', (SELECT count(*) FROM {_SEL} WHERE q NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'not_a_candidate', (SELECT count(*) FROM (SELECT q, t FROM {_SEL} EXCEPT SELECT q, t FROM {SCO}))")
def submission_checks(spark, d):
    s, c, o = decide.select_threshold(scored(spark, d), 0.5, 3).select("q", "t"), scored(spark, d).select("q", "t"), order_queries(spark, d)
    parts = [("duplicate_pair", s.agg((F.count("*") - F.count_distinct("q", "t")).alias("violations"))), ("unknown_query", s.join(o, "q", "left_anti").agg(F.count("*").alias("violations"))), ("not_a_candidate", s.subtract(c).agg(F.count("*").alias("violations")))]
    return retrieval.union_channels(*[x.select(F.lit(n).alias("name"), "violations") for n, x in parts])


_NEG = "(SELECT DISTINCT l_orderkey AS q, l_partkey AS t, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS y, 's' || (l_partkey % 2) AS slice FROM lineitem)"


@query(f"""WITH x AS {_NEG}, n AS (SELECT *, row_number() OVER (PARTITION BY q, slice ORDER BY sha256('neg' || q || ':' || t), t) AS rn FROM x WHERE y = 0), o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rn, slice) AS o, count(*) OVER (PARTITION BY q, slice) AS total FROM n),
b AS (SELECT q, greatest(2, 1 * sum(y)) AS budget FROM x GROUP BY q), k AS (SELECT o.* FROM o JOIN b ON b.q = o.q WHERE o <= budget)
SELECT q, t, y, slice, 1.0::DOUBLE AS weight FROM x WHERE y = 1 UNION ALL SELECT q, t, y, slice, round(total / count(*) OVER (PARTITION BY q, slice), 9) FROM k""")
def hard_negatives(spark, d):
    x = read_parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("t"), F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(0).alias("y"), F.concat(F.lit("s"), (F.col("l_partkey") % 2).cast("string")).alias("slice")).distinct()
    return folds.hard_negatives(x, 1, 2)


# --- verification, vectors, learning ----------------------------------------------------------------------------------------
#: Predicates that no row may meet, evaluated in one scan.
INVARIANTS = {"negative_quantity": "l_quantity < 0", "discount_range": "l_discount < 0 OR l_discount > 1", "null_key": "l_orderkey IS NULL OR l_partkey IS NULL", "bad_flag": "l_returnflag NOT IN ('A', 'N', 'R')", "line_number": "l_linenumber < 1"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count_if({p})::BIGINT AS violations FROM lineitem" for n, p in INVARIANTS.items()))
def invariant_report(spark, d):
    one = read_parquet(spark, d, "lineitem").agg(*[F.count_if(F.expr(p)).alias(n) for n, p in INVARIANTS.items()])
    return one.unpivot([], list(INVARIANTS), "name", "violations")


@query("SELECT l_orderkey, l_linenumber, (crc32 % 8)::INT AS shard FROM (SELECT 0 AS l_orderkey, 0 AS l_linenumber, 0 AS crc32) WHERE false")
def sharded_rows(spark, d):
    return shard(read_parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 8)


del ORACLES["sharded_rows"]  # DuckDB has no CRC-32


@query("SELECT q, t, score, rnk FROM (SELECT a.vec_id AS q, b.vec_id AS t, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id)::INT AS rnk FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE rnk <= 10")
def embedding_topk(spark, d):
    v = read_parquet(spark, d, "embeddings").select(F.col("vec_id").alias("t"), F.col("embedding").alias("v"))
    return retrieval.top_by_cosine(v.where("t % 100 = 0").withColumnRenamed("t", "q"), v, 64, 10).select("q", "t", "score", "rnk")


@query(f"WITH r AS (SELECT x.q, min(r) AS r FROM {RNK} x JOIN {PTR} y ON x.q = y.q AND x.t = y.t GROUP BY x.q) SELECT count(*) AS queries, round(avg(1.0 / r), 9) AS mrr, round(avg((r <= 1)::INT), 9) AS recall_1, round(avg((r <= 3)::INT), 9) AS recall_3, quantile_cont(r, 0.5) AS median_rank FROM r")
def rank_metrics_mrr(spark, d):
    r = decide.ranked(scored(spark, d)).join(pair_truth(spark, d), ["q", "t"], "left_semi").groupBy("q").agg(F.min("r").alias("r"))
    return r.agg(F.count("*").alias("queries"), F.round(F.avg(1.0 / F.col("r")), 9).alias("mrr"), F.round(F.avg((F.col("r") <= 1).cast("int")), 9).alias("recall_1"), F.round(F.avg((F.col("r") <= 3).cast("int")), 9).alias("recall_3"), F.expr("percentile(r, 0.5)").alias("median_rank"))


@query()
def calibrated_scores(spark, d):
    """Isotonic and Platt calibration on one half of the queries, reported on the other."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    x = scored(spark, d).join(pair_truth(spark, d).withColumn("label", F.lit(1.0)), ["q", "t"], "left").na.fill(0.0, ["label"])
    x = VectorAssembler(inputCols=["p"], outputCol="f").transform(x).withColumn("half", F.pmod(F.crc32(F.col("q").cast("string").cast("binary")), F.lit(2)))
    fit, rest = x.where("half = 0"), x.where("half = 1")
    iso = IsotonicRegression(featuresCol="f", labelCol="label", predictionCol="isotonic").fit(fit).transform(rest)
    platt = LogisticRegression(featuresCol="f", labelCol="label", probabilityCol="pr", rawPredictionCol="raw", predictionCol="pred").fit(fit).transform(iso)
    from pyspark.ml.functions import vector_to_array

    return platt.select("q", "t", "p", "label", F.round("isotonic", 9).alias("isotonic"), F.round(vector_to_array("pr")[1], 9).alias("platt"))


@query()
def gbdt_scores(spark, d):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = read_parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label"))
    x = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(x)
    train = x.where(F.pmod(F.crc32(F.col("l_orderkey").cast("string").cast("binary")), F.lit(5)) != 0)
    return GBTClassifier(labelCol="label", maxIter=5, maxDepth=3, seed=7).fit(train).transform(x).select("l_orderkey", "l_linenumber", F.round(vector_to_array("probability")[1], 6).alias("score"))
