"""Queries of the linkage engine against DuckDB, and its scalar functions against plain Python."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import records, similarity, text
from tessera.operators import decide, retrieval
from tessera.plans import analysis, queries  # noqa: F401
from tessera.sources.tables import read_tsv, spread

DATA = "/root/testdata/sf0.001"
QUICK = ["v1_key", "clean_text_repairs", "skeleton", "fold_manifest", "stratified_sample", "eq_channel_oversize", "postings_tokens", "select_threshold", "select_expected_f", "one_owner", "macro_f05", "policy_grid", "hard_negatives", "submission_lists", "pair_jaro_winkler", "address_segments", "eq_channel_plain", "stress_manifest", "errors_by_stratum", "paired_bootstrap", "abbreviation_candidates", "mini_world", "contract_report", "submission_report", "invariants_by_table"]


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = queries.QUERIES[name](spark, DATA)
    r = con.execute(queries.ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(found.columns) == sorted(names)
    order = sorted(names)
    ours = sorted((tuple(plain(row[c]) for c in order) for row in found.collect()), key=repr)
    theirs = sorted((tuple(plain(row[names.index(c)]) for c in order) for row in r.fetchall()), key=repr)
    assert ours == theirs


def test_text_functions(spark):
    df = spark.createDataFrame([("a‌b", "Éclat œuvre", "Zeta L.L.P.", "N°5 ‘x’")], "j string, f string, l string, p string")
    r = df.select(text.remove_joiners(F.col("j")), text.fold_latin(F.col("f")), text.join_dotted_legal(F.col("l")), text.normalize_punctuation(F.col("p"))).first()
    assert tuple(r) == ("ab", "Eclat oeuvre", "Zeta LLP", "No 5 'x'".replace("No 5", "No 5"))


def test_name_and_address_records():
    n = records.name_features("The Zeta Foods Pvt. Ltd.", "India")
    assert (n["name_core"], n["legal_form"], n["legal_position"], n["name_leading_removed"]) == ("zeta foods", "PVT+LTD", "suffix", "the")
    n = records.name_features("Limited")
    assert (n["name_core"], n["name_core_fallback"], n["legal_position"]) == ("limited", True, "suffix")
    n = records.name_features("Alpha (India) LLC")
    assert (n["name_core"], n["name_bracket_text"], n["legal_form"], n["legal_position"]) == ("alpha india", "india", "LLC", "suffix")
    assert records.name_features("(LLC) Alpha Beta", "US")["legal_position"] == "bracket"
    n = records.name_features("M/s Orbit and Orbit Traders Services", "India")
    assert (n["name_core"], n["name_core_trim"], n["name_token_counts"]) == ("orbit orbit traders services", "orbit orbit traders", '{"orbit": 2}')
    n = records.name_features("Alpha Pvt Ltd d / b / a The Beta Inc", "India")
    assert (n["alias_marker"], n["alias_left"], n["alias_right"]) == ("dba", "alpha", "beta")
    n = records.name_features("www.shop-now.com")
    assert (n["name_core"], n["name_domain"], n["name_domain_label"]) == ("shop now", True, "shop-now")
    assert records.name_features("www shop com")["name_core"] == "www shop com"
    assert [records.name_features("Private Care Inc", c)["legal_form"] for c in ("US", "India", "native", "")] == ["INC", "PVT+INC", "INC", "INC"]
    n = records.name_features("ज़ेटा प्राइवेट लिमिटेड", "India")
    assert (n["name_core"], n["legal_form"], n["name_ntokens"]) == ("ज़ेटा", "PVT+LTD", 3)
    n = records.name_features("Éclat Límited")
    assert (n["name_core"], n["name_core_fold"], n["legal_form"]) == ("éclat", "eclat", "LTD")
    assert records.name_features("")["name_core"] == "" and not records.name_features("")["name_core_fallback"]
    a = records.address_features("0042 Elm Ave, New York, 10001")
    assert a["address_canon"] == "42 elm avenue new york 10001" and a["address_state"] == "new york" and a["address_postal"] == ["10001"]


def test_address_states_and_cities():
    a = records.address_features("Austin, TX, Texas, Dallas")
    assert (a["address_state"], a["address_state_kind"], a["address_cities"]) == ("texas", "exact", ["dallas", "austin"])
    a = records.address_features("12 Elm St, TX, California")
    assert (a["address_state"], a["address_state_kind"]) == ("", "conflict")


def test_name_record_reads_the_cleaned_text(spark):
    rows = [("Zeta S.A.R.L.", "France"), ("Zeta L.L.C.", "US"), (None, None)]
    got = spark.createDataFrame(rows, "n string, c string").select(records.name_record(F.col("n"), F.col("c")).alias("r")).select("r.*").collect()
    assert [(r["name_core"], r["legal_form"]) for r in got] == [("zeta", "SARL"), ("zeta", "LLC"), ("", "")]


def test_ratio_against_dynamic_programming():
    random.seed(3)
    for _ in range(200):
        a, b = ("".join(random.choice("abc") for _ in range(random.randint(0, 9))) for _ in range(2))
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        assert similarity._lcs(a, b) == m[-1][-1]


def test_expected_f_against_every_prefix(spark):
    """The value of a prefix by its meaning: a query with a link (1 - P(none)) times F0.5 of expected counts, else P(none) for nothing."""
    rows = [(1, i, p) for i, p in enumerate([0.9, 0.6, 0.2])] + [(2, 0, 0.1), (3, 0, 0.55), (4, 0, 0.5), (4, 1, 0.45)] + [(5, i, 0.95) for i in range(15)]
    got = {(r["q"], r["t"]) for r in decide.select_expected_f(spark.createDataFrame(rows, "q long, t long, p double")).collect()}
    want, plain_rule = set(), set()
    for q in range(1, 6):
        ps = sorted((p for a, _, p in rows if a == q), reverse=True)
        none = math.prod(1 - p for p in ps)
        worth = {}
        for m in range(1, min(12, len(ps)) + 1):
            hits, wrong, missed = sum(ps[:m]), sum(1 - p for p in ps[:m]), sum(ps[m:])
            worth[m] = 1.25 * hits / (1.25 * hits + wrong + 0.25 * missed)
        best = max(worth, key=lambda m: (round(worth[m], 8), -m))
        want |= {(q, i) for i in range(best)} if (1 - none) * worth[best] > none else set()
        plain_rule |= {(q, i) for i in range(best)} if worth[best] > none else set()
    assert got == want != plain_rule


def test_scorer_refuses(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "q long")
    truth = {1: [1, 2], 3: [5]}
    t = spark.createDataFrame([(a, b) for a, v in truth.items() for b in v], "q long, t long")
    good = {1: [1, 9], 2: [4]}
    frame = lambda d: spark.createDataFrame([(a, b) for a, v in d.items() for b in v], "q long, t long")
    per = decide.scored_queries(q, t, frame(good)).collect()
    assert sum(r["f"] for r in per) / 3 == pytest.approx(decide.reference_f05(truth, good, [1, 2, 3]))
    for bad in ({1: [1, 1]}, {7: [1]}):
        with pytest.raises(Exception, match="twice|unknown"):
            decide.scored_queries(q, t, frame(bad)).collect()
        with pytest.raises(ValueError):
            decide.reference_f05(truth, bad, [1, 2, 3])
    s = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 4, 0.3)], "q long, t long, p double")
    assert {r["q"]: r["matched"] for r in decide.decisions(q, decide.decide_queries(s, 0.5, 5, max_card=1)).collect()} == {1: [1], 2: [], 3: []}
    assert decide.decide_queries(s, 0.1, 5, margin=0.2).count() == 1
    with pytest.raises(Exception, match="unknown query"):
        decide.decisions(q.where("q > 1"), s).collect()


def test_one_owner_among_selected(spark):
    rows = [(1, 7, 0.8, True), (2, 7, 0.9, False), (3, 7, 0.6, True), (4, 8, 0.5, True), (5, 8, 0.5, True)]
    s = spark.createDataFrame(rows, "q long, t long, p double, selected boolean")
    kept = lambda **k: {r["q"] for r in decide.one_owner(s, **k).collect()}
    assert kept() == {4, 5} and kept(among="selected") == {1, 4, 5} and kept(margin=0.15) == {1, 4, 5}


def test_policy_search_against_every_policy(spark):
    r = random.Random(3)
    rows = [(q, t, round(r.random(), 3), "ab"[t % 2]) for q in range(40) for t in range(5)]
    truth = {q: [t for _, t, p, s in rows[q * 5 : q * 5 + 5] if r.random() < (p if s == "a" else p * p)] for q in range(40)}
    pairs = spark.createDataFrame(rows, "q long, t long, p double, slice string")
    t = spark.createDataFrame([(q, x) for q, v in truth.items() for x in v], "q long, t long")
    qs = spark.createDataFrame([(q,) for q in range(40)], "q long")
    taus, tops, margins = [0.2, 0.4, 0.6, 0.8], [1, 3], (0.0, 0.1)

    def value(p):
        got = {}
        for q in range(40):
            own = sorted(rows[q * 5 : q * 5 + 5], key=lambda x: (-x[2], x[1]))
            if own[0][2] - own[1][2] >= p["margin"]:
                got[q] = [x[1] for x in own[: p["top_k"]] if x[2] >= p.get(x[3], p["tau"])]
        return decide.reference_f05(truth, got, list(range(40)))

    best, top = decide.search_policy(pairs, qs, t, taus, tops, margins, slices=("a", "b"))
    assert top == pytest.approx(value(best), abs=1e-9)
    plain = max(value({"tau": a, "top_k": k, "margin": m}) for a in taus for k in tops for m in margins)
    assert top >= plain - 1e-9 and all(value(best) >= value(best | {"b": a}) - 1e-9 for a in taus)


def test_strict_tsv(spark, tmp_path):
    f = tmp_path / "x.tsv"
    f.write_text('a\tb\nNA\t\n"x ""y"""\tz\n')
    assert [tuple(r) for r in read_tsv(spark, str(f), ["a", "b"]).collect()] == [("NA", ""), ('x "y"', "z")]


def test_skeleton_is_a_fixpoint_of_whole_passes(spark):
    names = ["sahar", "kahan", "bihar", "jahangir", "Xerxes 2200", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(text.skeleton(F.col("n"))).collect()] == ["sr", "kn", "fr", "jnkr", "ksrks 20", None]


def test_frequent_tokens_retrieve_without_a_cap(spark):
    docs = spark.createDataFrame([(t, f"shared passage {'more' if t < 3 else ''}".strip()) for t in range(150)], "t long, key string")
    bench = spark.createDataFrame([(1, "shared passage more")], "q long, key string")
    run = lambda cap: retrieval.postings_channel("tok", bench, docs, text.tokens(F.col("key")), cap, 2, 1, 200)
    assert (run(100).count(), run(None).count()) == (3, 150)
    bench = spark.createDataFrame([(1, "shared passage"), (2, "more")], "q long, key string")  # all of the first one's tokens are over the cap
    assert sorted(r[0] for r in run(100).groupBy("q").count().select("count").collect()) == [3, 150]


def test_spread_leaves_tables_of_many_splits(spark):
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert "Exchange" not in spread(spark.range(0, 100, 1, 50))._jdf.queryExecution().toString()


def test_postings_tokens_all_matches_duckdb(spark):
    test_query_matches_duckdb(spark, "postings_tokens_all")


def test_holders_have_no_rank_or_frequency_cut(spark):
    passage = "one two three four five six seven"
    rows = [(t, f"start {t} {passage} end") for t in range(30)] + [(100, "one two three four six five seven"), (101, "two words"), (102, "xtwo words"), (103, "")]
    docs = spark.createDataFrame(rows, "t long, key string")
    bench = spark.createDataFrame([(1, passage), (2, "two words"), (3, "")], "q long, key string")
    assert {tuple(r) for r in queries.holders(bench, docs).collect()} == {(1, t) for t in range(30)} | {(2, 101)}


def test_grams_of_the_whole_text(spark):
    keys = ["x" * 50 + "zebra", "ab", "", "é💡ab"]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(text.char_grams(F.col("k"), first=None)).collect()]
    assert got == [["xxx", "xxz", "xze", "zeb", "ebr", "bra"], [], [], ["é💡a", "💡ab"]]


def test_postings_trigrams_all_matches_duckdb(spark):
    test_query_matches_duckdb(spark, "postings_trigrams_all")


def test_script_mask_all_reads_its_tables(spark):
    test_query_matches_duckdb(spark, "script_mask_all")
    found = {r["source"]: r["count"] for r in queries.QUERIES["script_mask_all"](spark, DATA).groupBy("source").count().collect()}
    assert found == {"documents": spark.read.parquet(f"{DATA}/documents.parquet").count(), "part": spark.read.parquet(f"{DATA}/part.parquet").count(), "literal": 6}


def test_address_noise_goes_to_a_fixpoint():
    canon = lambda raw, country: records.address_features(raw, country)["address_canon"]
    assert canon("HN HN 5 6, 12 Elm Rd, Pune Region, B03, Pune", "India") == "12 elm road pune"
    assert canon("PO Box 0012, 4 Elm St, P.O. Box, Salem CDP, PMB 7", "US") == "4 elm street salem"
    assert canon("HN 5, Salem CDP", "") == "hn 5 salem cdp"
    assert canon("Plot No, No No 93", "") == "plot 93"
    assert records.number_spans("Flat No C-0251, near gate 12A")[0] == {"raw": "C-0251", "canon": "c251", "context": "flat no"}
    assert records.number_spans("Flat No C-0251, near gate 12A")[1] == {"raw": "12A", "canon": "12a", "context": "near gate"}


def oversize(spark, folder, rows):
    """Rows of eq_channel_oversize and of its SQL over the given (p_partkey, p_name, p_brand)."""
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"{folder}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    columns = ["channel", "q", "t", "rnk", "score", "blk"]
    found = queries.QUERIES["eq_channel_oversize"](spark, str(folder)).select(*columns).collect()
    theirs = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES['eq_channel_oversize']})").fetchall()
    return [sorted((tuple(plain(v) for v in r) for r in x), key=repr) for x in (found, theirs)]


def test_oversize_blocks_match_duckdb_on_odd_names(spark, tmp_path):
    rng = random.Random(5)
    names = ["red gear", "gear red", "red  gear", "red gear red", "", " ", None, "old", "Old"] + [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(40)]
    rows = [(i, rng.choice(names), rng.choice(["big", "big", "big", "mid"])) for i in range(300)]
    rows += [(1000 + i, rng.choice(names), b) for b, n in (("at cap", 20), ("over cap", 21), ("one", 1)) for i in range(n)]
    rows = [(10 * i, n, b) for i, (_, n, b) in enumerate(rows)] + [(9001, "red gear", None)]
    ours, theirs = oversize(spark, tmp_path, rows)
    assert ours == theirs


def test_oversize_query_of_two_rows_is_ranked_over_both(spark, tmp_path):
    rows = [(i, f"w{i % 7} x{i % 5}", "a" if i < 60 else "b") for i in range(100)] + [(3, "w1 x1", "b"), (70, "w0 x1", "c")]
    ours, theirs = oversize(spark, tmp_path, rows)
    assert [r[:5] for r in ours] == [r[:5] for r in theirs]  # its row in the one block ties with that in the other


def test_oversize_blocks_compare_distinct_names_only(spark):
    """600 rows of 16 names in one block: 360,000 pairs of rows, 256 of names."""
    p = spark.createDataFrame([(i, "a", f"w{i % 16}") for i in range(600)], "id long, brand string, word string")
    seen = spark.sparkContext.accumulator(0)

    def same(a, b):
        seen.add(1)
        return float(a == b)

    found = retrieval.equality_channel("eq", p.withColumnRenamed("id", "q"), p.withColumnRenamed("id", "t"), F.col("brand"), F.udf(same, "double")("q_word", "t_word"), cap=20)
    rows = {(r["q"], r["rnk"]): (r["t"], r["score"], r["blk"]) for r in found.collect()}
    assert rows == {(q, i + 1): (q % 16 + 16 * i, 1.0, 600) for q in range(600) for i in range(20)}
    assert 256 <= seen.value <= 512
