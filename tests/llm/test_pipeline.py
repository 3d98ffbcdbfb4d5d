"""The pipeline's stages on odd tables, and the near duplicates against brute force."""

import pytest

import corpus_pipeline
from tessera.llm.hashing import shingle_set

STAGES = dict(corpus_pipeline.STAGES)
DATA = "/root/testdata/sf0.001"
#: Columns that could clash with a stage's own.
COLUMNS = "doc_id long, text string, lang string, source string, score double, language string, component_id long, text_hash long, `a.b` string, quality_score int"


def rows(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", 0.5, "x", 1, 2, "y", 3) for i, t in pairs], COLUMNS)


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


@pytest.mark.parametrize("name", ["quality", "language", "near_duplicates", "packing"])
def test_stages_take_any_columns_and_rows(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").limit(40)
    odd = rows(spark, [(None, words(0, 50)), (10**6, None), (10**6 + 1, ""), (10**6 + 2, "   "), (10**6 + 3, "1 2 3")])
    frame = docs.unionByName(odd, allowMissingColumns=True)
    out = STAGES[name](spark, frame, DATA)
    if name != "packing":
        assert out.columns == frame.columns
        assert STAGES[name](spark, frame.where("false"), DATA).count() == 0
    kept = {r["doc_id"] for r in out.collect()}
    if name == "language":
        assert not kept & {10**6, 10**6 + 1, 10**6 + 2, 10**6 + 3}
    if name in ("near_duplicates", "packing"):
        assert {None, 10**6, 10**6 + 1} <= kept
    nulls = rows(spark, [(None, None), (None, None)])
    assert STAGES[name](spark, nulls, DATA).count() <= (0 if name == "language" else 2)


def test_near_duplicates_by_row(spark):
    a, b = words(0, 60), words(100, 160)
    pairs = [(1, a), (5, a + " x"), (5, b), (7, words(200, 240)), (7, words(200, 240)), (9, b), (None, a)]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in STAGES["near_duplicates"](spark, rows(spark, pairs), DATA).collect())
    assert got == sorted([(0, a), (1, a), (5, b), (7, words(200, 240))])


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sets = {r["doc_id"]: set(shingle_set(r["text"], 5).tolist()) for r in docs.collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in STAGES["near_duplicates"](spark, docs, DATA).collect()} == {i for i in sets if find(i) == i}


def test_run_packs_what_is_left(spark):
    out = corpus_pipeline.run(spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
    left = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in out} == left and 0 < len(left) < 200
    assert all(sum(r["length"] for r in out if r["doc_id"] == i) == next(r["doc_tokens"] for r in out if r["doc_id"] == i) for i in sorted(left)[:20])
