"""Every check finds the violation planted for it, and nothing in a sound table."""

import pytest

from tessera.operators import checks, folds

MAN = "entity_id string, role string, country string, fold string, stratum string, match_count long, owner_id string, assignment string, sample boolean"


def found(df):
    return {r["name"][:3] if r["name"][0] == "L" and r["name"][1].isdigit() else r["name"]: r["violations"] for r in df.collect() if r["violations"]}


def sound():
    """30 queries in one stratum, ten owned and ten free targets, folds by floors."""
    fold = lambda i, n: "dev" if i < n * 8 // 10 else "val" if i < n * 9 // 10 else "holdout"
    place = [(i * 7) % 30 for i in range(30)]  # folds do not follow the id
    q = [[f"S1-{i}", "query", "US", fold(place[i], 30), "US|x", int(i < 10), None, "query", place[i] >= 27] for i in range(30)]
    t = [[f"S2-{i}", "target", "US", q[i][3], "owned", 1, f"S1-{i}", "owner", False] for i in range(10)]
    u = [[f"S3-{i}", "target", "US", fold(i, 10), "US", 0, None, "unmatched", False] for i in range(10)]
    return q, t, u


def run(spark, q, t, u, truth=None, **more):
    rows = [tuple(r) for r in [*q, *t, *u]]
    ids = lambda x: spark.createDataFrame([(r[0],) for r in x], "entity_id string")
    a, b, c = sound()
    truth = spark.createDataFrame(truth or [(f"S1-{i}", f"S2-{i}") for i in range(10)], "q string, t string")
    return found(checks.leakage(spark.createDataFrame(rows, MAN), ids(a), ids([*b, *c]), truth, **more))


def test_leakage_finds_each_violation(spark):
    q, t, u = sound()
    again = spark.createDataFrame([(r[0], r[3]) for r in [*q, *u]], "entity_id string, fold string")
    stress = spark.createDataFrame([(r[0], r[1], r[3], r[0]) for r in [*q, *t, *u]], "entity_id string, role string, fold string, group_id string")
    assert run(spark, q, t, u, recomputed=again, stress=stress) == {}
    last = next(i for i, r in enumerate(q) if r[3] == "dev")
    changed = [[*r] for r in q]
    changed[last][3] = "test"
    names = set(run(spark, changed, t, u, recomputed=again))
    assert {"L04", "L08", "L10"} <= names
    assert {"L01", "L08"} <= set(run(spark, [*q, q[0]], t, u)) and "L02" in run(spark, q[1:], t, u) and "L03" in run(spark, q, t[1:], u)
    moved = [[*r] for r in t]
    moved[0][3] = "val" if t[0][3] != "val" else "dev"
    assert set(run(spark, q, moved, u)) == {"L05"}
    moved = [[*r] for r in t]
    moved[1][6], moved[2][7] = "S1-9", "unmatched"
    assert {"L06", "L07"} <= set(run(spark, q, moved, u))
    free = [[*r] for r in u]
    free[0][3] = "holdout"
    assert set(run(spark, q, t, free)) == {"L09"}
    by_id = [[*r[:3], f, *r[4:8], False] for r, f in zip(q, ["dev"] * 24 + ["val"] * 3 + ["holdout"] * 3, strict=True)]
    assert "L11" in run(spark, by_id, [[*r[:3], "dev", *r[4:]] for r in t], u, drift=1.5)
    counted = [[*r] for r in q]
    counted[3][5] = 4
    assert set(run(spark, counted, t, u)) == {"L12"}
    assert "L13" in run(spark, [r for r in q if r[3] != "val"], t, u)
    sampled = [[*r] for r in t]
    sampled[0][8] = True
    assert set(run(spark, q, sampled, u)) == {"L14"}
    other = spark.createDataFrame([("S1-0", "query", "dev", "g"), ("S1-1", "query", "val", "g"), ("S2-0", "target", "val", "g")], "entity_id string, role string, fold string, group_id string")
    assert {"L15", "L16", "L17"} <= set(run(spark, q, t, u, stress=other))


def test_contract_submission_and_coverage(spark):
    ddl = "s1_entity_id string, candidate_entity_id string, country string, is_positive int, sample_weight double, channels array<string>, scores array<double>, ranks array<int>"
    good = ("S1-1", "S2-1", "US", 1, 1.0, ["a", "b"], [0.1, 0.2], [])
    assert found(checks.contract(spark.createDataFrame([good], ddl))) == {}
    bad = [good, good, ("S2-1", "X-1", "", 5, 0.0, ["a", "a"], [0.1], [1])]
    assert len(found(checks.contract(spark.createDataFrame(bad, ddl)))) == 9
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    need, valid = frame([("S1-1",), ("S1-2",)], "q string"), frame([("S2-1",), ("S3-2",)], "t string")
    cand = frame([("S1-1", "S2-1,S3-2")], "q string, ids string")
    assert found(checks.submission(frame([("S1-1", "S2-1"), ("S1-2", "")], "q string, ids string"), need, valid, cand)) == {}
    wrong = frame([("S1-1", "S2-1,S2-1"), ("S1-1", "S1-5"), ("S1-9", "Q-1,S2-99")], "q string, ids string")
    assert len(found(checks.submission(wrong, need, valid, cand))) == 8
    a = frame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    assert found(checks.coverage(a, a, "k", ["v"])) == {} and found(checks.same_rows(a, a.orderBy("v"))) == {}
    b = frame([(1, "x"), (1, "z"), (3, "w"), (4, None)], "k int, v string")
    assert set(found(checks.coverage(b, a, "k", ["v"]))) == {"missing", "added", "changed", "repeated_key", "rows_differ"}
    assert set(found(checks.same_rows(a, b))) == {"only_first", "only_second"}
    assert found(checks.nulls(frame([(None, [1, None]), (2, None)], "a int, b array<int>"))) == {"a": 1, "b": 1, "b[]": 1}
    d = [checks.content_digest(x, ["k", "v"]).first() for x in (a, a.orderBy(checks.F.desc("k")).repartition(3), b)]
    assert d[0] == d[1] != d[2]
    m = frame([(0.995, 0.96, 0.001)], "recall double, oracle_f05 double, zero_rate double")
    assert [r["passed"] for r in checks.gates(m).collect()] == [True, False, True]
    n = frame([("S1-1", "query", "val"), ("S2-1", "target", "val"), ("S2-2", "target", "dev")], "entity_id string, role string, fold string")
    assert found(checks.candidate_leakage(frame([("S1-1", "S2-1")], "q string, t string"), n, "val")) == {}
    assert len(found(checks.candidate_leakage(frame([("S1-1", "S2-2"), ("S1-1", "S2-2"), ("S1-7", "S2-1")], "q string, t string"), n, "val"))) == 3


def test_allowed_features():
    assert checks.allowed_features(["a", "b", "label"], ["b", "a"]) == ["b", "a"]
    for bad in (["label"], ["c"], ["x_entity_id"]):
        with pytest.raises(ValueError):
            checks.allowed_features(["a", "label", "x_entity_id"], bad)
