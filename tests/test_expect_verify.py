import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pinmark.functions import encode
from pinmark.operators import capture as C
from pinmark.operators import expect as X
from pinmark.operators import ordering as O
from pinmark.operators import rollup as R
from pinmark.operators import verify as V
from pinmark.plans.regression import compare_native
from pinmark.schema import CAPTURES
from tests.plans import executed

NAN, INF = float("nan"), float("inf")


def capture_row(seq, args, output=None, error=None, function="f", module="m", mro=None):
    head = (module, function, seq, *encode.arguments(args))
    if error is not None:
        name = error.split(":")[0]
        return (*head, "crashed", *[None] * 7, error, name, mro or encode.class_names(name), None)
    return (*head, "success", *encode.output(output), None, None, None, None)


def table(spark, rows):
    return spark.createDataFrame(rows, CAPTURES)


def test_error_texts(spark):
    texts = ["ValueError: a: b", "KeyError", "A:b", " Odd : x", "", None, "Failed to import m: E: x", ": x"]
    df = spark.createDataFrame([(t,) for t in texts], "e string")
    rows = df.select(X.error_class(F.col("e")).alias("c"), X.error_message(F.col("e")).alias("m")).collect()
    assert [r.c for r in rows] == ["ValueError", "KeyError", "A:b", "Odd", "Exception", "Exception", "Failed to import m", ""]
    assert [r.m for r in rows] == ["a: b", "", "", "x", "", "", "E: x", "x"]


def test_is_digest(spark):
    texts = ["[list of 3 items]", "x... [truncated]", "y" * 500, "y" * 501, "[list", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.d for r in df.select(X.is_digest(F.col("t")).alias("d")).collect()] == [True, True, False, True, False, False]


CASES = [
    (["x", ["a", "b"]], "b", "member"),
    ([["a"], ["b"]], "c", "equal"),
    (["abc"], "b", "member"),
    (["abc"], "bc", "equal"),
    (["abc"], "", "equal"),
    (['a"b'], '"', "member"),
    (["a\\b"], "\\", "member"),
    (['a"b'], "\\", "equal"),
    (["😀x"], "😀", "member"),
    ([[1, 2]], True, "member"),
    ([[1, 2]], 2.0, "member"),
    ([[NAN]], NAN, "approx_nan"),
    ([[None]], None, "member"),
    ([[[1]]], [1], "member"),
    ([1], 1, "equal"),
    ([[1.5]], 1.5, "member"),
    ([], 1.5, "approx"),
    ([], INF, "approx"),
    ([], True, "is_bool"),
    ([], None, "equal"),
    ([], "[list of 9 items]", "not_null"),
    ([["[list of 9 items]"]], "[list of 9 items]", "not_null"),
    ([], ["x [truncated]"], "not_null"),
    ([], "z" * 600, "not_null"),
    ([], {"a": 1}, "equal"),
]


def test_rules(spark):
    df = table(spark, [capture_row(i, a, o) for i, (a, o, _) in enumerate(CASES)])
    found = {r.seq: r for r in X.derive_expectations(df).collect()}
    assert [(i, found[i].assertion) for i in range(len(CASES))] == [(i, c[2]) for i, c in enumerate(CASES)]
    assert found[0].source_keys == ['"a"', '"b"'] and found[0].source_text is None
    assert found[2].source_text == "abc" and found[2].source_keys is None


def test_first_argument_that_holds_the_output_is_the_source(spark):
    df = table(spark, [capture_row(0, ["xyz", "abc", ["b"], "b"], "b")])
    assert X.derive_expectations(df).first().source_text == "abc"


def test_missing_function_and_status(spark):
    rows = [("m", None, 5, [], [], [], [], *[None] * 8, "Function zz not found.", None, None, None)]
    case = X.derive_expectations(table(spark, rows)).first()
    assert (case.function, case.case_kind, case.assertion, case.error_class) == (
        "unknown", "crash", "raises", "Function zz not found.",
    )


def test_strict_spares_calls_that_never_vary(spark):
    rows = [capture_row(i, [["a", "b"]], o) for i, o in enumerate("abab")]
    rows += [capture_row(i, [["c"]], "c") for i in range(4, 8)]
    found = Counter(r.assertion for r in X.derive_expectations(table(spark, rows), strict=True).collect())
    assert found == {"member": 4, "equal": 4}


PAIRS = [
    (5, 5.0, True), (5, True, False), (1, True, True), ([1.0], [1], True), ([0.1], [0.1 + 1e-12], False), ([NAN], [NAN], False),
    ({"a": 1, "b": [2]}, {"b": [2.0], "a": True}, True), (None, None, True), ("1", 1, False),
    (True, True, True), (True, 1, False), (False, 0, False),
    (1.0, 1.0 + 9e-7, True), (1.0, 1.0 + 2e-6, False), (0.0, 1e-13, True), (0.0, 1e-11, False), (1.0, True, True), (2.0, 2, True),
    (INF, INF, True), (INF, 1e308, False), (INF, -INF, False), (1.0, NAN, False), (1.0, INF, False), (1.0, "1.0", False),
    (1.0, None, False), (NAN, NAN, True), (NAN, 1.0, False), (1e-300, 2e-300, True), ("z" * 600, "q", True), ("z" * 600, None, False),
]


def test_comparisons(spark):
    before = table(spark, [capture_row(i, [], e) for i, (e, _, _) in enumerate(PAIRS)])
    after = table(spark, [capture_row(i, [], a) for i, (_, a, _) in enumerate(PAIRS)])
    results = {r.seq: r.passed for r in V.verify(X.derive_expectations(before), after).collect()}
    assert [(PAIRS[i], results[i]) for i in results] == [(PAIRS[i], PAIRS[i][2]) for i in results]
    assert len(results) == len(PAIRS)


def test_approx_like_pytest(spark):
    rng = random.Random(1)
    pairs = [(e, e * (1 + rng.choice([-1, 1]) * 10 ** rng.uniform(-9, -3))) for e in (rng.uniform(-1e6, 1e6) for _ in range(500))]
    df = spark.createDataFrame(pairs, "e double, a double")
    for r in df.select("e", "a", V.assert_approx(F.col("e"), F.col("a")).alias("ok")).collect():
        assert r.ok == (r.a == pytest.approx(r.e))


def test_members(spark):
    before = table(spark, [capture_row(0, [["a", "b"]], "a"), capture_row(1, ["abc"], "a"), capture_row(2, ["abc"], "a"), capture_row(3, ["abc"], "a"), capture_row(4, [[1, 2]], 1)])
    after = table(spark, [capture_row(0, [["a", "b"]], "c"), capture_row(1, ["abc"], "bc"), capture_row(2, ["abc"], ""), capture_row(3, ["abc"], 1), capture_row(4, [[1, 2]], 2.0)])
    results = {r.seq: r.passed for r in V.verify(X.derive_expectations(before), after).collect()}
    assert results == {0: False, 1: True, 2: True, 3: False, 4: True}


def test_crashes_and_reasons(spark):
    before = table(spark, [
        capture_row(0, [], error="LookupError: x"), capture_row(1, [], error="ValueError: x"), capture_row(2, [], error="ValueError: x"),
        capture_row(3, [], 1), capture_row(4, [], 1),
    ])
    after = table(spark, [
        capture_row(0, [], error="KeyError: 'k'"), capture_row(1, [], error="TypeError: t"), capture_row(2, [], 3),
        capture_row(3, [], error="ValueError: x"),
    ])
    results = {r.seq: (r.passed, r.reason) for r in V.verify(X.derive_expectations(before), after).collect()}
    assert results == {
        0: (True, "ok"), 1: (False, "other_error"), 2: (False, "did_not_raise"), 3: (False, "unexpected_crash"), 4: (False, "missing"),
    }


def test_unmatched_and_duplicates(spark):
    a = table(spark, [capture_row(0, [], 1), capture_row(1, [], 1), capture_row(1, [], 2)])
    e = X.derive_expectations(table(spark, [capture_row(0, [], 1)]))
    assert [r.seq for r in V.unmatched_actuals(a, e).collect()] == [1, 1]
    assert [(r.seq, r.n_rows) for r in V.duplicate_cases(a).collect()] == [(1, 2)]


def test_rollups(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "module string, passed boolean")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "module string")
    suites = R.suite_rollup(df, asked)
    assert {tuple(r) for r in suites.collect()} == {("a", 1, 1, "FAILED"), ("b", 1, 0, "PASSED"), ("c", None, None, "ERROR")}
    assert tuple(R.total_rollup(suites).first()) == (3, 2, 1, False)
    assert tuple(R.total_rollup(R.suite_rollup(df.where("module = 'b'"))).first()) == (1, 1, 0, True)
    assert tuple(R.total_rollup(R.suite_rollup(df.where("false"))).first()) == (0, 0, 0, False)


def test_review(spark):
    suites = spark.createDataFrame([("a", "PASSED"), ("b", "PASSED")], "module string, status string")
    none = spark.createDataFrame([], "issue_type string")
    some = spark.createDataFrame([("Missing Coverage",), ("Missing Coverage",)], "issue_type string")
    assert tuple(R.review(suites, none).first()) == (True, 0, 0, 0, 0, None)
    assert tuple(R.review(suites, some).first())[:3] == (False, 0, 2)
    failed = suites.withColumn("status", F.lit("ERROR"))
    assert R.review(failed, none).first().is_approved is False


def test_override_and_profile(spark):
    rows = [capture_row(i, [i - 1, ""][: 1 + i % 2], i * 1.5) for i in range(6)] + [capture_row(9, [3], error="ValueError: x")]
    captures = table(spark, rows)
    auto = X.derive_expectations(captures)
    manual = auto.where("case_name = 'test_f_success_2'").withColumn("assertion", F.lit("not_null"))
    merged = X.override_cases(auto, manual)
    assert merged.count() == 7 and merged.where("assertion = 'not_null'").count() == 1
    profile = R.function_profile(captures, k=2).first()
    assert (profile.successes, profile.crashes, len(profile.crash_examples)) == (6, 1, 1)
    assert [e.seq for e in profile.edge_cases] == [0, 1]
    assert [e.seq for e in profile.successful_mappings] == [2, 4]


def test_dense_index_over_wild_orders(spark):
    rng = random.Random(5)
    orders = set(range(50)) | {rng.randrange(2**62) for _ in range(200)} | {2**21 - 1, 2**21, 2**42 - 1, 2**42, 2**63 - 1, -1, -(2**63), -(2**40)}
    rows = [(g, o) for g in ("a", "b") for o in orders if g == "a" or o % 3]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o bigint")
    indexed = O.dense_index(df, ["g"], "o", "i")
    found = defaultdict(list)
    for r in indexed.collect():
        found[r.g].append((r.o, r.i))
    for g, pairs in found.items():
        expected = sorted(o for h, o in rows if h == g)
        assert sorted(pairs) == [(o, i) for i, o in enumerate(expected)]
    assert indexed.columns == ["g", "o", "i"]


def test_dense_index_never_sorts_a_whole_group(spark):
    df = spark.createDataFrame([("a", 1)], "g string, o bigint")
    plan = executed(O.dense_index(df, ["g"], "o", "i"))
    for line in plan.splitlines():
        if "row_number()" in line and "Window" in line:
            assert "block" in line.split("[g#")[1]


def test_top_k_prunes_before_the_exchange(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id")
    top = O.top_k(df, ["g"], ["id"], 2)
    assert sorted(map(tuple, top.collect())) == [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5)]
    assert "WindowGroupLimit" in executed(top)


def test_comparing_in_place_needs_no_exchange(spark):
    df = spark.range(200).selectExpr("id", "id * 1.0D AS v", "CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS half")
    v = F.col("v")
    guard = C.Guard(v == 0, ZeroDivisionError, "division by zero")
    results = compare_native(
        df, C.Outcome(v * 2, (guard,)), C.Outcome(F.when(v > 150, v * 3).otherwise(v * 2), (guard,)), [v],
        module=F.col("half"), function="double", seq=F.col("id"),
    )
    assert "Exchange" not in executed(results)
    assert Counter((r.module, r.reason) for r in results.collect()) == {
        ("even", "ok"): 76, ("odd", "ok"): 75, ("even", "mismatch"): 24, ("odd", "mismatch"): 25,
    }
