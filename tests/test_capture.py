import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pinmark.functions import subjects as S
from pinmark.operators import capture as C
from tests.plans import executed


def number(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "k bigint, v double")


def captured(df, fn, args=("v",), **options):
    return {r.seq: r for r in C.capture(df, fn, list(args), module="m", function="f", seq="k", **options).collect()}


def test_one_record_per_call_whatever_happens(spark):
    class Custom(KeyError):
        pass

    def fn(v):
        if v == 0:
            raise Custom("no")
        if v == 1:
            raise SystemExit(3)
        if v == 2:
            return {(1, 2): 3}
        if v == 3:
            return "\ud800"
        if v == 4:
            return (1, [2.5, None])
        if v == 5:
            return {1, }
        if v == 6:
            raise ValueError("\ud800 bad")
        if v == 7:
            loop = []
            loop.append(loop)
            return loop
        return None

    rows = captured(number(spark, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]), fn)
    assert rows[0].error_class == "Custom" and rows[0].error_mro[:3] == ["Custom", "KeyError", "LookupError"]
    assert rows[0].traceback.startswith("Traceback") and "in fn" in rows[0].traceback
    assert (rows[1].status, rows[1].error) == ("crashed", "SystemExit: 3")
    assert (rows[2].status, rows[2].out_type) == ("success", "other")
    assert rows[3].out_type == "string" and json.loads(rows[3].out_json) == "\ud800"
    assert (rows[4].out_type, rows[4].out_json, rows[4].out_len) == ("list", "[1, [2.5, null]]", 16)
    assert (rows[5].out_type, rows[5].out_json) == ("other", '"{1}"')
    assert rows[6].error_class == "ValueError" and rows[6].error.endswith("bad")
    assert rows[7].out_type == "other"
    assert (rows[8].out_type, rows[8].out_json, rows[8].out_key) == ("null", "null", "null")


def test_nan_and_null_arguments_reach_python_apart(spark):
    rows = captured(number(spark, [float("nan"), None]), lambda v: "none" if v is None else str(v))
    assert rows[0].out_json == '"nan"' and rows[1].out_json == '"none"'
    assert rows[0].arg_json == ["NaN"] and rows[1].arg_json == ["null"]


def test_arguments_are_recorded_before_the_call(spark):
    df = spark.createDataFrame([(0, ["a"])], "k bigint, v array<string>")
    rows = captured(df, lambda v: v.append("b") or len(v))
    assert rows[0].arg_json == ['["a"]'] and rows[0].arg_elem_keys == [['"a"']]
    assert rows[0].out_json == "2"


def test_digest(spark):
    def fn(v):
        return {0: "x" * 498, 1: "x" * 499, 2: list(range(300)), 3: {"k": "é" * 100}, 4: [1]}[int(v)]

    rows = captured(number(spark, [0.0, 1.0, 2.0, 3.0, 4.0]), fn)
    assert rows[0].out_digest is None and rows[0].out_len == 500
    assert rows[1].out_digest == "x" * 200 + "... [truncated]" and rows[1].out_json is None and rows[1].out_len == 501
    assert rows[2].out_digest == "[list of 300 items]"
    assert rows[3].out_digest == str({"k": "é" * 100})[:200] + "... [truncated]" and rows[3].out_len == 609
    assert rows[4].out_digest is None


def test_native_digest_agrees_with_python(spark):
    texts = ["x" * 498, "x" * 499, "é" * 83, "é" * 84, "😀" * 41 + "abcdef", "😀" * 42, '"' * 249, '"' * 250, None, "\x00" * 84]
    df = spark.createDataFrame([(i, t, [t, None]) for i, t in enumerate(texts)], "k bigint, v string, l array<string>")
    for column in ("v", "l"):
        native = C.capture_native(df, C.Outcome(F.col(column)), [F.col(column)], module="m", function="f", seq=F.col("k"))
        python = C.capture(df, lambda x: x, [column], module="m", function="f", seq="k")
        shown = ["seq", "status", "out_type", "out_key", "out_len", "out_digest", "arg_keys", "arg_elem_keys"]
        assert sorted(native.select(*shown).collect()) == sorted(python.select(*shown).collect())


def test_functions_without_arguments(spark):
    df = spark.range(3)
    rows = C.capture(df, lambda: 7, [], module="m", function="seven").collect()
    assert len(rows) == 3 and {r.out_json for r in rows} == {"7"} and rows[0].arg_json == []


def test_several_functions_in_one_pass(spark):
    df = spark.createDataFrame([(i, "abca") for i in range(4)], "k bigint, w string")
    rows = C.capture_many(
        df, {"n": (S.unique_letters_py, ["w"]), "crash": (lambda w, k: w[int(k)], ["w", "k"])}, module="m", seq="k"
    )
    assert Counter((r.function, r.out_json) for r in rows.collect()) == {
        ("n", "3"): 4, ("crash", '"a"'): 2, ("crash", '"b"'): 1, ("crash", '"c"'): 1,
    }
    assert executed(rows).count("MapInArrow") == 1


def test_guards_are_tried_in_order_and_protect_the_value(spark):
    df = number(spark, [0.0, -1.0, 2.0, None])
    v = F.col("v")
    outcome = C.Outcome(
        F.lit(10.0) / v,
        (C.Guard(v < 0, ValueError, "negative"), C.Guard(v == 0, ZeroDivisionError, F.concat(F.lit("by "), v.cast("string")))),
    )
    rows = {r.seq: r for r in C.capture_native(df, outcome, [v], module="m", function="f", seq=F.col("k")).collect()}
    assert rows[0].error == "ZeroDivisionError: by 0.0" and rows[0].error_mro[1] == "ArithmeticError"
    assert (rows[1].error_class, rows[1].out_type, rows[1].out_json) == ("ValueError", None, None)
    assert rows[2].out_double == 5.0 and rows[2].error_mro is None
    assert (rows[3].status, rows[3].out_type) == ("success", "null")


def test_native_plan_is_narrow_pruned_and_free_of_python(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id * 1.5D AS v", "'x' AS unused").write.parquet(path)
    df = spark.read.parquet(path)
    plan = executed(
        C.capture_native(df, S.process_transaction(F.col("v")), [F.col("v")], module="m", function="f", seq=F.col("id"))
    )
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert "ReadSchema: struct<id:bigint,v:double>" in plan
    plan = executed(C.capture(df, S.process_transaction_py, ["v"], module="m", seq="id"))
    assert "Exchange" not in plan and "ReadSchema: struct<id:bigint,v:double>" in plan


def test_summary_and_profile(spark):
    rows = [("a", "f", "success", None), ("a", "f", "crashed", "KeyError"), ("a", None, None, "Exception"), ("b", "g", "success", None)]
    df = spark.createDataFrame(rows, "module string, function string, status string, error_class string")
    assert {tuple(r) for r in C.capture_summary(df).collect()} == {("a", 3, 1, 2, "f"), ("b", 1, 1, 0, "g")}
    assert {tuple(r) for r in C.error_profile(df).collect()} == {
        ("a", "f", "KeyError", 1), ("a", "unknown", "Exception", 1),
    }


def test_behaviour_diff_counts_duplicates(spark):
    before = C.capture_native(number(spark, [1.0, 1.0, 2.0]), C.Outcome(F.col("v")), [F.col("v")], module="m", function="f")
    after = C.capture_native(number(spark, [1.0, 2.0, 2.0, 3.0]), C.Outcome(F.col("v")), [F.col("v")], module="m", function="f")
    diff = {(r.behaviour, r.change, r.n) for r in C.behaviour_diff(before, after).collect()}
    assert diff == {("1", "removed", 1), ("2", "added", 1), ("3", "added", 1)}
    assert executed(C.behaviour_diff(before, after)).count("Exchange hashpartitioning") == 1


def test_replay_passes_stored_types(spark):
    from pinmark.operators import expect as X

    df = spark.createDataFrame([(0, 2, 2.0, "2", True, [1, 2])], "k bigint, i int, d double, s string, b boolean, l array<int>")
    fn = lambda *a: [type(x).__name__ for x in a]
    native = C.capture_native(
        df, C.Outcome(F.lit("x")), [F.col(c) for c in "idsbl"], module="m", function="f", seq=F.col("k")
    )
    again = C.replay(X.derive_expectations(native, index=False), {"f": fn}).first()
    assert json.loads(again.act_out_json) == ["int", "float", "str", "bool", "list"]


def test_keyboard_interrupt_is_not_swallowed():
    def fn():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        C._call(fn, [], 500)
