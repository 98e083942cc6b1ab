"""Functions named by rows, repeated calls, whole values, stored suites and positions."""

import json
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pinmark.functions import encode, keys
from pinmark.operators import capture as C
from pinmark.operators import expect as X
from pinmark.operators import observe as B
from pinmark.operators import ordering as O
from pinmark.operators import probes as P
from pinmark.operators import rollup as R
from pinmark.operators import verify as V
from pinmark.plans import catalog, observed
from pinmark.plans.regression import compare_native, replay_python, replay_store, verify_store
from pinmark.plans.registry import Tables
from pinmark.plans.texts import capture_lines
from pinmark.schema import CAPTURES
from pinmark.sources import logs, store
from pinmark.streaming import capture_stream as S
from tests.plans import executed
from tests.test_expect_verify import capture_row, table

NAN = float("nan")
verified = S.verify_stream
PROBES = "module string, function string, case_seq int, arg_json array<string>"


def add(a, b):
    return a + b


def test_probes_call_what_their_row_names(spark):
    probes = spark.createDataFrame(
        [
            ("m", "add", 0, ["1", "2"]),
            ("n", "add", 0, ["1", "2"]),
            ("m", "add", 1, ['"a"', "null"]),
            ("m", "add", 2, ["[1, ", "2"]),
            ("m", "add", 3, None),
            ("m", "gone", 0, ["1"]),
            ("m", "gone", 1, ["2"]),
            ("n", "gone", 5, ["2"]),
            (None, "add", 7, ["1", "1"]),
            ("m", None, 0, []),
        ],
        PROBES,
    )
    found = B.capture_probes(probes, {"add": add, ("n", "add"): lambda a, b: a - b})
    rows = {(r.module, r.function, r.seq): r for r in found.collect()}
    assert found.count() == len(rows) == 8
    assert rows["m", "add", 0].out_json == "3" and rows["n", "add", 0].out_json == "-1" and rows[None, "add", 7].out_json == "2"
    assert rows["m", "add", 1].error_class == "TypeError" and rows["m", "add", 1].arg_json == ['"a"', "null"]
    assert rows["m", "add", 2].error_class == "JSONDecodeError" and rows["m", "add", 2].arg_json == ["[1, ", "2"]
    assert rows["m", "gone", 0].error == "Function gone not found." == rows["n", "gone", 5].error
    assert rows["m", "gone", 0].status == "crashed" and rows["m", None, 0].error == "Function unknown not found."
    assert found.schema == CAPTURES


def test_no_probe_and_no_function(spark):
    none = spark.createDataFrame([], PROBES)
    assert B.capture_probes(none, {"add": add}).count() == 0
    assert B.capture_probes(none, {}).count() == 0


SOURCES = {
    "fine": "import sys\nseen = []\nprint('hello')\ndef one(x):\n    print(x)\n    seen.append(x)\n    return len(seen)\ndef none():\n    sys.exit(3)\ndef ask():\n    return input()\n",
    "broken": "def f(:",
    "stops": "def f():\n    return 1\nraise RuntimeError('no')\n",
    "leaves": "import sys\ndef f():\n    return 1\nsys.exit(2)\n",
    "empty": "",
    "slow": "def f():\n    while True:\n        pass\n",
    "odd": "class Odd(Exception):\n    def __str__(self):\n        raise ValueError\ndef f(a, *, b=2):\n    raise Odd\n",
}


def test_sources_are_run_and_called(spark):
    table = spark.createDataFrame([*SOURCES.items(), ("null", None)], "module string, source string")
    begun = time.time()
    rows = B.capture_sources(table, seconds=0.5).collect()
    assert time.time() - begun < 30
    by = {}
    for r in sorted(rows, key=lambda r: (r.module, r.seq)):
        by.setdefault(r.module, []).append((r.function, r.arg_json, r.out_json, r.error))
    assert by == {
        "fine": [("one", ["0"], "1", None), ("one", ["1"], "2", None), ("one", ["-1"], "3", None), ("none", [], None, "SystemExit: 3")],
        "stops": [(None, [], None, "Failed to import stops: RuntimeError: no")],
        "leaves": [(None, [], None, "Failed to import leaves: SystemExit: 2")],
        "slow": [("f", [], None, "TimeoutError: no result within 0.5 seconds")],
        "odd": [("f", [a], None, "Odd: <unprintable Odd>") for a in ("0", "1", "-1")],
    }


def test_sources_with_named_calls(spark):
    calls = [("gone", ["1"]), ("one", ["2"]), ("gone", ["3"]), ("one", ["2", "3"]), ("ask", [])]
    table = spark.createDataFrame(
        [("fine", SOURCES["fine"], calls), ("broken", SOURCES["broken"], calls[:1]), ("empty", "", None), ("empty", "", [])],
        "module string, source string, wanted array<struct<function string, arg_json array<string>>>",
    )
    rows = sorted(B.capture_sources(table, calls="wanted").collect(), key=lambda r: (r.module, r.seq))
    assert [(r.module, r.function, r.error_class) for r in rows] == [
        ("broken", None, "Failed to import broken"),
        ("fine", "gone", "Function gone not found."),
        ("fine", "one", None),
        ("fine", "one", "TypeError"),
        ("fine", "ask", rows[-1].error_class),
    ]
    assert rows[-1].status == "crashed"


def test_calling_sources_exchanges_nothing(spark):
    table = spark.createDataFrame(list(SOURCES.items()), "module string, source string")
    assert "Exchange" not in executed(B.capture_sources(table))


LONG = [float(i) for i in range(300)]
VALUES = [NAN, [NAN], [1.0, NAN], {"a": NAN}, 1.0, 1, True, "x", None, [1], "y" * 600, LONG, [*LONG, NAN], [*LONG[:-1], NAN, 7.0], [*LONG[:-1], NAN, 8.0]]


def test_whole_values_are_told_apart_and_nan_is_like_nan(spark):
    rows = [capture_row(i, [i], v) for i, v in enumerate(VALUES)]
    hashes = [encode.output(v) for v in VALUES]
    named = [h[-1] or h[2] for h in hashes]
    assert all(named) and len(set(named)) == len(VALUES) - 2  # 1, 1.0 and True are equal
    assert [h[-1] is not None for h in hashes] == [True] * 4 + [False] * 6 + [True] * 5
    before = table(spark, rows)
    assert C.behaviour_diff(before, table(spark, rows)).count() == 0
    cases = X.derive_expectations(before, index=False)
    assert V.verify(cases, before, exact=True).where("not passed").count() == 0
    changed = table(spark, [capture_row(i, [i], VALUES[(i + 1) % len(VALUES)]) for i in range(len(VALUES))])
    failed = V.verify(cases, changed, exact=True).where("not passed")
    # 1.0 and 1 are equal to what follows.
    assert {r.seq for r in failed.collect()} == set(range(len(VALUES))) - {4, 5}
    assert C.behaviour_diff(before, changed).where("change = 'added'").count() == len(VALUES) - 2


@pytest.mark.parametrize("kind", ["double", "array<double>", "map<string,array<double>>", "struct<a:double,b:string>", "string", "int"])
def test_native_hash_equals_python_hash(spark, kind):
    lists = {
        "double": [1.5, NAN, None],
        "array<double>": [[1.0, NAN], LONG, [*LONG, NAN], [], None],
        "map<string,array<double>>": [{"b": [NAN], "a": [1.0]}, {"k": LONG}, {}, None],
        "struct<a:double,b:string>": [{"a": NAN, "b": "z"}, {"a": 1.0, "b": "z" * 600}, None],
        "string": ["a", "é\"" * 400, None],
        "int": [1, None],
    }[kind]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], f"i int, v {kind}")
    native = C.capture_native(rows, C.Outcome(F.col("v")), [F.col("i")], module="m", function="f", seq=F.col("i"))
    python = C.capture(rows.select("i", "v"), lambda i, v: v, ["i", "v"], module="m", function="f", seq="i")
    by = lambda df: {r.seq: (r.out_hash, r.out_key) for r in df.collect()}
    assert by(native) == by(python)


def test_a_call_that_is_always_nan_does_not_vary(spark):
    rows = [capture_row(i, [7], [NAN]) for i in range(3)] + [capture_row(9 + i, [8], [NAN, i]) for i in range(2)]
    rows += [capture_row(20, [9], 1), capture_row(21, [9], error="ValueError: x"), capture_row(30, [5], [*LONG, 1.0]), capture_row(31, [5], [*LONG, 2.0])]
    assert sorted(r.arg_keys[0] for r in X.varying_calls(table(spark, rows)).collect()) == ["5", "8"]


def test_exact_comparison_of_long_lists(spark):
    rows = spark.createDataFrame([(i, [*LONG, NAN if i % 2 else 1.0]) for i in range(6)], "i bigint, v array<double>")
    other = F.when(F.col("i") < 2, F.concat("v", F.array(F.lit(1.0)))).otherwise(F.col("v"))
    found = compare_native(rows, C.Outcome(F.col("v")), C.Outcome(other), [F.col("i")], module="m", function="f", seq=F.col("i"), exact=True)
    assert {r.seq: r.reason for r in found.collect()} == {i: "mismatch" if i < 2 else "ok" for i in range(6)}


def test_exact_comparison_keeps_truth_values_apart(spark):
    rows = spark.range(2).withColumn("b", F.col("id") == 1)
    found = compare_native(rows, C.Outcome(F.col("b")), C.Outcome(F.col("b").cast("int")), [F.col("id")], module="m", function="f", seq=F.col("id"), exact=True)
    assert {r.reason for r in found.collect()} == {"mismatch"}


def test_repeated_calls_give_one_result_for_each_case(spark):
    def rows(*groups):
        return [capture_row(seq, [seq], v) if not isinstance(v, str) else capture_row(seq, [seq], error=v) for seq, values in groups for v in values]

    cases = X.derive_expectations(table(spark, rows((1, [5]), (2, [5, 6]), (3, [5, 6]), (4, [5, 5]), (5, [5]), (6, ["ValueError: x"]), (7, [1, "ValueError: x"]), (8, [5]))), index=False)
    fresh = table(
        spark,
        rows((1, [5, 5, 5]), (2, [6, 5]), (3, [5, 5, 6]), (4, [5]), (5, [5, 6]), (6, ["ValueError: x", "ValueError: y"]), (7, ["ValueError: z", 1]), (9, [1])),
    )
    found = V.verify_repeated(cases, fresh)
    assert found.count() == cases.count()
    told = Counter((r.seq, r.reason) for r in found.collect())
    assert told == Counter({(1, "ok"): 1, (2, "ok"): 2, (3, "ambiguous"): 2, (4, "ok"): 2, (5, "ambiguous"): 1, (6, "ok"): 1, (7, "ok"): 2, (8, "missing"): 1})


def test_numbered_rows(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("v"), F.lit("x").alias("n"))
    found = O.numbered(rows, "n", ["v"]).collect()
    assert sorted((r.n, r.v) for r in found) == [(i, i) for i in range(1000)]
    plain = O.numbered(rows, "at")
    assert sorted((r["at"], r.v) for r in plain.collect()) == [(i, i * 37 % 1000) for i in range(1000)]
    assert plain.collect() == plain.collect() and O.numbered(rows.where("false"), "at").count() == 0
    assert "SinglePartition" not in executed(O.numbered(rows, "at")).split("Window")[0]


def test_captures_without_position_become_cases(spark):
    rows = table(spark, [capture_row(None, [i], i if i % 3 else [i], function="fg"[i % 2]) for i in range(20)])
    assert {r.reason for r in V.verify(X.derive_expectations(rows, index=False), rows).collect()} == {"missing"}
    placed = X.with_seq(rows)
    cases = X.derive_expectations(placed).collect()
    assert len({(c.function, c.case_name) for c in cases}) == 20 and {c.seq for c in cases} == set(range(20))


@pytest.mark.parametrize("k", [3, 1500])
def test_top_k_for_any_k(spark, k):
    rows = spark.range(4000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 4000).alias("v"))
    found = Counter((r.g, r.v) for r in O.top_k(rows, ["g"], ["v"], k).collect())
    assert found == Counter((v % 2, v) for v in range(2 * k))


def test_stored_suites_are_verified_without_being_exchanged(spark, tmp_path):
    def captured(changed):
        rows = [capture_row(i, [i], i + (changed and m == "b" and i == 3), module=m) for m in "ab" for i in range(40)]
        return table(spark, rows)

    cases = X.derive_expectations(captured(False), index=False)
    store.write_bucketed(cases, "stored_suites", 4, path=str(tmp_path / "suites"))
    store.write_modules(captured(True), str(tmp_path / "fresh"), ["a", "b"])
    fresh = store.scan_captures(spark, str(tmp_path / "fresh"))
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "module string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = verify_store(spark, "stored_suites", fresh, asked)
        plan = executed(found)
        stored_side = plan[plan.index("SortMergeJoin") :]
        assert stored_side[: stored_side.index("stored_suites")].count("Exchange") == 0
        assert plan.count("Exchange hashpartitioning") == 2  # the fresh side, and counts by module
        assert {r.module: (r.passed, r.failed, r.status) for r in found.collect()} == {"a": (40, 0, "PASSED"), "b": (39, 1, "FAILED"), "c": (None, None, "ERROR")}
        only = verify_store(spark, "stored_suites", fresh, asked.where("module = 'a'"))
        assert [tuple(r) for r in only.collect()] == [("a", 40, 0, "PASSED")]
        functions = {("a", "f"): lambda x: x, ("b", "f"): lambda x: x + (x == 5)}
        again = replay_store(spark, "stored_suites", functions, asked)
        assert executed(again).count("Exchange") == 1
        assert {r.module: r.failed for r in again.collect()} == {"a": 0, "b": 1, "c": None}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE stored_suites")


def test_asked_suites_that_ran_empty_or_not_at_all(spark):
    results = spark.createDataFrame([("a", True), ("a", None), ("b", False), (None, True)], "module string, passed boolean")
    asked = spark.createDataFrame([("a",), ("c",), (None,)], "module string")
    found = {r.module: (r.passed, r.failed, r.status) for r in R.suite_rollup(results, asked).collect()}
    assert found == {"a": (1, 0, "PASSED"), "c": (None, None, "ERROR"), None: (1, 0, "PASSED")}


def test_records_of_observation_are_json(spark):
    table = spark.createDataFrame([("fine", SOURCES["fine"])], "module string, source string")
    for r in B.capture_sources(table).collect():
        assert [json.loads(a) for a in r.arg_json] == [json.loads(k) for k in r.arg_keys]


def test_typed_arguments_are_given_back(spark):
    kinds = "i bigint, n decimal(10,3), d date, t timestamp, l timestamp_ntz, b binary, s string"
    rows = [
        (0, Decimal("1.500"), date(2024, 2, 29), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 678), b"\x00\xff", "1.5"),
        (1, Decimal("-100"), None, None, None, b"", None),
        (2, None, date(1, 1, 1), datetime(1999, 12, 31, 23, 59, 59, 1), datetime(2024, 1, 1), None, "x"),
    ]
    seen = lambda *args: repr([(type(a).__name__, str(a)) for a in args])
    args = ["n", "d", "t", "l", "b", "s"]
    captured = C.capture(spark.createDataFrame(rows, kinds), seen, args, module="m", function="f", seq="i")
    told = {r.seq: r for r in captured.collect()}
    assert told[0].arg_types == ["decimal", "date", "timestamp", "timestamp", "binary", None] and told[1].arg_types[1] is None
    cases = X.derive_expectations(captured, index=False)
    pinned = cases.where("seq <> 0")
    assert {r.reason for r in replay_python(pinned, {"f": seen}).collect()} == {"ok"}
    old = cases.withColumn("arg_types", F.lit(None).cast("array<string>"))
    assert replay_python(old, {"f": lambda *a: 1}).count() == 3


def test_decimals_are_equal_whatever_their_scale(spark):
    wide = spark.createDataFrame([(0, Decimal("1.5000")), (1, Decimal("100.0000")), (2, Decimal("0.0000")), (3, Decimal("-7.0100"))], "i bigint, n decimal(12,4)")
    values = [Decimal("1.50"), Decimal("100"), Decimal("0.00"), Decimal("-7.01")]
    native = C.capture_native(wide, C.Outcome(F.col("n")), [F.col("n")], module="m", function="f", seq=F.col("i"))
    for r in native.collect():
        assert r.out_key == r.arg_keys[0] == encode.identity_key(values[r.seq]), r
        assert r.arg_types == ["decimal"]


DEEP = ["[[[[[[1.0]]]]]]", '[{"a": [2.0, {"b": -1.50}]}]', '[["x", {"k": NaN}], [1, 2], 3]', "[[[1, [2.0]], null], null]"]


def test_inputs_of_any_depth_keep_their_values(spark):
    rows = spark.createDataFrame([(i, r, n) for i, r in enumerate(DEEP) for n in (1, 2)] + [(9, None, 1)], "i int, raw string, n int")
    found = {(r.i, r.n): r.t for r in rows.select("i", "n", P.normalise_inputs(P.parse_list(F.col("raw")), F.col("n")).alias("t")).collect()}
    for i, raw in enumerate(DEEP):
        items = json.loads(raw)
        assert [[repr(json.loads(a)) for a in call] for call in found[i, 1]] == [[repr(x) for x in (v if isinstance(v, list) and len(v) == 1 else [v])] for v in items]
        lists = [v for v in items if isinstance(v, list)]
        assert [[repr(json.loads(a)) for a in call] for call in found[i, 2]] == [[repr(x) for x in v] for v in lists]
    assert found[9, 1] is None


def test_inputs_nested_too_deeply_do_not_fail_the_job(spark):
    raw = "[" * 900 + "1.0" + "]" * 900
    rows = spark.createDataFrame([(raw, 1), ("[[1]]", 1)], "raw string, n int")
    assert rows.select(P.normalise_inputs(P.parse_list(F.col("raw")), F.col("n")).alias("t")).count() == 2


def lines_of(name, n):
    return "\n".join(json.dumps({"function": "f", "inputs": {"args": [name, i]}, "status": "success", "output": i}) for i in range(n))


def test_a_stream_numbers_its_lines_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()
    (inbox / "b.log").write_text(lines_of("b", 30) + "\nnoise")
    (inbox / "a.log").write_text("noise\n" + lines_of("a", 20))
    run = lambda: S.capture_stream(S.log_stream(spark, str(inbox)), out, mark, number=True).awaitTermination()
    read = lambda: sorted((r.seq, r.module, r.out_json) for r in spark.read.parquet(out).collect())
    run()
    first = [(i + 1, "a", str(i)) for i in range(20)] + [(i + 21, "b", str(i)) for i in range(30)]
    assert read() == first
    (inbox / "c.log").write_text(lines_of("c", 3))
    run()
    both = first + [(52 + i, "c", str(i)) for i in range(3)]
    assert read() == both
    again = spark.read.text(str(inbox / "c.log")).select(
        F.lit("c").alias("module"), F.col("value").alias("line"), F.lit("c").alias("file"), F.lit(0).cast("bigint").alias("block"), F.lit(None).cast("bigint").alias("line_no")
    )
    S.write_batch(logs.captures_from_log(S.numbered_lines(again, 1, f"{mark}-lines")), 1, out)
    assert read() == both


def test_a_stream_is_verified_as_it_arrives(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()
    cases = X.derive_expectations(table(spark, [capture_row(i, [f"{i}"], i, module="a") for i in range(5)]), index=False)
    for name, values in (("1", [0, 1, 7]), ("2", [3])):
        text = "\n".join(json.dumps({"function": "f", "inputs": {"args": []}, "status": "success", "output": v}) for v in values)
        (inbox / f"{name}.log").write_text(text)
        lines = S.log_stream(spark, str(inbox), F.lit("a"))
        S.verify_stream(lines, cases, out, mark).awaitTermination()
    assert sorted((r.seq, r.reason, r.batch_id) for r in spark.read.parquet(out).collect()) == [(0, "ok", 0), (1, "ok", 0), (2, "mismatch", 0), (3, "ok", 1)]


def test_captures_that_name_nothing_meet_their_expectations(spark):
    rows = table(spark, [capture_row(0, [], error="Function zz not found.", function=None, module=None), capture_row(1, [], 5, function=None)])
    cases = X.derive_expectations(rows, index=False)
    for found in (V.verify(cases, rows), V.verify_repeated(cases, rows)):
        assert {r.reason for r in found.collect()} == {"ok"}
    assert V.unmatched_actuals(rows, cases).count() == 0


def test_many_modules_are_replaced_in_one_write(spark, tmp_path):
    path, names = str(tmp_path / "store"), [f"m{i}" for i in range(40)]
    rows = lambda which, v: table(spark, [capture_row(0, [], v, module=m) for m in which])
    store.write_modules(rows(names, 1), path, names)
    store.write_modules(rows(names[:20], 2), path, names[:21])
    assert Counter(r.out_json for r in store.scan_captures(spark, path).collect()) == {"2": 20, "1": 19}
    assert store.scan_captures(spark, path, "m20").count() == 0


def events(spark, folder, rows):
    kinds = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def event_rows(n):
    return [(i, datetime(2024, 1, 1), i, ("view", "click", "error")[i % 3], i * 1.01, "{}") for i in range(n)]


def test_long_lists_of_one_file_are_compared_by_all_cores(spark, tmp_path):
    found = catalog.queries()["compare_exact"](spark, events(spark, tmp_path, event_rows(60)))
    assert "RoundRobinPartitioning" in executed(found)
    assert {r.module: (r.passed, r.failed) for r in found.collect()} == {m: (16, 4) for m in ("view", "click", "error")}


def test_long_lists_of_one_file_are_told_apart_by_all_cores(spark, tmp_path):
    found = catalog.queries()["behaviour_diff_long"](spark, events(spark, tmp_path, event_rows(60)))
    plan = executed(found)
    assert "RoundRobinPartitioning" in plan
    # Each side has the text of a number behind the question whether the list is long, and in what is kept of a short one.
    once = executed(spark.range(1).select(F.transform(F.array(F.rand()), lambda e: keys.json_text(e, T.DoubleType())).alias("t"))).count("%.15e")
    assert plan.count("%.15e") == 2 * 2 * once
    assert {(r.module, r.change): r.n for r in found.collect()} == {(m, c): 4 for m in ("view", "click", "error") for c in ("added", "removed")}


def test_lines_of_one_module_are_in_several_files_in_order(spark, tmp_path):
    rows = [(*r[:3], "view", *r[4:]) for r in event_rows(300)]
    tables = Tables(spark, events(spark, tmp_path, rows[::-1]))
    root, lines = observed.streamed(tables)
    files = sorted(Path(root, "logs", "module=view").glob("*.txt"))
    assert len(files) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = [line for f in files for line in f.read_text().split("\n")[:-1]]
    assert told == [r.line for r in capture_lines(tables).orderBy("line_no").collect()]
    S.capture_stream(lines, f"{root}/out", f"{root}/mark", number=True).awaitTermination()
    assert {r.seq for r in spark.read.parquet(f"{root}/out").collect()} == {i for i in range(300) if i % 9 in (1, 2, 3, 4, 6, 8)}


def test_stored_cases_of_a_stream_are_not_numbered_in_one_task(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(S, "verify_stream", lambda lines, cases, *a: plans.append(executed(cases)) or verified(lines, cases, *a))
    found = catalog.queries()["stream_verified"](spark, events(spark, tmp_path, event_rows(90))).collect()
    assert "row_number" not in plans[0]
    assert sum(r.cases for r in found) == 60 and {r.reason for r in found} == {"ok", "mismatch"}
