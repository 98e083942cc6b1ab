import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pinmark.functions import subjects as S
from pinmark.operators import capture as C
from pinmark.operators import expect as X
from pinmark.operators import inventory as I
from pinmark.operators import probes as P
from pinmark.operators import transcript as T
from pinmark.operators import verify as V
from pinmark.operators.ordering import below_kth
from pinmark.schema import CAPTURES, EXPECTATIONS
from pinmark.sources import files, logs, store
from pinmark.streaming import capture_stream as stream
from tests.plans import executed

GOOD = '{"function": "f", "inputs": {"args": [1, "a"], "kwargs": {}}, "status": "success", "output": 5, "error": null}'
CRASH = '{"function": "f", "inputs": {"args": [], "kwargs": {}}, "status": "crashed", "output": null, "error": "KeyError: \'k\'", "traceback": "Traceback"}'
WITH_NAN = '{"function": "f", "inputs": {"args": [], "kwargs": {}}, "status": "success", "output": NaN, "error": null}'
MISSING = '{"error": "Function zz not found."}'
LOG = ["Loading...", GOOD, CRASH, WITH_NAN, MISSING, "{broken}", "  \t" + GOOD + " \r", GOOD + GOOD, GOOD + "," + GOOD, "{'a': 1}", "", "{}"]


@pytest.fixture(scope="module")
def lines(spark):
    runs = spark.createDataFrame([("m", "\n".join(LOG))], "module string, log string")
    return logs.log_lines(runs)


def test_log_records(lines):
    rows = {r.line_no: r for r in logs.parse_capture_log(lines).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 6, 11]
    assert (rows[1].function, rows[1].status, len(rows[1].args)) == ("f", "success", 2)
    assert rows[2].error == "KeyError: 'k'" and rows[2].traceback == "Traceback"
    assert (rows[4].function, rows[4].status, rows[4].error) == (None, None, "Function zz not found.")
    assert "Python" not in executed(logs.parse_capture_log(lines))
    assert sorted(r.line_no for r in logs.corrupt_lines(lines).collect()) == [5, 7, 8, 9]


def test_log_captures(lines):
    found = logs.captures_from_log(lines)
    rows = {r.seq: r for r in found.collect()}
    assert found.schema.fieldNames() == CAPTURES.fieldNames()
    assert sorted(rows) == [1, 2, 3, 4, 6, 11]
    assert (rows[1].arg_json, rows[1].arg_keys, rows[1].out_key) == (["1", '"a"'], ["1", '"a"'], "5")
    assert (rows[3].out_type, rows[3].out_json, rows[3].out_key) == ("float", "NaN", None)
    assert (rows[2].error_class, rows[2].error_mro) == ("KeyError", ["KeyError", "LookupError", "Exception", "BaseException"])
    assert (rows[4].function, rows[4].status) == (None, "crashed")
    assert rows[11].error_class == "Exception"


def test_silent_logs(spark):
    runs = [("a", "x\n" + GOOD), ("b", "noise\n{broken}\n" + "y" * 600), ("c", ""), ("d", "  {}\r\nz")]
    found = logs.silent_logs(spark.createDataFrame(runs, "module string, log string"))
    assert {r.module: r.preview for r in found.collect()} == {"b": runs[1][1][:500], "c": ""}


def test_runs_without_a_log_are_silent(spark):
    found = logs.silent_logs(spark.createDataFrame([("m", None), ("n", "hello")], "module string, log string"))
    assert {(r.module, r.preview) for r in found.collect()} == {("m", None), ("n", "hello")}


def test_reset_empties_the_store_in_a_dynamic_session(spark, tmp_path):
    path = str(tmp_path / "store")
    table = spark.createDataFrame([("m", 1), ("n", 2)], "module string, x int")
    table.write.partitionBy("module").parquet(path)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        store.reset_store(table, path)
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert not list((tmp_path / "store").rglob("*=*/*.parquet"))


def test_outcome_counts(spark):
    log = "\n".join(["a::test_x PASSED [ 50%]", "a::test_y FAILED [100%]", "___ ERROR collecting a ___", "FAILED a::test_y"])
    df = spark.createDataFrame([("s", log, None), ("t", "", None), ("u", None, "boom" * 100)], "module string, log string, fault string")
    rows = {r.module: r for r in logs.suite_results(df).collect()}
    assert (rows["s"].passed, rows["s"].failed, rows["s"].status, rows["s"].detail) == (1, 2, "FAILED", log)
    assert (rows["t"].passed, rows["t"].failed, rows["t"].status) == (0, 0, "PASSED")
    assert (rows["u"].passed, rows["u"].failed, rows["u"].status, len(rows["u"].detail)) == (None, None, "ERROR", 200)
    totals = {r.module: (r.passed, r.failed) for r in logs.log_suites(logs.log_lines(df)).collect()}
    assert totals == {"s": (1, 2), "t": (0, 0)}


@pytest.mark.parametrize("n", [1, 5, 17, 1000])
def test_log_tail(spark, n):
    text = "first\n\nsecond line\n\n\nlast é"
    df = logs.log_lines(spark.createDataFrame([("m", text)], "module string, log string"))
    assert logs.log_tail(df, n).first().detail == text[-n:]


def test_run_texts(spark):
    texts = [
        "Execution Successful. Output Logs:\nhello\nworld", "Execution Failed with Exit Code -9.\nError Logs:\nTraceback",
        "Sandbox Fault: Could not execute environment. x", "System Error: Docker daemon", "else",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = [tuple(r) for r in df.select(*logs.run_outcome(F.col("t"))).collect()]
    assert rows == [
        ("success", 0, "hello\nworld"), ("failed", -9, "Traceback"), ("fault", None, "Could not execute environment. x"),
        ("system_error", None, "Docker daemon"), ("unknown", None, "else"),
    ]


SOURCES = {
    "a/plain.py": "def f(a, b):\n    return a\n\ndef g():\n    pass\n",
    "a/asks.py": "def f(q):\n    return input(q)\ndef g(x):\n    def h():\n        return input()\n    return h\ndef k(o):\n    return o.input()\n",
    "b/shapes.py": "async def f(a): pass\nclass C:\n    def m(self): pass\nif True:\n    def inner(): pass\ndef p(a, /, b, *c, d=1, **e): pass\nlam = lambda x: x\n",
    "b/broken.py": "def f(:\n",
    "b/a.pyx.py": "def f(): pass\n",
    "b/__init__.py": "def f(): pass\n",
    "b/__pycache__/x.py": "def f(): pass\n",
}


def test_source_files_and_inventory(spark, tmp_path):
    for path, source in SOURCES.items():
        target = tmp_path / "root dir" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(source)
    found = files.source_files(spark, str(tmp_path / "root dir"))
    assert [(r.path, r.module) for r in found.collect()] == [
        ("a/asks.py", "asks"), ("a/plain.py", "plain"), ("b/a.pyx.py", "ax"), ("b/broken.py", "broken"), ("b/shapes.py", "shapes"),
    ]
    inventory = I.function_inventory(found)
    rows = {(r.path, r.function): (r.seq, r.args, r.testable, r.reason) for r in inventory.collect()}
    assert rows == {
        ("a/plain.py", "f"): (0, ["a", "b"], True, "ok"),
        ("a/plain.py", "g"): (1, [], True, "ok"),
        ("a/asks.py", "f"): (0, ["q"], False, "uses input()"),
        ("a/asks.py", "g"): (1, ["x"], False, "uses input()"),
        ("a/asks.py", "k"): (2, ["o"], True, "ok"),
        ("b/shapes.py", "p"): (0, ["b"], True, "ok"),
        ("b/a.pyx.py", "f"): (0, [], True, "ok"),
    }
    assert {tuple(r) for r in I.inventory_summary(inventory).collect()} == {
        ("a/plain.py", 2, 0), ("a/asks.py", 1, 2), ("b/shapes.py", 1, 0), ("b/a.pyx.py", 1, 0),
    }
    assert [r.path for r in I.syntax_errors(found).collect()] == ["b/broken.py"]
    captured = spark.createDataFrame([("plain", "f"), ("plain", "zz"), ("asks", "f")], "module string, function string")
    gaps = {tuple(r) for r in I.coverage_gap(inventory, captured).collect()}
    assert gaps == {
        ("plain", "g", "uncaptured"), ("asks", "k", "uncaptured"), ("shapes", "p", "uncaptured"), ("ax", "f", "uncaptured"),
        ("plain", "zz", "undefined"),
    }
    plan = executed(I.coverage_gap(inventory, captured))
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Exchange hashpartitioning") == 1
    issues = {(r.test_name, r.issue_type) for r in I.validation_issues(I.coverage_gap(inventory, captured), I.syntax_errors(found)).collect()}
    assert ("test_zz", "Hallucination") in issues and ("test_broken", "Syntax Error") in issues
    assert ("test_g", "Missing Coverage") in issues


def test_unparsable_sources_do_not_fail_the_job():
    deep = "x = " + "(" * 5000 + ")" * 5000
    assert [I.top_level_functions(s) for s in (None, "a\x00b", deep)] == [None, None, None]
    assert I.top_level_functions("") == []


def captures(spark, module, n, rate=1.05):
    df = spark.range(1, n + 1).select("id", F.col("id").cast("double").alias("v"))
    return C.capture_native(df, S.process_transaction(F.col("v"), rate=rate), [F.col("v")], module=module, function="f", seq=F.col("id"))


def test_store_replaces_whole_modules(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.scan_captures(spark, path).count() == 0
    names = ["a", "b=c/d", "e"]
    for name, n in zip(names, (3, 4, 5)):
        store.write_modules(captures(spark, name, n), path, [name])
    counts = lambda: {r.module: r["count"] for r in store.scan_captures(spark, path).groupBy("module").count().collect()}
    assert counts() == {"a": 3, "b=c/d": 4, "e": 5}
    store.write_modules(captures(spark, "a", 7, rate=2.0), path, ["a", "b=c/d"])
    assert counts() == {"a": 7, "e": 5}
    assert store.scan_captures(spark, path, "a").where("seq = 1").first().out_double == 2.0
    plan = executed(store.scan_captures(spark, path, "a"))
    assert "PartitionFilters: [isnotnull(module" in plan and "= a)" in plan
    store.reset_store(store.scan_captures(spark, path), str(tmp_path / "other"))
    assert store.scan_captures(spark, str(tmp_path / "other")).count() == 0


def test_replaced_view(spark):
    before = captures(spark, "a", 3).unionByName(captures(spark, "b", 2))
    merged = store.replaced(before, captures(spark, "a", 1))
    assert sorted((r.module, r.seq) for r in merged.collect()) == [("a", 1), ("b", 1), ("b", 2)]
    gone = store.replaced(before, captures(spark, "a", 1).limit(0), captures(spark, "a", 1))
    assert sorted((r.module, r.seq) for r in gone.collect()) == [("b", 1), ("b", 2)]


def test_suites_round_trip(spark, tmp_path):
    path = str(tmp_path / "suites")
    cases = X.derive_expectations(captures(spark, "a", 3))
    store.write_modules(cases, path, ["a"])
    back = store.scan_expectations(spark, path)
    assert back.schema.fieldNames() == EXPECTATIONS.fieldNames()
    assert sorted(map(str, back.collect())) == sorted(map(str, cases.collect()))
    assert [r.suite for r in store.scan_suites(back).collect()] == ["test_a.py"]


def test_default_probes(spark):
    df = spark.createDataFrame([("m", "f", []), ("m", "g", ["a", "b"])], "module string, function string, args array<string>")
    rows = {(r.function, r.case_seq): r.arg_json for r in P.default_probes(df).collect()}
    assert rows == {("f", 0): [], ("g", 0): ["0", "0"], ("g", 1): ["1", "1"], ("g", 2): ["-1", "-1"]}


def test_normalised_inputs(spark):
    raw = ["[[1], [2]]", "[1, 2.50, 1.0, 1e3, NaN, -Infinity, 12345678901234567890123]", '[[1, "a"], [[1], {"b": 1, "a": 2}], 3]', "[]", '[[[1, 2]], "é\\n", null, true]']
    df = spark.createDataFrame([(i, r, n) for i, r in enumerate(raw) for n in (1, 2)], "i int, raw string, n int")
    rows = {(r.i, r.n): r.t for r in df.select("i", "n", P.normalise_inputs(P.parse_list(F.col("raw")), F.col("n")).alias("t")).collect()}
    assert rows[(0, 1)] == [["1"], ["2"]] and rows[(0, 2)] == [["1"], ["2"]]
    assert rows[(1, 1)] == [["1"], ["2.5"], ["1.0"], ["1000.0"], ["NaN"], ["-Infinity"], ["12345678901234567890123"]]
    assert rows[(1, 2)] == []
    assert rows[(2, 2)] == [["1", '"a"'], ["[1]", '{"a":2,"b":1}']]
    assert rows[(2, 1)] == [['[1, "a"]'], ['[[1], {"a":2,"b":1}]'], ["3"]]
    assert rows[(3, 1)] == []
    assert [a for (a,) in rows[(4, 1)]] == ["[1, 2]", json.dumps("é\n", ensure_ascii=False), "null", "true"]


def test_extracted_inputs(spark):
    cases = [
        ('{"test_inputs": [[5], [0]]}', [["5"], ["0"]], False),
        ('```json\n{"test_inputs": [5]}\n```', [["5"]], False),
        ("```\n[[1]]```", [["1"]], False),
        ('{"a": 1, "z": [7], "b": [8]}', [["7"]], False),
        ('{"test_inputs": null, "b": [8]}', [["8"]], False),
        ("{'test_inputs': [None, True, (1,)]}", [["null"], ["true"], ["1"]], False),
        ("[1, 2", [["0"], ["1"], ["-1"]], True),
        ('{"test_inputs": []}', [["0"], ["1"], ["-1"]], True),
        ('{"test_inputs": 5, "b": [8]}', [["0"], ["1"], ["-1"]], True),
        ("", [["0"], ["1"], ["-1"]], True),
        (None, [["0"], ["1"], ["-1"]], True),
    ]
    df = spark.createDataFrame([(i, c[0], 1) for i, c in enumerate(cases)], "i int, response string, n_args int")
    rows = {r.i: r for r in P.extract_inputs(df).collect()}
    for i, (text, inputs, fallback) in enumerate(cases):
        assert (rows[i].inputs, rows[i].fallback) == (inputs, fallback), text


def test_sampled_probes_hold_the_boundaries(spark):
    rows = [(i % 2, float(i), f"t{i % 7}") for i in range(200)] + [(0, None, "x"), (0, 0.0, ""), (1, 5.0, None)] * 3
    df = spark.createDataFrame(rows, "g int, v double, s string")
    found = P.sample_probes(df, ["v", "s"], ["g"], 4).collect()
    calls = {(r.g, r.v, r.s) for r in found}
    assert len(calls) == len(found) and calls <= set(rows)
    assert {(0, None, "x"), (0, 0.0, ""), (1, 5.0, None), (0, 198.0, "t2"), (1, 199.0, "t3"), (1, 1.0, "t1")} <= calls
    assert len(calls) <= 2 * (4 + 8)
    assert "WindowGroupLimit" in executed(P.sample_probes(df, ["v", "s"], ["g"], 4))


@pytest.mark.parametrize("k", [3, 2000])
def test_sampled_probes_of_a_hot_stratum(spark, k):
    rows = spark.range(30000).select(
        F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 == 0, "cold").alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 12000).cast("int").alias("v"),
    )
    order = F.md5(F.col("v").cast("string"))
    groups = {}
    for r in rows.distinct().collect():
        groups.setdefault(r.g, []).append(r.v)
    key = lambda v: hashlib.md5(str(v).encode()).hexdigest()
    expected = set()
    for g, values in groups.items():
        expected |= {(g, v) for v in sorted(values, key=key)[:k]} | {(g, min(values)), (g, max(values))} | {(g, 0) for v in values if v == 0}
    found = P.sample_probes(rows, ["v"], ["g"], k, order).collect()
    assert len(found) == len(expected) and {(r.g, r.v) for r in found} == expected
    left = below_kth(rows, ["g"], ["v"], order, k).distinct().groupBy("g").count().collect()
    assert all(min(k, len(groups[r.g])) <= r["count"] <= 1.3 * k + 10 for r in left)
    assert P.sample_probes(rows.where("v < 0"), ["v"], ["g"], k).count() == 0
    assert below_kth(rows, [], ["v"], order, k).count() == 30000


def test_source_files_keep_all_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "TASK_FILES", 2)
    texts = {"_x.py": "def f(): pass\r\n", "_lib/empty.py": "", "b c/#1.py": "a = '\u00e9'\n", "d/e/f.py": "x", "n.txt": "no", "d/__init__.py": "", ".h.py": "no", ".v/a.py": "no"}
    rows = spark.createDataFrame(list(texts.items()) + [("z/null.py", None)], "path string, source string")
    files.write_files(rows, str(tmp_path / "root"))
    (tmp_path / "root" / "dir.py").mkdir()
    (tmp_path / "root" / "broken.py").write_bytes(b"a\xffb")
    kept = {p: x for p, x in texts.items() if p in ("_x.py", "_lib/empty.py", "b c/#1.py", "d/e/f.py")} | {"z/null.py": "", "broken.py": "a\ufffdb"}
    for root in (str(tmp_path / "root"), f"file://{tmp_path}/root/"):
        found = files.source_files(spark, root)
        assert [(r.path, r.source) for r in found.collect()] == sorted(kept.items())
        assert "Exchange" not in executed(found)
    reader = files._SourceReader(str(tmp_path / "root"), ".py")
    assert [len(p.paths) for p in reader.partitions()] == [2, 2, 2, 1]
    (tmp_path / "none").mkdir()
    assert files.source_files(spark, str(tmp_path / "none")).count() == 0


def test_last_message(spark):
    rows = [
        (1, 0, "system", "go"), (1, 1, "user", "DONE"), (1, 2, "critic", "all DONE now"), (1, 3, "system", "x"), (1, 4, "", "y"), (1, 5, None, "z"),
        (2, 0, "user", "DONE"), (2, 1, "critic", None), (3, 0, "system", "DONE"),
    ]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    last = {r.conv_id: (r.last_turn, r.last_author, r.last_text) for r in T.last_message(df).collect()}
    assert last == {1: (2, "critic", "all DONE now"), 2: (1, "critic", ""), 3: (None, None, None)}
    assert {tuple(r) for r in T.is_terminated(df, "DONE").collect()} == {(1, True), (2, False), (3, False)}


def test_speaking_order(spark):
    opening, cycle = ["Observer", "Engineer", "Critic"], ["Engineer", "Critic"]
    df = spark.range(14).select("id", T.expected_speaker(F.col("id"), opening, cycle).alias("who"))
    who = [r.who for r in df.orderBy("id").collect()]
    assert who == opening + cycle * 5 + cycle[:1]
    turns = spark.createDataFrame([(0, "Observer"), (1, "Critic"), (12, "Critic"), (4, None)], "turn int, role string")
    rows = {r.turn: (r.in_order, r.within_limit) for r in T.turn_order_check(turns, opening, cycle).collect()}
    assert rows == {0: (True, True), 1: (False, True), 12: (True, False), 4: (False, True)}


def test_stream_picks_up_new_files_and_a_repeated_batch_replaces_itself(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()
    (inbox / "billing.log").write_text("\n".join(LOG))
    stream.capture_stream(stream.log_stream(spark, str(inbox)), out, mark).awaitTermination()
    (inbox / "game.log").write_text(GOOD + "\nnoise\n" + CRASH)
    stream.capture_stream(stream.log_stream(spark, str(inbox)), out, mark).awaitTermination()
    read = lambda: {(r.module, r.batch_id): r["count"] for r in spark.read.parquet(out).groupBy("module", "batch_id").count().collect()}
    assert read() == {("billing", 0): 6, ("game", 1): 2}
    rows = logs.captures_from_log(spark.createDataFrame([("game", 0, GOOD)], "module string, line_no bigint, line string"))
    stream.write_batch(rows, 1, out)
    assert read() == {("billing", 0): 6, ("game", 1): 1}


@pytest.mark.parametrize("keys", [("module", "function", "seq"), ("seq",)])
def test_bucketed_suites_are_not_exchanged_again(spark, tmp_path, keys):
    cases = X.derive_expectations(captures(spark, "a", 50), index=False)
    store.write_bucketed(cases, "bucketed_cases", 4, keys, path=str(tmp_path / "bucketed"))
    fresh = captures(spark, "a", 50)
    if len(keys) > 1:
        store.write_modules(fresh, str(tmp_path / "fresh"), ["a"])
        fresh = store.scan_captures(spark, str(tmp_path / "fresh"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        results = V.verify(spark.table("bucketed_cases"), fresh)
        assert executed(results).count("Exchange hashpartitioning") == 1
        assert results.where("passed").count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_cases")
