"""The recorded 64 calls, from log line to verdict."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pinmark.functions import subjects as S
from pinmark.operators import capture as C
from pinmark.operators import expect as X
from pinmark.operators import rollup as R
from pinmark.operators import verify as V
from pinmark.plans.regression import replay_python
from pinmark.sources import logs
from tests.golden import BILLING, WORD_GAME

FUNCTIONS = {
    "load_words": lambda: ["w"] * 55900,
    "choose_word": S.choose_word_py,
    "has_player_won": S.has_player_won_py,
    "get_word_progress": S.get_word_progress_py,
    "get_available_letters": S.get_available_letters_py,
    "revealed": S.revealed_py,
    "unique_letters": S.unique_letters_py,
    "process_transaction": S.process_transaction_py,
}


def line(function, args, outcome, assertion):
    crashed = assertion == "raises"
    record = {
        "function": function,
        "inputs": {"args": args, "kwargs": {}},
        "status": "crashed" if crashed else "success",
        "output": None if crashed else outcome,
        "error": outcome if crashed else None,
    }
    return json.dumps(record)


@pytest.fixture(scope="module")
def expectations(spark):
    rows = [(m, i, line(*case)) for m, cases in (("word_game", WORD_GAME), ("billing", BILLING)) for i, case in enumerate(cases)]
    lines = spark.createDataFrame(rows, "module string, line_no bigint, line string")
    return X.derive_expectations(logs.captures_from_log(lines))


def test_assertion_of_each_case(expectations):
    found = {(r.module, r.seq): r for r in expectations.collect()}
    for module, cases in (("word_game", WORD_GAME), ("billing", BILLING)):
        numbers = Counter()
        for seq, (function, _, _, assertion) in enumerate(cases):
            kind = "crash" if assertion == "raises" else "success"
            row = found[(module, seq)]
            assert (row.function, row.case_kind, row.assertion) == (function, kind, assertion)
            assert row.case_idx == numbers[(function, kind)]
            assert row.case_name == f"test_{function}_{kind}_{row.case_idx}"
            numbers[(function, kind)] += 1
    assert len(found) == 64


def test_tally(expectations):
    tally = {r.assertion: r["count"] for r in expectations.groupBy("assertion").count().collect()}
    assert tally == {
        "not_null": 1, "member": 13, "is_bool": 9, "equal": 28, "approx": 3, "approx_nan": 1, "raises": 9,
    }


def test_replay_passes(expectations):
    results = replay_python(expectations, FUNCTIONS)
    assert [r.asDict() for r in results.where("not passed").select("case_name", "reason").collect()] == []
    suites = R.suite_rollup(results)
    assert {r.module: (r.passed, r.failed, r.status) for r in suites.collect()} == {
        "word_game": (55, 0, "PASSED"),
        "billing": (9, 0, "PASSED"),
    }
    total = R.total_rollup(suites).first()
    assert (total.suites, total.passed, total.failed, total.all_pass) == (2, 64, 0, True)


def test_error_class_of_replay_is_the_recorded_one(expectations):
    act = C.replay(expectations.where("assertion = 'raises'"), FUNCTIONS)
    assert act.where("error_class <> act_error_class").count() == 0


def test_changed_rate_fails_the_approximate_cases_only(expectations):
    altered = dict(FUNCTIONS, process_transaction=lambda a: S.process_transaction_py(a, 1.06))
    failed = replay_python(expectations, altered).where("not passed")
    assert {(r.function, r.assertion, r.reason) for r in failed.collect()} == {("process_transaction", "approx", "mismatch")}
    assert failed.count() == 3


def test_missing_function_is_a_missing_actual(expectations):
    results = replay_python(expectations, {})
    assert {r.reason for r in results.collect()} == {"missing"}


def test_native_forms_agree_with_golden(spark):
    def rows(name, schema):
        cases = [(i, *a, o) for i, (f, a, o, k) in enumerate(WORD_GAME) if f == name]
        return spark.createDataFrame(cases, schema)

    won = rows("has_player_won", "seq int, word string, letters array<string>, out boolean")
    progress = rows("get_word_progress", "seq int, word string, letters array<string>, out string")
    available = rows("get_available_letters", "seq int, letters array<string>, out string")
    unique = rows("unique_letters", "seq int, word string, out int")
    word, letters = F.col("word"), F.col("letters")
    for df, outcome in (
        (won, S.has_player_won(word, letters)),
        (progress, S.get_word_progress(word, letters)),
        (available, S.get_available_letters(letters)),
        (unique, S.unique_letters(word)),
    ):
        assert df.where(~outcome.value.eqNullSafe(F.col("out"))).count() == 0


def test_native_billing_agrees_with_golden(spark):
    texts = [(i, a[0], o) for i, (_, a, o, _) in enumerate(BILLING) if a[0] is None or isinstance(a[0], str)]
    df = spark.createDataFrame([(i, a) for i, a, _ in texts], "seq int, amount string")
    amount = F.col("amount")
    found = C.capture_native(
        df, S.process_transaction(amount, text=True), [amount], module="b", function="p", seq=F.col("seq")
    )
    by_seq = {r.seq: r for r in found.collect()}
    for seq, _, outcome in texts:
        row = by_seq[seq]
        if isinstance(outcome, str):
            assert row.error == outcome
        else:
            assert repr(row.out_double) == repr(outcome)


def test_seeded_pick_is_stable_and_from_the_candidates(spark):
    df = spark.createDataFrame([(i, "mississippi", "sp") for i in range(50)], "k int, word string, pool string")
    outcome = S.revealed(F.col("word"), F.col("pool"), key=F.col("k"), seed=3)
    picks = df.select("k", outcome.value.alias("p"))
    first, second = sorted(picks.collect()), sorted(picks.repartition(7).collect())
    assert first == second
    assert {r.p for r in first} == {"s", "p"}


def test_verify_by_join_finds_all_reasons(spark, expectations):
    actual = spark.createDataFrame(
        [(c[1], i) for i, c in enumerate(BILLING[:1])], "amount array<string>, seq bigint"
    ).selectExpr("amount[0] AS amount", "seq")
    fresh = C.capture(actual, S.process_transaction_py, ["amount"], module="billing", function="process_transaction", seq="seq")
    results = V.verify(expectations, fresh, suite="billing")
    assert Counter(r.reason for r in results.collect()) == {"ok": 1, "missing": 8}
