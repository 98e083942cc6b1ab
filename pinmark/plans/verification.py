"""Queries over expectations and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import subjects as S
from ..operators import capture as C
from ..operators import expect as X
from ..operators import inventory as I
from ..operators import rollup as R
from ..operators import verify as V
from ..schema import ARGUMENT_KEY, EXPECTATION_COLUMNS
from ..session import shared_dir, spread
from ..sources import store
from .captures import CHANGED_RATE, FUNCTION, billing, changed_billing, native_words
from .regression import compare_native, replay_python
from .registry import Tables, query


def customers(t: Tables, module="billing") -> DataFrame:
    return billing(t.customer, "c_acctbal", "c_custkey", module)


def by_segment(t: Tables) -> DataFrame:
    """One suite per market segment."""
    return customers(t, F.col("c_mktsegment"))


def changed_by_segment(t: Tables) -> DataFrame:
    return changed_billing(t.customer, "c_acctbal", "c_custkey", F.col("c_mktsegment"))


def case_results(t: Tables) -> DataFrame:
    """Every segment's cases against the altered function."""
    return V.verify(X.derive_expectations(by_segment(t), index=False), changed_by_segment(t))


# A case fails where the altered rate leaves the tolerance of the expected amount.
RESULTS_SQL = f"""
WITH c AS (SELECT c_mktsegment AS module, c_custkey AS seq, c_acctbal AS v, c_acctbal * CAST(1.05 AS DOUBLE) AS expected,
                  c_acctbal * {CHANGED_RATE.format(v="c_acctbal")} AS actual FROM customer),
results AS (SELECT module, seq, CASE WHEN v > 0 THEN 'approx' ELSE 'raises' END AS assertion,
    CASE WHEN v > 0 THEN 'success' ELSE 'crash' END AS case_kind,
    v <= 0 OR abs(actual - expected) <= greatest(1e-6 * abs(expected), 1e-12) AS passed FROM c)
"""


@query(
    "verify_billing",
    """
SELECT 'billing' AS module, CASE WHEN c_acctbal > 0 THEN 'approx' ELSE 'raises' END AS assertion, 'ok' AS reason,
       count(*) AS cases FROM customer GROUP BY ALL""",
)
def verify_billing(t: Tables) -> DataFrame:
    """Expectations from the column form, replayed by the Python form, paired by case and judged."""
    expectations = X.derive_expectations(customers(t), index=False)
    actual = C.capture(
        t.customer, S.process_transaction_py, ["c_acctbal"], module="billing", function=FUNCTION, seq="c_custkey"
    )
    results = V.verify(expectations, actual)
    return results.groupBy("module", "assertion", "reason").agg(F.count(F.lit(1)).alias("cases"))


@query(
    "verify_replay",
    """
SELECT CASE WHEN l_tax > 0 THEN 'approx' ELSE 'raises' END AS assertion,
       CASE WHEN l_tax > 0 THEN 'mismatch' ELSE 'ok' END AS reason, count(*) AS cases FROM lineitem GROUP BY ALL""",
)
def verify_replay(t: Tables) -> DataFrame:
    """An altered Python function called on the stored arguments, beside each expectation: no join."""
    captures = billing(spread(t.lineitem), "l_tax", "l_orderkey")
    expectations = X.derive_expectations(captures, index=False, plain=True)
    results = replay_python(expectations, {FUNCTION: lambda amount: S.process_transaction_py(amount, 1.06)})
    return results.groupBy("assertion", "reason").agg(F.count(F.lit(1)).alias("cases"))


@query(
    "compare_native",
    f"""
WITH c AS (SELECT l_returnflag AS module, l_extendedprice AS v, l_extendedprice * CAST(1.05 AS DOUBLE) AS expected,
                  l_extendedprice * {CHANGED_RATE.format(v="l_extendedprice")} AS actual FROM lineitem)
SELECT module, count(*) FILTER (v <= 0 OR abs(actual - expected) <= greatest(1e-6 * abs(expected), 1e-12)) AS passed,
       count(*) FILTER (v > 0 AND abs(actual - expected) > greatest(1e-6 * abs(expected), 1e-12)) AS failed
FROM c GROUP BY module""",
)
def compare_native_query(t: Tables) -> DataFrame:
    amount = F.col("l_extendedprice")
    same = S.process_transaction(amount)
    rate = F.when(amount > 5000, F.lit(1.06)).otherwise(F.lit(S.RATE))
    results = compare_native(
        spread(t.lineitem),
        same,
        C.Outcome(amount * rate, same.guards, same.given),
        [amount],
        module=F.col("l_returnflag"),
        function=FUNCTION,
        seq=F.col("l_orderkey"),
    )
    return R.suite_rollup(results).drop("status")


@query(
    "verify_mutation",
    RESULTS_SQL + "SELECT module, seq, assertion, passed FROM results",
)
def verify_mutation(t: Tables) -> DataFrame:
    return case_results(t).select("module", "seq", "assertion", "passed")


@query(
    "verify_suites",
    RESULTS_SQL
    + """
SELECT module, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed,
       CASE WHEN bool_and(passed) THEN 'PASSED' ELSE 'FAILED' END AS status, grouping(module) = 1 AS is_total
FROM results GROUP BY ROLLUP (module)""",
)
def verify_suites(t: Tables) -> DataFrame:
    return R.suites_and_total(case_results(t))


ASKED_SQL = """,
counted AS (SELECT module, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM results GROUP BY module),
asked AS (SELECT DISTINCT c_mktsegment AS module FROM customer UNION SELECT DISTINCT o_orderpriority FROM orders),
suites AS (SELECT a.module, passed, failed, CASE WHEN failed IS NULL THEN 'ERROR' WHEN failed = 0 THEN 'PASSED' ELSE 'FAILED' END AS status
           FROM asked a LEFT JOIN counted c ON a.module = c.module)
"""


def asked_suites(t: Tables) -> DataFrame:
    """Suites that exist (segments) and suites that do not (order priorities)."""
    segments = t.customer.select(F.col("c_mktsegment").alias("module")).distinct()
    return segments.union(t.orders.select("o_orderpriority").distinct())


@query("suite_rollup", RESULTS_SQL + ASKED_SQL + "SELECT * FROM suites")
def suite_rollup(t: Tables) -> DataFrame:
    return R.suite_rollup(case_results(t), asked_suites(t))


@query(
    "verify_total",
    RESULTS_SQL
    + ASKED_SQL
    + """
SELECT count(*) AS suites, CAST(sum(coalesce(passed, 0)) AS BIGINT) AS passed,
       CAST(sum(coalesce(failed, 0)) AS BIGINT) AS failed, bool_and(status = 'PASSED') AS all_pass FROM suites""",
)
def verify_total(t: Tables) -> DataFrame:
    return R.total_rollup(R.suite_rollup(case_results(t), asked_suites(t)))


@query(
    "review",
    RESULTS_SQL
    + """,
suites AS (SELECT module, bool_and(passed) AS ok FROM results GROUP BY module),
found AS (SELECT count(*) AS n FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal > 9000)),
lost AS (SELECT count(*) AS n FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9000) c
         WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey))
SELECT bool_and(ok) AND (SELECT n FROM found) = 0 AND (SELECT n FROM lost) = 0 AS is_approved, count(*) FILTER (NOT ok) AS failing_suites,
       (SELECT n FROM found) AS missing_coverage, (SELECT n FROM lost) AS hallucinations, CAST(0 AS BIGINT) AS syntax_errors,
       CASE WHEN NOT bool_and(ok) THEN 'Fix the failing cases.' WHEN (SELECT n FROM lost) > 0 THEN 'Drop cases of functions that do not exist.'
            WHEN (SELECT n FROM found) > 0 THEN 'Capture the functions no case covers.' END AS recommendation FROM suites""",
)
def review(t: Tables) -> DataFrame:
    """Suppliers stand for functions, their nations for modules; rich customers' nations for captured modules."""
    nation = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    inventory = t.supplier.select(nation.alias("module"), F.col("s_name").alias("function"), F.lit(True).alias("testable"))
    rich = t.customer.where("c_acctbal > 9000").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("module")).distinct()
    covered = inventory.join(rich, "module", "left_semi").select("module", "function")
    lost = rich.join(inventory, "module", "left_anti").withColumn("function", F.lit("gone"))
    gaps = I.coverage_gap(inventory, covered.unionByName(lost))
    return R.review(R.suite_rollup(case_results(t)), I.validation_issues(gaps))


@query(
    "verify_one_suite",
    RESULTS_SQL + "SELECT seq, passed FROM results WHERE module = 'BUILDING'",
)
def verify_one_suite(t: Tables) -> DataFrame:
    expectations = X.derive_expectations(by_segment(t), index=False)
    return V.verify(expectations, changed_by_segment(t), suite="BUILDING").select("seq", "passed")


@query(
    "failure_sample",
    RESULTS_SQL
    + """
SELECT module, seq FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY seq) AS rn FROM results WHERE NOT passed)
WHERE rn <= 3""",
)
def failure_sample(t: Tables) -> DataFrame:
    return V.failure_sample(case_results(t), 3).select("module", "seq")


@query(
    "verify_distinct_calls",
    """
SELECT CASE WHEN l_tax > 0 THEN 'approx' ELSE 'raises' END AS assertion, true AS passed,
       count(DISTINCT l_tax) AS cases, count(*) AS n_rows FROM lineitem GROUP BY ALL""",
)
def verify_distinct_calls(t: Tables) -> DataFrame:
    """A table without a unique row key: every distinct argument is called once and weighted by its rows."""
    calls = C.distinct_calls(t.lineitem, ["l_tax"])
    amount = F.col("l_tax")
    native = C.capture_native(
        calls, S.process_transaction(amount), [amount], module="billing", function=FUNCTION, keep=["n_rows"]
    )
    expectations = X.derive_expectations(native, index=False, keep=("n_rows",))
    actual = C.capture(calls, S.process_transaction_py, ["l_tax"], module="billing", function=FUNCTION)
    results = V.verify(expectations, actual, ARGUMENT_KEY)
    return results.groupBy("assertion", "passed").agg(
        F.count(F.lit(1)).alias("cases"), F.sum("n_rows").alias("n_rows")
    )


EXPECTED_SQL = """
SELECT p_partkey AS seq, 'first_letter' AS function, 'member' AS assertion FROM part
UNION ALL SELECT p_partkey, 'larger', 'member' FROM part
UNION ALL SELECT p_partkey, 'is_large', 'is_bool' FROM part
UNION ALL SELECT p_partkey, 'price', 'approx' FROM part
UNION ALL SELECT p_partkey, 'ratio', CASE WHEN p_size % 5 = 0 THEN 'raises' WHEN p_size % 5 = 1 THEN 'approx_nan' ELSE 'approx' END FROM part
UNION ALL SELECT p_partkey, 'name_length', 'equal' FROM part
UNION ALL SELECT p_partkey, 'label', CASE WHEN 2 + p_size * length(p_name) > 500 THEN 'not_null' WHEN p_size * length(p_name) = 1 THEN 'member' ELSE 'equal' END FROM part
UNION ALL SELECT p_partkey, 'nothing', 'equal' FROM part
UNION ALL SELECT p_partkey, 'sizes', 'equal' FROM part
"""


def part_captures(t: Tables) -> DataFrame:
    """Functions over parts that lead to every kind of assertion."""
    name, size, price = F.col("p_name"), F.col("p_size"), F.col("p_retailprice")
    sizes = F.array(size, F.lit(25))
    rest = F.pmod(size, F.lit(5))
    ratio = C.Outcome(
        F.when(rest == 1, F.lit(float("nan"))).otherwise(price / F.nullif(rest, F.lit(0))),
        (C.Guard(rest == 0, ZeroDivisionError, S.DIVISION),),
    )
    return C.capture_native_many(
        spread(t.part),
        {
            "first_letter": (C.Outcome(F.left(name, F.lit(1))), [name]),
            "larger": (C.Outcome(F.array_max(sizes)), [sizes]),
            "is_large": (C.Outcome(size > 25), [size]),
            "price": (C.Outcome(price * 1.1), [price]),
            "ratio": (ratio, [price, size]),
            "name_length": (C.Outcome(F.length(name)), [name]),
            "label": (C.Outcome(F.repeat(name, size)), [name, size]),
            "nothing": (C.Outcome(F.lit(None).cast("string")), [name]),
            "sizes": (C.Outcome(sizes), [size]),
        },
        module="parts",
        seq=F.col("p_partkey"),
    )


@query("derive_expectations", EXPECTED_SQL)
def derive_expectations(t: Tables) -> DataFrame:
    return X.derive_expectations(part_captures(t), index=False).select("seq", "function", "assertion")


@query(
    "verify_all_kinds",
    f"""
WITH e AS ({EXPECTED_SQL})
SELECT function, assertion, assertion <> 'approx_nan' OR function = 'ratio' AS passed, count(*) AS cases FROM e GROUP BY ALL""",
)
def verify_all_kinds(t: Tables) -> DataFrame:
    """Each kind of assertion holds for a second capture of the same functions."""
    captures = part_captures(t)
    results = V.verify(X.derive_expectations(captures, index=False), captures)
    return results.groupBy("function", "assertion", "passed").agg(F.count(F.lit(1)).alias("cases"))


@query(
    "derive_strict",
    """
WITH calls AS (SELECT event_type, user_id, event_id, CAST(length(event_type) + user_id % 2 * event_id AS BIGINT) AS out FROM events),
varies AS (SELECT event_type, user_id, min(out) <> max(out) AS varies FROM calls GROUP BY ALL)
SELECT event_id AS seq, CASE WHEN varies THEN 'member' ELSE 'equal' END AS assertion
FROM calls JOIN varies USING (event_type, user_id)""",
)
def derive_strict(t: Tables) -> DataFrame:
    """Only calls that were seen to vary are weakened to membership."""
    word, user = F.col("event_type"), F.col("user_id")
    # The function returns its list's element; for odd users that element differs from call to call.
    out = (F.length(word) + user % 2 * F.col("event_id")).cast("bigint")
    captures = C.capture_native(
        t.events, C.Outcome(out), [word, user], module="events", function="pick", seq=F.col("event_id")
    )
    listed = captures.withColumn(
        "arg_elem_keys", F.array(F.lit(None).cast("array<string>"), F.array("out_key"))
    )
    return X.derive_expectations(listed, index=False, strict=True).select("seq", "assertion")


@query(
    "case_index",
    """
WITH c AS (SELECT c_mktsegment AS module, c_custkey AS seq, CASE WHEN c_acctbal > 0 THEN 'success' ELSE 'crash' END AS case_kind FROM customer),
numbered AS (SELECT *, row_number() OVER (PARTITION BY module, case_kind ORDER BY seq) - 1 AS case_idx FROM c)
SELECT module, seq, case_idx, concat('test_process_transaction_', case_kind, '_', case_idx) AS case_name FROM numbered""",
)
def case_index(t: Tables) -> DataFrame:
    return X.derive_expectations(by_segment(t), index=True).select("module", "seq", "case_idx", "case_name")


@query("case_count", "SELECT c_mktsegment AS module, count(*) AS cases FROM customer GROUP BY 1")
def case_count(t: Tables) -> DataFrame:
    return R.case_count(X.derive_expectations(by_segment(t), index=False))


@query(
    "scan_suites",
    "SELECT DISTINCT c_mktsegment AS module, concat('test_', c_mktsegment, '.py') AS suite FROM customer",
)
def scan_suites(t: Tables) -> DataFrame:
    return store.scan_suites(X.derive_expectations(by_segment(t), index=False))


# Pairs an order total with an actual value at, inside and outside the tolerance, and with the special values.
ACTUAL_SQL = """
CASE o_orderkey % 8
  WHEN 0 THEN o_totalprice
  WHEN 1 THEN o_totalprice * (1 + 9e-7)
  WHEN 2 THEN o_totalprice * (1 - 2e-6)
  WHEN 3 THEN CAST('NaN' AS DOUBLE)
  WHEN 4 THEN CAST('Infinity' AS DOUBLE)
  WHEN 5 THEN NULL
  ELSE -o_totalprice
END"""
EXPECTED_VALUE_SQL = """
CASE o_custkey % 4 WHEN 0 THEN CAST('Infinity' AS DOUBLE) WHEN 1 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice END"""


@query(
    "assert_approx_edges",
    f"""
WITH p AS (SELECT o_orderkey, {EXPECTED_VALUE_SQL} AS e, {ACTUAL_SQL} AS a FROM orders)
SELECT o_orderkey, a IS NOT NULL AND NOT isnan(e) AND NOT isnan(a) AND (a = e OR (e <> CAST('Infinity' AS DOUBLE)
       AND abs(a - e) <= greatest(1e-6 * abs(e), 1e-12))) AS approx, coalesce(isnan(a), false) AS is_nan FROM p""",
)
def assert_approx_edges(t: Tables) -> DataFrame:
    pairs = t.orders.select("o_orderkey", F.expr(EXPECTED_VALUE_SQL).alias("e"), F.expr(ACTUAL_SQL).alias("a"))
    return pairs.select(
        "o_orderkey",
        V.assert_approx(F.col("e"), F.col("a")).alias("approx"),
        V.assert_nan(F.col("a")).alias("is_nan"),
    )


@query(
    "assert_raises_base",
    """
SELECT c_custkey AS seq, c_acctbal <= 0 AS passed, CASE WHEN c_acctbal <= 0 THEN 'ok' ELSE 'did_not_raise' END AS reason FROM customer""",
)
def assert_raises_base(t: Tables) -> DataFrame:
    """A test that expects a base class is met by any class derived from it."""
    actual = customers(t)
    wanted = X.derive_expectations(actual, index=False).withColumns(
        {"assertion": F.lit("raises"), "error_class": F.lit("Exception")}
    )
    return V.verify(wanted, actual).select("seq", "passed", "reason")


@query(
    "unmatched_actuals",
    "SELECT s_suppkey AS seq FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def unmatched_actuals(t: Tables) -> DataFrame:
    """Supplier calls that no case derived from a successful customer call covers."""
    covered = X.derive_expectations(customers(t).where("status = 'success'"), index=False)
    return V.unmatched_actuals(billing(t.supplier, "s_acctbal", "s_suppkey"), covered).select("seq")


@query(
    "missing_actuals",
    """
SELECT c_custkey AS seq, CASE WHEN s_suppkey IS NULL THEN 'missing' WHEN c_acctbal > 0 AND s_acctbal <= 0 THEN 'unexpected_crash'
       WHEN c_acctbal > 0 THEN 'mismatch' WHEN s_acctbal > 0 THEN 'did_not_raise' ELSE 'ok' END AS reason
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""",
)
def missing_actuals(t: Tables) -> DataFrame:
    """Customer cases judged on supplier calls: most have no counterpart."""
    expectations = X.derive_expectations(customers(t), index=False)
    return V.verify(expectations, billing(t.supplier, "s_acctbal", "s_suppkey")).select("seq", "reason")


@query(
    "duplicate_cases",
    "SELECT l_orderkey AS seq, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_cases(t: Tables) -> DataFrame:
    return V.duplicate_cases(billing(t.lineitem, "l_tax", "l_orderkey")).select("seq", "n_rows")


REPLACED_SQL = """
WITH kept AS (SELECT c_mktsegment AS module, c_custkey AS seq, c_acctbal * CAST(1.05 AS DOUBLE) AS v, c_acctbal > 0 AS ok
              FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')),
new AS (SELECT 'BUILDING' AS module, s_suppkey AS seq, s_acctbal * CAST(1.05 AS DOUBLE) AS v, s_acctbal > 0 AS ok FROM supplier)
SELECT module, seq, CASE WHEN ok THEN v END AS output FROM (SELECT * FROM kept UNION ALL SELECT * FROM new)"""


def replacement(t: Tables) -> DataFrame:
    return billing(t.supplier, "s_acctbal", "s_suppkey", "BUILDING")


@query("replace_module", REPLACED_SQL)
def replace_module(t: Tables) -> DataFrame:
    """Two modules are captured again; one of them has no record any more."""
    again = t.customer.select(F.col("c_mktsegment").alias("module")).where("module IN ('BUILDING', 'MACHINERY')")
    merged = store.replaced(by_segment(t), replacement(t), again)
    return merged.selectExpr("module", "seq", "out_double AS output")


@query("replace_module_store", REPLACED_SQL)
def replace_module_store(t: Tables) -> DataFrame:
    """The same on disk: write, overwrite two modules, scan."""
    path = shared_dir(t.spark, "captures")
    by_segment(t).write.partitionBy("module").parquet(path)
    store.write_modules(replacement(t), path, ["BUILDING", "MACHINERY"])
    return store.scan_captures(t.spark, path).selectExpr("module", "seq", "out_double AS output")


@query(
    "scan_module",
    """
SELECT c_custkey AS seq, CASE WHEN c_acctbal > 0 THEN 'approx' ELSE 'raises' END AS assertion FROM customer WHERE c_mktsegment = 'FURNITURE'""",
)
def scan_module(t: Tables) -> DataFrame:
    """Suites are stored per module, each replaced on its own; one is read back by partition pruning."""
    path = shared_dir(t.spark, "suites")
    store.write_modules(X.derive_expectations(by_segment(t), index=False), path, ["BUILDING", "FURNITURE"])
    store.write_modules(X.derive_expectations(changed_by_segment(t), index=False), path, ["BUILDING"])
    return store.scan_expectations(t.spark, path, "FURNITURE").select("seq", "assertion")


@query(
    "override_cases",
    """
SELECT c_custkey AS seq, CASE WHEN s_suppkey IS NOT NULL THEN 'not_null' WHEN c_acctbal > 0 THEN 'approx' ELSE 'raises' END AS assertion
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey AND c_acctbal > 0 AND s_acctbal > 0""",
)
def override_cases(t: Tables) -> DataFrame:
    """Hand-written cases (here: one per supplier) take the place of derived ones of the same name."""
    auto = X.derive_expectations(customers(t), index=False)
    written = X.derive_expectations(billing(t.supplier, "s_acctbal", "s_suppkey").where("status = 'success'"), index=False)
    written = written.join(auto.select("case_name"), "case_name", "left_semi").withColumn("assertion", F.lit("not_null"))
    return X.override_cases(auto, written.select(*EXPECTATION_COLUMNS)).select("seq", "assertion")


@query(
    "word_expectations",
    """
SELECT p_partkey AS seq, f AS function, CASE f WHEN 'has_player_won' THEN 'is_bool' ELSE 'equal' END AS assertion
FROM part, (VALUES ('has_player_won'), ('get_word_progress'), ('unique_letters')) AS v(f)""",
)
def word_expectations(t: Tables) -> DataFrame:
    return X.derive_expectations(native_words(t), index=False).select("seq", "function", "assertion")
