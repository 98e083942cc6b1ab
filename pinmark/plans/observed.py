"""Queries over observation and verification as a whole: from sources to captures, from stored suites to verdicts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import subjects as S
from ..functions.encode import DIGEST_LIMIT
from ..operators import capture as C
from ..operators import expect as X
from ..operators import observe as B
from ..operators import probes as P
from ..operators import verify as V
from ..operators.ordering import numbered
from ..session import shared_dir, spread
from ..sources import logs, store
from ..streaming import capture_stream as stream
from .captures import CHANGED_RATE, FUNCTION, billing, changed_billing
from .regression import compare_native, replay_python, replay_store, verify_store
from .registry import Tables, query
from .texts import FROM_LOG_SQL, FUNCTIONS_SQL, LINES_SQL, capture_lines, found_functions, shown_inputs, sources
from .verification import EXPECTED_SQL, asked_suites, by_segment, part_captures


def _price(a, b):
    return a


def _kw(b):
    return 10 // b


@query(
    "inventory_to_captures",
    FUNCTIONS_SQL
    + """,
counted AS (SELECT module, function, CASE WHEN function IN ('price', 'kw') THEN 3 ELSE 1 END AS records,
    CASE function WHEN 'price' THEN 3 WHEN 'kw' THEN 2 ELSE 0 END AS successes FROM functions WHERE testable)
SELECT module, CAST(sum(records) AS BIGINT) AS records, CAST(sum(successes) AS BIGINT) AS successes,
       CAST(sum(records - successes) AS BIGINT) AS crashes, string_agg(function, ', ' ORDER BY function) AS functions
FROM counted GROUP BY module""",
)
def inventory_to_captures(t: Tables) -> DataFrame:
    """Sources, their functions, default inputs, calls by name, summary; the second function of a source is not on offer."""
    probes = P.default_probes(found_functions(t).where("testable"))
    return C.capture_summary(B.capture_probes(probes, {"price": _price, "kw": _kw}))


@query(
    "capture_sources",
    FUNCTIONS_SQL
    + """,
calls AS (SELECT f.*, s.form, i FROM functions f JOIN sources s USING (path, module), (VALUES (0), (1), (2)) AS c(i)
          WHERE testable AND (args <> '' OR i = 0)),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY seq, i) - 1 AS BIGINT) AS place FROM calls)
SELECT module, place AS seq, function, CASE function WHEN 'kw' THEN 'crashed' ELSE 'success' END AS status,
       CASE function WHEN 'kw' THEN NULL WHEN 'price' THEN CASE i WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '-1' END ELSE '1' END AS out_json,
       CASE function WHEN 'kw' THEN 'kw() missing 1 required positional argument: ''b''' END AS error
FROM placed""",
)
def capture_sources(t: Tables) -> DataFrame:
    """What the source texts themselves do: the positional-only argument is not counted, so its function lacks one."""
    captured = B.capture_sources(sources(t))
    error = F.regexp_replace("error", "^TypeError: ", "")
    return captured.select("module", "seq", "function", "status", "out_json", error.alias("error"))


@query(
    "verify_store",
    """
WITH found AS (SELECT how, module, CASE WHEN module = 'billing' THEN 0 ELSE 1 END AS altered, c_acctbal AS v FROM customer,
    (VALUES ('joined'), ('replayed')) AS h(how), (VALUES ('billing'), ('billing_new')) AS m(module)),
suites AS (SELECT how, module, count(*) FILTER (altered = 0 OR v <= 5000) AS passed, count(*) FILTER (altered = 1 AND v > 5000) AS failed
           FROM found GROUP BY ALL)
SELECT how, module, passed, failed, CASE failed WHEN 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM suites
UNION ALL SELECT how, name, NULL, NULL, 'ERROR' FROM (SELECT DISTINCT o_orderpriority AS name FROM orders), (VALUES ('joined'), ('replayed')) AS h(how)""",
)
def verify_store_query(t: Tables) -> DataFrame:
    """Two stored suites whose functions share a name, verified by a join and by calls; order priorities are asked for, too."""
    both = billing(t.customer, "c_acctbal", "c_custkey").unionByName(changed_billing(t.customer, "c_acctbal", "c_custkey", "billing_new"))
    name = f"suites_{uuid.uuid4().hex}"
    cases = X.derive_expectations(both, index=False)
    store.write_bucketed(cases, name, 8, path=shared_dir(t.spark, "suites"))
    asked = t.orders.select(F.col("o_orderpriority").alias("module")).distinct().union(t.spark.range(1).select(F.explode(F.array(F.lit("billing"), F.lit("billing_new")))))
    fresh = billing(t.customer, "c_acctbal", "c_custkey").unionByName(billing(t.customer, "c_acctbal", "c_custkey", "billing_new"))
    joined = verify_store(t.spark, name, fresh, asked)
    functions = {("billing", FUNCTION): S.process_transaction_py, FUNCTION: lambda amount: S.process_transaction_py(amount)}
    replayed = replay_store(t.spark, name, functions, asked)
    return joined.withColumn("how", F.lit("joined")).unionByName(replayed.withColumn("how", F.lit("replayed")))


@query(
    "verify_negative_kinds",
    f"""
WITH e AS ({EXPECTED_SQL})
SELECT function, assertion, CASE assertion WHEN 'raises' THEN 'did_not_raise' ELSE 'mismatch' END AS reason, count(*) AS cases FROM e GROUP BY ALL""",
)
def verify_negative_kinds(t: Tables) -> DataFrame:
    """Each kind of assertion fails where the functions do something else."""
    name, size, price = F.col("p_name"), F.col("p_size"), F.col("p_retailprice")
    other = C.capture_native_many(
        t.part,
        {
            "first_letter": (C.Outcome(F.lit("##")), [name]),
            "larger": (C.Outcome(F.lit(-5)), [size]),
            "is_large": (C.Outcome(~(size > 25)), [size]),
            "price": (C.Outcome(price * 1.2 + 1), [price]),
            "ratio": (C.Outcome(F.lit(-1.0)), [price, size]),
            "name_length": (C.Outcome(F.length(name) + 1), [name]),
            "label": (C.Outcome(F.lit(None).cast("string")), [name, size]),
            "nothing": (C.Outcome(F.lit("something")), [name]),
            "sizes": (C.Outcome(F.array(size)), [size]),
        },
        module="parts",
        seq=F.col("p_partkey"),
    )
    results = V.verify(X.derive_expectations(part_captures(t), index=False), other)
    return results.groupBy("function", "assertion", "reason").agg(F.count(F.lit(1)).alias("cases"))


@query(
    "case_index_unnumbered",
    """
WITH c AS (SELECT c_mktsegment AS module, c_custkey, CASE WHEN c_acctbal > 0 THEN 'success' ELSE 'crash' END AS case_kind FROM customer)
SELECT module, c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS seq,
       row_number() OVER (PARTITION BY module, case_kind ORDER BY c_custkey) - 1 AS case_idx FROM c""",
)
def case_index_unnumbered(t: Tables) -> DataFrame:
    """Captures that were not numbered get their position first."""
    amount = F.col("c_acctbal")
    captured = C.capture_native(
        t.customer, S.process_transaction(amount), [amount], module=F.col("c_mktsegment"), function=FUNCTION, keep=["c_custkey"]
    )
    placed = X.with_seq(captured, ["c_custkey"])
    return X.derive_expectations(placed, index=True, keep=["c_custkey"]).select("module", "c_custkey", "seq", "case_idx")


@query(
    "ambiguous_cases",
    """
WITH o AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_quantity) AS d FROM lineitem GROUP BY 1)
SELECT CASE WHEN l_orderkey % 3 <> 0 THEN 'ok' WHEN d = 1 THEN 'mismatch' ELSE 'ambiguous' END AS reason, CAST(sum(n) AS BIGINT) AS cases
FROM o GROUP BY 1""",
)
def ambiguous_cases(t: Tables) -> DataFrame:
    """An order has several lines, so its key names several calls; each still gets one result."""
    key, quantity = F.col("l_orderkey"), F.col("l_quantity")
    more = F.when(key % 3 == 0, F.lit(1.0)).otherwise(F.lit(0.0))

    def lines(value):
        return C.capture_native(t.lineitem, C.Outcome(value), [key], module="orders", function="quantity", seq=key)

    results = V.verify_repeated(X.derive_expectations(lines(quantity), index=False), lines(quantity + more))
    return results.groupBy("reason").agg(F.count(F.lit(1)).alias("cases"))


# How long the JSON text of a document's text is.
LENGTH_SQL = r"""
2 + length(text) + (length(text) - length(regexp_replace(text, '["\\\n\r\t\x08\x0c]', '', 'g')))
  + 5 * (length(text) - length(regexp_replace(text, '[\x00-\x07\x0b\x0e-\x1f\x{7f}-\x{ffff}]', '', 'g')))
  + 11 * (length(text) - length(regexp_replace(text, '[\x{10000}-\x{10ffff}]', '', 'g')))"""


@query(
    "verify_long",
    f"""
SELECT doc_id, doc_id % 4 <> 0 OR text IS NULL AS exact,
       doc_id % 4 <> 0 OR text IS NULL OR {LENGTH_SQL} > {DIGEST_LIMIT} AS plain FROM documents""",
)
def verify_long(t: Tables) -> DataFrame:
    """Texts that differ at their end: the digest of a long one cannot tell, the stored hash can."""
    text = F.col("text")

    def texts(value):
        return C.capture_native(t.documents, C.Outcome(value), [F.col("doc_id")], module="documents", function="text", seq=F.col("doc_id"))

    cases = X.derive_expectations(texts(text), index=False)
    fresh = texts(F.when(F.col("doc_id") % 4 == 0, F.concat(text, F.lit("!"))).otherwise(text))
    exact = V.verify(cases, fresh, exact=True).select(F.col("seq").alias("doc_id"), F.col("passed").alias("exact"))
    plain = V.verify(cases, fresh).select(F.col("seq").alias("doc_id"), F.col("passed").alias("plain"))
    return exact.join(plain, "doc_id")


def _series(value, last) -> C.Outcome:
    """A list of 101 numbers with a NaN among them in every other row."""
    hole = F.when(F.col("event_id") % 2 == 1, F.lit(float("nan"))).otherwise(F.lit(0.0))
    steps = F.transform(F.sequence(F.lit(1), F.lit(99)), lambda i: value * i)
    return C.Outcome(F.concat(F.array(hole), steps, F.array(last)))


def _changed_end():
    value = F.col("value")
    return F.when(F.col("event_id") % 5 == 0, value + 1).otherwise(value)


@query(
    "compare_exact",
    """
SELECT event_type AS module, count(*) FILTER (event_id % 5 <> 0) AS passed, count(*) FILTER (event_id % 5 = 0) AS failed
FROM events GROUP BY event_type""",
)
def compare_exact(t: Tables) -> DataFrame:
    """Long lists that hold NaN, compared in place by their whole value."""
    value = F.col("value")
    results = compare_native(
        spread(t.events), _series(value, value), _series(value, _changed_end()), [F.col("event_id")],
        module=F.col("event_type"), function="series", seq=F.col("event_id"), exact=True,
    )
    return results.groupBy("module").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


@query(
    "behaviour_diff_long",
    """
SELECT event_type AS module, change, count(*) AS n FROM events, (VALUES ('added'), ('removed')) AS c(change)
WHERE event_id % 5 = 0 GROUP BY ALL""",
)
def behaviour_diff_long(t: Tables) -> DataFrame:
    value, rows = F.col("value"), spread(t.events)

    def series(last):
        return C.capture_native(rows, _series(value, last), [F.col("event_id")], module=F.col("event_type"), function="series", seq=F.col("event_id"))

    found = C.behaviour_diff(series(value), series(_changed_end()))
    return found.groupBy("module", "change").agg(F.sum("n").cast("bigint").alias("n"))


@query(
    "failure_sample_many",
    f"""
WITH c AS (SELECT l_returnflag AS module, l_orderkey AS seq, l_extendedprice AS v, l_extendedprice * CAST(1.05 AS DOUBLE) AS expected,
                  l_extendedprice * {CHANGED_RATE.format(v="l_extendedprice")} AS actual FROM lineitem)
SELECT module, seq FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY seq) AS r FROM c
    WHERE v > 0 AND abs(actual - expected) > greatest(1e-6 * abs(expected), 1e-12)) WHERE r <= 2000""",
)
def failure_sample_many(t: Tables) -> DataFrame:
    """More failing cases of each suite than Spark prunes to by itself."""
    amount = F.col("l_extendedprice")
    same = S.process_transaction(amount)
    rate = F.when(amount > 5000, F.lit(1.06)).otherwise(F.lit(S.RATE))
    results = compare_native(
        t.lineitem, same, C.Outcome(amount * rate, same.guards, same.given), [amount],
        module=F.col("l_returnflag"), function=FUNCTION, seq=F.col("l_orderkey"),
    )
    return V.failure_sample(results, 2000).select("module", "seq")


DEEP_INPUTS = """
CASE o_orderkey % 6
  WHEN 0 THEN '[[[[[[[1.0]]]]]]]'
  WHEN 1 THEN concat('[{"a": [2.0], "b": {"c": NaN, "d": ', CAST(o_custkey AS STRING), '}}]')
  WHEN 2 THEN '[[1, {"k": [1.0, [2.5, true]]}]]'
  WHEN 3 THEN '[[[1, "é/y"], [[2.0, null]]], 1e400]'
  WHEN 4 THEN '[[12345678901234567890123, [[-1.50]]]]'
  ELSE concat('[[7, ', CAST(o_custkey AS STRING), ']]')
END"""


@query(
    "deep_inputs",
    r"""
WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS form, 1 + o_custkey % 2 AS n, CAST(o_custkey AS VARCHAR) AS c FROM orders)
SELECT o_orderkey, CASE form
    WHEN 0 THEN '([[[[[1.0]]]]])'
    WHEN 1 THEN CASE n WHEN 1 THEN concat('({"a":[2.0],"b":{"c":NaN,"d":', c, '}})') ELSE '' END
    WHEN 2 THEN CASE n WHEN 1 THEN '([1, {"k":[1.0, [2.5, true]]}])' ELSE '(1|{"k":[1.0, [2.5, true]]})' END
    WHEN 3 THEN CASE n WHEN 1 THEN '([[1, "é/y"], [[2.0, null]]]);(Infinity)' ELSE '([1, "é/y"]|[[2.0, null]])' END
    WHEN 4 THEN CASE n WHEN 1 THEN '([12345678901234567890123, [[-1.5]]])' ELSE '(12345678901234567890123|[[-1.5]])' END
    ELSE CASE n WHEN 1 THEN concat('([7, ', c, '])') ELSE concat('(7|', c, ')') END END AS inputs FROM o""",
)
def deep_inputs(t: Tables) -> DataFrame:
    raw = t.orders.select("o_orderkey", (1 + F.col("o_custkey") % 2).alias("n"), P.parse_list(F.expr(DEEP_INPUTS)).alias("raw"))
    return raw.select("o_orderkey", P.normalise_inputs(F.col("raw"), F.col("n")).alias("inputs")).select("o_orderkey", shown_inputs().alias("inputs"))


NUMBERED_SQL = (
    LINES_SQL
    + """,
placed AS (SELECT module, line_no, row_number() OVER (ORDER BY module, line_no) - 1 AS seq FROM lines),
found AS ("""
    + FROM_LOG_SQL.replace("line_no AS seq, ", "line_no, ")
    + """)
"""
)


# A range that holds the end of a module makes a file more; a batch of the stream takes 1,000.
LOG_RANGES = 400


def streamed(t: Tables) -> tuple[str, DataFrame]:
    """Log lines of each module as files, in order, and the stream that reads them.

    Lines are dealt out by ranges of module and line, so a module may have any number of lines; its files go by the number
    of their range. They must be few enough for one batch, as batches take files by their age.
    """
    root = shared_dir(t.spark, "stream")
    ranges = min(int(t.spark.conf.get("spark.sql.shuffle.partitions")), LOG_RANGES)
    ordered = capture_lines(t).repartitionByRange(ranges, "module", "line_no").sortWithinPartitions("module", "line_no").select("module", "line")
    ordered.write.partitionBy("module").text(f"{root}/logs")
    return root, stream.log_stream(t.spark, f"{root}/logs", F.regexp_extract("_metadata.file_path", r"/module=([^/]+)/", 1))


@query("stream_numbered", NUMBERED_SQL + "SELECT module, seq, function, status, error_class FROM found JOIN placed USING (module, line_no)")
def stream_numbered(t: Tables) -> DataFrame:
    """Records of a stream know their position in it."""
    root, lines = streamed(t)
    stream.capture_stream(lines, f"{root}/captures", f"{root}/checkpoint", number=True).awaitTermination()
    return t.spark.read.parquet(f"{root}/captures").select("module", "seq", "function", "status", "error_class")


@query(
    "stream_verified",
    NUMBERED_SQL
    + """
SELECT module, CASE WHEN status = 'success' AND out_json <> 'NaN' AND seq % 3 = 0 THEN 'mismatch' ELSE 'ok' END AS reason, count(*) AS cases
FROM found JOIN placed USING (module, line_no) GROUP BY ALL""",
)
def stream_verified(t: Tables) -> DataFrame:
    """Stored expectations, some of them altered, judged while the lines of a fresh run arrive."""
    known = logs.captures_from_log(numbered(capture_lines(t), "line_no", ["module", "line_no"]))
    cases = X.derive_expectations(known, index=False)
    altered = F.when((F.col("seq") % 3 == 0) & (F.col("assertion") == "approx"), F.col("exp_double") + 1).otherwise(F.col("exp_double"))
    cases = cases.withColumns({"exp_double": altered, "exp_key": F.when((F.col("seq") % 3 == 0) & F.col("assertion").isin("member", "equal"), F.lit('"?"')).otherwise(F.col("exp_key"))})
    root, lines = streamed(t)
    stream.verify_stream(lines, cases, f"{root}/results", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/results").groupBy("module", "reason").agg(F.count(F.lit(1)).alias("cases"))


def _signed(amount, day, at):
    if amount == 0:
        raise ZeroDivisionError(S.DIVISION)
    return amount if day.month > 6 and at.date() == day else -amount


@query(
    "replay_typed",
    """
SELECT 'equal' AS assertion, CASE WHEN month(o_orderdate) > 6 THEN 'ok' ELSE 'mismatch' END AS reason, count(*) AS cases
FROM orders GROUP BY ALL""",
)
def replay_typed(t: Tables) -> DataFrame:
    """Decimals, dates and times reach the function as such again; a rewrite forgets the sign."""
    typed = t.orders.select(
        "o_orderkey",
        F.col("o_totalprice").cast("decimal(14,3)").alias("amount"),
        F.to_date("o_orderdate").alias("day"),
        F.col("o_orderdate").alias("at"),
    )
    captured = C.capture(typed, _signed, ["amount", "day", "at"], module="orders", function="signed", seq="o_orderkey")
    results = replay_python(X.derive_expectations(captured, index=False), {"signed": lambda amount, day, at: abs(_signed(amount, day, at))})
    return results.groupBy("assertion", "reason").agg(F.count(F.lit(1)).alias("cases"))
