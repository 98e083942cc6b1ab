"""Queries over logs, source texts, probe inputs and transcripts, rendered from the tables at hand.

The texts are built by SQL both engines read, so the statements work on the same strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import inventory as I
from ..operators import probes as P
from ..operators import transcript as T
from ..session import shared_dir, spread
from ..sources import files, logs
from ..streaming import capture_stream as stream
from .registry import Tables, query

_SUCCESS = """concat('{"function": "score", "inputs": {"args": [', CAST(value AS STRING), ', "', event_type, '"], "kwargs": {}}, "status": "success", "output": ', CAST(value AS STRING), ', "error": null}')"""

LINE = f"""
CASE event_id % 9
  WHEN 0 THEN 'Loading word list from file...'
  WHEN 1 THEN {_SUCCESS}
  WHEN 2 THEN concat('{{"function": "score", "inputs": {{"args": [null], "kwargs": {{}}}}, "status": "crashed", "output": null, "error": "ValueError: bad ', event_type, '", "traceback": "Traceback"}}')
  WHEN 3 THEN '{{"function": "score", "inputs": {{"args": [], "kwargs": {{}}}}, "status": "success", "output": NaN, "error": null}}'
  WHEN 4 THEN '{{"error": "Function zz not found."}}'
  WHEN 5 THEN '{{broken}}'
  WHEN 6 THEN concat('   ', {_SUCCESS}, chr(9))
  WHEN 7 THEN concat({_SUCCESS}, {_SUCCESS})
  ELSE props
END"""

LINES_SQL = f"""
WITH lines AS (SELECT event_type AS module, event_id AS line_no, event_id % 9 AS form, value, {LINE} AS line FROM events),
records AS (SELECT module, line_no, form, value,
    CASE WHEN form IN (1, 2, 3, 6) THEN 'score' END AS function,
    CASE WHEN form IN (1, 3, 6) THEN 'success' WHEN form = 2 THEN 'crashed' END AS status,
    CASE form WHEN 2 THEN concat('ValueError: bad ', module) WHEN 4 THEN 'Function zz not found.' END AS error
  FROM lines WHERE form IN (1, 2, 3, 4, 6, 8))
"""


def capture_lines(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_type").alias("module"), F.col("event_id").alias("line_no"), F.expr(LINE).alias("line")
    )


@query(
    "parse_capture_log",
    LINES_SQL
    + """
SELECT module, line_no, function, status, error, CASE WHEN form IN (1, 6) THEN value END AS output, form = 3 AS is_nan,
       CASE WHEN form IN (1, 6) THEN 2 WHEN form = 2 THEN 1 WHEN form = 3 THEN 0 END AS n_args FROM records""",
)
def parse_capture_log(t: Tables) -> DataFrame:
    number = F.try_variant_get("output", "$", "double")
    is_nan = F.coalesce(F.isnan(number), F.lit(False))
    return logs.parse_capture_log(capture_lines(t)).select(
        "module",
        "line_no",
        "function",
        "status",
        "error",
        F.when(~is_nan, number).alias("output"),
        is_nan.alias("is_nan"),
        F.when(F.col("args").isNotNull(), F.size("args")).alias("n_args"),
    )


FROM_LOG_SQL = """
SELECT module, line_no AS seq, function, CASE WHEN status = 'success' THEN 'success' ELSE 'crashed' END AS status,
       CASE WHEN status = 'success' THEN NULL WHEN form = 2 THEN 'ValueError' WHEN form = 4 THEN 'Function zz not found.' ELSE 'Exception' END AS error_class,
       CASE WHEN form = 3 THEN 'NaN' WHEN form IN (1, 6) THEN CAST(value AS VARCHAR) END AS out_json,
       CASE WHEN form IN (1, 6) THEN 2 WHEN form = 2 THEN 1 ELSE 0 END AS n_args FROM records"""


@query("captures_from_log", LINES_SQL + FROM_LOG_SQL)
def captures_from_log(t: Tables) -> DataFrame:
    found = logs.captures_from_log(capture_lines(t))
    return found.select(
        "module", "seq", "function", "status", "error_class", "out_json", F.size("arg_json").alias("n_args")
    )


@query("corrupt_lines", LINES_SQL + "SELECT module, line_no, line FROM lines WHERE form IN (5, 7)")
def corrupt_lines(t: Tables) -> DataFrame:
    return logs.corrupt_lines(capture_lines(t))


@query(
    "silent_logs",
    LINES_SQL
    + "SELECT line_no, left(concat(repeat(concat('start', chr(10)), 90), line), 500) AS preview FROM lines WHERE form IN (0, 5, 7)",
)
def silent_logs(t: Tables) -> DataFrame:
    opening = F.repeat(F.lit("start\n"), 90)
    runs = capture_lines(t).select("line_no", F.concat(opening, "line").alias("log"))
    return logs.silent_logs(runs)


@query(
    "log_lines",
    """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, CAST(max(length(line)) AS INTEGER) AS longest FROM l GROUP BY doc_id""",
)
def log_lines(t: Tables) -> DataFrame:
    lines = logs.log_lines(t.documents, text="text", module="doc_id")
    return lines.groupBy(F.col("module").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.max(F.length("line")).alias("longest")
    )


TEST_LINE = """
CASE event_type
  WHEN 'error' THEN concat('suite.py::test_', CAST(event_id AS STRING), ' FAILED [ 50%]')
  WHEN 'view' THEN concat('___ ERROR collecting test_', CAST(event_id AS STRING), ' ___')
  WHEN 'signup' THEN concat('FAILED suite.py::test_', CAST(event_id AS STRING))
  WHEN 'purchase' THEN concat('test_a PASSED test_', CAST(event_id AS STRING), ' PASSED')
  ELSE concat('suite.py::test_', CAST(event_id AS STRING), ' PASSED [100%]')
END"""
COUNTS_SQL = """
(length(line) - length(replace(line, ' PASSED', ''))) // 7 AS passed,
(length(line) - length(replace(line, ' FAILED', ''))) // 7 AS failed,
(length(line) - length(replace(line, ' ERROR', ''))) // 6 AS errors"""
TEST_LINES_SQL = f"""
WITH lines AS (SELECT event_id, event_type, user_id, {TEST_LINE} AS line FROM events),
counted AS (SELECT event_id, user_id, line, {COUNTS_SQL} FROM lines)
"""


@query("count_outcomes", TEST_LINES_SQL + "SELECT event_id, passed, failed, errors FROM counted")
def count_outcomes(t: Tables) -> DataFrame:
    return t.events.select("event_id", *logs.count_outcomes(F.expr(TEST_LINE)))


@query(
    "log_suites",
    TEST_LINES_SQL
    + """
SELECT CAST(user_id AS VARCHAR) AS module, CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(failed + errors) AS BIGINT) AS failed,
       CASE WHEN sum(failed + errors) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM counted GROUP BY user_id""",
)
def log_suites(t: Tables) -> DataFrame:
    lines = t.events.select(F.col("user_id").cast("string").alias("module"), F.expr(TEST_LINE).alias("line"))
    return logs.log_suites(lines)


@query(
    "log_tails",
    TEST_LINES_SQL
    + """
SELECT CAST(user_id AS VARCHAR) AS module, right(string_agg(line, chr(10) ORDER BY event_id), 300) AS detail
FROM counted GROUP BY user_id""",
)
def log_tails(t: Tables) -> DataFrame:
    lines = t.events.select(
        F.col("user_id").cast("string").alias("module"),
        F.col("event_id").alias("line_no"),
        F.expr(TEST_LINE).alias("line"),
    )
    return logs.log_tail(lines, logs.TAIL_PASSED)


RUN_LOG = f"""
CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat(repeat(concat('collected item', chr(10)), CAST(event_id % 50 AS INT)), {TEST_LINE}) END"""


@query(
    "suite_results",
    f"""
WITH runs AS (SELECT event_id, concat('Timeout: ', repeat(event_type, 60)) AS fault, {RUN_LOG} AS line FROM events),
counted AS (SELECT event_id, fault, line, {COUNTS_SQL} FROM runs)
SELECT event_id, passed, failed + errors AS failed,
       CASE WHEN line IS NULL THEN 'ERROR' WHEN failed + errors = 0 THEN 'PASSED' ELSE 'FAILED' END AS status,
       CASE WHEN line IS NULL THEN left(fault, 200) WHEN failed + errors = 0 THEN right(line, 300) ELSE right(line, 500) END AS detail
FROM counted""",
)
def suite_results(t: Tables) -> DataFrame:
    runs = t.events.select(
        "event_id",
        F.concat(F.lit("Timeout: "), F.repeat("event_type", 60)).alias("fault"),
        F.expr(RUN_LOG).alias("log"),
    )
    return logs.suite_results(runs)


RUN_TEXT = """
CASE event_id % 5
  WHEN 0 THEN concat('Execution Successful. Output Logs:', chr(10), props, chr(10), event_type)
  WHEN 1 THEN concat('Execution Failed with Exit Code ', CAST(event_id % 7 - 2 AS STRING), '.', chr(10), 'Error Logs:', chr(10), event_type)
  WHEN 2 THEN concat('Sandbox Fault: Could not execute environment. ', event_type)
  WHEN 3 THEN concat('System Error: ', event_type)
  ELSE props
END"""


@query(
    "run_outcome",
    """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' WHEN 2 THEN 'fault' WHEN 3 THEN 'system_error' ELSE 'unknown' END AS kind,
       CAST(CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN event_id % 7 - 2 END AS INTEGER) AS exit_code,
       CASE event_id % 5 WHEN 0 THEN concat(props, chr(10), event_type) WHEN 1 THEN event_type
         WHEN 2 THEN concat('Could not execute environment. ', event_type) WHEN 3 THEN event_type ELSE props END AS body
FROM events""",
)
def run_outcome(t: Tables) -> DataFrame:
    return t.events.select("event_id", *logs.run_outcome(F.expr(RUN_TEXT)))


STREAM_SQL = LINES_SQL + FROM_LOG_SQL.replace("line_no AS seq, ", "")


@query("capture_stream", STREAM_SQL)
def capture_stream(t: Tables) -> DataFrame:
    """Log lines land as files, one stream run picks up all of them, the store is read back."""
    root = shared_dir(t.spark, "stream")
    capture_lines(t).select("module", "line").write.partitionBy("module").text(f"{root}/logs")
    module = F.regexp_extract("_metadata.file_path", r"/module=([^/]+)/", 1)
    lines = stream.log_stream(t.spark, f"{root}/logs", module)
    stream.capture_stream(lines, f"{root}/captures", f"{root}/checkpoint").awaitTermination()
    found = t.spark.read.parquet(f"{root}/captures")
    return found.select("module", "function", "status", "error_class", "out_json", F.size("arg_json").alias("n_args"))


@query(
    "module_name",
    "SELECT page_id, replace(list_extract(string_split(concat(url, '.pyx.py'), '/'), -1), '.py', '') AS module FROM pages",
)
def module_name(t: Tables) -> DataFrame:
    path = F.concat("url", F.lit(".pyx.py"))
    return t.pages.select("page_id", files.module_name(path).alias("module"))


PATH = """
CASE p_partkey % 10
  WHEN 0 THEN concat('src/__pycache__/m', CAST(p_partkey AS STRING), '.py')
  WHEN 1 THEN concat('src/p', CAST(p_partkey AS STRING), '/__init__.py')
  ELSE concat('src/', p_brand, '/m', CAST(p_partkey AS STRING), '.py')
END"""
_SECOND = "concat(chr(10), 'def second_', CAST(p_partkey AS STRING), '():', chr(10), '    return 1', chr(10))"
SOURCE = f"""
concat('# ', p_name, chr(10), CASE p_size % 6
  WHEN 0 THEN concat('def price(a, b):', chr(10), '    return a', {_SECOND})
  WHEN 1 THEN concat('def ask(q):', chr(10), '    return input(q)', {_SECOND})
  WHEN 2 THEN concat('def outer(x):', chr(10), '    def inner(y):', chr(10), '        return input(y)', chr(10), '    return inner', {_SECOND})
  WHEN 3 THEN concat('async def go(a):', chr(10), '    pass', chr(10), 'class C:', chr(10), '    def m(self):', chr(10), '        pass', {_SECOND})
  WHEN 4 THEN concat('def kw(a, /, b, *args, c=1, **k):', chr(10), '    return b.input()', {_SECOND})
  ELSE 'def broken(:'
END)"""

# What each rendered source defines.
FUNCTIONS_SQL = f"""
WITH sources AS (SELECT * FROM (SELECT p_partkey, p_size % 6 AS form, {PATH} AS path,
    concat('m', CAST(p_partkey AS STRING)) AS module FROM part)
    WHERE NOT contains(path, '__pycache__') AND NOT suffix(path, '/__init__.py')),
first AS (SELECT *, CASE form WHEN 0 THEN 'price' WHEN 1 THEN 'ask' WHEN 2 THEN 'outer' WHEN 4 THEN 'kw' END AS function,
    CASE form WHEN 0 THEN 'a,b' WHEN 1 THEN 'q' WHEN 2 THEN 'x' WHEN 4 THEN 'b' END AS args, form IN (0, 4) AS testable
    FROM sources WHERE form IN (0, 1, 2, 4)),
functions AS (
  SELECT path, module, 0 AS seq, function, args, testable FROM first
  UNION ALL SELECT path, module, CASE WHEN form = 3 THEN 0 ELSE 1 END, concat('second_', p_partkey), '', true FROM sources WHERE form < 5)
"""


def sources(t: Tables) -> DataFrame:
    return files.as_sources(spread(t.part).select(F.expr(PATH).alias("path"), F.expr(SOURCE).alias("source")))


def found_functions(t: Tables) -> DataFrame:
    return I.function_inventory(sources(t))


# One file for each part: names that Spark's file sources hide, empty files, and some that are no sources.
FILE_PATH = """concat(replace(p_brand, '#', ' #'), CASE p_partkey % 5 WHEN 0 THEN '/_m' WHEN 1 THEN '/_lib/m' ELSE '/m' END,
    CAST(p_partkey AS STRING), CASE p_partkey % 11 WHEN 0 THEN '.txt' WHEN 1 THEN '/__init__.py' WHEN 2 THEN '/__pycache__/c.py' ELSE '.py' END)"""
FILE_SOURCE = "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('def price(a):', chr(10), '    return a  # ', p_name, chr(10)) END"


@query(
    "source_files",
    f"""
SELECT path, replace(regexp_extract(path, '[^/]*$'), '.py', '') AS module, length(source) AS chars, md5(source) AS source_md5
FROM (SELECT {FILE_PATH} AS path, {FILE_SOURCE} AS source FROM part)
WHERE NOT contains(path, '__pycache__') AND NOT suffix(path, '/__init__.py') AND suffix(path, '.py')""",
)
def source_files(t: Tables) -> DataFrame:
    folder = shared_dir(t.spark, "files")
    files.write_files(t.part.select(F.expr(FILE_PATH).alias("path"), F.expr(FILE_SOURCE).alias("source")), folder)
    found = files.source_files(t.spark, folder)
    return found.select("path", "module", F.char_length("source").cast("bigint").alias("chars"), F.md5("source").alias("source_md5"))


@query(
    "source_table",
    f"""
SELECT path, concat('m', CAST(p_partkey AS STRING)) AS module, source
FROM (SELECT p_partkey, {PATH} AS path, {SOURCE} AS source FROM part)
WHERE NOT contains(path, '__pycache__') AND NOT suffix(path, '/__init__.py')""",
)
def source_table(t: Tables) -> DataFrame:
    return sources(t)


@query(
    "function_inventory",
    FUNCTIONS_SQL
    + "SELECT path, module, seq, function, args, testable, CASE WHEN testable THEN 'ok' ELSE 'uses input()' END AS reason FROM functions",
)
def function_inventory(t: Tables) -> DataFrame:
    return found_functions(t).withColumn("args", F.array_join("args", ","))


@query(
    "inventory_summary",
    FUNCTIONS_SQL
    + "SELECT path, count(*) FILTER (testable) AS testable, count(*) FILTER (NOT testable) AS skipped FROM functions GROUP BY path",
)
def inventory_summary(t: Tables) -> DataFrame:
    return I.inventory_summary(found_functions(t))


@query("syntax_errors", FUNCTIONS_SQL + "SELECT path, module FROM sources WHERE form = 5")
def syntax_errors(t: Tables) -> DataFrame:
    return I.syntax_errors(sources(t))


CAPTURED = """
concat(CASE WHEN p_retailprice > 1000 THEN 'second_' ELSE 'ghost_' END, CAST(p_partkey AS STRING))"""
GAP_SQL = (
    FUNCTIONS_SQL
    + f""",
captured AS (SELECT DISTINCT concat('m', CAST(p_partkey AS STRING)) AS module, {CAPTURED} AS function FROM part),
gaps AS (SELECT module, function, 'uncaptured' AS gap FROM functions f WHERE testable
           AND NOT EXISTS (SELECT 1 FROM captured c WHERE c.module = f.module AND c.function = f.function)
         UNION ALL SELECT module, function, 'undefined' FROM captured c
           WHERE NOT EXISTS (SELECT 1 FROM functions f WHERE c.module = f.module AND c.function = f.function))
"""
)


def gaps(t: Tables) -> DataFrame:
    captured = t.part.select(
        F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("module"), F.expr(CAPTURED).alias("function")
    )
    return I.coverage_gap(found_functions(t), captured)


@query("coverage_gap", GAP_SQL + "SELECT * FROM gaps")
def coverage_gap(t: Tables) -> DataFrame:
    return gaps(t)


@query(
    "validation_issues",
    GAP_SQL
    + """
SELECT module, concat('test_', function) AS test_name, CASE gap WHEN 'uncaptured' THEN 'Missing Coverage' ELSE 'Hallucination' END AS issue_type,
       CASE gap WHEN 'uncaptured' THEN concat('No case covers ', function, '.') ELSE concat('Function ', function, ' not found.') END AS description
FROM gaps
UNION ALL SELECT module, concat('test_', module), 'Syntax Error', concat('Source ', path, ' does not parse.') FROM sources WHERE form = 5""",
)
def validation_issues(t: Tables) -> DataFrame:
    return I.validation_issues(gaps(t), I.syntax_errors(sources(t)))


@query(
    "default_probes",
    FUNCTIONS_SQL
    + """
SELECT module, function, CAST(c.i AS INTEGER) AS case_seq, CASE WHEN args = '' THEN '' ELSE regexp_replace(args, '[a-z]', c.v, 'g') END AS arg_json
FROM functions, (VALUES (0, '0'), (1, '1'), (2, '-1')) AS c(i, v) WHERE testable AND (args <> '' OR c.i = 0)""",
)
def default_probes(t: Tables) -> DataFrame:
    probes = P.default_probes(found_functions(t).where("testable"))
    return probes.withColumn("arg_json", F.array_join("arg_json", ","))


def shown_inputs() -> Column:
    """Argument tuples as one text."""
    return F.array_join(F.transform("inputs", lambda c: F.concat(F.lit("("), F.array_join(c, "|"), F.lit(")"))), ";")


RAW_INPUTS = """
CASE o_orderkey % 6
  WHEN 0 THEN concat('[[', CAST(o_custkey AS STRING), '], [2]]')
  WHEN 1 THEN concat('[', CAST(o_custkey AS STRING), ', 2.5, 1.0, "x", null, true]')
  WHEN 2 THEN concat('[[1, "', o_orderstatus, '"], [2, "b"], 7]')
  WHEN 3 THEN '[]'
  WHEN 4 THEN '[[[1, 2.0]], [1, 2, 3]]'
  ELSE concat('[[], {"k": ', CAST(o_custkey AS STRING), '}]')
END"""
INPUTS_SQL = """
CASE form
  WHEN 0 THEN concat('(', c, ');(2)')
  WHEN 1 THEN CASE n WHEN 1 THEN concat('(', c, ');(2.5);(1.0);("x");(null);(true)') ELSE '' END
  WHEN 2 THEN CASE n WHEN 1 THEN concat('([1, "', s, '"]);([2, "b"]);(7)') ELSE concat('(1|"', s, '");(2|"b")') END
  WHEN 3 THEN ''
  WHEN 4 THEN CASE n WHEN 1 THEN '([1, 2.0]);([1, 2, 3])' ELSE '([1, 2.0]);(1|2|3)' END
  ELSE CASE n WHEN 1 THEN concat('([]);({"k":', c, '})') ELSE '()' END
END"""


@query(
    "normalise_inputs",
    f"""
WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS form, 1 + o_custkey % 2 AS n, CAST(o_custkey AS VARCHAR) AS c, o_orderstatus AS s FROM orders)
SELECT o_orderkey, {INPUTS_SQL} AS inputs FROM o""",
)
def normalise_inputs(t: Tables) -> DataFrame:
    raw = spread(t.orders).select(
        "o_orderkey", (1 + F.col("o_custkey") % 2).alias("n"), P.parse_list(F.expr(RAW_INPUTS)).alias("raw")
    )
    listed = raw.select("o_orderkey", P.normalise_inputs(F.col("raw"), F.col("n")).alias("inputs"))
    return listed.select("o_orderkey", shown_inputs().alias("inputs"))


RESPONSE = """
CASE o_orderkey % 8
  WHEN 0 THEN concat('{"test_inputs": [[', CAST(o_custkey AS STRING), '], [2]]}')
  WHEN 1 THEN concat('```json', chr(10), '{"test_inputs": [', CAST(o_custkey AS STRING), ', 3]}', chr(10), '```')
  WHEN 2 THEN concat('  [[', CAST(o_custkey AS STRING), ']]  ')
  WHEN 3 THEN concat('{"note": "x", "test_inputs": null, "values": [', CAST(o_custkey AS STRING), '], "more": [9]}')
  WHEN 4 THEN concat('{''test_inputs'': [None, True, (', CAST(o_custkey AS STRING), ',)]}')
  WHEN 5 THEN concat('Sure, here is ', o_orderpriority)
  WHEN 6 THEN '{"test_inputs": []}'
  ELSE concat('```', chr(10), '[', CAST(o_custkey AS STRING), ']', chr(10), '```')
END"""


@query(
    "extract_inputs",
    """
WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS form, 1 + o_custkey % 2 AS n, CAST(o_custkey AS VARCHAR) AS c FROM orders)
SELECT o_orderkey, form IN (5, 6) AS fallback, CASE
    WHEN form = 0 THEN concat('(', c, ');(2)')
    WHEN form = 1 THEN CASE n WHEN 1 THEN concat('(', c, ');(3)') ELSE '' END
    WHEN form = 2 THEN concat('(', c, ')')
    WHEN form IN (3, 7) THEN CASE n WHEN 1 THEN concat('(', c, ')') ELSE '' END
    WHEN form = 4 THEN CASE n WHEN 1 THEN concat('(null);(true);(', c, ')') ELSE concat('(', c, ')') END
    WHEN n = 1 THEN '(0);(1);(-1)' ELSE '(0|0);(1|1);(-1|-1)' END AS inputs FROM o""",
)
def extract_inputs(t: Tables) -> DataFrame:
    responses = spread(t.orders).select(
        "o_orderkey", (1 + F.col("o_custkey") % 2).cast("int").alias("n_args"), F.expr(RESPONSE).alias("response")
    )
    return P.extract_inputs(responses).select("o_orderkey", "fallback", shown_inputs().alias("inputs"))


@query(
    "sample_probes",
    """
WITH calls AS (SELECT DISTINCT o_orderstatus AS s, o_totalprice AS p, o_orderpriority AS r FROM orders),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5(concat(CAST(p AS VARCHAR), '|', r)), p, r) AS hashed,
    row_number() OVER (PARTITION BY s ORDER BY p, r) AS low, row_number() OVER (PARTITION BY s ORDER BY p DESC, r DESC) AS high,
    row_number() OVER (PARTITION BY s ORDER BY r, p) AS first, row_number() OVER (PARTITION BY s ORDER BY r DESC, p DESC) AS last FROM calls)
SELECT s AS o_orderstatus, p AS o_totalprice, r AS o_orderpriority FROM ranked WHERE hashed <= 8 OR 1 IN (low, high, first, last)""",
)
def sample_probes(t: Tables) -> DataFrame:
    # md5 because both engines have it; the default order is a cheaper hash.
    order = F.md5(F.concat_ws("|", F.col("o_totalprice").cast("string"), "o_orderpriority"))
    return P.sample_probes(t.orders, ["o_totalprice", "o_orderpriority"], ["o_orderstatus"], 8, order)


LAST_SQL = """
WITH last AS (SELECT conv_id, max(turn) FILTER (role <> '' AND role <> 'system') AS last_turn,
    arg_max(role, turn) FILTER (role <> '' AND role <> 'system') AS last_author,
    arg_max(text, turn) FILTER (role <> '' AND role <> 'system') AS last_text FROM conversations GROUP BY conv_id)
"""


@query("last_message", LAST_SQL + "SELECT * FROM last")
def last_message(t: Tables) -> DataFrame:
    return T.last_message(t.conversations)


@query("is_terminated", LAST_SQL + "SELECT conv_id, coalesce(contains(last_text, 'la'), false) AS terminated FROM last")
def is_terminated(t: Tables) -> DataFrame:
    return T.is_terminated(t.conversations, "la")


@query(
    "turn_order_check",
    """
WITH e AS (SELECT conv_id, turn, role, CASE WHEN turn = 0 THEN 'system' WHEN turn = 1 THEN 'user' WHEN turn % 2 = 0 THEN 'assistant' ELSE 'user' END AS expected_role FROM conversations)
SELECT conv_id, turn, expected_role, role = expected_role AS in_order, turn < 6 AS within_limit FROM e""",
)
def turn_order_check(t: Tables) -> DataFrame:
    checked = T.turn_order_check(t.conversations, ["system", "user"], ["assistant", "user"], max_rounds=6)
    return checked.select("conv_id", "turn", "expected_role", "in_order", "within_limit")
