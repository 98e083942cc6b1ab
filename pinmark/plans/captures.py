"""Queries over captures: what the sample functions do to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import subjects as S
from ..functions.encode import DIGEST_HEAD, DIGEST_LIMIT
from ..operators import capture as C
from ..operators import expect as X
from ..operators import rollup as R
from ..session import spread
from .registry import Tables, query

FUNCTION = "process_transaction"

# Renders amounts as the texts people type; read by both engines.
AMOUNT_TEXT = """
CASE event_id % 8
  WHEN 0 THEN concat('  ', CAST(value AS STRING), '  ')
  WHEN 1 THEN 'NaN'
  WHEN 2 THEN ''
  WHEN 3 THEN event_type
  WHEN 4 THEN NULL
  WHEN 5 THEN concat('-', CAST(value AS STRING))
  WHEN 6 THEN '0.0'
  ELSE CAST(value AS STRING)
END"""

ERROR_SQL = """
CASE
  WHEN {v} < 0 THEN 'ValueError: Transaction amount cannot be negative.'
  WHEN {v} = 0 THEN 'ZeroDivisionError: division by zero'
END"""


def billing(rows: DataFrame, amount: str, key: str, module="billing", rate: float = S.RATE) -> DataFrame:
    """Native captures of the billing function over one amount column."""
    outcome = S.process_transaction(F.col(amount), rate=rate)
    return C.capture_native(rows, outcome, [F.col(amount)], module=module, function=FUNCTION, seq=F.col(key))


def text_billing(t: Tables) -> DataFrame:
    amounts = t.events.withColumn("amount", F.expr(AMOUNT_TEXT))
    return C.capture_native(
        amounts,
        S.process_transaction(F.col("amount"), text=True),
        [F.col("amount")],
        module=F.col("event_type"),
        function=FUNCTION,
        seq=F.col("event_id"),
    )


TEXT_SQL = f"""
WITH amounts AS (SELECT event_id, event_type, {AMOUNT_TEXT} AS amount FROM events),
parsed AS (SELECT *, TRY_CAST(trim(amount) AS DOUBLE) AS v FROM amounts),
captured AS (
  SELECT event_id AS seq, event_type AS module, v, CASE
    WHEN amount IS NULL THEN 'TypeError: float() argument must be a string or a real number, not ''NoneType'''
    WHEN v IS NULL THEN concat('ValueError: could not convert string to float: ''', amount, '''')
    WHEN v < 0 THEN 'ValueError: Transaction amount cannot be negative.'
    WHEN v = 0 THEN 'ZeroDivisionError: division by zero' END AS error
  FROM parsed)
"""

_SHOWN = ["seq", "status", "out_double AS output", "error", "error_class"]


@query(
    "capture_billing",
    f"""
WITH c AS (SELECT c_custkey AS seq, c_acctbal AS v, {ERROR_SQL.format(v="c_acctbal")} AS error FROM customer)
SELECT seq, CASE WHEN error IS NULL THEN 'success' ELSE 'crashed' END AS status,
       CASE WHEN error IS NULL THEN v * CAST(1.05 AS DOUBLE) END AS output, error,
       split_part(error, ':', 1) AS error_class FROM c""",
)
def capture_billing(t: Tables) -> DataFrame:
    return billing(t.customer, "c_acctbal", "c_custkey").selectExpr(*_SHOWN)


LINEITEM_SQL = f"""
WITH c AS (SELECT l_orderkey AS seq, l_tax AS v, {ERROR_SQL.format(v="l_tax")} AS error FROM lineitem)
SELECT seq, CASE WHEN error IS NULL THEN 'success' ELSE 'crashed' END AS status,
       CASE WHEN error IS NULL THEN v * CAST(1.05 AS DOUBLE) END AS output, error,
       split_part(error, ':', 1) AS error_class FROM c"""


@query("capture_billing_lineitem", LINEITEM_SQL)
def capture_billing_lineitem(t: Tables) -> DataFrame:
    return billing(t.lineitem, "l_tax", "l_orderkey").selectExpr(*_SHOWN)


@query("capture_billing_udf", LINEITEM_SQL)
def capture_billing_udf(t: Tables) -> DataFrame:
    captured = C.capture(
        spread(t.lineitem), S.process_transaction_py, ["l_tax"], module="billing", function=FUNCTION, seq="l_orderkey"
    )
    return captured.selectExpr(*_SHOWN)


@query(
    "capture_text_amounts",
    TEXT_SQL
    + """
SELECT seq, module, CASE WHEN error IS NULL THEN 'success' ELSE 'crashed' END AS status, error,
       CASE WHEN error IS NULL AND NOT isnan(v) THEN v * CAST(1.05 AS DOUBLE) END AS output,
       error IS NULL AND isnan(v) AS is_nan FROM captured""",
)
def capture_text_amounts(t: Tables) -> DataFrame:
    is_nan = F.coalesce(F.isnan("out_double"), F.lit(False))
    return text_billing(t).select(
        "seq", "module", "status", "error", F.when(~is_nan, F.col("out_double")).alias("output"), is_nan.alias("is_nan")
    )


@query(
    "error_profile",
    TEXT_SQL
    + """
SELECT module, 'process_transaction' AS function, split_part(error, ':', 1) AS error_class, count(*) AS crashes
FROM captured WHERE error IS NOT NULL GROUP BY ALL""",
)
def error_profile(t: Tables) -> DataFrame:
    return C.error_profile(text_billing(t))


@query(
    "error_texts",
    TEXT_SQL
    + """
SELECT seq, split_part(error, ':', 1) AS error_class, trim(substr(error, strpos(error, ':') + 1)) AS error_message,
       concat('test_process_transaction_crash_', seq) AS case_name, length(error) > 500 AS is_digest
FROM captured WHERE error IS NOT NULL""",
)
def error_texts(t: Tables) -> DataFrame:
    error = F.col("error")
    crashed = text_billing(t).where("status = 'crashed'")
    return crashed.select(
        "seq",
        X.error_class(error).alias("error_class"),
        X.error_message(error).alias("error_message"),
        X.case_name(F.col("function"), F.lit("crash"), F.col("seq")).alias("case_name"),
        X.is_digest(error).alias("is_digest"),
    )


@query(
    "capture_summary",
    TEXT_SQL
    + """
SELECT module, count(*) AS records, count(*) FILTER (error IS NULL) AS successes,
       count(*) FILTER (error IS NOT NULL) AS crashes, 'process_transaction' AS functions
FROM captured GROUP BY module""",
)
def capture_summary(t: Tables) -> DataFrame:
    return C.capture_summary(text_billing(t))


def word_rows(t: Tables) -> DataFrame:
    """Part names as secret words; the letters of the type are the guesses."""
    letters = S.characters(F.lower("p_type"))
    return t.part.select("p_partkey", "p_brand", F.col("p_name").alias("word"), letters.alias("letters"))


WORDS_SQL = """
WITH words AS (SELECT p_partkey, p_brand, p_name AS word, regexp_extract_all(lower(p_type), '(?s).') AS letters,
                      regexp_extract_all(p_name, '(?s).') AS chars FROM part),
played AS (SELECT *, len(list_filter(chars, lambda c: NOT list_contains(letters, c))) = 0 AS won,
                  array_to_string(list_transform(chars, lambda c: CASE WHEN list_contains(letters, c) THEN c ELSE '_' END), '') AS progress,
                  len(list_distinct(chars)) AS n_unique FROM words)
"""

WORD_MANY_SQL = (
    WORDS_SQL
    + """
SELECT p_partkey AS seq, 'has_player_won' AS function, CASE WHEN won THEN 'true' ELSE 'false' END AS out_json FROM played
UNION ALL SELECT p_partkey, 'get_word_progress', concat('"', progress, '"') FROM played
UNION ALL SELECT p_partkey, 'unique_letters', CAST(n_unique AS VARCHAR) FROM played"""
)


def native_words(t: Tables, module="word_game") -> DataFrame:
    word, letters = F.col("word"), F.col("letters")
    return C.capture_native_many(
        word_rows(t),
        {
            "has_player_won": (S.has_player_won(word, letters), [word, letters]),
            "get_word_progress": (S.get_word_progress(word, letters), [word, letters]),
            "unique_letters": (S.unique_letters(word), [word]),
        },
        module=module,
        seq=F.col("p_partkey"),
    )


@query("capture_many", WORD_MANY_SQL)
def capture_many(t: Tables) -> DataFrame:
    return native_words(t).select("seq", "function", "out_json")


@query("capture_many_udf", WORD_MANY_SQL)
def capture_many_udf(t: Tables) -> DataFrame:
    captured = C.capture_many(
        word_rows(t),
        {
            "has_player_won": (S.has_player_won_py, ["word", "letters"]),
            "get_word_progress": (S.get_word_progress_py, ["word", "letters"]),
            "unique_letters": (S.unique_letters_py, ["word"]),
        },
        module="word_game",
        seq="p_partkey",
    )
    return captured.select("seq", "function", "out_json")


@query("word_won", WORDS_SQL + "SELECT p_partkey, won FROM played")
def word_won(t: Tables) -> DataFrame:
    return word_rows(t).select("p_partkey", S.has_player_won(F.col("word"), F.col("letters")).value.alias("won"))


@query("word_progress", WORDS_SQL + "SELECT p_partkey, progress FROM played")
def word_progress(t: Tables) -> DataFrame:
    progress = S.get_word_progress(F.col("word"), F.col("letters")).value
    return word_rows(t).select("p_partkey", progress.alias("progress"))


@query(
    "available_letters",
    WORDS_SQL
    + """
SELECT p_partkey, array_to_string(list_filter(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' '),
       lambda c: NOT list_contains(letters, c)), '') AS available FROM played""",
)
def available_letters(t: Tables) -> DataFrame:
    return word_rows(t).select("p_partkey", S.get_available_letters(F.col("letters")).value.alias("available"))


@query(
    "unique_letters",
    "SELECT doc_id, len(list_distinct(regexp_extract_all(text, '(?s).'))) AS n_unique FROM documents",
)
def unique_letters(t: Tables) -> DataFrame:
    return spread(t.documents).select("doc_id", S.unique_letters(F.col("text")).value.cast("bigint").alias("n_unique"))


FIRST_LINE_SQL = r"""
WITH lines AS (SELECT doc_id, regexp_extract_all(regexp_extract(text, '^[^\n\r]*'),
                      '[^\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+') AS words FROM documents)
"""


@query(
    "first_line_words",
    FIRST_LINE_SQL + "SELECT doc_id, len(words) AS n_words, array_to_string(words, ' ') AS words FROM lines",
)
def first_line_words(t: Tables) -> DataFrame:
    words = S.load_words(F.col("text"))
    return t.documents.select(
        "doc_id", F.size(words).cast("bigint").alias("n_words"), F.array_join(words, " ").alias("words")
    )


@query(
    "pick_word",
    FIRST_LINE_SQL
    + """
SELECT doc_id, CASE WHEN len(words) = 0 THEN 'IndexError: list index out of range' END AS error,
       len(words) > 0 AS is_member FROM lines""",
)
def pick_word(t: Tables) -> DataFrame:
    """The pick depends on a hash, so what is shown is that it comes from the list."""
    lines = t.documents.select("doc_id", S.load_words(F.col("text")).alias("words"))
    outcome = S.choose_word(F.col("words"), key=F.col("doc_id"))
    picked = C.capture_native(
        lines.withColumn("list", F.col("words")),
        outcome,
        [F.col("words")],
        module="word_game",
        function="choose_word",
        seq=F.col("doc_id"),
    )
    member = F.array_contains(F.get("arg_elem_keys", F.lit(0)), F.col("out_key"))
    return picked.select(F.col("seq").alias("doc_id"), "error", F.coalesce(member, F.lit(False)).alias("is_member"))


CANDIDATES_SQL = """
WITH c AS (SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(p_name, '(?s).'),
                  lambda x: contains(lower(p_type), x)), '') AS candidates FROM part)
"""


@query("revealed_candidates", CANDIDATES_SQL + "SELECT * FROM c")
def revealed_candidates(t: Tables) -> DataFrame:
    found = S.revealed_candidates(F.col("p_name"), F.lower("p_type"))
    return t.part.select("p_partkey", F.array_join(found, "").alias("candidates"))


@query(
    "revealed",
    CANDIDATES_SQL
    + """
SELECT p_partkey, candidates <> '' AS is_candidate,
       CASE WHEN candidates = '' THEN 'ValueError: empty range for randrange() (0, 0, 0)' END AS error FROM c""",
)
def revealed(t: Tables) -> DataFrame:
    word, pool = F.col("p_name"), F.lower("p_type")
    captured = C.capture_native(
        t.part,
        S.revealed(word, pool, key=F.col("p_partkey")),
        [word, pool],
        module="word_game",
        function="revealed",
        seq=F.col("p_partkey"),
        keep=["p_name", "p_type"],
    )
    letter = F.substring("out_key", 2, 1)
    fits = F.contains("p_name", letter) & F.contains(F.lower("p_type"), letter)
    return captured.select(
        F.col("seq").alias("p_partkey"), F.coalesce(fits, F.lit(False)).alias("is_candidate"), "error"
    )


@query(
    "digest_output",
    rf"""
WITH sized AS (SELECT doc_id, text, 2 + length(text)
    + (length(text) - length(regexp_replace(text, '["\\\n\r\t\x08\x0c]', '', 'g')))
    + 5 * (length(text) - length(regexp_replace(text, '[\x00-\x07\x0b\x0e-\x1f\x{{7f}}-\x{{ffff}}]', '', 'g')))
    + 11 * (length(text) - length(regexp_replace(text, '[\x{{10000}}-\x{{10ffff}}]', '', 'g'))) AS out_len
  FROM documents)
SELECT doc_id, CAST(out_len AS INTEGER) AS out_len,
       CASE WHEN out_len > {DIGEST_LIMIT} THEN concat(left(text, {DIGEST_HEAD}), '... [truncated]') END AS out_digest
FROM sized""",
)
def digest_output(t: Tables) -> DataFrame:
    captured = C.capture_native(
        spread(t.documents), C.Outcome(F.col("text")), [], module="documents", function="text", seq=F.col("doc_id")
    )
    return captured.select(F.col("seq").alias("doc_id"), "out_len", "out_digest")


@query(
    "digest_lists",
    rf"""
WITH split AS (SELECT doc_id, len(string_split(text, ' ')) AS n, replace(text, ' ', '') AS s FROM documents),
sized AS (SELECT doc_id, n, 2 + 2 * n + 2 * (n - 1) + length(s)
    + (length(s) - length(regexp_replace(s, '["\\\n\r\t\x08\x0c]', '', 'g')))
    + 5 * (length(s) - length(regexp_replace(s, '[\x00-\x07\x0b\x0e-\x1f\x{{7f}}-\x{{ffff}}]', '', 'g')))
    + 11 * (length(s) - length(regexp_replace(s, '[\x{{10000}}-\x{{10ffff}}]', '', 'g'))) AS out_len FROM split)
SELECT doc_id, CAST(out_len AS INTEGER) AS out_len,
       CASE WHEN out_len > {DIGEST_LIMIT} THEN concat('[list of ', n, ' items]') END AS out_digest FROM sized""",
)
def digest_lists(t: Tables) -> DataFrame:
    """Digest of list outputs: the words of a document."""
    captured = C.capture_native(
        spread(t.documents),
        C.Outcome(F.split("text", " ")),
        [],
        module="documents",
        function="words",
        seq=F.col("doc_id"),
    )
    return captured.select(F.col("seq").alias("doc_id"), "out_len", "out_digest")


@query(
    "bucket_by_function",
    WORDS_SQL
    + """
SELECT 'word_game' AS module, f AS function, count(*) AS successes, CAST(0 AS BIGINT) AS crashes, min(p_partkey) AS first_seq
FROM played, (VALUES ('has_player_won'), ('get_word_progress'), ('unique_letters')) AS v(f) GROUP BY f
UNION ALL
SELECT 'billing', 'process_transaction', count(*) FILTER (c_acctbal > 0), count(*) FILTER (c_acctbal <= 0), min(c_custkey) FROM customer""",
)
def bucket_by_function(t: Tables) -> DataFrame:
    return R.bucket_by_function(native_words(t).unionByName(billing(t.customer, "c_acctbal", "c_custkey")))


@query(
    "function_list",
    """
WITH seen AS (SELECT c_mktsegment AS module, 'late' AS function, min(c_custkey) + 1 AS first FROM customer GROUP BY 1
    UNION ALL SELECT c_mktsegment, 'early', min(c_custkey) FROM customer GROUP BY 1)
SELECT module, string_agg(function, ', ' ORDER BY first) AS functions FROM seen GROUP BY module""",
)
def function_list(t: Tables) -> DataFrame:
    calls = t.customer.select(F.col("c_mktsegment").alias("module"), "c_custkey")
    late = calls.select("module", F.lit("late").alias("function"), (F.col("c_custkey") + 1).alias("seq"), F.lit("success").alias("status"))
    early = calls.select("module", F.lit("early").alias("function"), F.col("c_custkey").alias("seq"), F.lit("success").alias("status"))
    return R.function_list(late.unionByName(early))


@query(
    "function_profile",
    """
WITH c AS (SELECT c_mktsegment AS module, c_custkey AS seq, c_acctbal AS v, c_acctbal > 0 AS ok FROM customer),
bucketed AS (SELECT *, CASE WHEN NOT ok THEN 'crash' WHEN v IN (0, -1) THEN 'edge' ELSE 'mapping' END AS bucket,
    CASE WHEN ok THEN v * CAST(1.05 AS DOUBLE) END AS out FROM c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY module, bucket ORDER BY seq) AS rn FROM bucketed)
SELECT module, 'process_transaction' AS function, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS crashes,
       min(out) AS min_output, max(out) AS max_output,
       coalesce(string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) FILTER (bucket = 'mapping' AND rn <= 5), '') AS mappings,
       coalesce(string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) FILTER (bucket = 'crash' AND rn <= 5), '') AS crash_seqs,
       coalesce(string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) FILTER (bucket = 'edge' AND rn <= 5), '') AS edge_seqs
FROM ranked GROUP BY module""",
)
def function_profile(t: Tables) -> DataFrame:
    captured = billing(t.customer, "c_acctbal", "c_custkey", module=F.col("c_mktsegment"))
    profile = R.function_profile(captured, 5)

    def places(column: str):
        return F.array_join(F.transform(column, lambda s: s["seq"].cast("string")), ",")

    return profile.select(
        "module",
        "function",
        "successes",
        "crashes",
        "min_output",
        "max_output",
        places("successful_mappings").alias("mappings"),
        places("crash_examples").alias("crash_seqs"),
        places("edge_cases").alias("edge_seqs"),
    )


@query(
    "distinct_calls",
    "SELECT l_tax, count(*) AS n_rows FROM lineitem GROUP BY l_tax",
)
def distinct_calls(t: Tables) -> DataFrame:
    return C.distinct_calls(t.lineitem, ["l_tax"])


CHANGED_RATE = "CASE WHEN {v} > 5000 THEN CAST(1.06 AS DOUBLE) ELSE CAST(1.05 AS DOUBLE) END"


def changed_billing(rows: DataFrame, amount: str, key: str, module="billing") -> DataFrame:
    """Captures of an altered billing function: large amounts get another rate."""
    same = S.process_transaction(F.col(amount))
    rate = F.when(F.col(amount) > 5000, F.lit(1.06)).otherwise(F.lit(S.RATE))
    altered = C.Outcome(F.col(amount) * rate, same.guards, same.given)
    return C.capture_native(rows, altered, [F.col(amount)], module=module, function=FUNCTION, seq=F.col(key))


@query(
    "behaviour_diff",
    f"""
WITH b AS (SELECT c_mktsegment AS module, c_acctbal AS v, CASE WHEN c_acctbal > 0 THEN c_acctbal * CAST(1.05 AS DOUBLE) END AS out FROM customer),
a AS (SELECT c_mktsegment AS module, c_acctbal AS v, CASE WHEN c_acctbal > 0 THEN c_acctbal * {CHANGED_RATE.format(v="c_acctbal")} END AS out FROM customer),
added AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b), removed AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
SELECT module, 'added' AS change, CAST(count(*) AS BIGINT) AS n FROM added GROUP BY module
UNION ALL SELECT module, 'removed', CAST(count(*) AS BIGINT) FROM removed GROUP BY module""",
)
def behaviour_diff(t: Tables) -> DataFrame:
    segment = F.col("c_mktsegment")
    before = billing(t.customer, "c_acctbal", "c_custkey", segment)
    after = changed_billing(t.customer, "c_acctbal", "c_custkey", segment)
    return C.behaviour_diff(before, after).groupBy("module", "change").agg(F.sum("n").cast("bigint").alias("n"))


@query(
    "native_equals_python",
    "SELECT count(*) AS calls, CAST(0 AS BIGINT) AS differing FROM customer",
)
def native_equals_python(t: Tables) -> DataFrame:
    """Both capture forms must see the same behaviour, keys included."""
    rows = t.customer
    shown = ["seq", "arg_json", "arg_keys", "status", "out_json", "out_key", "out_double", "out_len", "error", "error_mro"]
    native = billing(rows, "c_acctbal", "c_custkey").select("seq", F.struct(*shown).alias("native"))
    python = C.capture(
        rows, S.process_transaction_py, ["c_acctbal"], module="billing", function=FUNCTION, seq="c_custkey"
    ).select("seq", F.struct(*shown).alias("python"))
    return native.join(python, "seq", "left").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("native").eqNullSafe(F.col("python"))).alias("differing")
    )
