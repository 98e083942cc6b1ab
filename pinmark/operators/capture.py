"""Capture: apply a function to every row and record what it did, one record per call, without failing the job.

Two forms with one result shape. ``capture_native`` takes a Column expression plus the guards under which it is
defined to fail and stays in the JVM. ``capture`` / ``capture_many`` call arbitrary Python on Arrow batches.

Choices where Python leaves room: arguments are recorded before the call, so in-place changes do not show; SystemExit
counts as a crash; KeyboardInterrupt is re-raised; a value JSON cannot hold is recorded by its ``repr`` as type
``other``.
"""

from __future__ import annotations

import linecache
import traceback as tb
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import encode, keys
from ..schema import CAPTURE_COLUMNS, CAPTURES, CRASHED, OUTCOME_COLUMNS, OUTCOME_FIELDS, SUCCESS


@dataclass(frozen=True)
class Guard:
    """A condition under which the function raises ``error`` with ``message``."""

    when: Column
    error: type[BaseException]
    message: Column | str


@dataclass(frozen=True)
class Outcome:
    """A function as columns: ordered guards, and the value where none of them holds.

    ``given`` names intermediate columns that guards and value share; they are computed once per row.
    """

    value: Column
    guards: tuple[Guard, ...] = ()
    given: Mapping[str, Column] = field(default_factory=dict)


def _fold_guards(guards: Sequence[Guard], result) -> Column | None:
    """``CASE WHEN guard1 THEN result(guard1) WHEN guard2 ...``, NULL where no guard holds."""
    chain = None
    for guard in guards:
        hit = F.coalesce(guard.when, F.lit(False))
        chain = F.when(hit, result(guard)) if chain is None else chain.when(hit, result(guard))
    return chain


def _failure(guards: Sequence[Guard]) -> Column:
    """Text of the error the first holding guard raises, NULL on success."""

    def text(guard: Guard) -> Column:
        message = guard.message if isinstance(guard.message, Column) else F.lit(guard.message)
        return F.concat(F.lit(guard.error.__name__ + ": "), message)

    return _fold_guards(guards, text) if guards else F.lit(None).cast("string")


def outcome_columns(
    value: Column, dtype: T.DataType, length: Column, long: Column, error: Column, guards: Sequence[Guard]
) -> dict[str, Column]:
    """The outcome part of a record, from value, JSON length, whether that is too long, and error text already computed as
    columns."""
    no_text = F.lit(None).cast("string")
    error_class = F.when(error.isNotNull(), F.split_part(error, F.lit(":"), F.lit(1)))
    error_mro = F.lit(None).cast("array<string>")
    for cls in dict.fromkeys(g.error for g in guards):
        names = F.array(*[F.lit(n) for n in encode.mro_names(cls)])
        error_mro = F.when(error_class == cls.__name__, names).otherwise(error_mro)
    ok = error.isNull()
    bounded = _bounded(dtype)
    kept = ok if bounded else ok & ~long
    return {
        "status": F.when(ok, F.lit(SUCCESS)).otherwise(F.lit(CRASHED)),
        "out_type": F.when(~ok, no_text)
        .when(value.isNull(), F.lit("null"))
        .otherwise(F.lit(keys.python_type(dtype))),
        "out_json": F.when(kept, keys.json_text(value, dtype)),
        "out_key": F.when(kept, keys.equality_key(value, dtype)),
        "out_double": F.when(kept, keys.as_double(value, dtype)),
        "out_len": F.when(ok, length),
        "out_digest": no_text if bounded else F.when(ok, keys.digest(value, dtype, long)),
        "out_hash": _whole_hash(value, dtype, long, ok),
        "error": error,
        "error_class": error_class,
        "error_mro": error_mro,
        "traceback": no_text,
    }


def _bounded(dtype: T.DataType) -> bool:
    """Whether outputs of the type are short whatever their value."""
    return not isinstance(dtype, (T.StringType, T.ArrayType, T.MapType, T.StructType))


def _whole_hash(value: Column, dtype: T.DataType, long: Column, ok: Column) -> Column:
    """SHA-256 of the identity key of outputs that ``out_key`` does not name: long ones, and those that hold NaN."""
    bounded = _bounded(dtype)
    if bounded and not keys.may_hold_nan(dtype):
        return F.lit(None).cast("string")
    unnamed = keys.holds_nan(value, dtype)
    if not bounded:
        unnamed = long | unnamed
    return F.when(ok & unnamed, F.sha2(keys.identity_key(value, dtype), 256))


Subject = tuple[Outcome, Sequence[Column]]


def _evaluated(
    df: DataFrame, subjects: Sequence[Subject], digest_limit: int, turn: Column | None = None
) -> DataFrame:
    """Add error text, value, JSON length, whether that is too long, and arguments of each subject as columns.

    They are separate projections because the later ones use them many times; Catalyst keeps a projection apart when
    merging it would repeat work. ``turn`` says whose row it is if each subject has its own. Where nobody reads the
    length itself, Catalyst moves it into the question whether it is too long, which mostly is answered without it.
    """

    def own(place: int, column: Column) -> Column:
        return column if turn is None else F.when(turn == place, column)

    given, errors, values, lengths, longs = {}, {}, {}, {}, {}
    for i, (outcome, args) in enumerate(subjects):
        given.update({n: own(i, c) for n, c in outcome.given.items()})
        errors[f"__error{i}"] = own(i, _failure(outcome.guards))
        errors.update({f"__arg{i}_{j}": own(i, a) for j, a in enumerate(args)})
        values[f"__value{i}"] = own(i, F.when(F.col(f"__error{i}").isNull(), outcome.value))
    named = df.withColumns(given) if given else df
    valued = named.withColumns(errors).withColumns(values)
    schema = valued.schema
    for i in range(len(subjects)):
        value, dtype = F.col(f"__value{i}"), schema[f"__value{i}"].dataType
        lengths[f"__length{i}"] = own(i, keys.json_length(value, dtype).cast("int"))
        long = F.lit(False) if _bounded(dtype) else keys.is_long(value, dtype, F.col(f"__length{i}"), digest_limit)
        longs[f"__long{i}"] = own(i, long)
    return valued.withColumns(lengths).withColumns(longs)


def argument_columns(schema: T.StructType, args: Sequence[str]) -> dict[str, Column]:
    typed = [(F.col(a), schema[a].dataType) for a in args]
    return {
        "arg_json": F.array(*[keys.json_text(a, t) for a, t in typed]).cast("array<string>"),
        "arg_keys": F.array(*[keys.identity_key(a, t) for a, t in typed]).cast("array<string>"),
        "arg_elem_keys": F.array(*[keys.element_keys(a, t) for a, t in typed]).cast("array<array<string>>"),
        "arg_types": F.array(*[F.lit(keys.type_name(t)) for _, t in typed]).cast("array<string>"),
    }


def _record(schema: T.StructType, subject: Subject, place: int) -> dict[str, Column]:
    outcome, args = subject
    error, value, length, long = (F.col(f"__{part}{place}") for part in ("error", "value", "length", "long"))
    dtype = schema[f"__value{place}"].dataType
    return {
        **argument_columns(schema, [f"__arg{place}_{i}" for i in range(len(args))]),
        **outcome_columns(value, dtype, length, long, error, outcome.guards),
    }


def capture_native(
    df: DataFrame,
    outcome: Outcome,
    args: Sequence[Column],
    *,
    module: str | Column,
    function: str,
    seq: Column | None = None,
    keep: Sequence[str] = (),
    digest_limit: int = encode.DIGEST_LIMIT,
) -> DataFrame:
    """Capture a Column expression: one narrow projection, no shuffle and no Python worker."""
    df = _evaluated(df, [(outcome, args)], digest_limit)
    columns = {
        "module": module if isinstance(module, Column) else F.lit(module),
        "function": F.lit(function),
        "seq": (seq if seq is not None else F.lit(None)).cast("bigint"),
        **_record(df.schema, (outcome, args), 0),
    }
    return df.select(*[columns[c].alias(c) for c in CAPTURE_COLUMNS], *keep)


def with_outcome(
    df: DataFrame,
    outcome: Outcome,
    args: Sequence[Column],
    *,
    prefix: str = "act_",
    digest_limit: int = encode.DIGEST_LIMIT,
) -> DataFrame:
    """Add what a Column expression does to each row as prefixed columns beside the row's own."""
    subject = (outcome, args)
    evaluated = _evaluated(df, [subject], digest_limit)
    record = _record(evaluated.schema, subject, 0)
    return evaluated.select(*df.columns, *[record[c].alias(prefix + c) for c in OUTCOME_COLUMNS])


def capture_native_many(
    df: DataFrame,
    subjects: Mapping[str, Subject],
    *,
    module: str | Column,
    seq: Column | None = None,
    digest_limit: int = encode.DIGEST_LIMIT,
) -> DataFrame:
    """Several functions in one scan: each input row gives one record per function, in the order given.

    The row is multiplied first and every copy evaluates its own function only, so no copy carries the records of the
    others and columns nobody reads are not computed.
    """
    turn = F.col("__turn")
    copies = df.withColumn("__turn", F.explode(F.array(*[F.lit(i) for i in range(len(subjects))])))
    evaluated = _evaluated(copies, list(subjects.values()), digest_limit, turn)
    schema = evaluated.schema
    records = [
        {"function": F.lit(function), **_record(schema, subject, i)}
        for i, (function, subject) in enumerate(subjects.items())
    ]

    def chosen(column: str) -> Column:
        first, *others = records
        chain = F.when(turn == 0, first[column])
        for i, record in enumerate(others, 1):
            chain = chain.when(turn == i, record[column])
        return chain

    shared = {
        "module": module if isinstance(module, Column) else F.lit(module),
        "seq": (seq if seq is not None else F.lit(None)).cast("bigint"),
    }
    return evaluated.select(*[(shared[c] if c in shared else chosen(c)).alias(c) for c in CAPTURE_COLUMNS])


def _trace(error: BaseException) -> str:
    """Traceback text below our own frame; formatted by hand since a table can hold millions of crashes."""
    lines = ["Traceback (most recent call last):"]
    for frame, number in tb.walk_tb(error.__traceback__.tb_next):
        code = frame.f_code
        lines.append(f'  File "{code.co_filename}", line {number}, in {code.co_name}')
        source = linecache.getline(code.co_filename, number).strip()
        if source:
            lines.append(f"    {source}")
    return "\n".join(lines + [f"{type(error).__name__}: {encode.shown(error, str)}", ""])


def _call(fn: Callable, args: Sequence, digest_limit: int) -> tuple:
    try:
        result = fn(*args)
    except KeyboardInterrupt:
        raise
    except (Exception, SystemExit) as e:
        cls = type(e)
        name = cls.__name__
        message = f"{name}: {encode.shown(e, str)}"
        return (CRASHED, *[None] * 7, message, name, encode.mro_names(cls), _trace(e))
    return (SUCCESS, *encode.output(result, digest_limit), None, None, None, None)


def _arrays(rows: list[tuple], fields: Sequence[T.StructField]) -> list[pa.Array]:
    types = [f.type for f in to_arrow_schema(T.StructType(list(fields)))]
    arrays = []
    for values, dtype in zip(zip(*rows) if rows else [()] * len(types), types):
        try:
            arrays.append(pa.array(values, dtype))
        except UnicodeEncodeError:
            arrays.append(pa.array([encode.utf8(v) for v in values], dtype))
    return arrays


def capture_many(
    df: DataFrame,
    subjects: Mapping[str, tuple[Callable, Sequence[str]]],
    *,
    module: str,
    seq: str | None = None,
    digest_limit: int = encode.DIGEST_LIMIT,
) -> DataFrame:
    """Call Python functions ``{name: (fn, argument columns)}`` on every row in one pass over Arrow batches.

    Only the argument columns and ``seq`` cross to Python. Filter ``df`` first: nothing can be pushed below the call.
    """
    specs = [(name, fn, list(args)) for name, (fn, args) in subjects.items()]
    wanted = list(dict.fromkeys(([seq] if seq else []) + [a for _, _, args in specs for a in args]))
    if not wanted:
        df, wanted = df.select(F.lit(0).alias("__row")), ["__row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n).to_pylist(maps_as_pydicts="strict") for n in batch.schema.names}
            places = columns[seq] if seq else [None] * batch.num_rows
            for name, fn, args in specs:
                calls = zip(*[columns[a] for a in args]) if args else [()] * batch.num_rows
                rows = [
                    (module, name, place, *encode.arguments(call), *_call(fn, call, digest_limit))
                    for place, call in zip(places, calls)
                ]
                yield pa.RecordBatch.from_arrays(_arrays(rows, CAPTURES.fields), names=CAPTURE_COLUMNS)

    return df.select(*wanted).mapInArrow(run, CAPTURES)


def capture(
    df: DataFrame,
    fn: Callable,
    args: Sequence[str],
    *,
    module: str,
    function: str | None = None,
    seq: str | None = None,
    digest_limit: int = encode.DIGEST_LIMIT,
) -> DataFrame:
    """``capture_many`` for a single function."""
    return capture_many(
        df, {function or fn.__name__: (fn, args)}, module=module, seq=seq, digest_limit=digest_limit
    )


def replay(
    expectations: DataFrame,
    functions: Mapping[str | tuple[str, str], Callable],
    *,
    prefix: str = "act_",
    digest_limit: int = encode.DIGEST_LIMIT,
) -> DataFrame:
    """Call each case's function again on its stored arguments and put the outcome beside the expectation.

    ``functions`` by name, or by (module, name) where modules share a name; the latter go first. Decimals, dates, times and
    bytes among the arguments are given back as such (inside lists and objects they are texts). A narrow step: no key,
    no join, no shuffle. A function that is not offered, or a case without arguments, leaves a NULL outcome.
    """
    missing = (None,) * len(OUTCOME_FIELDS)

    def run(modules: pa.Array, names: pa.Array, arg_json: pa.Array, arg_types: pa.Array) -> pa.Array:
        rows = []
        for module, name, args, types in zip(*(c.to_pylist() for c in (modules, names, arg_json, arg_types))):
            fn = functions.get((module, name)) or functions.get(name)
            callable_ = fn is not None and args is not None
            # Captures of an older form have no types.
            given = [encode.argument(a, t) for a, t in zip(args, types or [None] * len(args))] if callable_ else ()
            rows.append(_call(fn, given, digest_limit) if callable_ else missing)
        return pa.StructArray.from_arrays(_arrays(rows, OUTCOME_FIELDS), names=OUTCOME_COLUMNS)

    # Only name and arguments cross to Python; the rest of the expectation waits in the JVM. The call counts as
    # nondeterministic, so the optimizer neither repeats nor drops it.
    call = F.arrow_udf(run, T.StructType(OUTCOME_FIELDS)).asNondeterministic()
    called = expectations.withColumn("__call", call("module", "function", "arg_json", "arg_types"))
    return called.select(
        *expectations.columns, *[F.col(f"__call.{c}").alias(prefix + c) for c in OUTCOME_COLUMNS]
    )


def distinct_calls(df: DataFrame, args: Sequence[str], count: str = "n_rows") -> DataFrame:
    """Argument tuples with the number of rows that hold them.

    For a deterministic function each tuple has to be called once only. The count is combined before the shuffle, so a
    tuple that fills a third of the table costs one row per task.
    """
    return df.groupBy(*args).agg(F.count(F.lit(1)).alias(count))


def capture_summary(captures: DataFrame) -> DataFrame:
    """Records, successes, crashes and function names per module; all that is not ``success`` is a crash."""
    ok = F.col("status").eqNullSafe(SUCCESS)
    # First down to one row per function, so the name list is built from few rows whatever the module's size.
    per_function = captures.groupBy("module", "function").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("crashes")
    )
    return per_function.groupBy("module").agg(
        F.sum("records").alias("records"),
        F.sum("successes").alias("successes"),
        F.sum("crashes").alias("crashes"),
        F.array_join(F.array_sort(F.collect_set("function")), ", ").alias("functions"),
    )


def error_profile(captures: DataFrame) -> DataFrame:
    """Crashes per function and error class."""
    crashed = captures.where(~F.col("status").eqNullSafe(SUCCESS))
    return crashed.groupBy(
        "module", F.coalesce("function", F.lit("unknown")).alias("function"), "error_class"
    ).agg(F.count(F.lit(1)).alias("crashes"))


def behaviour_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """What two capture generations of the same calls disagree on, duplicates counted.

    Same content as EXCEPT ALL both ways, in one shuffle: both sides are tagged +1 / -1 and summed per behaviour, which
    also combines repeated calls before they are exchanged. ``behaviour`` is a text to read; long
    outputs and those that hold NaN are told apart by the hash of their whole value, in which NaN is like NaN.
    """
    behaviour = ["module", "function", "arg_keys", "status", "behaviour", "out_hash"]

    def tagged(captures: DataFrame, weight: int) -> DataFrame:
        return captures.select(
            "module",
            "function",
            "arg_keys",
            "status",
            F.coalesce("out_key", "out_json", "out_digest", "error").alias("behaviour"),
            "out_hash",
            F.lit(weight).alias("weight"),
        )

    net = tagged(after, 1).unionByName(tagged(before, -1)).groupBy(*behaviour).agg(F.sum("weight").alias("net"))
    return net.where("net <> 0").select(
        *behaviour,
        F.when(F.col("net") > 0, F.lit("added")).otherwise(F.lit("removed")).alias("change"),
        F.abs("net").alias("n"),
    )


