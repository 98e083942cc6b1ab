"""Observation: call the functions that rows name, on the inputs that rows hold.

``capture`` knows its function before the job starts. Here the target is data: ``capture_probes`` looks each row's function
up in a registry, ``capture_sources`` runs each row's source text and calls what it defines. Both are narrow steps over
Arrow batches and give the records of ``capture``.
"""

from __future__ import annotations

import contextlib
import io
import json
import signal
import threading
import types
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import encode
from ..schema import CAPTURE_COLUMNS, CAPTURES, CRASHED
from .capture import _arrays, _call
from .inventory import top_level_functions

Registry = Mapping[str | tuple[str, str], Callable]


def not_found(name: str) -> str:
    return f"Function {name} not found."


def _failed(error: str) -> tuple:
    """The outcome of a call that never came to be."""
    name = error.split(":")[0].strip() if ": " in error else error
    return (CRASHED, *[None] * 7, error, name, encode.class_names(name), None)


def _in_registry(functions: Registry) -> Column:
    """Whether a row's function is offered under its module and name, or under its name alone."""
    plain = [k for k in functions if isinstance(k, str)]
    paired = [k for k in functions if not isinstance(k, str)]
    known = F.lit(False)
    if plain:
        known = known | F.col("function").isin(plain)
    by_module: dict[str, list[str]] = {}
    for module, name in paired:
        by_module.setdefault(module, []).append(name)
    for module, names in by_module.items():
        known = known | ((F.col("module") == module) & F.col("function").isin(names))
    return F.coalesce(known, F.lit(False))


def capture_probes(
    probes: DataFrame, functions: Registry, *, seq: str = "case_seq", digest_limit: int = encode.DIGEST_LIMIT
) -> DataFrame:
    """One capture for each probe ``(module, function, arg_json, <seq>)``: the row's function, called on its arguments.

    ``functions`` by (module, name), or by name for any module; the former go first. Arguments are JSON texts; a probe
    whose arguments are NULL calls nothing and a text that is not JSON is recorded as the crash of its call. A function
    that is not offered gives a single record, in place of its first probe, that says so: these are told from the names
    alone, in the JVM, and combined per task before they are exchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for module, name, place, texts in zip(*(c.to_pylist() for c in batch.columns)):
                fn = functions.get((module, name)) or functions[name]
                rows.append((module, name, place, *_observed(fn, texts, digest_limit)))
            yield pa.RecordBatch.from_arrays(_arrays(rows, CAPTURES.fields), names=CAPTURE_COLUMNS)

    narrow = probes.select("module", "function", F.col(seq).cast("bigint").alias("seq"), "arg_json")
    known = _in_registry(functions)
    called = narrow.where(known & F.col("arg_json").isNotNull()).mapInArrow(run, CAPTURES)
    return called.unionByName(_missing(narrow.where(~known)))


def _missing(probes: DataFrame) -> DataFrame:
    """The records of functions that do not exist, one for each."""
    names = probes.groupBy("module", "function").agg(F.min("seq").alias("seq"))
    error = F.concat(F.lit("Function "), F.coalesce("function", F.lit("unknown")), F.lit(" not found."))
    known = {
        "module": F.col("module"),
        "function": F.col("function"),
        "seq": F.col("seq"),
        "arg_json": F.array().cast("array<string>"),
        "arg_keys": F.array().cast("array<string>"),
        "arg_elem_keys": F.array().cast("array<array<string>>"),
        "arg_types": F.array().cast("array<string>"),
        "status": F.lit(CRASHED),
        "error": error,
        "error_class": error,
        "error_mro": F.array(error),
    }
    return names.select(*[known.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in CAPTURES.fields])


def _observed(fn: Callable, texts: Sequence[str], digest_limit: int) -> tuple:
    """Arguments and outcome of one call on JSON texts."""
    try:
        call = [json.loads(t) for t in texts]
    except (TypeError, ValueError, RecursionError) as e:
        return (list(texts), *([None] * len(texts) for _ in range(3)), *_failed(f"{type(e).__name__}: {e}"))
    return (*encode.arguments(call), *_call(fn, call, digest_limit))


def default_calls(names: Sequence[str], args: Mapping[str, Sequence[str]]) -> list[tuple[str, list[str]]]:
    """The calls of ``probes.default_inputs`` for each function, in order."""
    calls = []
    for name in names:
        n = len(args[name])
        calls += [(name, [v] * n) for v in ("0", "1", "-1")] if n else [(name, [])]
    return calls


@contextlib.contextmanager
def _limited(seconds: float | None):
    """Raise TimeoutError in the running call after some seconds; only a main thread can be interrupted."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise TimeoutError(f"no result within {seconds:g} seconds")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def _run_source(module: str, source: str, calls: Sequence[tuple] | None, seconds: float | None, digest_limit: int) -> Iterator[tuple]:
    """Records of one source in the order of its calls; what it prints is dropped."""
    defined = top_level_functions(source)
    if calls is None:
        if not defined:
            return
        testable = {name: args for _, name, args, ok in defined if ok}
        if not testable:
            return
        calls = default_calls(list(testable), testable)
    with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        space = types.ModuleType(module or "source")
        try:
            with _limited(seconds):
                exec(compile(source or "", f"{module}.py", "exec"), space.__dict__)
        except KeyboardInterrupt:
            raise
        except BaseException as e:
            said = f"{type(e).__name__}: {encode.shown(e, str)}"
            yield (module, None, 0, [], [], [], [], *_failed(f"Failed to import {module}: {said}"))
            return
        gone = set()
        for place, (name, texts) in enumerate(calls):
            fn = getattr(space, name, None) if name else None
            if callable(fn):
                yield (module, name, place, *_observed(_timed(fn, seconds), texts or [], digest_limit))
            elif name not in gone:
                gone.add(name)
                error = not_found(name)
                yield (module, name, place, [], [], [], [], CRASHED, *[None] * 7, error, error, [error], None)


def _timed(fn: Callable, seconds: float | None) -> Callable:
    def call(*args):
        with _limited(seconds):
            return fn(*args)

    return call


def capture_sources(
    sources: DataFrame, *, calls: str | None = None, seconds: float | None = 60, digest_limit: int = encode.DIGEST_LIMIT
) -> DataFrame:
    """Run the source texts of a table ``(module, source)`` and capture what their functions do.

    Every top-level function that does not ask for input is called on the default inputs, in the order of the source; a
    column ``calls`` of type ``array<struct<function string, arg_json array<string>>>`` names other calls, and where it is
    NULL the default ones are made. ``seq`` numbers the calls of a source. As in an imported module, calls of one source see
    what earlier ones left behind. A source that cannot be run gives one record without a function, a function that does
    not exist one record; sources without a function to call, and those that do not parse, give none unless calls are named.
    ``seconds`` bounds the run of the source and each call.

    The sources are run inside the executors' Python workers with all rights these have: bring sources you trust, or
    executors that may be lost. A narrow step: nothing is joined or exchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for module, source, named in zip(*(c.to_pylist() for c in batch.columns)):
                wanted = None if named is None else [(c["function"], c["arg_json"]) for c in named if c]
                rows += _run_source(module, source, wanted, seconds, digest_limit)
            yield pa.RecordBatch.from_arrays(_arrays(rows, CAPTURES.fields), names=CAPTURE_COLUMNS)

    kind = "array<struct<function:string,arg_json:array<string>>>"
    named = F.col(calls).cast(kind) if calls else F.lit(None).cast(kind)
    return sources.select("module", "source", named.alias("calls")).mapInArrow(run, CAPTURES)
