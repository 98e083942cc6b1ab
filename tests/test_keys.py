"""Typed columns and Python must encode alike."""

import json
import math
import random
import struct
from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pinmark.functions import encode, keys, text
from pinmark.operators import capture as C
from tests.plans import executed

FLOATS = [
    0.0, -0.0, 1.0, -1.0, 0.1, 1e7, 1e16, 1e15, 123456789.125, 1e-4, 1.5e-4, 1e-5, 1.5e-7, 1e22, 1.7976931348623157e308,
    -2.5e10, 9007199254740993.0, 123456.7, -1e-3, 12345678901234.5, 1e300, 2.0**62, 2.0**63, -(2.0**63), 1e19,
    5.684341886080802e-14, float("nan"), float("inf"), float("-inf"),
]
TEXTS = ["", "a", "'", '"', "\\", 'a\\"b', "\n\t\r\b\f", "\x00\x01\x1f\x7f", "é", "日本", "😀x", "null", "1", "[]", "a,b"]
CASES = [
    (T.DoubleType(), FLOATS + [None]),
    (T.LongType(), [0, 1, -1, 2**63 - 1, -(2**63), None]),
    (T.BooleanType(), [True, False, None]),
    (T.StringType(), TEXTS + [None]),
    (T.ArrayType(T.StringType()), [[], TEXTS, [None], ["a", None], None]),
    (T.ArrayType(T.DoubleType()), [[], FLOATS[:8], [1.0, float("nan")], [None, 2.5], None]),
    (T.ArrayType(T.ArrayType(T.LongType())), [[], [[]], [[1, 2], [3]], [None, [4]]]),
    (T.MapType(T.StringType(), T.LongType()), [{}, {"b": 1, "a": 2}, {'q"': None}, None]),
    (T.DecimalType(20, 8), [Decimal("1.50000000"), Decimal("0E-8"), Decimal("-12345678901.00000001"), None]),
    (T.DateType(), [date(2024, 2, 29), None]),
    (T.TimestampNTZType(), [datetime(2024, 1, 1, 0, 0, 7), datetime(2024, 1, 1, 0, 0, 7, 179500), None]),
    (T.StructType([T.StructField("b", T.LongType()), T.StructField("a", T.StringType())]), [(1, "x"), (None, None), None]),
]


def as_python(value, dtype):
    if isinstance(dtype, T.StructType) and value is not None:
        return dict(zip(dtype.fieldNames(), value))
    return value


@pytest.mark.parametrize("dtype, values", CASES, ids=[c[0].simpleString() for c in CASES])
def test_native_keys_equal_python_keys(spark, dtype, values):
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", dtype)])
    df = spark.createDataFrame(list(enumerate(values)), schema)
    v = F.col("v")
    rows = df.select(
        "i",
        keys.identity_key(v, dtype).alias("name"),
        keys.equality_key(v, dtype).alias("key"),
        keys.json_text(v, dtype).alias("json"),
        keys.json_length(v, dtype).alias("length"),
        keys.element_keys(v, dtype).alias("elements"),
    ).collect()
    for r in rows:
        value = as_python(values[r.i], dtype)
        assert r.name == encode.identity_key(value), value
        assert r.key == encode.equality_key(value), value
        text = json.dumps(value, default=encode.other_text)
        assert r.length == len(text), value
        back, same = json.loads(r.json), json.loads(text)
        assert encode.identity_key(back) == encode.identity_key(same), value
        if isinstance(value, list):
            assert r.elements == [encode.equality_key(e) for e in value]
        else:
            assert r.elements is None


NESTED = T.ArrayType(T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))


def test_lengths_are_those_of_the_json_text_and_each_part_has_its_text_once(spark):
    values = [[{'q"é': [1.5, None, float("nan")], "😀": []}, {}, None], [], [{"k": FLOATS}, {"a": None}], None]
    df = spark.createDataFrame(list(enumerate(values)), T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", NESTED)]))
    assert {r.i: r.n for r in df.select("i", keys.json_length(F.col("v"), NESTED).alias("n")).collect()} == {i: len(json.dumps(v)) for i, v in enumerate(values)}
    lists = spark.createDataFrame([([1.5],)], "v array<double>")
    one = executed(lists.select(F.transform("v", lambda e: keys.json_text(e, T.DoubleType())).alias("t"))).count("%.15e")
    assert executed(lists.select(keys.json_length(F.col("v"), T.ArrayType(T.DoubleType())).alias("n"))).count("%.15e") == one


@pytest.mark.parametrize("value, dtype", [
    ([0.1] * 101, T.ArrayType(T.DoubleType())), ([None] * 101, T.ArrayType(T.DoubleType())), ([7] * 167, T.ArrayType(T.LongType())),
    (["a"] * 126, T.ArrayType(T.StringType())), ({str(i): "" for i in range(63)}, T.MapType(T.StringType(), T.StringType())), ("x" * 499, T.StringType()),
])
def test_what_has_many_parts_is_long_without_being_measured(spark, value, dtype):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", dtype)]))
    measured = F.raise_error(F.lit("measured")).cast("int")
    assert df.select(keys.is_long(F.col("v"), dtype, measured, 500)).first()[0] is True
    assert len(json.dumps(value)) > 500


@pytest.mark.parametrize("value, dtype", [
    ([7] * 166, T.ArrayType(T.LongType())), ([7] * 167, T.ArrayType(T.LongType())), ([], T.ArrayType(T.LongType())), ("x" * 498, T.StringType()),
    ("é" * 83, T.StringType()), ("é" * 84, T.StringType()), ([0.0] * 100, T.ArrayType(T.DoubleType())), ([""] * 125, T.ArrayType(T.StringType())),
    ({"a": 1}, T.MapType(T.StringType(), T.LongType())), (None, T.ArrayType(T.LongType())), (None, T.StringType()),
])
def test_what_is_long_has_a_long_text(spark, value, dtype):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", dtype)]))
    found = df.select(keys.is_long(F.col("v"), dtype, keys.json_length(F.col("v"), dtype), 500)).first()[0]
    assert found == (len(json.dumps(value)) > 500)


def test_a_long_list_is_captured_without_its_text(spark):
    df = spark.createDataFrame([(0, [0.1] * 101), (1, [0.1] * 3)], "i int, v array<double>")
    found = C.capture_native(df, C.Outcome(F.col("v")), [F.col("i")], module="m", function="f", seq=F.col("i"))
    whole = [encode.output([0.1] * n) for n in (101, 3)]
    rows = found.orderBy("seq").select("out_type", "out_json", "out_key", "out_double", "out_len", "out_digest", "out_hash").collect()
    assert [tuple(r) for r in rows] == whole
    read = found.select("out_key", "out_hash")
    one = executed(df.select(F.transform("v", lambda e: keys.json_text(e, T.DoubleType())).alias("t"))).count("%.15e")
    # The text is behind the question whether the list is long, and nowhere else.
    assert executed(read).count("%.15e") == one and "> 500) THEN true ELSE" in executed(read)


def test_float_text_is_repr(spark):
    values = [f for f in FLOATS if math.isfinite(f)]
    rng = random.Random(7)
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-30, 30) for _ in range(20000)]
    values += [float(rng.randint(-(10**20), 10**20)) for _ in range(5000)] + [10.0**i for i in range(-30, 31)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", text.python_float_text(F.col("v")).alias("t")).collect()
    other = [(r.t, repr(r.v)) for r in rows if r.t != repr(r.v)]
    assert [(t, p) for t, p in other if float(t) != float(p)] == []
    assert len(other) < len(rows) / 200


def test_python_float(spark):
    texts = [
        "1", " 25.5 ", "1e3", "NaN", "-nan", "inf", "-Infinity", "+iNf", "", " ", "abc", "1_000", "1__0", "_1", "1_", "1d",
        "1f", "0x10", ".5", "5.", ".", "e5", "1e", "1e5_0", "1e400", "--1", "+-1", " 1 ", "\x1c7\x1f", "1 2", "1\n",
        "1,5", "0b1", "١".replace("١", "x"), "-0.0",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def expected(t):
        try:
            return repr(float(t))
        except ValueError:
            return None

    for r in df.select("t", text.python_float(F.col("t")).alias("v")).collect():
        assert (None if r.v is None else repr(r.v)) == expected(r.t), repr(r.t)


def test_strip_split_and_repr(spark):
    texts = [" a b ", "\t\n", "", " x y\x1c", "it's", 'say "hi"', "both ' and \"", "a\\b\nc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for r in df.select(
        "t", text.python_strip(t).alias("s"), text.python_split(t).alias("w"), text.python_repr_text(t).alias("r")
    ).collect():
        assert r.s == r.t.strip()
        assert r.w == r.t.split()
        if r.t.isprintable() or r.t == "a\\b\nc":
            assert r.r == repr(r.t)


@given(st.floats(allow_nan=False))
def test_hash_definition(value):
    xxhash = pytest.importorskip("xxhash")
    word = struct.pack("<d", value)
    assert encode._spark_hash(int.from_bytes(word, "little")) == xxhash.xxh64_intdigest(word, 42)


nested = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats() | st.text(max_size=3),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=2), inner, max_size=3),
    max_leaves=6,
)


@settings(max_examples=300)
@given(nested, nested)
def test_equality_key_is_python_equality(a, b):
    # A fresh object for every NaN: lists take one and the same object for equal.
    def decoded(value):
        return json.loads(json.dumps(value), parse_constant=float)

    a, b = decoded(a), decoded(b)
    same = encode.equality_key(a) is not None and encode.equality_key(a) == encode.equality_key(b)
    assert same == (a == b)
    again = decoded(a)
    assert (encode.equality_key(a) is not None) == (a == again)


def test_mixed_numbers_are_equal():
    for group in ([True, 1, 1.0], [False, 0, 0.0, -0.0], [2**70, float(2**70)], [[True, {"a": 1.0}], [1, {"a": 1}]]):
        assert len({encode.equality_key(v) for v in group}) == 1
    assert encode.equality_key("1") != encode.equality_key(1)
    assert encode.equality_key(2**70 + 1) != encode.equality_key(float(2**70))


def test_typed_columns_reach_python_as_the_same_values(spark):
    df = spark.sql(
        "SELECT 0L AS k, timestamp'2024-01-01 10:20:30.5' AS t, 1.50BD AS d, date'2024-01-02' AS day, 1.5F AS f, "
        "named_struct('b', 1, 'a', array(true)) AS s, map('x', 1.25D) AS m"
    )
    names = [c for c in df.columns if c != "k"]
    native = C.capture_native(df, C.Outcome(F.lit(1)), [F.col(c) for c in names], module="m", function="f", seq=F.col("k"))
    python = C.capture(df, lambda *a: 1, names, module="m", function="f", seq="k")
    assert native.first().arg_keys == python.first().arg_keys


def test_binary_is_refused(spark):
    df = spark.sql("SELECT CAST('x' AS BINARY) AS b")
    with pytest.raises(TypeError, match="base64"):
        keys.identity_key(df.b, T.BinaryType())
