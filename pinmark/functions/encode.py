"""Python side of the capture form, used inside Arrow batches where a Python function has to be called.

It must give the same keys as ``functions.keys`` gives for typed columns.
"""

from __future__ import annotations

import base64
import builtins
import hashlib
import json
import math
import struct
from datetime import date, datetime
from decimal import Decimal

try:
    import xxhash
except ImportError:  # the definition below gives the same, slower
    xxhash = None

_MASK = (1 << 64) - 1
_INT64 = 1 << 63

DIGEST_LIMIT, DIGEST_HEAD = 500, 200


def _spark_hash(bits: int) -> int:
    """Spark's ``xxhash64`` of one 8-byte value (seed 42), by the published XXH64 definition."""
    # XXH64 primes.
    p1, p2, p3, p4, p5 = (
        0x9E3779B185EBCA87,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0x85EBCA77C2B2AE63,
        0x27D4EB2F165667C5,
    )

    def rotate(x: int, n: int) -> int:
        return ((x << n) | (x >> (64 - n))) & _MASK

    h = 42 + p5 + 8
    h ^= (rotate((bits * p2) & _MASK, 31) * p1) & _MASK
    h = (rotate(h, 27) * p1 + p4) & _MASK
    h = ((h ^ (h >> 33)) * p2) & _MASK
    h = ((h ^ (h >> 29)) * p3) & _MASK
    return h ^ (h >> 32)


def _bits_name(value: float) -> str:
    word = struct.pack("<d", value)
    if xxhash is not None:
        return f"f{xxhash.xxh64_intdigest(word, 42):X}"
    return f"f{_spark_hash(int.from_bytes(word, 'little')):X}"


def _float_key(value: float) -> str:
    if math.isnan(value):
        return "nan"
    if -_INT64 <= value < _INT64 and value.is_integer():
        return str(int(value))
    return _bits_name(value)


def _int_key(value: int) -> str:
    if -_INT64 <= value < _INT64:
        return str(int(value))
    try:
        wide = float(value)
    except OverflowError:
        return str(int(value))
    return _float_key(wide) if wide == value else str(int(value))


def _text_key(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def other_text(value) -> str:
    """Text of a value JSON has no form for; decimals as Spark writes them, bytes as base64."""
    if isinstance(value, Decimal):
        return format(value, "f")
    return base64.b64encode(value).decode() if isinstance(value, (bytes, bytearray)) else str(value)


def other_key(value) -> str:
    """The same for keys: 1.50 and 1.500 are equal."""
    text = other_text(value)
    return text.rstrip("0").rstrip(".") if isinstance(value, Decimal) and "." in text else text


def type_name(value) -> str | None:
    """The type of an argument that its JSON text alone does not give back."""
    if isinstance(value, Decimal):
        return "decimal"
    if isinstance(value, datetime):
        return "timestamp"
    if isinstance(value, date):
        return "date"
    return "binary" if isinstance(value, (bytes, bytearray)) else None


_FROM_TEXT = {"decimal": Decimal, "date": date.fromisoformat, "timestamp": datetime.fromisoformat, "binary": base64.b64decode}


def argument(text: str, type_name: str | None):
    """The argument that ``text`` was recorded of."""
    value = json.loads(text)
    return value if type_name is None or value is None else _FROM_TEXT[type_name](value)


def identity_key(value) -> str:
    if isinstance(value, float):
        return _float_key(value)
    if isinstance(value, str):
        return _text_key(value)
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, int):
        return _int_key(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(identity_key, value)) + "]"
    if isinstance(value, dict):
        names = {k if isinstance(k, str) else json.dumps(k): v for k, v in value.items()}
        if len(names) < len(value):
            raise ValueError("keys that JSON cannot tell apart")
        return "{" + ",".join(sorted(f"{_text_key(k)}:{identity_key(v)}" for k, v in names.items())) + "}"
    return _text_key(other_key(value))


def holds_nan(value) -> bool:
    if isinstance(value, float):
        return math.isnan(value)
    if isinstance(value, (list, tuple)):
        return any(map(holds_nan, value))
    if isinstance(value, dict):
        return any(map(holds_nan, value.values()))
    return False


def equality_key(value) -> str | None:
    if isinstance(value, float):
        return _float_key(value) if value == value else None
    return None if holds_nan(value) else identity_key(value)


_KINDS = {type(None): "null", bool: "bool", int: "int", float: "float", str: "string", list: "list", dict: "dict"}


def kind(value) -> str:
    found = _KINDS.get(type(value))
    if found is None:
        found = next((n for t, n in _KINDS.items() if isinstance(value, t)), "other")
        found = "list" if isinstance(value, tuple) else found
    return found


_ENCODER = json.JSONEncoder(default=other_text)


def shown(value, text=repr) -> str:
    """``repr`` or another text of a value, whatever its methods do."""
    try:
        return text(value)
    except Exception:
        return f"<unprintable {type(value).__name__}>"


def described(value) -> tuple:
    """(value, kind, JSON text, identity key, holds NaN).

    A value that has no JSON text even with a text fallback, or whose parts cannot be named, becomes its ``repr``.
    """
    exact = type(value)
    if exact is float and math.isfinite(value):
        return value, "float", repr(value), _float_key(value), False
    try:
        text = repr(value) if exact is int else _ENCODER.encode(value)
        return value, kind(value), text, identity_key(value), holds_nan(value)
    except Exception:
        plain = shown(value)
        return plain, "other", _ENCODER.encode(plain), _text_key(plain), False


def arguments(args) -> tuple:
    """(arg_json, arg_keys, arg_elem_keys, arg_types) of one call."""
    texts, names, elements, types = [], [], [], []
    for arg in args:
        plain, out_kind, text, name, _ = described(arg)
        texts.append(text)
        names.append(name)
        elements.append([equality_key(e) for e in plain] if out_kind == "list" else None)
        types.append(type_name(arg))
    return texts, names, elements, types


def output(value, limit: int = DIGEST_LIMIT) -> tuple:
    """(out_type, out_json, out_key, out_double, out_len, out_digest, out_hash); big values keep digest and hash only.

    The hash names the whole value, NaN included, where ``out_key`` does not.
    """
    value, out_type, text, key, nan = described(value)
    long = len(text) > limit and value is not None
    name = hashlib.sha256(key.encode("utf-8", "surrogatepass")).hexdigest() if long or nan else None
    if long:
        if out_type == "list":
            short = f"[list of {len(value)} items]"
        else:
            whole = value if out_type in ("string", "other") and isinstance(value, str) else shown(text, json.loads)
            short = shown(whole, str)[:DIGEST_HEAD] + "... [truncated]"
        return out_type, None, None, None, len(text), short, name
    number = None
    if out_type in ("float", "int", "bool"):
        try:
            number = float(value)
        except OverflowError:
            number = None
    return out_type, text, None if nan else key, number, len(text), None, name


def class_names(error_class: str) -> list[str]:
    """Names of a class and its bases, for one known only by name."""
    found = getattr(builtins, error_class, None)
    if isinstance(found, type) and issubclass(found, BaseException):
        return mro_names(found)
    return [error_class]


def mro_names(cls: type) -> list[str]:
    return [c.__name__ for c in cls.__mro__ if c is not object]


def utf8(text):
    """Text Arrow can carry: lone surrogates become escapes."""
    if isinstance(text, str):
        return text.encode("utf-8", "backslashreplace").decode("utf-8")
    if isinstance(text, list):
        return [utf8(t) for t in text]
    return text
