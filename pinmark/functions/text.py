"""Column expressions that reproduce Python's text rules for numbers, JSON and whitespace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip treats as blank, as a Java character class.
PY_BLANK = r"[\s\x{1c}-\x{1f}]"
_NUMBER = r"(?i)^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$"
_SPECIAL = r"(?i)^[+-]?(nan|inf|infinity)$"

# How json.dumps widens a code point when it escapes to ASCII.
_TWO_CHARS = r'["\\\n\r\t\x08\f]'
_SIX_CHARS = r"[\x{0}-\x{7}\x{b}\x{e}-\x{1f}\x{7f}-\x{ffff}]"
_TWELVE_CHARS = r"[\x{10000}-\x{10ffff}]"


def python_strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{PY_BLANK}+|{PY_BLANK}+$", "")


def python_split(text: Column) -> Column:
    """``str.split()``: runs of blanks separate, no empty parts."""
    return F.regexp_extract_all(text, F.lit(r"(?U)([^\s\x{1c}-\x{1f}]+)"), F.lit(1))


def python_float(text: Column) -> Column:
    """``float(text)``, NULL where Python raises. Only ASCII digits are known."""
    # Unlike str.strip, float() keeps the separators 1c to 1f.
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    special = F.lower(F.regexp_replace(bare, r"^\+", ""))
    return (
        F.when(bare.rlike(_NUMBER), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))
        .when(~bare.rlike(_SPECIAL), F.lit(None).cast("double"))
        .when(special.endswith("nan"), F.lit(float("nan")))
        .when(special.startswith("-"), F.lit(float("-inf")))
        .otherwise(F.lit(float("inf")))
    )


def python_float_text(value: Column) -> Column:
    """``repr`` of a finite double. It always reads back as the same number; on Java before 19 about one in a thousand
    random doubles (mostly beyond 1e17, or subnormal) differs from Python in its last digit or shows one digit more.

    Java and Python both print shortest-digit forms, but switch to an exponent at other magnitudes; inside
    [1e-3, 1e7) the two texts are alike and nothing has to be rearranged. Java versions before 19 sometimes print a
    digit more than needed, so long texts are replaced by one of 16 or 17 digits that reads back as the number.
    """
    size = F.abs(value)
    text = value.cast("string")
    sixteen, seventeen = F.format_string("%.15e", value), F.format_string("%.16e", value)
    digits = (
        F.when(F.length(text) <= 17, text)
        .when(sixteen.try_cast("double") == value, sixteen)
        .when(seventeen.try_cast("double") == value, seventeen)
        .otherwise(text)
    )
    # 16 whole digits and 3 + 17 decimals are the most that Python's plain form needs.
    plain = F.when((size >= 1e-4) & (size < 1e16), digits.try_cast("decimal(38,21)").cast("string"))
    power = F.regexp_replace(F.regexp_replace(digits, r"(\.0)?E(\d)", "e+$2"), r"(\.0)?E-|\.?0*e-", "e-")
    power = F.regexp_replace(power, r"\.?0*e\+", "e+")
    alike = ((size >= 1e-3) & (size < 1e7) & (F.length(text) <= 17)) | (size == 0)
    return F.when(alike, text).otherwise(
        F.coalesce(
            F.regexp_replace(plain, r"(\.\d+?)0+$", "$1"), F.regexp_replace(power, r"e([+-])(\d)$", "e$10$2")
        )
    )


def json_string(text: Column) -> Column:
    """JSON text of a string, taken out of a one-element array so that Spark does the escaping."""
    wrapped = F.to_json(F.array(text))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def json_string_length(text: Column) -> Column:
    """``len(json.dumps(text))``: two quotes, one per code point, and what ASCII escaping adds."""

    def extra(pattern: str, each: int) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) * each

    return F.lit(2) + F.length(text) + extra(_TWO_CHARS, 1) + extra(_SIX_CHARS, 5) + extra(_TWELVE_CHARS, 11)


def python_repr_text(text: Column) -> Column:
    """``repr`` of a string for messages; control characters beyond tab and line ends stay as they are."""
    escaped = text
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    double_quoted = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double_quoted, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )
