"""Column expressions for turning source values into fact values, and for comparing them.

Fact values are text. The rules follow Python's ``str`` and ``strip``, as lens
files and queries written elsewhere expect them, and a double is read from text
as DuckDB's TRY_CAST does.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: LIKE without an escape character of its own: this one never occurs in patterns.
_NO_ESCAPE = "\u0001"
_NUMBER = r"^[ \t\n\r\f\u000B]*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?[ \t\n\r\f\u000B]*$"
_SPECIAL = r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$"


def pystrip(c: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^[\s\u001C-\u001F]+|[\s\u001C-\u001F]+$", "")


def _inked(c: Column) -> Column:
    """Whether a text begins and ends with visible ASCII, by comparing bytes."""
    return (c >= "!") & (c < "\u007f") & F.substring(c, -1, 1).between("!", "~")


def _double(c: Column) -> Column:
    """The common sizes are written alike by both languages. The others go through a lambda, which stays out of generated code: inlined, it makes methods too long to be compiled."""
    size = F.abs(c)
    return F.when((size >= 1e-3) & (size < 1e7), c.cast("string")).otherwise(F.element_at(F.transform(F.array(c), _far_double), 1))


def _far_double(c: Column) -> Column:
    text = c.cast("string")
    fixed = text.try_cast("decimal(38,20)").cast("string")
    fixed = F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", ".0")
    exponent = F.regexp_extract(text, r"E(-?)(\d+)$", 1)
    digits = F.regexp_extract(text, r"E(-?)(\d+)$", 2)
    mantissa = F.regexp_replace(F.regexp_replace(text, r"E.*$", ""), r"\.0$", "")
    far = F.concat(mantissa, F.lit("e"), F.when(exponent == "-", "-").otherwise("+"), F.lpad(digits, 2, "0"))
    far = F.when(F.length(digits) > 2, F.concat(mantissa, F.lit("e"), F.when(exponent == "-", "-").otherwise("+"), digits)).otherwise(far)
    size = F.abs(c)
    return (
        F.when(F.isnan(c), "nan")
        .when(text == "Infinity", "inf")
        .when(text == "-Infinity", "-inf")
        .when(c == 0, F.when(text.startswith("-"), "-0.0").otherwise("0.0"))
        .when((size >= 1e-4) & (size < 1e16), fixed)
        .when(text == "4.9E-324", "5e-324")
        .when(text == "-4.9E-324", "-5e-324")
        .otherwise(far)
    )


def pystr(c: Column, kind: T.DataType) -> Column:
    """The text that Python's ``str`` gives a value of this type; null stays null."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(c.isNotNull(), _double(c.cast("double")))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(c, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    return c.cast("string")


def fact_value(c: Column, kind: T.DataType) -> Column:
    """Trimmed text, or null where a fact has no value: null, blank, or "nan"."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), pystr(c, kind))
    if isinstance(kind, (T.IntegralType, T.DecimalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return pystr(c, kind)  # never blank or padded
    text = pystr(c, kind)
    named = lambda v: F.when((F.octet_length(v) != 3) | (F.lower(v) != "nan"), v)
    rare = F.element_at(F.transform(F.array(text), lambda t: F.element_at(F.transform(F.array(pystrip(t)), lambda v: F.when(v != "", named(v))), 1)), 1)
    return F.when(_inked(text), named(text)).otherwise(rare)


def literal_text(value) -> str:
    """A query literal as text."""
    return str(value)


def safe_double(c: Column) -> Column:
    """The number that a text spells, or null."""
    plain = F.regexp_replace(c, "_", "")
    return F.when(c.rlike(_NUMBER), plain.try_cast("double")).when(c.rlike(_SPECIAL), F.regexp_replace(c, r"\s", "").try_cast("double"))


def like(c: Column, pattern: str) -> Column:
    return F.like(c, F.lit(pattern), F.lit(_NO_ESCAPE if _NO_ESCAPE not in pattern else "\u0002"))


def contains(c: Column, text: str) -> Column:
    """% and _ in the text are wildcards."""
    return F.contains(c, F.lit(text)) if not set(text) & {"%", "_"} else like(c, f"%{text}%")


def prefixed(c: Column, text: str) -> Column:
    return F.startswith(c, F.lit(text)) if not set(text) & {"%", "_"} else like(c, f"{text}%")


def lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def blank_to_null(c: Column) -> Column:
    return F.when((F.trim(c) != "") & (F.lower(F.trim(c)) != "nan"), F.trim(c))


def without_number_suffix(c: Column) -> Column:
    """A name without a trailing number in parentheses."""
    return F.trim(F.regexp_replace(c, r"\s*\(\d+\)\s*$", ""))


def items(c: Column) -> Column:
    """The trimmed, non-blank parts between commas, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))


def first_item(c: Column) -> Column:
    return F.nullif(F.trim(F.split_part(c, F.lit(","), F.lit(1))), F.lit(""))


def year(c: Column) -> Column:
    """The first four digits that stand alone."""
    return F.nullif(F.regexp_extract(F.trim(c), r"\b(\d{4})\b", 1), F.lit(""))


def slug(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower case, other than letters and digits turned to single underscores, none at the ends."""
    clean = F.lower(pystrip(c))
    if aliases:
        clean = F.coalesce(lookup(aliases)[clean], clean)
    return F.btrim(F.regexp_replace(clean, "[^a-z0-9]+", "_"), F.lit("_"))


def money(c: Column) -> Column:
    return F.nullif(F.translate(F.trim(c), "$,", ""), F.lit(""))


def third_part(c: Column) -> Column:
    """The year of MM/DD/YYYY."""
    parts = F.split(F.trim(c), "/")
    return F.when(F.size(parts) == 3, F.trim(F.try_element_at(parts, F.lit(3))))


def sublabel(*parts: Column) -> Column:
    return F.concat_ws(" · ", *[F.nullif(p, F.lit("")) for p in parts])


def isbn(c: Column) -> Column:
    """Digits and X of a number, without what follows the first blank."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"\s.*$", ""), "[^0-9Xx]", "")


def iso_time(c: Column) -> Column:
    return c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$")


def sql_quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def type_words(c: Column) -> tuple[Column, Column]:
    """Words before and after the long dash of a type line."""
    parts = F.split(c, "\\s*—\\s*", 2)
    words = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: w != "")
    return words(F.try_element_at(parts, F.lit(1))), words(F.try_element_at(parts, F.lit(2)))
