"""Texts as typed values, and typed literals for comparisons with a column."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError

# The ways to write a date, and a date with a time.
DATE_FORMATS = ("%Y%m%d", "%Y-%m-%d", "%Y_%m_%d")
DATETIME_FORMATS = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y%m%d%H%M%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S.%f")
# Separators by name.
SEPARATORS = {"": ",", "comma": ",", "tab": "\t", "semicolon": ";", "pipe": "|"}

_INTEGERS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _wrong(text: str, kind: str) -> EngineError:
    return EngineError("conversion", f"{text!r} isn't {kind}")


def parse_date(text: str) -> date:
    for form, shape in zip(DATE_FORMATS, (r"\d{8}", r"\d{4}-\d{1,2}-\d{1,2}", r"\d{4}_\d{1,2}_\d{1,2}"), strict=True):
        if re.fullmatch(shape, text.strip()):
            try:
                return datetime.strptime(text.strip(), form).date()
            except ValueError:
                break
    raise _wrong(text, "a date")


def parse_datetime(text: str) -> datetime:
    """One of the formats above, or a date alone, which is its midnight; in UTC. Digits after microseconds are cut."""
    short = re.sub(r"(:\d\d\.\d{6})\d+$", r"\1", text.strip())
    for form in DATETIME_FORMATS:
        try:
            return datetime.strptime(short, form).replace(tzinfo=UTC)
        except ValueError:
            continue
    d = parse_date(text)
    return datetime(d.year, d.month, d.day, tzinfo=UTC)


def parse_boolean(text: str) -> bool:
    low = text.strip().lower()
    if low in ("true", "t", "1"):
        return True
    if low in ("false", "f", "0"):
        return False
    raise _wrong(text, "a boolean")


def parse_ascending(text: str) -> bool:
    return text.strip() == "" or parse_boolean(text)


def separator(text: str) -> str:
    if text in SEPARATORS:
        return SEPARATORS[text]
    if len(text.encode()) == 1:
        return text
    raise _wrong(text, "a separator: comma, tab, semicolon, pipe or one character")


def literal(text: str, kind: T.DataType, strict: bool = False) -> Column:
    """text as a literal of a column's type, so that a comparison with it can be pushed down to the scan.

    strict refuses timestamps and decimals, which are an extension of the language.
    """
    value = text.strip()
    if bits := _INTEGERS.get(type(kind)):
        if not re.fullmatch(r"[+-]?\d+", value) or not -(1 << bits - 1) <= int(value) < 1 << bits - 1:
            raise _wrong(text, f"an integer of {bits} bits")
        return F.lit(int(value)).cast(kind)
    if isinstance(kind, T.FloatType | T.DoubleType):
        try:
            return F.lit(float(value)).cast(kind)
        except ValueError:
            raise _wrong(text, "a number") from None
    if isinstance(kind, T.BooleanType):
        return F.lit(parse_boolean(value))
    if isinstance(kind, T.StringType):
        return F.lit(value)
    if isinstance(kind, T.DateType):
        return F.lit(parse_date(value))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType) and not strict:
        return F.lit(parse_datetime(value).strftime("%Y-%m-%d %H:%M:%S.%f") + ("Z" if isinstance(kind, T.TimestampType) else "")).cast(kind)
    if isinstance(kind, T.DecimalType) and not strict:
        try:
            return F.lit(Decimal(value))
        except InvalidOperation:
            raise _wrong(text, "a decimal") from None
    raise EngineError("not-supported", f"columns of type {kind.simpleString()} can't be compared")


# Names of column types in schemas.
TYPE_NAMES = {"tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "string": "String", "boolean": "Boolean", "date": "Date", "binary": "Binary", "timestamp": "Datetime('us')", "timestamp_ntz": "Datetime('us')", "void": "Null"}


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return f"List({type_name(kind.elementType)})"
    if isinstance(kind, T.DecimalType):
        return f"Decimal({kind.precision}, {kind.scale})"
    if isinstance(kind, T.StructType):
        return f"Struct({', '.join(f'{f.name}: {type_name(f.dataType)}' for f in kind)})"
    return TYPE_NAMES.get(kind.simpleString(), kind.simpleString())
