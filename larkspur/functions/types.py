"""The dialect's types over Spark's: declared types, kinds, literals, assignment and rendering."""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import EngineError

I64 = (-(1 << 63), (1 << 63) - 1)
U64 = (0, (1 << 64) - 1)
SCALE = 18

#: Declared type to Spark type. INTEGER has 64 bits, UNSIGNED the range of 64 bits without sign.
SPARK_TYPES: dict[str, T.DataType] = {
    "INTEGER": T.LongType(),
    "UNSIGNED": T.DecimalType(20, 0),
    "FLOAT": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "VARCHAR": T.StringType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "DECIMAL": T.DecimalType(38, SCALE),
}
INDEXABLE = ("INTEGER", "UNSIGNED")

#: Order of values of different kinds.
NUMERIC, DATE, TIMESTAMP, BOOLEAN, STRING = range(5)


def kind_of(spark_type: T.DataType) -> int:
    if isinstance(spark_type, T.NumericType):
        return NUMERIC
    if isinstance(spark_type, T.DateType):
        return DATE
    if isinstance(spark_type, (T.TimestampNTZType, T.TimestampType)):
        return TIMESTAMP
    if isinstance(spark_type, T.BooleanType):
        return BOOLEAN
    if isinstance(spark_type, (T.StringType, T.VarcharType, T.CharType)):
        return STRING
    raise EngineError(f"Values of type {spark_type.simpleString()} can't be compared")


def constant(value: Any, declared: str) -> Column:
    """A value of a declared type. Times go as text: as Python values they would pass through a zone."""
    if isinstance(value, dt.datetime):
        value = value.isoformat(" ", "seconds")
    return F.lit(value).cast(SPARK_TYPES[declared])


@dataclass(frozen=True)
class Literal:
    """A constant: ``type`` is a declared type, or NULL."""

    type: str
    value: Any

    def __str__(self) -> str:
        if self.type in ("DATE", "TIMESTAMP", "DECIMAL"):
            return f"{self.type} '{render(self.value)}'"
        if self.type == "VARCHAR":
            return "'" + self.value.replace("'", "''") + "'"
        if self.type == "BOOLEAN":
            return "TRUE" if self.value else "FALSE"
        return render(self.value)

    @property
    def kind(self) -> int | None:
        return None if self.type == "NULL" else kind_of(SPARK_TYPES[self.type])

    def column(self) -> Column:
        return F.lit(None) if self.type == "NULL" else constant(self.value, self.type)


NULL = Literal("NULL", None)


def integer(value: int) -> Literal:
    if I64[0] <= value <= I64[1]:
        return Literal("INTEGER", value)
    if value < 0:
        raise EngineError("Integer literal below supported range")
    if value > U64[1]:
        raise EngineError("Integer literal exceeds the range of UNSIGNED")
    return Literal("UNSIGNED", Decimal(value))


_DATE = re.compile(r"\d{4}-\d{2}-\d{2}", re.ASCII)
_TIMESTAMP = re.compile(r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", re.ASCII)
_DECIMAL = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)", re.ASCII)


def parse_date(text: str) -> dt.date:
    try:
        if _DATE.fullmatch(text):
            return dt.date.fromisoformat(text)
    except ValueError:
        pass
    raise EngineError(f"Invalid DATE: {text!r} is not a day as YYYY-MM-DD")


def parse_timestamp(text: str) -> dt.datetime:
    try:
        if _TIMESTAMP.fullmatch(text):
            return dt.datetime.fromisoformat(text)
    except ValueError:
        pass
    raise EngineError(f"Invalid TIMESTAMP: {text!r} is not a time as YYYY-MM-DD HH:MM:SS")


def parse_decimal(text: str) -> Decimal:
    try:
        if not _DECIMAL.fullmatch(text):
            raise InvalidOperation
        value = Decimal(text)
    except InvalidOperation:
        raise EngineError(f"Invalid DECIMAL: {text!r}") from None
    return _fits_decimal(value)


def _fits_decimal(value: Decimal) -> Decimal:
    _, digits, exponent = value.as_tuple()
    if -exponent > SCALE and any(digits[exponent + SCALE :]) or abs(value) >= Decimal(10) ** (38 - SCALE):
        raise EngineError(f"Invalid DECIMAL: {value} has more than {38 - SCALE} whole or {SCALE} fractional digits")
    return value


def assign(literal: Literal, declared: str) -> Any:
    """The Python value that a column of a declared type takes for a constant."""
    value, given = literal.value, literal.type
    wrong = EngineError(f"Type mismatch: expected {declared}", "invalid_data")
    if given == "NULL":
        return None
    if given == declared:
        return _fits_decimal(value) if declared == "DECIMAL" else value
    if declared in INDEXABLE:
        if given == "FLOAT":
            if not math.isfinite(value) or value != int(value):
                raise wrong
        elif given not in INDEXABLE:
            raise wrong
        low, high = I64 if declared == "INTEGER" else U64
        if not low <= int(value) <= high:
            raise wrong
        return int(value) if declared == "INTEGER" else Decimal(int(value))
    if declared == "FLOAT" and given in INDEXABLE:
        return float(value)
    if declared == "DECIMAL" and given in (*INDEXABLE, "FLOAT", "VARCHAR"):
        if given == "VARCHAR":
            return parse_decimal(value)
        if given == "FLOAT" and not math.isfinite(value):
            raise wrong
        return _fits_decimal(Decimal(repr(value)) if given == "FLOAT" else Decimal(value))
    if declared == "DATE" and given == "VARCHAR":
        return parse_date(value)
    if declared == "TIMESTAMP" and given == "VARCHAR":
        return parse_timestamp(value)
    raise wrong


def assign_column(value: Column, given: str, declared: str) -> Column:
    """A column's values for a column of another declared type; values that don't fit raise at run time."""
    if given == declared:
        return value
    wrong = EngineError(f"Type mismatch: expected {declared}", "invalid_data")
    target = SPARK_TYPES[declared]
    fail = F.raise_error(F.lit(str(wrong)))
    if declared in INDEXABLE and given in (*INDEXABLE, "FLOAT"):
        low, high = I64 if declared == "INTEGER" else U64
        if given == "FLOAT":
            # as doubles the upper ends are powers of two that don't fit themselves
            fits = (value == F.floor(value)) & (value >= float(low)) & (value < float(high + 1))
            return F.when(value.isNull() | fits, value.cast("decimal(20,0)").cast(target)).otherwise(fail)
        wide = value.cast("decimal(20,0)")
        fits = (wide >= F.lit(Decimal(low))) & (wide <= F.lit(Decimal(high)))
        return F.when(value.isNull() | fits, wide.cast(target)).otherwise(fail)
    if declared == "FLOAT" and given in INDEXABLE or declared == "DECIMAL" and given in (*INDEXABLE, "FLOAT"):
        return value.cast(target)
    if given == "VARCHAR" and declared in ("DATE", "TIMESTAMP", "DECIMAL"):
        shape = {"DATE": r"^\d{4}-\d{2}-\d{2}$", "TIMESTAMP": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "DECIMAL": r"^[+-]?(\d+(\.\d*)?|\.\d+)$"}[declared]
        cast = value.try_cast(target)
        return F.when(value.isNull() | (value.rlike(shape) & cast.isNotNull()), cast).otherwise(fail)
    raise wrong


def render(value: Any) -> str:
    """A value as text: trailing zeros of decimals are not shown."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, Decimal):
        text = format(value, "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S") if value.year >= 1000 else value.isoformat(" ", "seconds")
    if isinstance(value, dt.date):
        return value.isoformat()
    return str(value)
