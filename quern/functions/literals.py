"""Values fitted to the type of the column that they are compared with, on the driver: a cast can't fail in a task."""

from __future__ import annotations

from datetime import date, datetime, timezone
from decimal import Decimal, InvalidOperation
from typing import Any
from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, NumericType, StringType, TimestampNTZType, TimestampType, CharType, VarcharType


class Unfit(Exception):
    """No value of the column's type is what the literal says."""


def fitted(value: Any, kind: DataType) -> Any:
    """The value to compare a column of that type with. Raises Unfit if none can be equal to it."""
    if isinstance(value, UUID):
        value = str(value)
    if isinstance(kind, (StringType, CharType, VarcharType)):
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, (str, int, float, Decimal)):
            return str(value)
        if isinstance(value, (datetime, date)):
            return value.isoformat()
    elif isinstance(kind, BooleanType):
        if isinstance(value, bool):
            return value
        if value in ("true", "false"):
            return value == "true"
    elif isinstance(kind, NumericType):
        return _number(value, kind)
    elif isinstance(kind, (TimestampType, TimestampNTZType)):
        return _moment(value, kind)
    elif isinstance(kind, DateType):
        moment = _moment(value, TimestampNTZType())
        return moment.date() if moment.time() == datetime.min.time() else moment
    elif isinstance(kind, BinaryType):
        if isinstance(value, (bytes, bytearray, str)):
            return value.encode() if isinstance(value, str) else bytes(value)
    raise Unfit


def literal(value: Any, kind: DataType) -> Column:
    """``fitted`` as a column. A moment without a zone is one in the session's zone, whatever the driver's own is."""
    value = fitted(value, kind)
    if isinstance(value, datetime) and value.tzinfo is None:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp" if isinstance(kind, TimestampType) else "timestamp_ntz")
    return F.lit(value)


def _number(value: Any, kind: NumericType) -> Any:
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal, str)):
        raise Unfit
    if isinstance(value, str):
        try:
            value = Decimal(value.strip())
        except InvalidOperation:
            raise Unfit from None
        if not value.is_finite():
            raise Unfit
        if value == value.to_integral_value():
            value = int(value)
    if isinstance(kind, (DoubleType, FloatType)):
        return float(value)
    if isinstance(kind, DecimalType) and isinstance(value, float):
        return Decimal(repr(value))
    if isinstance(kind, IntegralType) and isinstance(value, int) and not -(2**63) <= value < 2**63:
        return Decimal(value)
    return value


def _moment(value: Any, kind: DataType) -> datetime:
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value.strip())
        except ValueError:
            raise Unfit from None
    elif isinstance(value, date) and not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    if not isinstance(value, datetime):
        raise Unfit
    if value.tzinfo and isinstance(kind, TimestampNTZType):
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value
