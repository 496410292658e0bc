"""Cell tests shared by validation, profiling and the clean write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(value: Column | str) -> Column:
    """True for NULL, empty and spaces-only cells."""
    v = _col(value)
    return v.isNull() | (F.trim(v) == "")


# Spark's casts are lenient: they cut what follows a date, round to a scale, and read `5d` or
# hexadecimal floats. A cell has to look like its type before it is cast.
_WHOLE = r"^[+-]?\d+$"
_FLOAT = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[Ii]nf(?:inity)?|[Nn]a[Nn])$"
_DATE = r"^\d{4}-\d{1,2}-\d{1,2}$"
_TIMESTAMP = (
    r"^\d{4}-\d{1,2}-\d{1,2}"
    r"(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?: ?(?:Z|UTC|[+-]\d{2}(?::?\d{2})?))?)?$"
)


def pattern_of(kind: T.DataType) -> str | None:
    """What a trimmed cell of the type looks like; None if its cast is strict already. A
    DECIMAL has at most as many decimals as its scale, but for zeros."""
    if isinstance(kind, T.IntegralType):
        return _WHOLE
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return _FLOAT
    if isinstance(kind, T.DecimalType):
        digits = r"\d{0," + str(kind.scale) + "}"
        return rf"^[+-]?(?:\d+(?:\.{digits}0*)?|(?=\.\d)\.{digits}0*)(?:[eE]\+?\d+)?$"
    if isinstance(kind, T.DateType):
        return _DATE
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return _TIMESTAMP
    return None


def castable(value: Column | str, kind: T.DataType) -> Column:
    """True when a non-null cell reads as the given type, all of it and unchanged."""
    if isinstance(kind, T.StringType):
        return F.lit(True)
    fits = _col(value).try_cast(kind).isNotNull()
    pattern = pattern_of(kind)
    return fits if pattern is None else F.trim(_col(value)).rlike(pattern) & fits


def typed(value: Column | str, kind: T.DataType) -> Column:
    """The cell as its target type; blank cells, and those that don't read as it, are NULL."""
    v = _col(value)
    if isinstance(kind, T.StringType):
        return F.when(~is_blank(v), v)
    pattern = pattern_of(kind)
    fits = F.lit(True) if pattern is None else F.trim(v).rlike(pattern)
    return F.when(~is_blank(v) & fits, v.try_cast(kind))
