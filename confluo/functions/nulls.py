"""Null / NaN tests and lenient double casts (ANSI-safe: always ``try_cast``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


# What Spark's cast reads as a double, and as NaN (blanks and
# control characters around it are dropped).
_BLANK = "[\\x00-\\x20]*"
NUMBER = (f"^{_BLANK}[+-]?(?:(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?[dDfF]?"
          "|0[xX][0-9a-fA-F]*\\.?[0-9a-fA-F]*[pP][+-]?[0-9]+[dDfF]?|[nN][aA][nN]"
          f"|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?){_BLANK}\\z")
NAN = f"^{_BLANK}(?:[+-]NaN|[nN][aA][nN]){_BLANK}\\z"


def col_ref(name: str) -> Column:
    """Reference a column by its exact name (dots, blanks, backticks allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NUMERIC)


def as_double(c: Column, dtype: T.DataType) -> Column:
    """The value as a double, or null where it does not parse.

    Strings that look like a number go through ``try_cast`` (ANSI mode would
    raise on ``'abc'``, and each failed cast costs an exception inside);
    numeric types cast directly; anything else is not numeric.
    """
    if isinstance(dtype, T.StringType):
        return F.when(c.rlike(NUMBER), c.try_cast("double"))
    if is_numeric_type(dtype):
        return c.cast("double")
    return F.lit(None).cast("double")


def null_or_nan(c: Column, dtype: T.DataType, empty_as_null: bool = True) -> Column:
    """True where a value counts as missing: SQL null, NaN, or the string NaN.

    ``empty_as_null`` also counts ``''`` — the combined output writes null as
    ``''`` and a CSV re-read turns it back into null.
    """
    cond = c.isNull()
    if isinstance(dtype, T.StringType):
        cond = cond | c.rlike(NAN)
        if empty_as_null:
            cond = cond | (c == F.lit(""))
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        cond = cond | F.isnan(c)
    return F.coalesce(cond, F.lit(False))
