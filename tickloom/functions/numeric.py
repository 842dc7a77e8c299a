"""Null-safe numeric column helpers. NaN and infinities count as missing everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value as a double, or null where it is NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def holds(condition: Column) -> Column:
    """A condition that is false where it can't be decided."""
    return F.coalesce(condition, F.lit(False))


def coerce(c: Column) -> Column:
    """Text or numbers to a finite double; what isn't a number is null."""
    return finite(c.try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def normalise(df: DataFrame) -> DataFrame:
    """Floating-point NaN and infinities to null in all columns, so that null tests see them."""
    kinds = dict(df.dtypes)
    return df.select(*(finite(F.col(c)).cast(kinds[c]).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns))
