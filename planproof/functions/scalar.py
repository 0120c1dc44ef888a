"""Scalar functions whose meaning differs between engines, as Columns. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared type names by the type they are read as. `numeric` is double: no precision is declared.
_NAMES = {
    "long": "int64 int integer bigint smallint tinyint number",
    "double": "float64 float double real numeric bignumeric decimal",
    "boolean": "bool boolean",
    "timestamp_ntz": "datetime timestamp timestamp_ntz timestamp_tz timestamp_ltz timestamptz",
    "date": "date",
    "string": "string text char varchar enum json jsonb variant super",
}
_BY_NAME = {n: t for t, names in _NAMES.items() for n in names.split()}
_TYPES = {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(), "date": T.DateType(), "string": T.StringType()}


def declared_type(name: str | None) -> T.DataType:
    """The Spark type of a declared type; `(p, s)` is dropped, unknown names are strings."""
    return _TYPES[_BY_NAME.get((name or "").split("(")[0].strip().lower(), "string")]


def try_cast_text(c: Column, t: T.DataType) -> Column:
    """A lenient cast from text. '1.0' and '2.6' are whole numbers 1 and 3 (Spark alone gives NULL)."""
    if isinstance(t, T.LongType):
        return F.coalesce(c.try_cast("bigint"), F.round(c.try_cast("double")).try_cast("bigint"))
    return c.try_cast(t)


_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def date_diff(unit: str, start: Column, end: Column) -> Column:
    """Boundaries of the unit crossed from start to end, not whole units elapsed."""
    unit = unit.lower()
    cut = lambda c: F.date_trunc(unit, c.cast("timestamp"))
    if unit in _SECONDS:
        return F.expr("0").cast("long") + F.floor((F.unix_timestamp(cut(end)) - F.unix_timestamp(cut(start))) / _SECONDS[unit])
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    if unit == "month":
        return months.cast("long")
    if unit == "quarter":
        return ((F.year(end) - F.year(start)) * 4 + F.quarter(end) - F.quarter(start)).cast("long")
    if unit == "year":
        return (F.year(end) - F.year(start)).cast("long")
    raise ValueError(f"unknown unit {unit}")


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def ieee_divide(a: Column, b: Column) -> Column:
    """Division that gives infinities and NaN for a zero divisor, NULL for NULL."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, zero).otherwise(F.try_divide(a, b))


def cents_to_units(c: Column) -> Column:
    return F.round(c / 100, 2)


def time_spine(spark, first: str, last: str):
    """One row a day from first to last, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("date_day"))
