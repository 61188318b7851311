"""Scalar column expressions; everything here stays inside Spark's own operators."""

from __future__ import annotations

import datetime as dt
import decimal
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

MASK = "****"
LITERALS = {True: "true", False: "false"}


def map_operation(op: Column) -> Column:
    """Source operation code to INSERT, UPDATE, DELETE or UNKNOWN (NULL included)."""
    # Operation codes of the change feed.
    return (
        F.when(op.isin("insert", "load"), "INSERT")
        .when(op == "update", "UPDATE")
        .when(op == "delete", "DELETE")
        .otherwise("UNKNOWN")
    )


def mask(c: Column, visible: int = 4, keep: str = "first") -> Column:
    """Keep the first (or last) ``visible`` characters and hide the rest; NULL stays NULL."""
    if keep == "first":
        return F.concat(F.substring(c, 1, visible), F.lit(MASK))
    if keep == "last":
        shown = F.right(c, F.lit(visible)) if visible else F.substring(c, 1, 0)
        return F.concat(F.lit(MASK), shown)
    raise ValueError(f"keep must be 'first' or 'last', not {keep!r}")


def lenient_cast(c: Column, source: T.DataType, target: T.DataType) -> Column:
    """Cast that yields NULL for bad input; a decimal string loses its fraction in integer casts."""
    if isinstance(source, T.StringType) and isinstance(target, T.IntegralType):
        c = F.regexp_replace(F.regexp_replace(F.trim(c), r"^([+-]?)(\.\d+)$", "$10$2"), r"\.\d*$", "")
    return c.try_cast(target)


def hour_label(ts: Column) -> Column:
    """Start of the hour as text, the run label of quarantined rows."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:00:00")


def literal_as(value: Any, dtype: T.DataType) -> Column:
    """A literal of the column's own type, so that ANSI mode has nothing to coerce."""
    if isinstance(value, bool) and isinstance(dtype, T.StringType):
        value = LITERALS[value]
    return F.lit(value).cast(dtype)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fits(value: Any, dtype: T.DataType) -> bool:
    """Whether a configured value is one that a column of this type can hold, without loss."""
    if value is None or isinstance(dtype, T.StringType):
        return value is not None
    try:
        if isinstance(dtype, T.BooleanType):
            return isinstance(value, bool) or str(value).lower() in LITERALS.values()
        if isinstance(dtype, T.NumericType):
            if isinstance(value, bool):
                return False
            number = decimal.Decimal(str(value))
            if isinstance(dtype, T.DecimalType):
                whole = dtype.precision - dtype.scale
                return number == round(number, dtype.scale) and abs(number) < decimal.Decimal(10) ** whole
            if isinstance(dtype, T.IntegralType):
                bits = {"tinyint": 7, "smallint": 15, "int": 31}.get(dtype.simpleString(), 63)
                return number == int(number) and -(2**bits) <= number < 2**bits
            return True
        if isinstance(dtype, T.DateType):
            return isinstance(value, dt.date) or bool(dt.date.fromisoformat(str(value)))
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            return isinstance(value, dt.datetime) or bool(dt.datetime.fromisoformat(str(value)))
    except (ValueError, ArithmeticError):
        return False
    return True
