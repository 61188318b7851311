"""Database constraints as queries that return what violates them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from cdcflow.functions.columns import literal_as
from cdcflow.spec import TableSpec


def primary_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that are incomplete or held by more than one row, with their row count."""
    incomplete = _any_null(key)
    return (
        df.groupBy(*key)
        .agg(F.count("*").alias("rows"))
        .filter(incomplete | (F.col("rows") > 1))
        .withColumn("violation", F.when(incomplete, "null").otherwise("duplicate"))
    )


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs per column, from one aggregate."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)])
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("null_rows")) for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Repeated combinations; as in SQL, a combination with a NULL repeats nothing."""
    return (
        df.filter(~_any_null(columns)).groupBy(*columns).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)
    )


def foreign_key(child: DataFrame, column: str, parent: DataFrame, ref_column: str) -> DataFrame:
    """Child rows whose reference finds no parent; a NULL reference is allowed."""
    keys = parent.select(F.col(ref_column).alias("_ref"))
    return child.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_ref"), "left_anti")


def unique_after(
    repeated: DataFrame | None, current: DataFrame | None, staged: DataFrame, key: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Repeated combinations among the open versions after a batch: columns and rows, as ``unique`` of all of them.

    ``repeated`` and ``current`` are this result and the open versions before the batch, ``staged`` its
    last change of each key. Only combinations that a changed key had or gets are counted anew; a
    DELETE, or a change to another value, frees what its key held. The open versions are read in
    the key and ``columns`` alone and joined with what the batch brings, never shuffled as a whole
    where that is small enough to broadcast.
    """
    kept = [c for c in [*key, *columns] if c not in columns] + list(columns)
    writes = staged.filter(F.col("_operation").isin("INSERT", "UPDATE")).select(*kept).filter(~_any_null(columns))
    if current is None or repeated is None:
        return unique(writes, columns)
    changed = staged.select(*key).distinct()
    held = current.select(*kept).filter(~_any_null(columns))
    freed = held.join(changed, list(key), "left_semi").select(*columns)
    met = freed.unionByName(writes.select(*columns)).distinct()
    stay = held.join(changed, list(key), "left_anti").join(met, list(columns), "left_semi")
    counted = unique(stay.select(*columns).unionByName(writes.select(*columns)), columns)
    return repeated.join(met, list(columns), "left_anti").select(*columns, "rows").unionByName(counted)


def orphan_intervals(
    child: DataFrame, column: str, parent: DataFrame, ref_column: str, begin: str = "_effective_from", end: str = "_effective_to"
) -> DataFrame:
    """When child versions had no parent: the child's columns, ``orphan_from`` and ``orphan_to`` (NULL: still).

    Both sides are histories. A parent is away before its first version, between two that do not
    meet, and after its last if that ended, so children that came before their parent are found as
    well as those it left. Each absence is met with the children of that parent whose own time it
    overlaps; a NULL reference is allowed.
    """
    w = Window.partitionBy("_ref").orderBy("_begin")
    spans = parent.select(F.col(ref_column).alias("_ref"), F.col(begin).alias("_begin"), F.col(end).alias("_end")).filter(F.col("_ref").isNotNull())
    ordered = spans.withColumns({"_before": F.lag("_end").over(w), "_first": F.row_number().over(w) == 1, "_next": F.lead("_begin").over(w)})
    none = F.lit(None).cast(spans.schema["_begin"].dataType)
    leading = F.when(F.col("_first") | (F.col("_before") < F.col("_begin")), F.struct(F.when(~F.col("_first"), F.col("_before")).alias("_away"), F.col("_begin").alias("_back")))
    trailing = F.when(F.col("_next").isNull() & F.col("_end").isNotNull(), F.struct(F.col("_end").alias("_away"), none.alias("_back")))
    absences = ordered.select("_ref", F.inline(F.filter(F.array(leading, trailing), lambda a: a.isNotNull())))
    bound = child.filter(F.col(column).isNotNull())
    met = (F.col("_back").isNull() | (F.col("_back") > F.col(begin))) & (F.col("_away").isNull() | F.col(end).isNull() | (F.col("_away") < F.col(end)))
    apart = bound.join(absences, (F.col(column) == F.col("_ref")) & met)
    left = apart.select(*child.columns, F.greatest(begin, "_away").alias("orphan_from"), F.least(end, "_back").alias("orphan_to"))
    never = bound.join(spans.select("_ref"), F.col(column) == F.col("_ref"), "left_anti")
    return left.unionByName(never.select(*child.columns, F.col(begin).alias("orphan_from"), F.col(end).alias("orphan_to")))


def defaults(df: DataFrame, values: Mapping[str, Any], now: Column) -> DataFrame:
    """Fill NULLs with declared defaults; the text ``NOW()`` stands for the batch time."""
    filled = {}
    for name, value in values.items():
        dtype = df.schema[name].dataType
        is_now = isinstance(value, str) and value.upper() == "NOW()"
        filled[name] = F.coalesce(F.col(name), now.cast(dtype) if is_now else literal_as(value, dtype))
    return df.withColumns(filled)


def _any_null(columns: Sequence[str]) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in columns])


def violations(spec: TableSpec, df: DataFrame, parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """What the rows of a table break of its description: constraint, columns and number of rows.

    One row for each constraint that is broken: ``primary_key``, ``not_null`` (columns marked as
    not nullable), ``unique`` (columns and indexes) and ``foreign_key``. Rows that repeat a value
    all count. ``parents`` holds the referenced tables by name; a reference to one that is not
    given raises.
    """
    parents = parents or {}
    found = []

    def add(kind: str, columns: Sequence[str], rows: DataFrame, count: Column) -> None:
        total = rows.agg(F.coalesce(count, F.lit(0)).alias("rows"))
        found.append(total.select(F.lit(kind).alias("constraint"), F.lit(",".join(columns)).alias("columns"), "rows"))

    if spec.primary_key:
        add("primary_key", spec.primary_key, primary_key(df, spec.primary_key), F.sum("rows"))
    required = [c.name for c in spec.columns if not c.nullable]
    if required:
        wide = not_null(df, required)
        found.append(wide.select(F.lit("not_null").alias("constraint"), F.col("column_name").alias("columns"), F.col("null_rows").alias("rows")))
    for columns in [*[(c.name,) for c in spec.columns if c.unique], *spec.unique_keys]:
        add("unique", columns, unique(df, columns), F.sum("rows"))
    for key in spec.foreign_keys:
        if key.table not in parents:
            raise ValueError(f"{spec.name}: {key.column} refers to {key.table}, which is not given")
        add("foreign_key", [key.column], foreign_key(df, key.column, parents[key.table], key.ref_column), F.count("*"))
    if not found:
        return df.sparkSession.createDataFrame([], "constraint string, columns string, rows bigint")
    return reduce(DataFrame.unionByName, found).filter(F.col("rows") > 0)


def described_defaults(spec: TableSpec, df: DataFrame, now: Column) -> DataFrame:
    """The rows with NULLs replaced by the defaults of the description."""
    return defaults(df, {c.name: c.default for c in spec.columns if c.default is not None}, now)
