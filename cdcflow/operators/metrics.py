"""Batch quality metrics as native aggregates, in long form with thresholds.

``batch`` is a batch number or the name of a column that holds one; with a column all
batches are measured in the same pass.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cdcflow.spec import Check

log = logging.getLogger(__name__)

# Metric names as they appear in the metrics table.
COMPLETENESS, UNIQUENESS, COMPLIANCE, SIZE = "Completeness", "Uniqueness", "Compliance", "Size"
METRIC_NAMES = {m.lower(): m for m in (COMPLETENESS, UNIQUENESS, COMPLIANCE, SIZE)}

METRIC_COLUMNS = [
    "table_name",
    "batch_id",
    "metric_name",
    "column_name",
    "metric_value",
    "threshold",
    "passed",
    "timestamp",
]

_COUNTS = "metric_name string, column_name string, matching bigint, total bigint, threshold double, severity string"


def metric_counts(df: DataFrame, checks: Sequence[Check], batch: int | str, *, strict: bool = True) -> DataFrame:
    """One row per batch and check with the counts behind its value, from one read of ``df``.

    Without uniqueness checks all share one aggregate. With some, every row also yields the
    value of each such column; values are counted first, before the shuffle too, and the
    counts then summed up, whatever the number of columns. A single column needs no such copies:
    the rows themselves are counted by its values.

    A compliance expression is evaluated as Spark would in a filter: one that may raise on
    odd text (a plain cast, say) stops the batch, so write ``try_cast`` and the like.
    """
    checks = usable(df, checks, strict)
    keyed = df.withColumn("batch_id", (F.col(batch) if isinstance(batch, str) else F.lit(batch)).cast("long"))
    by_column = ["batch_id"] if isinstance(batch, str) else []
    if not checks:
        return df.sparkSession.createDataFrame([], f"batch_id bigint, {_COUNTS}")
    single = [c for c in checks if METRIC_NAMES[c.metric.lower()] == UNIQUENESS]
    plain = [c for c in checks if c not in single]
    held = {i: _holds(c) for i, c in enumerate(plain)}
    conditions = {i: c for i, c in held.items() if c is not None}
    if len(single) == 1:
        wide = _by_value(keyed, single[0], conditions, by_column)
    elif single:
        wide = _with_values(keyed, single, conditions, by_column)
    else:
        wide = keyed.groupBy(*by_column).agg(
            F.count("*").alias("_n"), *[F.count_if(c).alias(f"_m{i}") for i, c in conditions.items()]
        )
    rows = [_row(c, F.col("_n" if held[i] is None else f"_m{i}"), F.col("_n")) for i, c in enumerate(plain)]
    rows += [_row(c, F.col(f"_once{j}"), F.col(f"_all{j}")) for j, c in enumerate(single)]
    counts = wide.select(*by_column, F.inline(F.array(*rows)))
    if not by_column:
        counts = counts.withColumn("batch_id", F.lit(batch).cast("long"))
    return counts.select("batch_id", "metric_name", "column_name", "matching", "total", "threshold", "severity")


def compute_metrics(
    df: DataFrame, checks: Sequence[Check], table: str, batch: int | str, at: Column, *, strict: bool = True
) -> DataFrame:
    """Metric rows plus ``severity``; a ratio over no rows has no value and no row."""
    return values(metric_counts(df, checks, batch, strict=strict), table, at)


def values(counts: DataFrame, table: str, at: Column) -> DataFrame:
    """Turn counts into metric values and judge them against their own thresholds."""
    value = F.when(F.col("metric_name") == SIZE, F.col("matching").cast("double")).otherwise(
        F.try_divide("matching", "total")
    )
    return (
        counts.withColumns({"table_name": F.lit(table), "metric_value": value, "timestamp": at})
        .filter(F.col("metric_value").isNotNull())
        .withColumn("passed", F.coalesce(F.col("metric_value") >= F.col("threshold"), F.lit(True)))
        .select(*METRIC_COLUMNS, "severity")
    )


def breaches(metrics: DataFrame) -> DataFrame:
    """Metric rows below their threshold."""
    return metrics.filter(~F.col("passed"))


def running(counts: DataFrame, table: str, uniqueness: DataFrame | None = None) -> DataFrame:
    """Metrics over all batches so far, from summed counts.

    Whether a value repeats across batches cannot be read from per-batch counts, so rows of
    uniqueness are those of ``uniqueness`` (``value_state.running_uniqueness``), none without it.
    The window runs over one row per batch, not over the data.
    """
    w = (
        Window.partitionBy("metric_name", "column_name")
        .orderBy("batch_id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = counts.filter(F.col("metric_name") != UNIQUENESS).withColumns(
        {"matching": F.sum("matching").over(w), "total": F.sum("total").over(w)}
    )
    value = F.when(F.col("metric_name") == SIZE, F.col("matching").cast("double")).otherwise(
        F.try_divide("matching", "total")
    )
    found = summed.select(
        F.lit(table).alias("table_name"), "batch_id", "metric_name", "column_name", value.alias("running_value")
    )
    return found if uniqueness is None else found.unionByName(uniqueness)


def latest(metrics: DataFrame) -> DataFrame:
    """The most recent result for each table, batch, metric and column."""
    w = Window.partitionBy("table_name", "batch_id", "metric_name", "column_name").orderBy(F.desc("timestamp"))
    return metrics.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def summarise(metrics: DataFrame) -> DataFrame:
    """Batch quality over time: average, minimum, batches and failed batches."""
    return (
        metrics.groupBy("table_name", "metric_name", "column_name")
        .agg(
            F.avg("metric_value").alias("avg_metric"),
            F.min("metric_value").alias("min_metric"),
            F.count("*").alias("batch_count"),
            F.count_if(~F.col("passed")).alias("failed_batches"),
        )
        .orderBy("table_name", "metric_name", "column_name")
    )


def trend(metrics: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Average, minimum, maximum and failures within the last ``hours``."""
    since = now - F.make_dt_interval(hours=F.lit(hours))
    return (
        metrics.filter(F.col("timestamp") > since)
        .groupBy("table_name", "metric_name", "column_name")
        .agg(
            F.avg("metric_value").alias("avg_value"),
            F.min("metric_value").alias("min_value"),
            F.max("metric_value").alias("max_value"),
            F.count_if(~F.col("passed")).alias("failures"),
        )
    )


def usable(df: DataFrame, checks: Sequence[Check], strict: bool = True) -> list[Check]:
    """Checks that can be evaluated on ``df``; with ``strict`` an unusable one raises."""
    kept = []
    for check in checks:
        name = METRIC_NAMES.get(check.metric.lower())
        needs_column = name != SIZE and not (name == COMPLIANCE and check.expression)
        problem = None
        if name is None:
            problem = f"unknown metric {check.metric!r}"
        elif needs_column and check.column not in df.columns:
            problem = f"{name}: no column {check.column!r}"
        if problem is None:
            kept.append(check)
        elif strict:
            raise ValueError(problem)
        else:
            log.warning("%s, skipped", problem)
    return kept


def _holds(check: Check) -> Column | None:
    """The condition a check counts; None for the row count itself."""
    name = METRIC_NAMES[check.metric.lower()]
    if name == COMPLETENESS:
        return F.col(check.column).isNotNull()
    if name == COMPLIANCE:
        return F.expr(check.expression) if check.expression else F.col(check.column).rlike(check.pattern)
    return None


def _instance(check: Check) -> str | None:
    """What the metric is about: a column, a named constraint, or the whole table."""
    name = METRIC_NAMES[check.metric.lower()]
    if name == SIZE:
        return None
    if name == COMPLIANCE:
        return (check.name or f"{check.column}_custom") if check.expression else f"{check.column}_compliance"
    return check.column


def _row(check: Check, matching: Column, total: Column) -> Column:
    return F.struct(
        F.lit(METRIC_NAMES[check.metric.lower()]).alias("metric_name"),
        F.lit(_instance(check)).cast("string").alias("column_name"),
        matching.alias("matching"),
        total.alias("total"),
        F.lit(check.threshold).cast("double").alias("threshold"),
        F.lit(check.severity).alias("severity"),
    )


def _with_values(df: DataFrame, single: list[Check], conditions: dict[int, Column], by_column: list[str]) -> DataFrame:
    """The plain counts and, for each column of ``single``, values that occur once and all non-NULL ones.

    Every row yields itself (place -1) with its conditions and the non-NULL values as text.
    """
    flags = [F.coalesce(c, F.lit(False)).cast("long").alias(f"_m{i}") for i, c in conditions.items()]
    none = [F.lit(0).cast("long").alias(f"_m{i}") for i in conditions]
    own = F.struct(F.lit(-1).alias("_place"), F.lit(None).cast("string").alias("_value"), *flags)
    values = [
        F.when(
            F.col(c.column).isNotNull(), F.struct(F.lit(j).alias("_place"), as_text(df, c.column).alias("_value"), *none)
        )
        for j, c in enumerate(single)
    ]
    each = df.select(*by_column, F.inline(F.filter(F.array(own, *values), lambda v: v.isNotNull())))
    counted = each.groupBy(*by_column, "_place", "_value").agg(
        F.count("*").alias("_rows"), *[F.sum(f"_m{i}").alias(f"_m{i}") for i in conditions]
    )
    of = lambda j: F.col("_place") == j
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = [zero(F.sum(F.when(of(-1), F.col("_rows")))).alias("_n")]
    sums += [zero(F.sum(F.col(f"_m{i}"))).alias(f"_m{i}") for i in conditions]
    for j in range(len(single)):
        sums.append(F.count_if(of(j) & (F.col("_rows") == 1)).alias(f"_once{j}"))
        sums.append(zero(F.sum(F.when(of(j), F.col("_rows")))).alias(f"_all{j}"))
    return counted.groupBy(*by_column).agg(*sums)


def _by_value(df: DataFrame, check: Check, conditions: dict[int, Column], by_column: list[str]) -> DataFrame:
    """What ``_with_values`` gives, for one column; whole numbers are compared as they are."""
    whole = isinstance(df.schema[check.column].dataType, T.IntegralType)
    value = F.col(check.column) if whole else as_text(df, check.column)
    counted = df.groupBy(*by_column, value.alias("_value")).agg(
        F.count("*").alias("_rows"), *[F.count_if(c).alias(f"_m{i}") for i, c in conditions.items()]
    )
    known = F.col("_value").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    return counted.groupBy(*by_column).agg(
        zero(F.sum("_rows")).alias("_n"),
        *[zero(F.sum(f"_m{i}")).alias(f"_m{i}") for i in conditions],
        F.count_if(known & (F.col("_rows") == 1)).alias("_once0"),
        zero(F.sum(F.when(known, F.col("_rows")))).alias("_all0"),
    )


def as_text(df: DataFrame, column: str) -> Column:
    """Equal values as equal text: 0.0 and -0.0 are one, bytes are written out."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return (F.col(column) + F.lit(0.0)).cast("string")
    if isinstance(dtype, T.BinaryType):
        return F.hex(column)
    return F.col(column).cast("string")
