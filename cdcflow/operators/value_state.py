"""Uniqueness over all batches so far, from state that batches add to.

A value is unique as long as it has been seen once. What a batch does to a column's uniqueness is
a change of two numbers: values seen once, and values at all. These changes add up, so the state
after any batch is a sum over the batches before it, and a batch only has to find out which of its
own values are known already.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cdcflow.operators.metrics import METRIC_NAMES, UNIQUENESS, as_text
from cdcflow.session import folders_in, remove_folder
from cdcflow.spec import Check

CHANGES = "column_name string, once bigint, total bigint, batch_id bigint"
VALUES = "column_name string, value string, once boolean, batch_id bigint"


def unique_columns(checks: Sequence[Check]) -> list[str]:
    return [c.column for c in checks if METRIC_NAMES.get(c.metric.lower()) == UNIQUENESS and c.column]


def value_counts(df: DataFrame, columns: Sequence[str], batch: str | None = None) -> DataFrame:
    """column_name, value (as text, NULL too) and rows of every value, with ``batch`` for each of its batches.

    Counted before the shuffle, so a value that fills the batch is a row per task.
    """
    by = [F.col(batch).cast("long").alias("batch_id")] if batch else []
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), as_text(df, c).alias("value")) for c in columns])
    return df.select(*by, F.inline(each)).groupBy(*(["batch_id"] if batch else []), "column_name", "value").agg(F.count("*").alias("rows"))


def changes_of(counts: DataFrame) -> DataFrame:
    """What each batch changes, for all batches at once: column_name, once, total and batch_id.

    A value counts from its first batch, if it comes once there, until its second; NULL does not count.
    """
    w = Window.partitionBy("column_name", "value").orderBy("batch_id")
    place, before = F.row_number().over(w), F.lag("rows").over(w)
    ranked = counts.withColumns({"_place": F.when(F.col("value").isNotNull(), place), "_before": before})
    change = F.when((F.col("_place") == 1) & (F.col("rows") == 1), 1).when((F.col("_place") == 2) & (F.col("_before") == 1), -1).otherwise(0)
    return ranked.groupBy("column_name", "batch_id").agg(
        F.sum(change).cast("long").alias("once"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("rows"))), F.lit(0)).alias("total")
    ).select("column_name", "once", "total", "batch_id")


def running_uniqueness(changes: DataFrame, table: str) -> DataFrame:
    """Uniqueness of each column over all batches up to each, in the shape of ``metrics.running``; one row per batch."""
    w = Window.partitionBy("column_name").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.try_divide(F.sum("once").over(w), F.sum("total").over(w))
    return changes.select(
        F.lit(table).alias("table_name"), "batch_id", F.lit(UNIQUENESS).alias("metric_name"), "column_name", value.alias("running_value")
    ).filter(F.col("running_value").isNotNull())


class ValueState:
    """The values a table's batches have brought, and what each batch changed.

        <root>/<table>/seen/batch_id=N      values new in batch N with ``once``, and known ones that
                                            came once before and are no longer unique
        <root>/<table>/unique/batch_id=N    change of both numbers by column
        <root>/<table>/seen_base/batch_id=N, seen_bases/batch_id=N   all values after batch N, once complete

    Batches come in rising order; the last one may be written again and replaces what it wrote.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def absorb(self, table: str, batch_id: int, df: DataFrame, columns: Sequence[str]) -> None:
        """Add a batch. It costs its own values and a join of the state with them, never a recount."""
        counts = value_counts(df, columns).filter(F.col("value").isNotNull())
        known = self._known(table, batch_id)
        if known is None:
            judged = counts.withColumn("_once", F.lit(None).cast("boolean"))
        else:
            keys = counts.select("column_name", "value")
            # Only state rows of the batch's values are grouped; Spark filters the rest by a bloom filter of its own.
            mine = known.join(keys, ["column_name", "value"], "left_semi")
            state = mine.groupBy("column_name", "value").agg(F.bool_and("once").alias("_once"))
            judged = counts.join(state, ["column_name", "value"], "left")
        new, ends = F.col("_once").isNull(), F.coalesce("_once", F.lit(False))
        judged = judged.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            told = judged.filter(new | ends).select("column_name", "value", (new & (F.col("rows") == 1)).alias("once"))
            self._replace(told, f"{table}/seen/batch_id={batch_id}")
            change = F.when(new & (F.col("rows") == 1), 1).when(ends, -1).otherwise(0)
            # A batch without values of a column leaves it as it is and has its row as well.
            none = self.spark.createDataFrame([(c, 0, 0) for c in columns], "column_name string, once long, total long")
            each = judged.select("column_name", change.cast("long").alias("once"), F.col("rows").alias("total")).unionByName(none)
            sums = each.groupBy("column_name").agg(F.sum("once").alias("once"), F.sum("total").alias("total"))
            self._replace(sums.coalesce(1), f"{table}/unique/batch_id={batch_id}")
        finally:
            judged.unpersist()

    def running(self, table: str) -> DataFrame | None:
        found = self._read(f"{table}/unique", CHANGES)
        return None if found is None else running_uniqueness(found, table)

    def compact(self, table: str) -> int:
        """Fold what the batches told into one row for each value; returns the last batch, -1 without any."""
        found = self._read(f"{table}/unique", CHANGES)
        last = None if found is None else found.agg(F.max("batch_id")).first()[0]
        if last is None or last == self._base(table, last + 1):
            return -1 if last is None else last
        whole = self._known(table, last + 1).groupBy("column_name", "value").agg(F.bool_and("once").alias("once"))
        self._replace(whole, f"{table}/seen_base/batch_id={last}")
        self._replace(self.spark.range(1), f"{table}/seen_bases/batch_id={last}")
        return last

    def expire(self, table: str) -> int:
        """Delete what the last base contains and the bases before it; returns how many folders went."""
        bases = [int(name.partition("=")[2]) for name in folders_in(f"{self.root}/{table}/seen_bases")]
        gone = 0
        for folder, keep in (("seen", max(bases, default=-1) + 1), ("seen_base", max(bases, default=-1)), ("seen_bases", max(bases, default=-1))):
            for name in folders_in(f"{self.root}/{table}/{folder}"):
                if int(name.partition("=")[2]) < keep:
                    remove_folder(f"{self.root}/{table}/{folder}/{name}")
                    gone += 1
        return gone

    def _base(self, table: str, before: int) -> int:
        found = self._read(f"{table}/seen_bases", "batch_id bigint")
        last = None if found is None else found.filter(F.col("batch_id") < before).agg(F.max("batch_id")).first()[0]
        return -1 if last is None else last

    def _known(self, table: str, before: int) -> DataFrame | None:
        """State rows of the batches before ``before``: those of the last base and of what follows."""
        base = self._base(table, before)
        since = self._read(f"{table}/seen", VALUES)
        parts = [] if since is None else [since.filter((F.col("batch_id") > base) & (F.col("batch_id") < before))]
        if base >= 0:
            parts.append(self._read(f"{table}/seen_base", VALUES).filter(F.col("batch_id") == base))
        return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _replace(self, df: DataFrame, place: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{place}")

    def _read(self, place: str, schema: str) -> DataFrame | None:
        path = f"{self.root}/{place}"
        try:
            return self.spark.read.option("basePath", path).schema(schema).parquet(path)
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
