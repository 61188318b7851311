"""Failed rows as a queryable table, and what can be reported from it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from cdcflow.functions.columns import hour_label
from cdcflow.operators.rules import FAILED, OPERATION, WARNED
from cdcflow.sources.envelope import CONTROL, KIND, MALFORMED, ROW, rows_of

PARTITIONS = ["table_name", "run_date", "batch_id"]
COUNTS = (
    "table_name string, batch_id bigint, messages bigint, malformed_count bigint, control_count bigint, total_rows bigint, "
    "quarantined_count bigint, unknown_count bigint, staged_count bigint, failed_rules array<string>, path string, "
    "quarantined_at timestamp, first_change timestamp"
)


def quarantine_frame(tagged: DataFrame, table: str, batch_id: int | Column, at: Column) -> DataFrame:
    """Failed rows with the time they were set aside and the three partition columns."""
    batch = batch_id if isinstance(batch_id, Column) else F.lit(batch_id)
    return (
        tagged.filter(F.col(FAILED).isNotNull())
        .drop(WARNED)
        .withColumns(
            {
                "_quarantined_at": at,
                "run_date": hour_label(at),
                "table_name": F.lit(table),
                "batch_id": batch.cast("long"),
            }
        )
    )


def union_tables(*frames: DataFrame) -> DataFrame:
    """Quarantined rows of several tables; a column one of them lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def summary(tagged: DataFrame, table: str, batch_id: int | Column, at: Column, path: str = "") -> DataFrame:
    """The facts an alert needs: one row per batch with quarantined or unknown rows."""
    batch = batch_id if isinstance(batch_id, Column) else F.lit(batch_id)
    unknown = F.col(OPERATION) == "UNKNOWN" if OPERATION in tagged.columns else F.lit(False)
    return (
        tagged.groupBy(batch.cast("long").alias("batch_id"))
        .agg(
            F.count("*").alias("total_rows"),
            F.count(FAILED).alias("quarantined_count"),
            F.count_if(unknown).alias("unknown_count"),
            F.array_sort(F.collect_set(FAILED)).alias("failed_rules"),
            F.max(at).alias("quarantined_at"),
        )
        .filter((F.col("quarantined_count") > 0) | (F.col("unknown_count") > 0))
        .withColumns({"table_name": F.lit(table), "path": F.lit(path)})
        .select(
            "table_name",
            "batch_id",
            "total_rows",
            "quarantined_count",
            "unknown_count",
            "failed_rules",
            "path",
            "quarantined_at",
        )
    )


def batch_counts(
    classified: DataFrame,
    tagged: DataFrame,
    staged: DataFrame,
    table: str,
    batch_id: int | Column,
    at: Column,
    path: str = "",
) -> DataFrame:
    """What became of a batch's messages: one row per batch, clean ones and those without a usable message too.

    messages = malformed + control + total_rows; of these rows some are quarantined, some
    unknown, and ``staged_count`` changes are left after de-duplication. The frames are those
    of one batch, or of several with ``batch_id`` a column of theirs.
    """
    number = (batch_id if isinstance(batch_id, Column) else F.lit(batch_id)).cast("long").alias("batch_id")
    unknown = F.col(OPERATION) == "UNKNOWN"
    sums = {
        "messages": (classified, F.count("*")),
        "malformed_count": (classified, F.count_if(F.col(KIND) == MALFORMED)),
        "control_count": (classified, F.count_if(F.col(KIND) == CONTROL)),
        "total_rows": (classified, F.count_if(F.col(KIND) == ROW)),
        "quarantined_count": (tagged, F.count(FAILED)),
        "unknown_count": (tagged, F.count_if(unknown)),
        "staged_count": (staged, F.count("*")),
    }
    rules = F.array_sort(F.collect_set(FAILED)).alias("failed_rules")
    parts = [
        frame.groupBy(number).agg(*[c.alias(n) for n, (f, c) in sums.items() if f is frame], *([rules] if frame is tagged else []))
        for frame in (classified, tagged, staged)
    ]
    if not isinstance(batch_id, Column):
        # A batch without any message has its row as well.
        one = classified.sparkSession.range(1).select(number)
        parts.append(one)
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return (
        whole.groupBy("batch_id")
        .agg(
            *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums],
            F.coalesce(F.first("failed_rules", ignorenulls=True), F.array().cast("array<string>")).alias("failed_rules"),
        )
        .select(
            F.lit(table).alias("table_name"), "batch_id", *sums, "failed_rules", F.lit(path).alias("path"), at.alias("quarantined_at")
        )
    )


def observed(
    classified: DataFrame, tagged: DataFrame, rules: Sequence[str], frame: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, Callable[[], dict[str, Any]]]:
    """``frame`` of the tagged rows, and what ``batch_counts`` counts of the messages once that frame is written.

    Both inputs are counted in the stage that writes, as rows pass by; of the classified messages
    none goes on. Each rule has a counter of its own, which tells the rules that failed. With
    ``tagged`` all messages (they still have their ``_kind``), one read of them tells everything.
    """
    whole = KIND in tagged.columns
    row = F.col(KIND) == ROW if whole else F.lit(True)
    kinds = {"malformed_count": MALFORMED, "control_count": CONTROL, "total_rows": ROW}
    of_messages = [F.count("*").alias("messages"), *[F.count_if(F.col(KIND) == k).alias(n) for n, k in kinds.items()]]
    of_rows = [
        F.count_if(row & F.col(FAILED).isNotNull()).alias("quarantined_count"),
        F.count_if(row & (F.col(OPERATION) == "UNKNOWN")).alias("unknown_count"),
        *[F.count_if(row & (F.col(FAILED) == r)).alias(f"rule{i}") for i, r in enumerate(rules)],
    ]
    seen = [Observation()] if whole else [Observation(), Observation()]
    if whole:
        kept = frame(rows_of(tagged.observe(seen[0], *of_messages, *of_rows)))
    else:
        kept = frame(tagged.observe(seen[0], *of_rows))
        messages = classified.observe(seen[1], *of_messages)
        none = messages.filter(~F.col(KIND).isin(ROW, CONTROL, MALFORMED))
        kept = kept.unionAll(none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kept.schema]))

    def counts() -> dict[str, Any]:
        found = {k: v for o in seen for k, v in o.get.items()}
        failed = sorted({r for i, r in enumerate(rules) if found[f"rule{i}"]})
        return {**{k: v for k, v in found.items() if not k.startswith("rule")}, "failed_rules": failed}

    return kept, counts


def counts_row(spark: SparkSession, counts: dict[str, Any], table: str, batch_id: int, at: dt.datetime, path: str) -> DataFrame:
    """Observed counts of a batch as the row that ``batch_counts`` would give, and when its changes begin."""
    whole = {**counts, "table_name": table, "batch_id": batch_id, "path": path, "quarantined_at": at}
    zoned = {k: v.replace(tzinfo=dt.timezone.utc) if isinstance(v, dt.datetime) else v for k, v in whole.items()}
    return spark.createDataFrame([tuple(zoned[f.split()[0]] for f in COUNTS.split(", "))], COUNTS)


def by_rule(quarantined: DataFrame) -> DataFrame:
    """What is set aside and why: rows per table, rule and hour."""
    return quarantined.groupBy("table_name", FAILED, "run_date").agg(F.count("*").alias("rows"))


def by_hour(quarantined: DataFrame) -> DataFrame:
    return quarantined.groupBy("run_date", "table_name").agg(F.count("*").alias("rows"))
