"""What several operators share: column names that cannot clash, distributed running sums."""

from __future__ import annotations

import math
import pathlib
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: One word of the contracts: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python, once for each application.

    Functions that run in tasks are found there by name; nothing else says where the driver has them from.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = pathlib.Path(__file__).resolve().parents[1]
    packed = pathlib.Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(packed, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(packed))
    _shipped.add(application)


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


def same(left: DataFrame, right: DataFrame, columns: dict[str, str]) -> Column:
    """Null-safe equality of left columns (keys) with right ones (values)."""
    tests = [left[a].eqNullSafe(right[b]) for a, b in columns.items()]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucket_bits(rows: int) -> int:
    """Bits of a hash that deal ``rows`` into about sqrt(rows) buckets of about sqrt(rows) rows."""
    return max(1, math.ceil(math.log2(max(rows, 2)) / 2))


def running_before(df: DataFrame, group: list[str], key: str, ties: list[str], value: str, name: str, bits: int) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the earlier rows of the group, in the order of ``key`` and ``ties``.

    ``key`` is a 64-bit hash. Its upper ``bits`` deal every group into buckets; bucket totals, at most 2 ** bits
    for a group, give each bucket its start, so no task ever holds a whole group, however hot.
    """
    bucket, start, start_bucket = fresh(df, "_bucket", "_start", "_start_bucket")
    renamed = {g: n for g, n in zip(group, fresh(df, *(f"_start_{g}" for g in group)), strict=True)}
    dealt = df.withColumn(bucket, F.shiftrightunsigned(F.col(key), 64 - bits))
    totals = dealt.groupBy(*group, bucket).agg(F.sum(value).alias(start))
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *(F.col(g).alias(n) for g, n in renamed.items()),
        F.col(bucket).alias(start_bucket),
        F.coalesce(F.sum(start).over(earlier), F.lit(0)).alias(start),
    )
    joined = dealt.join(starts, same(dealt, starts, {**renamed, bucket: start_bucket}))
    within = Window.partitionBy(*group, bucket).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(name, F.col(start) + F.coalesce(F.sum(value).over(within), F.lit(0))).drop(
        bucket, start, start_bucket, *renamed.values()
    )
