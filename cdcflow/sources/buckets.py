"""Open versions as a bucketed table of Spark's own, and merges that leave it where it is.

A table bucketed by its key tells Spark how its rows are dealt. A batch of changes is then dealt
the same way and joined with it bucket by bucket: only the changes are exchanged, and as they are
the side that is hashed, the table is not sorted either.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cdcflow.operators import history as H


class BucketedVersions:
    """The open versions of one table below ``path``, in ``buckets`` parts by ``key``.

    Each write goes to a folder of its own, ``path/<name>``; a reader names the one it wants. The
    catalog entry that a bucketed write needs lives only as long as the call.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], buckets: int) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), list(key), buckets

    def write(self, name: str, versions: DataFrame) -> None:
        """Write open versions as ``name``; one dealt by key already is not shuffled, and each bucket is one file."""
        table = self._entry()
        try:
            dealt = versions.repartition(self.buckets, *self.key)
            writer = dealt.write.mode("overwrite").option("path", f"{self.path}/{name}").bucketBy(self.buckets, *self.key)
            writer.saveAsTable(table)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def read(self, name: str) -> DataFrame:
        """Versions of ``name`` in a frame that knows how they are dealt."""
        table = self._entry()
        columns = self.spark.read.parquet(f"{self.path}/{name}").schema
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
        keys = ", ".join(f"`{k}`" for k in self.key)
        try:
            self.spark.sql(
                f"CREATE TABLE {table} ({fields}) USING parquet CLUSTERED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
            )
            return self.spark.table(table)
        finally:
            # The table is external: its files stay, and the frame has what it needs.
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def merged(self, name: str, staged: DataFrame) -> DataFrame:
        """The versions after a batch: those it closed, and all that are open then.

        ``staged`` has one change for each key, none older than the last closed version of the
        table, so that it meets open versions only; a change older than its key's open version
        raises, and such batches go through ``history.apply_changes`` with the whole history.
        Updates of unknown keys open a version, deletes of unknown keys are told by no row.
        """
        old, new = self.read(name), H.known_changes(staged)
        columns = old.columns
        held = old.select(F.struct(*columns).alias("_old"), *[F.col(k).alias(f"_old{i}") for i, k in enumerate(self.key)])
        came = new.select(F.struct(*columns).alias("_new"), *[F.col(k).alias(f"_new{i}") for i, k in enumerate(self.key)])
        same = [F.col(f"_old{i}") == F.col(f"_new{i}") for i in range(len(self.key))]
        both = held.join(came.hint("shuffle_hash"), same, "full_outer")
        begins, since = F.col(f"_new.{H.FROM}"), F.col(f"_old.{H.FROM}")
        changed, known = F.col("_new").isNotNull(), F.col("_old").isNotNull()
        late = F.raise_error(F.lit("a change is older than its key's open version"))
        parts = {c: F.col(f"_old.{c}") for c in columns}
        stays = F.struct(*parts.values())
        ended = {**parts, H.TO: begins.cast(old.schema[H.TO].dataType), H.CURRENT: F.lit(False)}
        closed = F.struct(*[v.alias(c) for c, v in ended.items()])
        opened = F.struct(*[F.col(f"_new.{c}").alias(c) for c in columns])
        first = F.when(known & ~changed, stays).when(known & changed & (begins > since), closed)
        guarded = F.when(known & changed & (begins < since), late.cast(first_type(both, first))).otherwise(first)
        second = F.when(changed & F.col(f"_new.{H.OPERATION}").isin(*H.WRITTEN), opened)
        return both.select(F.inline(F.filter(F.array(guarded, second), lambda v: v.isNotNull())))

    def _entry(self) -> str:
        return f"cdcflow_{uuid.uuid4().hex}"


def first_type(df: DataFrame, c):
    return df.select(c.alias("_c")).schema["_c"].dataType
