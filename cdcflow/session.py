"""Session settings the library relies on and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where that costs one more shuffle of its result.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "cdcflow", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for name, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


_made: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: executors on other
    machines could not read it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="cdcflow-")
        spark.conf.set("spark.checkpoint.dir", shared)
    _made.append(f"{shared.rstrip('/')}/{uuid.uuid4().hex}")
    return _made[-1]


def clear_scratch() -> None:
    """Delete what this process wrote below the shared folder, once no frame that reads it is needed any more."""
    while _made:
        remove_folder(_made.pop())


def remove_folder(path: str) -> None:
    system, place = _system(path)
    if system.get_file_info(place).type != fs.FileType.NotFound:
        system.delete_dir(place)


def folders_in(path: str) -> list[str]:
    """Names of the folders directly below ``path``, none where it does not exist."""
    system, place = _system(path)
    found = system.get_file_info(fs.FileSelector(place, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{os.path.abspath(path)}")


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the shared folder.

    For frames that a plan uses several times: they are computed once, and a lost executor
    costs a read instead of the whole lineage.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(source: DataFrame, *, kept: bool = False) -> DataFrame:
    """Rows of a plain scan over all cores, for costly work per row such as JSON.

    Splits are cut by size, but a row group is read by one of them, so a file of few row groups
    leaves most splits empty. A source whose fullest split holds over one and a half times its
    even share of the rows is shuffled; others stay as they are. Rows are counted without reading a column.
    With ``kept``, for a source read several times, shuffled rows are written once.
    """
    cores = source.sparkSession.sparkContext.defaultParallelism
    held = source.groupBy(F.spark_partition_id()).count().agg(F.count("*"), F.max("count"), F.sum("count")).first()
    splits, fullest, rows = held[0], held[1] or 0, held[2] or 0
    if fullest * cores <= 1.5 * rows:
        return source
    even = source.repartition(max(cores, splits))
    return written(even) if kept else even
