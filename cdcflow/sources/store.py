"""Parquet folders of one deployment: changes, history, quarantine, metrics.

Every output of a batch is a folder of its own, named by the batch's id and replaced as a
whole, also by no rows at all: writing a batch again leaves nothing of what it wrote before.
History is the last compacted base plus the changes since; a batch costs what it brings,
not what the table holds. Tables are read in the columns that their description says, so
files from before a column was added give NULL for it.

    <root>/<table>/changes/batch_id=N       staged changes of batch N
    <root>/<table>/base/version=N/          by _is_current: versions open after batch N and
                                            those closed since the compaction before
    <root>/<table>/bases/version=N          written after that folder is complete
    <root>/batches/table_name=T/batch_id=N  time of the batch, fixed on its first attempt
    <root>/quarantine/table_name=T/run_date=H/batch_id=N
    <root>/metrics | summary/table_name=T/batch_id=N

A base is sorted by key within its files, which also carry bloom filters of the key, so one
key's versions are found without reading the rest. The marker of a base tells until when the
versions it closed were valid, and a batch's summary when its changes begin, so a read at one
moment passes over folders that have nothing of that time. Changes say whether they bring one row
a key at most, and the marker how many rows of a key the base may hold, so that no merge looks for
keys of very many rows where there can be none.

Times are kept in UTC, so the session has to run in that zone.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession, functions as F, types as T

from cdcflow.operators import history as H, skew
from cdcflow.plans.batch import staged_schema
from cdcflow.session import folders_in, remove_folder
from cdcflow.spec import TableSpec, parse_type

# Names of the zone whose times are those of UTC.
UTC = {"utc", "etc/utc", "z", "gmt", "etc/gmt", "+00:00", "utc+00:00"}
# Folders of closed versions that a base may consist of before it is written as one again.
CHAIN = 32
# Column of the changes that names the key of which they bring one row at most.
ONE_PER = "_one_per"
MARKER = "since bigint, closed_until timestamp, deepest bigint, key string"
METRICS = (
    "metric_name string, column_name string, metric_value double, threshold double, passed boolean, "
    "timestamp timestamp, _ingested_at timestamp, table_name string, batch_id bigint"
)
SUMMARY = (
    "messages bigint, malformed_count bigint, control_count bigint, total_rows bigint, quarantined_count bigint, "
    "unknown_count bigint, staged_count bigint, failed_rules array<string>, path string, quarantined_at timestamp, "
    "first_change timestamp, table_name string, batch_id bigint"
)
# What the quarantined rows of all tables have in common.
QUARANTINE_FACTS = (
    "_operation string, _failed_rule string, _quarantined_at timestamp, "
    "table_name string, run_date string, batch_id bigint"
)


class Store:
    def __init__(self, spark: SparkSession, root: str, chain: int = CHAIN) -> None:
        zone = spark.conf.get("spark.sql.session.timeZone")
        if zone.lower() not in UTC:
            raise ValueError(f"set spark.sql.session.timeZone to UTC, it is {zone}")
        self.spark = spark
        self.root = root.rstrip("/")
        self.chain = chain
        self._known: list[tuple[TableSpec, T.StructType]] = []

    def batch_time(self, table: str, batch_id: int, now: dt.datetime | None = None) -> dt.datetime:
        """The time of a batch. The first attempt writes it down, later attempts read it."""
        path = f"{self.root}/batches/table_name={table}/batch_id={batch_id}"
        known = self._read(path, "at timestamp_ntz")
        found = None if known is None else known.first()
        if found is not None:
            return found["at"]
        at = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
        self._replace(self.spark.createDataFrame([(at,)], "at timestamp_ntz").coalesce(1), path)
        return at

    def write_changes(self, spec: TableSpec, batch_id: int, staged: DataFrame, latest: bool = False) -> dict[str, Any]:
        """Write the changes; the job that writes them also counts them and finds when they begin.

        ``latest``: the caller knows that no key has two of them.
        """
        kind = parse_type(spec.ordering_type)
        typed = staged.withColumns({c: F.col(c).cast(kind) for c in spec.ordering})
        typed = typed.withColumn(ONE_PER, F.lit(_key(spec) if latest else None).cast("string"))
        seen = Observation()
        counted = typed.observe(seen, F.count("*").alias("staged_count"), F.min(H.FROM).alias("first_change"))
        self._replace(counted, f"{self.root}/{spec.name}/changes/batch_id={batch_id}")
        return seen.get

    def write_quarantine(self, spec: TableSpec, batch_id: int, quarantined: DataFrame, at: dt.datetime) -> None:
        """Columns differ by table, so the table is the outermost partition."""
        hour = at.strftime("%Y-%m-%dT%H:00:00").replace(":", "%3A")
        rows = quarantined.drop("table_name", "run_date", "batch_id")
        self._replace(rows, f"{self.quarantine_path(spec.name)}/run_date={hour}/batch_id={batch_id}")

    def write_metrics(self, spec: TableSpec, batch_id: int, metrics: DataFrame, at: dt.datetime) -> None:
        stamped = metrics.drop("severity").withColumn("_ingested_at", F.lit(at.replace(tzinfo=dt.timezone.utc)))
        self._replace_one(stamped, "metrics", spec, batch_id)

    def write_summary(self, spec: TableSpec, batch_id: int, counts: DataFrame) -> None:
        self._replace_one(counts, "summary", spec, batch_id)

    def quarantine_path(self, table: str) -> str:
        return f"{self.root}/quarantine/table_name={table}"

    def quarantine(self, spec: TableSpec) -> DataFrame | None:
        """Quarantined rows of one table, in the columns of its description."""
        values = ", ".join(f"`{c.name}` {parse_type(c.type).simpleString()}" for c in spec.columns)
        kind = parse_type(spec.ordering_type).simpleString()
        kept = "".join(f"`{c}` {kind}, " for c in spec.ordering)
        schema = f"{kept}{values}, _change_ts timestamp, {QUARANTINE_FACTS}"
        return self._read(self.quarantine_path(spec.name), schema, f"{self.root}/quarantine")

    def quarantine_facts(self) -> DataFrame | None:
        """Rule, time and batch of the quarantined rows of all tables."""
        return self._read(f"{self.root}/quarantine", QUARANTINE_FACTS)

    def metrics(self) -> DataFrame | None:
        return self._read(f"{self.root}/metrics", METRICS)

    def summary(self) -> DataFrame | None:
        """Counts of every batch of all tables."""
        return self._read(f"{self.root}/summary", SUMMARY)

    def keep_failed(self, spec: TableSpec, batch_id: int, messages: DataFrame, problem: str) -> None:
        """Set a batch's messages aside as they came, for ``failed`` and a later attempt."""
        self._replace(messages.withColumn("_problem", F.lit(problem)), f"{self.root}/{spec.name}/failed/batch_id={batch_id}")

    def failed(self, spec: TableSpec) -> list[int]:
        """Batches whose messages wait for another attempt, in order."""
        return sorted(int(name.partition("=")[2]) for name in folders_in(f"{self.root}/{spec.name}/failed"))

    def failed_messages(self, spec: TableSpec, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{spec.name}/failed/batch_id={batch_id}").drop("_problem")

    def drop_failed(self, spec: TableSpec, batch_id: int) -> None:
        remove_folder(f"{self.root}/{spec.name}/failed/batch_id={batch_id}")

    def base_version(self, spec: TableSpec) -> int:
        """Last batch contained in a complete base, -1 without one."""
        chain = self._chain(spec)
        return chain[-1]["version"] if chain else -1

    def base(self, spec: TableSpec) -> DataFrame | None:
        """History up to the last compaction: its open versions and all closed ones."""
        found = self._base(spec, self._chain(spec))
        return None if found is None else H.versions(found)

    def changes(self, spec: TableSpec, after: int = -1) -> DataFrame | None:
        found = self._changes(spec, after)
        return None if found is None else found.drop(ONE_PER)

    def _changes(self, spec: TableSpec, after: int) -> DataFrame | None:
        schema = T.StructType([*self._columns(spec), T.StructField(ONE_PER, T.StringType()), T.StructField("batch_id", T.LongType())])
        found = self._read(f"{self.root}/{spec.name}/changes", schema)
        return None if found is None else found.filter(F.col("batch_id") > after)

    def history(self, spec: TableSpec) -> DataFrame | None:
        """Every version up to the last written batch."""
        return self._whole(spec, lambda frame: frame, deep=True)

    def current(self, spec: TableSpec) -> DataFrame | None:
        """Open versions up to the last written batch.

        Changes in order of time meet open versions only, so no folder of closed ones is
        read; a late change adds those that ended at its time or later.
        """
        chain = self._chain(spec)
        changes = self.changes(spec, chain[-1]["version"] if chain else -1)
        if changes is None:
            found = self._base(spec, chain)
        else:
            first = changes.agg(F.min(H.FROM)).first()[0]
            found = self._merged(spec, self._near(spec, chain, first), changes)
        return None if found is None else H.current(found)

    def compact(self, spec: TableSpec) -> int:
        """Merge the changes since the last base into a new one and return its last batch.

        Changes in order of time only meet open versions, so the closed ones stay in the
        folders they are in. A change older than the last closed version, or ``chain``
        such folders, makes the new base a whole one. A base becomes visible when its
        one-row marker is written; folders before its ``since`` and the changes it contains
        can be expired then.
        """
        chain = self._chain(spec)
        changes = self._changes(spec, chain[-1]["version"] if chain else -1)
        if changes is None:
            return self.base_version(spec)
        brought = self._brought(spec, changes)
        last = brought["last"]
        if last is None:
            return self.base_version(spec)
        deepest = self._deepest(spec, chain, brought)
        in_order = 0 < len(chain) < self.chain and self._in_order(chain, brought["first_change"])
        target = self._base(spec, chain)
        if in_order:
            target = H.current(target)
        folder = f"{self.root}/{spec.name}"
        seen = Observation()
        merged = self._merged(spec, target, changes.drop(ONE_PER), deepest).sortWithinPartitions(H.CURRENT, *spec.primary_key)
        watched = merged.observe(seen, F.max(H.TO).alias("until"))
        watched.write.mode("overwrite").options(**self._blooms(spec)).partitionBy(H.CURRENT).parquet(f"{folder}/base/version={last}")
        marker = [(chain[-1]["since"] if in_order else last, seen.get["until"], deepest, _key(spec))]
        self._replace(self.spark.createDataFrame(marker, MARKER).coalesce(1), f"{folder}/bases/version={last}")
        return last

    @staticmethod
    def _in_order(chain: list[Row], first_change: dt.datetime | None) -> bool:
        closed = [r["closed_until"] for r in chain if r["closed_until"] is not None]
        return first_change is None or not closed or first_change >= max(closed)

    def as_of(self, spec: TableSpec, moment: dt.datetime) -> DataFrame | None:
        """What was valid at ``moment`` (UTC): the described columns, the operation and when it began.

        When a version ended later is not told, so nothing that begins after the moment is read:
        no changes folder whose first change is later, and of the closed versions only folders
        that hold some which ended after the moment, or after the first late change before it.
        """
        at = F.lit(moment.replace(tzinfo=dt.timezone.utc))
        chain = self._chain(spec)
        after = chain[-1]["version"] if chain else -1
        changes = self.changes(spec, after)
        if changes is not None:
            begins = self.summary()
            if begins is not None:
                of_table = (F.col("table_name") == spec.name) & (F.col("batch_id") > after) & (F.col("first_change") > at)
                later = [r[0] for r in begins.filter(of_table).select("batch_id").collect()]
                changes = changes.filter(~F.col("batch_id").isin(later)) if later else changes
            changes = changes.filter(F.col(H.FROM) <= at)
        first = None if changes is None else changes.agg(F.min(H.FROM)).first()[0]
        since = moment if first is None or not chain else min(moment, first)
        base = self._base(spec, chain, since)
        if base is not None:
            # Of a version that a late change may meet the end counts, whenever it was.
            base = base.filter((F.col(H.FROM) <= at) & (F.col(H.CURRENT) | (F.col(H.TO) >= F.lit(since.replace(tzinfo=dt.timezone.utc)))))
        found = base if first is None else self._merged(spec, base, changes)
        if found is None:
            return None
        return H.as_of(H.versions(found), at).select(*spec.column_names, H.OPERATION, H.FROM)

    def timeline(self, spec: TableSpec, key: Sequence[Any]) -> DataFrame | None:
        """The versions of one key in order of time; bloom filters keep other keys' row groups unread."""
        mine = F.lit(True)
        for column, value in zip(spec.primary_key, key, strict=True):
            mine = mine & (F.col(column) == F.lit(value).cast(self._columns(spec)[column].dataType))
        found = self._whole(spec, lambda frame: frame.filter(mine))
        return None if found is None else found.orderBy(H.FROM)

    def expire(self, spec: TableSpec) -> int:
        """Delete changes that the base contains and bases before its ``since``; returns how many folders went.

        Readers that began before the last compaction may still use them.
        """
        chain = self._chain(spec)
        if not chain:
            return 0
        last, since, gone = chain[-1]["version"], chain[0]["version"], 0
        for folder, keep in (("changes", last + 1), ("base", since), ("bases", since)):
            for name in folders_in(f"{self.root}/{spec.name}/{folder}"):
                label, _, number = name.partition("=")
                if label in ("batch_id", "version") and int(number) < keep:
                    remove_folder(f"{self.root}/{spec.name}/{folder}/{name}")
                    gone += 1
        return gone

    @staticmethod
    def _blooms(spec: TableSpec) -> dict[str, str]:
        """Writer options: a bloom filter of each key column, as large as its values need."""
        wanted = {f"parquet.bloom.filter.enabled#{k}": "true" for k in spec.primary_key}
        return {**wanted, "parquet.bloom.filter.adaptive.enabled": "true"}

    def _chain(self, spec: TableSpec) -> list[Row]:
        """Markers of the compactions that make up the base, one small row each, at most ``chain``."""
        found = self._read(f"{self.root}/{spec.name}/bases", f"{MARKER}, version bigint")
        newest = None if found is None else found.agg(F.max(F.struct("version", "since")).alias("m")).select("m.*").first()
        if newest is None or newest["version"] is None:
            return []
        return sorted(found.filter(F.col("version") >= newest["since"]).collect(), key=lambda r: r["version"])

    @staticmethod
    def _brought(spec: TableSpec, changes: DataFrame) -> Row:
        """How many batches brought changes, the last of them, when the changes begin and whether each brought one a key."""
        one = F.col(ONE_PER).eqNullSafe(_key(spec))
        by_batch = changes.groupBy("batch_id").agg(F.min(H.FROM).alias("first_change"), F.bool_and(one).alias("one"))
        return by_batch.agg(
            F.count("*").alias("batches"),
            F.max("batch_id").alias("last"),
            F.min("first_change").alias("first_change"),
            F.bool_and("one").alias("one"),
        ).first()

    @staticmethod
    def _deepest(spec: TableSpec, chain: list[Row], brought: Row) -> int | None:
        """Rows that base and changes hold of one key at most, None where it is not known.

        A change adds one row at most: it is a version, or it moves an end, or the end of the version
        it parts stays as a marker.
        """
        if not brought["one"]:
            return None
        if not chain:
            return brought["batches"]
        held = chain[-1]["deepest"] if chain[-1]["key"] == _key(spec) else None
        return None if held is None else held + brought["batches"]

    def _columns(self, spec: TableSpec) -> T.StructType:
        for known, schema in self._known:
            if known == spec:
                return schema
        self._known.append((spec, staged_schema(self.spark, spec)))
        return self._known[-1][1]

    def _whole(self, spec: TableSpec, narrowed: Callable[[DataFrame], DataFrame], deep: bool = False) -> DataFrame | None:
        """Base and changes, merged; ``deep``: large ones are asked how many rows a key may have."""
        chain = self._chain(spec)
        base, changes = self._base(spec, chain), self._changes(spec, chain[-1]["version"] if chain else -1)
        base = None if base is None else narrowed(base)
        deepest = None
        if deep and changes is not None and skew.DEFAULT.possible(*[f for f in (base, changes) if f is not None]):
            deepest = self._deepest(spec, chain, self._brought(spec, changes))
        found = base if changes is None else self._merged(spec, base, narrowed(changes.drop(ONE_PER)), deepest)
        return None if found is None else H.versions(found)

    def _base(self, spec: TableSpec, chain: list[Row], since: dt.datetime | None = None) -> DataFrame | None:
        """Versions and markers of the base; ``_is_current`` and ``version`` are folders.

        With ``since``, folders of versions that all ended before it are left out.
        """
        if not chain:
            return None
        schema = T.StructType([f for f in self._columns(spec) if f.name != H.CURRENT])
        schema = schema.add(H.CURRENT, T.BooleanType()).add("version", T.LongType())
        found = self._read(f"{self.root}/{spec.name}/base", schema)
        closed = [r["version"] for r in chain if since is None or (r["closed_until"] is not None and r["closed_until"] >= since)]
        last = chain[-1]["version"]
        wanted = F.col(H.CURRENT) & (F.col("version") == last)
        if closed:
            wanted = wanted | (~F.col(H.CURRENT) & F.col("version").isin(closed))
        kept = found.filter(F.col("version").isin([*closed, last])).filter(wanted)
        return kept.select(*self._columns(spec).names)

    def _near(self, spec: TableSpec, chain: list[Row], first: dt.datetime | None) -> DataFrame | None:
        """The part of the base that changes since ``first`` can meet."""
        base = self._base(spec, chain)
        if base is None or self._in_order(chain, first):
            return None if base is None else base.filter(F.col(H.CURRENT))
        return base.filter(F.col(H.CURRENT) | (F.col(H.TO) >= F.lit(first)))

    def _merged(self, spec: TableSpec, target: DataFrame | None, changes: DataFrame, deepest: int | None = None) -> DataFrame:
        columns = self._columns(spec).names
        if target is not None:
            target = target.select(*columns, F.lit(-1).cast("long").alias("batch_id"))
        order = ["batch_id", *spec.ordering]
        merged = H.apply_changes(
            target, changes, spec.primary_key, order=order, hot=skew.DEFAULT, keep_deletes=True, deepest=deepest
        )
        return merged.select(*columns)

    def _replace(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(path)

    def _replace_one(self, df: DataFrame, folder: str, spec: TableSpec, batch_id: int) -> None:
        rows = df.drop("table_name", "batch_id").coalesce(1)
        self._replace(rows, f"{self.root}/{folder}/table_name={spec.name}/batch_id={batch_id}")

    def _read(self, path: str, schema: str | T.StructType, base: str | None = None) -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", base or path).schema(schema).parquet(path)
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return None
            raise


def _key(spec: TableSpec) -> str:
    return json.dumps(spec.primary_key)
