"""One streaming query per table, or one for a feed of many; each micro-batch runs the batch plan and is replay-safe."""

from __future__ import annotations

import datetime as dt
import logging
from collections import deque
from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from cdcflow.functions import predicates
from cdcflow.operators import quarantine as Q
from cdcflow.plans.batch import run_batch, tag
from cdcflow.sources.envelope import classify, route, rows_of
from cdcflow.sources.store import Store
from cdcflow.spec import TableSpec, streamed

log = logging.getLogger(__name__)


def write_batch(
    spec: TableSpec,
    raw: DataFrame,
    batch_id: int,
    store: Store,
    *,
    keep_intermediate: bool = False,
    now: dt.datetime | None = None,
    classified: DataFrame | None = None,
) -> None:
    """Decode a batch once, then judge it and write its outputs from the kept messages.

    Built-in rules are a projection of the kept messages, which each output repeats for less than
    a second copy costs; rows are kept as well when a rule joins them or is not the library's own.
    A caller that writes the same messages several times can pass them ``classified``, written or
    persisted.

    Counts are observed by the jobs that write, in their last stage, where a task that runs
    again is not counted again. Staged changes make the batch visible in the history; its counts
    follow, so a batch without them is one whose last attempt did not end.
    """
    at = store.batch_time(spec.name, batch_id, now)
    held: list[DataFrame] = []

    def hold(frame: DataFrame) -> DataFrame:
        held.append(frame.persist(StorageLevel.MEMORY_AND_DISK))
        return held[-1]

    try:
        kept = hold(classify(raw, spec, keep=spec.ordering)) if classified is None else classified
        plain = all(r.type in predicates.BUILTIN for r in spec.rules)
        tagged = tag(kept, spec) if plain else hold(tag(rows_of(kept), spec))
        result = run_batch(
            spec,
            raw,
            batch_id,
            at,
            keep_intermediate=keep_intermediate,
            quarantine_path=store.quarantine_path(spec.name),
            classified=kept,
            tagged=tagged,
            observe=True,
        )
        if spec.checks:
            store.write_metrics(spec, batch_id, result.metrics, at)
        store.write_quarantine(spec, batch_id, result.quarantined, at)
        counts = {**store.write_changes(spec, batch_id, result.staged, not keep_intermediate), **result.observed()}
        store.write_summary(spec, batch_id, Q.counts_row(kept.sparkSession, counts, spec.name, batch_id, at, store.quarantine_path(spec.name)))
    finally:
        for frame in reversed(held):
            frame.unpersist()


def start_stream(
    spec: TableSpec,
    source: DataFrame,
    store: Store,
    checkpoints: str,
    *,
    trigger: Mapping[str, object] | None = None,
    keep_intermediate: bool = False,
) -> StreamingQuery:
    """Start the query ``stream_<table>`` with its own checkpoint folder."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        write_batch(spec, batch, batch_id, store, keep_intermediate=keep_intermediate)

    return _started(source, on_batch, spec.name, checkpoints, trigger)


def _started(
    source: DataFrame, on_batch: Callable[[DataFrame, int], None], name: str, checkpoints: str, trigger: Mapping[str, object] | None
) -> StreamingQuery:
    """Start ``stream_<name>`` in a scheduler pool of its own, where the session schedules fairly (``spark.scheduler.mode``)."""
    context = source.sparkSession.sparkContext
    before = context.getLocalProperty("spark.scheduler.pool")
    context.setLocalProperty("spark.scheduler.pool", f"stream_{name}")
    try:
        return (
            source.writeStream.foreachBatch(on_batch)
            .option("checkpointLocation", f"{checkpoints.rstrip('/')}/{name}")
            .trigger(**(trigger or {"processingTime": "15 seconds"}))
            .queryName(f"stream_{name}")
            .start()
        )
    finally:
        context.setLocalProperty("spark.scheduler.pool", before)


def write_routed(
    specs: Sequence[TableSpec], messages: DataFrame, batch_id: int, store: Store, *, schema: str = "public", **options
) -> dict[str, Exception]:
    """Write one batch of a feed that many tables share; returns what went wrong, by table.

    The feed is read once and its headers decoded once. A table that fails does not stop the
    others: its messages of the batch are set aside in the store, where ``retry_failed`` finds
    them. A batch that comes again replaces what each table wrote.
    """
    problems: dict[str, Exception] = {}
    routed = route(messages, specs, schema=schema).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for spec in streamed(specs):
            mine = routed.filter(F.col("topic") == spec.topic).drop("topic")
            try:
                write_batch(spec, mine, batch_id, store, **options)
                store.drop_failed(spec, batch_id)
            except Exception as problem:
                log.exception("batch %s of %s failed, its messages are set aside", batch_id, spec.name)
                store.keep_failed(spec, batch_id, mine, str(problem)[:1000])
                problems[spec.name] = problem
    finally:
        routed.unpersist()
    return problems


def retry_failed(spec: TableSpec, store: Store, **options) -> list[int]:
    """Write the batches of a table that were set aside, in order; returns those that went through.

    Batches written since then stay as they are: the history puts late changes in their place.
    """
    done = []
    for batch_id in store.failed(spec):
        write_batch(spec, store.failed_messages(spec, batch_id), batch_id, store, **options)
        store.drop_failed(spec, batch_id)
        done.append(batch_id)
    return done


def start_routed(
    specs: Sequence[TableSpec],
    source: DataFrame,
    store: Store,
    checkpoints: str,
    *,
    name: str = "routed",
    trigger: Mapping[str, object] | None = None,
    **options,
) -> StreamingQuery:
    """One query ``stream_<name>`` for all tables of a shared feed."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        write_routed(specs, batch, batch_id, store, **options)

    return _started(source, on_batch, name, checkpoints, trigger)


class StreamFacts(StreamingQueryListener):
    """Progress and ends of a session's queries, as rows; the last ``most`` of them are kept.

    Spark tells a listener with some delay. Register with ``spark.streams.addListener``.
    """

    SCHEMA = "query string, kind string, batch_id bigint, input_rows bigint, milliseconds bigint, problem string"

    def __init__(self, most: int = 10_000) -> None:
        self._names: dict[str, str] = {}
        self._facts: deque[tuple] = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._names[str(event.id)] = event.name
        self._facts.append((event.name, "started", None, None, None, None))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._facts.append((p.name, "progress", p.batchId, p.numInputRows, p.batchDuration, None))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._facts.append((self._names.get(str(event.id)), "idle", None, None, None, None))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        name, problem = self._names.get(str(event.id)), event.exception
        self._facts.append((name, "failed" if problem else "ended", None, None, None, problem))

    def over(self) -> set[str]:
        """Names of the queries that are known to have ended or failed."""
        return {f[0] for f in list(self._facts) if f[1] in ("ended", "failed")}

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self._facts), self.SCHEMA)


def start_all(
    specs: Sequence[TableSpec],
    source_of: Callable[[TableSpec], DataFrame],
    store: Store,
    checkpoints: str,
    **options,
) -> list[StreamingQuery]:
    """Start every table that has a stream; one that fails to start does not stop the others."""
    queries = []
    for spec in streamed(specs):
        try:
            queries.append(start_stream(spec, source_of(spec), store, checkpoints, **options))
        except Exception:
            log.exception("stream for %s did not start", spec.name)
    return queries


def wait_for_any(spark: SparkSession, seconds: float | None = None) -> bool | None:
    """Block until one query ends; give ``seconds`` to stop waiting earlier."""
    return spark.streams.awaitAnyTermination(seconds) if seconds is not None else spark.streams.awaitAnyTermination()
