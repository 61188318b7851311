"""One batch of one table, from raw messages to history, as lazy frames."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cdcflow.operators import history as H, metrics as M, quarantine as Q, rules as R, skew
from cdcflow.operators.transforms import apply_transforms
from cdcflow.session import written
from cdcflow.sources.envelope import CHANGED_AT, KIND, classify, rows_of
from cdcflow.spec import Rule, TableSpec, parse_type


@dataclass
class BatchResult:
    """Frames of one batch. ``summary`` has a row if rows were set aside, ``counts`` always.

    ``history`` is planned when it is asked for; it uses the staged changes several times,
    so they are written to the shared folder first and decoded once.
    """

    tagged: DataFrame
    metrics: DataFrame
    quarantined: DataFrame
    summary: DataFrame
    counts: DataFrame
    staged: DataFrame
    merge: Callable[[DataFrame], DataFrame]
    #: What the job that wrote ``quarantined`` saw of all messages, if the batch was run with ``observe``.
    observed: Callable[[], dict[str, Any]] = dict

    @cached_property
    def history(self) -> DataFrame:
        return self.merge(written(self.staged))


def tag(parsed: DataFrame, spec: TableSpec) -> DataFrame:
    """Rule outcome of every row; a row without a complete key can never be versioned."""
    keyed = [Rule("primary_key", "not_null", k, deletes=True) for k in spec.primary_key]
    return R.tag_failures(parsed, [*keyed, *spec.rules])


def stage(tagged: DataFrame, spec: TableSpec, at: Column, *, keep_intermediate: bool = False) -> DataFrame:
    """Valid changes, transformed and versioned: the last one per key, or all of them."""
    valid, _ = R.split(tagged)
    changed = apply_transforms(H.known_changes(valid), spec.transforms)
    versioned = H.add_version_columns(changed, F.coalesce(F.col(CHANGED_AT), at), ingested=at)
    return versioned if keep_intermediate else H.latest_per_key(versioned, spec.primary_key, [H.FROM, *spec.ordering])


def run_batch(
    spec: TableSpec,
    raw: DataFrame,
    batch_id: int,
    batch_time: dt.datetime,
    *,
    target: DataFrame | None = None,
    keep_intermediate: bool = False,
    initial: str = "upsert",
    skip_unchanged: bool = False,
    quarantine_path: str = "",
    classified: DataFrame | None = None,
    tagged: DataFrame | None = None,
    observe: bool = False,
) -> BatchResult:
    """The outputs of a batch at ``batch_time`` (UTC). Nothing runs until one is used.

    ``skip_unchanged`` drops updates that repeat the values their key held just before, in
    the batch or in ``target``. A caller that uses several outputs can pass persisted
    ``classified`` messages and ``tagged`` rows, and have them counted by the job that writes
    ``quarantined``. ``tagged`` may hold all messages with their kind; its rows are taken.
    """
    at = F.lit(batch_time.replace(tzinfo=dt.timezone.utc))
    hot = skew.DEFAULT if keep_intermediate else None
    if classified is None:
        classified = classify(raw, spec, keep=spec.ordering)
    if tagged is None:
        tagged = tag(rows_of(classified), spec)
    judged, tagged = tagged, rows_of(tagged) if KIND in tagged.columns else tagged
    metrics = M.compute_metrics(tagged, spec.checks, spec.name, batch_id, at)
    staged = stage(tagged, spec, at, keep_intermediate=keep_intermediate)
    if skip_unchanged and target is not None:
        passing = {*spec.primary_key, *spec.ordering, H.OPERATION, CHANGED_AT, *H.VERSION_COLUMNS}
        values = [c for c in staged.columns if c not in passing]
        staged = H.drop_unchanged(target, staged, spec.primary_key, values, spec.ordering, hot)
    quarantined, observed = Q.quarantine_frame(tagged, spec.name, batch_id, at), dict
    if observe:
        rules = ["primary_key", *(r.id for r in spec.rules)]
        quarantined, observed = Q.observed(classified, judged, rules, lambda rows: Q.quarantine_frame(rows, spec.name, batch_id, at))
    return BatchResult(
        tagged=tagged,
        metrics=metrics,
        quarantined=quarantined,
        observed=observed,
        summary=Q.summary(tagged, spec.name, batch_id, at, quarantine_path),
        counts=Q.batch_counts(classified, tagged, staged, spec.name, batch_id, at, quarantine_path),
        staged=staged,
        merge=lambda rows: H.apply_changes(target, rows, spec.primary_key, order=spec.ordering, initial=initial, hot=hot),
    )


def staged_schema(spark: SparkSession, spec: TableSpec) -> T.StructType:
    """What a table's staged changes look like, from its description alone."""
    kind = parse_type(spec.ordering_type).simpleString()
    messages = spark.createDataFrame([], ", ".join(["value string", *[f"{c} {kind}" for c in spec.ordering]]))
    empty = tag(rows_of(classify(messages, spec, keep=spec.ordering)), replace(spec, rules=()))
    return stage(empty, spec, F.lit(None).cast("timestamp")).schema
