"""Ordered data-quality rules, evaluated in one projection.

Each row gets the id of the first error rule it breaks in ``_failed_rule`` and the ids of
the warning rules it breaks in ``_warned_rules``. No row is dropped and no action runs.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cdcflow.functions import predicates
from cdcflow.functions.columns import fits, fresh, literal_as
from cdcflow.session import written
from cdcflow.spec import Rule

log = logging.getLogger(__name__)

FAILED = "_failed_rule"
WARNED = "_warned_rules"
OPERATION = "_operation"

_custom: dict[str, predicates.Builder] = {}


def register_rule(name: str, builder: predicates.Builder) -> None:
    """Add a rule type. ``builder(column, params)`` returns the Boolean "row is good" column."""
    if name in predicates.BUILTIN or name == "unique":
        raise ValueError(f"built-in rule {name!r} cannot be replaced")
    if name in _custom:
        log.warning("replacing registered rule %s", name)
    _custom[name] = builder


def list_rules() -> list[str]:
    return [*predicates.BUILTIN, "unique", *_custom]


def tag_failures(
    df: DataFrame, rules: Sequence[Rule], *, strict: bool = True, apply_to_deletes: bool = False
) -> DataFrame:
    """Add ``_failed_rule`` and ``_warned_rules``; rules see only rows that earlier ones let pass.

    DELETE rows usually carry nothing but their key, so rules skip them unless
    ``apply_to_deletes`` or the rule's own ``deletes`` is set.

    ``unique`` joins the rows with counts of their values. Between two such rules the rows
    are written to the shared folder, so that each costs one join and not all before it again.
    """
    is_delete = _is_delete(df, apply_to_deletes)
    source = df.columns
    joined = False
    out = df.withColumns({FAILED: F.lit(None).cast("string"), WARNED: F.array().cast("array<string>")})
    for rule in usable(df, rules, strict):
        exempt = F.lit(False) if rule.deletes else is_delete
        if rule.type == "unique":
            out, repeated = _mark_repeated(written(out) if joined else out, rule.column, exempt)
            bad, joined = F.col(repeated), True
        else:
            bad = ~_good(out, rule) & ~exempt
        alive_and_bad = F.col(FAILED).isNull() & bad
        if rule.severity == "error":
            out = out.withColumn(FAILED, F.when(alive_and_bad, F.lit(rule.id)).otherwise(F.col(FAILED)))
        else:
            warned = F.array_append(F.col(WARNED), F.lit(rule.id))
            out = out.withColumn(WARNED, F.when(alive_and_bad, warned).otherwise(F.col(WARNED)))
    return out.select(*source, FAILED, WARNED)


def usable(df: DataFrame, rules: Sequence[Rule], strict: bool = True) -> list[Rule]:
    """Rules that can be evaluated on ``df``; with ``strict`` an unusable one raises."""
    known = set(list_rules())
    kept = []
    for rule in rules:
        problem = None
        if rule.type not in known:
            problem = f"rule {rule.id}: unknown type {rule.type!r}"
        elif rule.column not in df.columns:
            problem = f"rule {rule.id}: no column {rule.column!r}"
        else:
            problem = _unfit(rule, df.schema[rule.column].dataType)
        if problem is None:
            kept.append(rule)
        elif strict:
            raise ValueError(problem)
        else:
            log.warning("%s, skipped", problem)
    return kept


def _unfit(rule: Rule, dtype: T.DataType) -> str | None:
    """Parameters that no value of the column can be compared with, found before any row is read."""
    given: list = []
    if rule.type == "allowed_values":
        given = list(rule.params.get("values") or [])
    if rule.type == "range":
        given = [rule.params[k] for k in ("min", "max") if k in rule.params]
        dtype = T.DoubleType() if isinstance(dtype, (T.StringType, T.NumericType)) else dtype
    if rule.type == "length":
        given, dtype = [rule.params[k] for k in ("min", "max") if k in rule.params], T.IntegerType()
    wrong = [v for v in given if not fits(v, dtype)]
    return f"rule {rule.id}: {wrong} cannot be a {dtype.simpleString()}" if wrong else None


def _is_delete(df: DataFrame, apply_to_deletes: bool) -> Column:
    if OPERATION not in df.columns or apply_to_deletes:
        return F.lit(False)
    return F.coalesce(F.col(OPERATION) == "DELETE", F.lit(False))


def split(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, failed) halves of a tagged frame."""
    valid = tagged.filter(F.col(FAILED).isNull()).drop(FAILED, WARNED)
    failed = tagged.filter(F.col(FAILED).isNotNull()).drop(WARNED)
    return valid, failed


def rule_summary(
    df: DataFrame, rules: Sequence[Rule], *, strict: bool = True, apply_to_deletes: bool = False
) -> DataFrame:
    """Per rule, in order: rows it judged, rows it failed and its pass rate, from one aggregate.

    A row is judged by every rule up to and including the one that removed it, but for rules
    that skip it as a DELETE. Rules are told apart by their position, whatever their ids.
    """
    rules = usable(df, rules, strict)
    numbered = [replace(r, id=str(i)) for i, r in enumerate(rules)]
    tagged = tag_failures(df, numbered, strict=strict, apply_to_deletes=apply_to_deletes)
    skipped = _is_delete(df, apply_to_deletes)
    stop = F.coalesce(F.col(FAILED).cast("int"), F.lit(len(rules)))
    sums: list[Column] = []
    for i, rule in enumerate(rules):
        failed = F.col(FAILED) == str(i) if rule.severity == "error" else F.array_contains(WARNED, str(i))
        judged = stop >= i if rule.deletes else (stop >= i) & ~skipped
        sums.append(F.count_if(judged).alias(f"_n{i}"))
        sums.append(F.count_if(failed).alias(f"_f{i}"))
    rows = [
        F.struct(
            F.lit(r.id).alias("rule_id"),
            F.lit(r.severity).alias("severity"),
            F.col(f"_n{i}").alias("evaluated"),
            F.col(f"_f{i}").alias("failed"),
            F.try_divide(F.col(f"_n{i}") - F.col(f"_f{i}"), F.col(f"_n{i}")).alias("pass_rate"),
        )
        for i, r in enumerate(rules)
    ]
    return tagged.agg(*sums).select(F.inline(F.array(*rows)))


def _good(df: DataFrame, rule: Rule) -> Column:
    """Whether a row keeps the rule; bad text compares as NULL instead of raising."""
    c, dtype, params = F.col(rule.column), df.schema[rule.column].dataType, rule.params
    if rule.type == "range" and isinstance(dtype, T.StringType):
        c = c.try_cast("double")
    if rule.type == "allowed_values":
        params = {"values": [literal_as(v, dtype) for v in params.get("values") or []]}
    builder = predicates.BUILTIN.get(rule.type) or _custom[rule.type]
    kept = F.coalesce(builder(c, params), F.lit(False))
    if rule.on_null == "pass" and (rule.type in predicates.NULL_NEUTRAL or rule.type in _custom):
        return F.when(F.col(rule.column).isNull(), F.lit(True)).otherwise(kept)
    return kept


def _mark_repeated(df: DataFrame, column: str, exempt: Column) -> tuple[DataFrame, str]:
    """Flag rows whose value (NULL included) occurs more than once among rows still valid.

    Counts are combined before the shuffle and joined back, so a value that fills a third
    of the table costs one row per task here and is split by the skew join there. A count
    window would put that value's rows on a single task. Returns the flag's name as well.
    """
    flag, value, hit, rows = fresh(df, "_repeated", "_value", "_hit", "_rows")
    alive = F.col(FAILED).isNull() & ~exempt
    repeated = (
        df.filter(alive)
        .groupBy(F.col(column).alias(value))
        .agg(F.count("*").alias(rows))
        .filter(F.col(rows) > 1)
        .select(value, F.lit(True).alias(hit))
    )
    joined = df.join(repeated, F.col(column).eqNullSafe(F.col(value)), "left")
    return joined.withColumn(flag, F.coalesce(F.col(hit), F.lit(False)) & alive).drop(value, hit), flag
