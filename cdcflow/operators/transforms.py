"""Declarative column transforms, applied in ``order`` as plain projections."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from cdcflow.functions.columns import lenient_cast, literal_as, mask
from cdcflow.spec import Transform, parse_type

log = logging.getLogger(__name__)

Params = Mapping[str, Any]
Handler = Callable[[DataFrame, str, Params], DataFrame]


def _columnwise(build: Callable[[Column, Params], Column]) -> Handler:
    return lambda df, column, params: df.withColumn(column, build(F.col(column), params))


def _cast(df: DataFrame, column: str, params: Params) -> DataFrame:
    target = parse_type(params["target_type"] if "target_type" in params else params["to_type"])
    return df.withColumn(column, lenient_cast(F.col(column), df.schema[column].dataType, target))


def _default_value(df: DataFrame, column: str, params: Params) -> DataFrame:
    fill = literal_as(params["value"], df.schema[column].dataType)
    return df.withColumn(column, F.coalesce(F.col(column), fill))


def _rename(df: DataFrame, column: str, params: Params) -> DataFrame:
    return df.withColumnRenamed(column, params["new_name"])


_builtin: dict[str, Handler] = {
    "trim": _columnwise(lambda c, p: F.trim(c)),
    "lower": _columnwise(lambda c, p: F.lower(c)),
    "upper": _columnwise(lambda c, p: F.upper(c)),
    "round": _columnwise(lambda c, p: F.round(c, p.get("decimals", 2))),
    "mask_pii": _columnwise(lambda c, p: mask(c, p.get("visible_chars", 4), p.get("keep", "first"))),
    "cast": _cast,
    "default_value": _default_value,
    "rename": _rename,
}
_custom: dict[str, Handler] = {}


def register_transform(name: str, handler: Handler) -> None:
    """Add a transform type; ``handler(df, column, params)`` returns the changed frame."""
    if name in _builtin:
        raise ValueError(f"built-in transform {name!r} cannot be replaced")
    if name in _custom:
        log.warning("replacing registered transform %s", name)
    _custom[name] = handler


def list_transforms() -> list[str]:
    return [*_builtin, *_custom]


def apply_transforms(df: DataFrame, transforms: Sequence[Transform], *, strict: bool = True) -> DataFrame:
    """Apply transforms by ascending ``order``, ties in listed order.

    An unknown type, a missing column, a bad parameter or a step that Spark cannot analyse
    raises; with ``strict=False`` the transform is skipped instead.
    """
    for step in sorted(transforms, key=lambda t: t.order):
        label = step.id or f"{step.type}({step.column})"
        handler = _builtin.get(step.type) or _custom.get(step.type)
        try:
            if handler is None:
                raise ValueError(f"transform {label}: unknown type {step.type!r}")
            if step.column not in df.columns:
                raise ValueError(f"transform {label}: no column {step.column!r}")
            changed = handler(df, step.column, step.params)
            changed.schema  # analysed here, also where plans are analysed late
            df = changed
        except (ValueError, KeyError, TypeError, AnalysisException) as problem:
            if strict:
                raise ValueError(f"transform {label}: {problem}") from problem
            log.warning("%s, skipped", problem)
    return df
