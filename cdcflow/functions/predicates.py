"""Rule predicates: each builder returns a Boolean column that is never NULL."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, functions as F

Builder = Callable[[Column, Mapping[str, Any]], Column]


def between(c: Column, params: Mapping[str, Any]) -> Column:
    """Inclusive bounds; NaN sorts above every number, so it fails a ``max``."""
    ok = c.isNotNull()
    if "min" in params:
        ok = ok & (c >= F.lit(params["min"]))
    if "max" in params:
        ok = ok & (c <= F.lit(params["max"]))
    return F.coalesce(ok, F.lit(False))


def allowed(c: Column, params: Mapping[str, Any]) -> Column:
    values = list(params.get("values") or [])
    return c.isin(values) if values else F.lit(True)


def matches(c: Column, params: Mapping[str, Any]) -> Column:
    """The pattern may match anywhere in the text."""
    return c.rlike(params.get("pattern", ".*"))


def present(c: Column, params: Mapping[str, Any]) -> Column:
    return c.isNotNull()


def sized(c: Column, params: Mapping[str, Any]) -> Column:
    """Length in characters within inclusive bounds."""
    return between(F.length(c), params)


# Rules for which ``on_null`` decides; the others fail NULL by definition.
NULL_NEUTRAL = {"allowed_values", "regex"}

BUILTIN: dict[str, Builder] = {
    "range": between,
    "allowed_values": allowed,
    "regex": matches,
    "not_null": present,
    "length": sized,
}
