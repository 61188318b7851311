"""Declarative table descriptions: columns, rules, transforms, checks and keys."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

# Config type spellings and the Spark type each one means.
TYPE_NAMES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "varchar": T.StringType(),
    "text": T.StringType(),
    "integer": T.IntegerType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "float": T.DoubleType(),
    "real": T.DoubleType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "date": T.DateType(),
    "boolean": T.BooleanType(),
    "decimal": T.DecimalType(10, 2),
}

# Id of a rule that was configured without one.
UNNAMED = "unknown"

_DECIMAL = re.compile(r"decimal\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)")


def parse_type(text: str) -> T.DataType:
    """Spark type of a config type name; unknown names raise instead of becoming strings."""
    name = text.strip().lower()
    sized = _DECIMAL.fullmatch(name)
    if sized:
        return T.DecimalType(int(sized[1]), int(sized[2]))
    if name not in TYPE_NAMES:
        raise ValueError(f"unknown column type {text!r}")
    return TYPE_NAMES[name]


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    nullable: bool = True
    unique: bool = False
    default: Any = None


@dataclass(frozen=True)
class Rule:
    """A row-level check.

    ``on_null`` ("fail" or "pass") settles NULL for value rules, ``deletes`` says whether
    DELETE rows are judged too.
    """

    id: str
    type: str
    column: str
    params: Mapping[str, Any] = field(default_factory=dict)
    severity: str = "error"
    on_null: str = "fail"
    deletes: bool = False


@dataclass(frozen=True)
class Transform:
    type: str
    column: str
    params: Mapping[str, Any] = field(default_factory=dict)
    order: int = 0
    id: str = ""


@dataclass(frozen=True)
class Check:
    """A batch metric with an optional lower threshold."""

    metric: str
    column: str | None = None
    threshold: float | None = None
    severity: str = "warning"
    pattern: str = ".*"
    expression: str | None = None
    name: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    column: str
    table: str
    ref_column: str


@dataclass(frozen=True)
class TableSpec:
    """One table. ``ordering`` names message columns, an offset say, that order changes of a
    key made at the same time; ``ordering_type`` is the type they are stored in."""

    name: str
    columns: tuple[ColumnSpec, ...]
    primary_key: tuple[str, ...] = ()
    topic: str = ""
    rules: tuple[Rule, ...] = ()
    transforms: tuple[Transform, ...] = ()
    checks: tuple[Check, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    unique_keys: tuple[tuple[str, ...], ...] = ()
    ordering: tuple[str, ...] = ()
    ordering_type: str = "long"
    internal: bool = False

    def __post_init__(self) -> None:
        names = self.column_names
        if len(set(names)) != len(names):
            raise ValueError(f"{self.name}: duplicate column names")
        for key in self.primary_key:
            if key not in names:
                raise ValueError(f"{self.name}: primary key {key!r} is not a column")
        if not self.primary_key and not self.internal:
            raise ValueError(f"{self.name}: a streamed table needs a primary key")
        ids = [r.id for r in self.rules if r.id != UNNAMED]
        if len(set(ids)) != len(ids):
            raise ValueError(f"{self.name}: duplicate rule ids")
        if not self.topic:
            object.__setattr__(self, "topic", f"cdc-{self.name}")

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, parse_type(c.type), c.nullable) for c in self.columns])

    @classmethod
    def from_dict(cls, conf: Mapping[str, Any]) -> TableSpec:
        """Build a spec from one entry of a YAML/JSON ``tables:`` list.

        Rules and transforms without a type or a column carry no work and are left out.
        Metric checks may stand under any key that ends in ``checks``, if its entries name a metric;
        other sections of such a name are none of this table's business.
        """
        key = conf.get("primary_key") or ()
        indexes = conf.get("indexes", [])
        return cls(
            name=conf["name"],
            columns=tuple(ColumnSpec(**_pick(c, ColumnSpec)) for c in conf.get("schema", [])),
            primary_key=(key,) if isinstance(key, str) else tuple(key),
            topic=conf.get("topic", ""),
            rules=tuple(
                Rule(**({"id": UNNAMED} | _pick(r, Rule)))
                for r in conf.get("dq_rules", [])
                if r.get("type") and r.get("column")
            ),
            transforms=tuple(
                Transform(**_pick(t, Transform))
                for t in conf.get("transforms", [])
                if t.get("type") and t.get("column")
            ),
            checks=tuple(
                Check(**_pick(c, Check))
                for section, entries in conf.items()
                if section.endswith("checks") and isinstance(entries, (list, tuple))
                for c in entries
                if isinstance(c, Mapping) and c.get("metric")
            ),
            foreign_keys=tuple(
                ForeignKey(f["column"], f["references"]["table"], f["references"]["column"])
                for f in conf.get("foreign_keys", [])
            ),
            unique_keys=tuple(tuple(i["columns"]) for i in indexes if i.get("unique")),
            ordering=tuple(conf.get("ordering", ())),
            ordering_type=conf.get("ordering_type", "long"),
            internal=bool(conf.get("internal", False)),
        )


def streamed(specs: Iterable[TableSpec]) -> list[TableSpec]:
    """Specs that have a change stream; internal tables have none. Names and topics must differ."""
    found = [s for s in specs if not s.internal]
    for what in ("name", "topic"):
        values = [getattr(s, what) for s in found]
        if len(set(values)) != len(values):
            raise ValueError(f"two tables share a {what}: {sorted(values)}")
    return found


def _pick(conf: Mapping[str, Any], cls: type) -> dict[str, Any]:
    return {k: v for k, v in conf.items() if k in cls.__dataclass_fields__ and v is not None}
