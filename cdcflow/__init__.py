"""Change-data-capture tables on plain Spark: decode, check, transform, version, query."""

from cdcflow.spec import Check, ColumnSpec, ForeignKey, Rule, TableSpec, Transform, parse_type

__all__ = ["Check", "ColumnSpec", "ForeignKey", "Rule", "TableSpec", "Transform", "parse_type"]
