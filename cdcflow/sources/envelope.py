"""JSON change envelopes: decode, encode, route."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cdcflow.functions.columns import map_operation
from cdcflow.spec import TableSpec, streamed

CHANGED_AT = "_change_ts"

# Field names of the envelope's metadata.
METADATA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("timestamp", "record-type", "operation", "schema-name", "table-name")]
)


def envelope_schema(spec: TableSpec) -> T.StructType:
    return T.StructType([T.StructField("data", spec.schema), T.StructField("metadata", METADATA)])


KIND, ROW, CONTROL, MALFORMED = "_kind", "row", "control", "malformed"


def classify(messages: DataFrame, spec: TableSpec, *, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Every message as a typed row with ``_operation``, the source's change time and its ``_kind``.

    ``row``: a value in at least one declared column; ``control``: an envelope without one;
    ``malformed``: neither data nor metadata could be read.
    """
    parsed = _parse(messages, envelope_schema(spec), value, keep)
    header = reduce(or_, [F.col("_message.metadata").getField(n).isNotNull() for n in METADATA.names])
    held = reduce(or_, [F.col("_message.data").getField(c).isNotNull() for c in spec.column_names])
    kind = F.when(F.coalesce(held, F.lit(False)), ROW).when(F.coalesce(header, F.lit(False)), CONTROL)
    return parsed.select(
        *keep,
        "_message.data.*",
        map_operation(F.col("_message.metadata.operation")).alias("_operation"),
        F.try_to_timestamp(F.col("_message.metadata.timestamp")).alias(CHANGED_AT),
        kind.otherwise(MALFORMED).alias(KIND),
    )


def rows_of(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col(KIND) == ROW).drop(KIND)


def decode(messages: DataFrame, spec: TableSpec, *, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Typed rows with ``_operation`` and the source's change time.

    Malformed text and control messages carry no column value and are left out. ``keep``
    names message columns (an offset, say) to carry along.
    """
    return rows_of(classify(messages, spec, value=value, keep=keep))


def drop_control(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in at least one declared column."""
    return rows.filter(reduce(or_, [F.col(c).isNotNull() for c in columns]))


def encode(
    rows: DataFrame,
    columns: Sequence[str],
    *,
    operation: Column,
    at: Column,
    table: str,
    schema: str = "public",
    record_type: str = "data",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows as envelopes in a ``value`` column, NULL fields written out."""
    envelope = F.struct(
        F.struct(*columns).alias("data"),
        F.struct(
            at.cast("string").alias("timestamp"),
            F.lit(record_type).alias("record-type"),
            operation.alias("operation"),
            F.lit(schema).alias("schema-name"),
            F.lit(table).alias("table-name"),
        ).alias("metadata"),
    )
    return rows.select(*keep, F.to_json(envelope, {"ignoreNullFields": "false"}).alias("value"))


def route(messages: DataFrame, specs: Sequence[TableSpec], *, schema: str = "public", value: str = "value") -> DataFrame:
    """Messages of the known tables with the ``topic`` of their table.

    One decode of the metadata serves all tables; internal tables have no topic.
    """
    topics = F.create_map(*[F.lit(x) for s in streamed(specs) for x in (s.name, s.topic)])
    header = T.StructType([T.StructField("metadata", METADATA)])
    return (
        _parse(messages, header, value, messages.columns)
        .filter(F.col("_message.metadata.schema-name") == schema)
        .withColumn("topic", F.try_element_at(topics, F.col("_message.metadata.table-name")))
        .filter(F.col("topic").isNotNull())
        .drop("_message")
    )


def full_load_then_changes(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """A snapshot followed by changes as one log; ``_phase`` orders the snapshot first."""
    loaded = snapshot.withColumns({"_operation": F.lit("INSERT"), "_phase": F.lit(0)})
    return loaded.unionByName(changes.withColumn("_phase", F.lit(1)))


def _parse(messages: DataFrame, schema: T.StructType, value: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` and the parsed ``_message``.

    The optimizer copies a projected expression into every filter above it, so each tested
    field would parse the text again. It does not look into a generator: exploding a
    one-element array parses each message once.
    """
    message = F.from_json(F.col(value).cast("string"), schema)
    return messages.select(*keep, F.explode(F.array(message)).alias("_message"))
