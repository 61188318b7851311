"""Change feed: encode, decode, route."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cdcflow.functions.columns import map_operation
from cdcflow.plans.catalog.base import Tables, moment, order_changes, query
from cdcflow.session import spread
from cdcflow.sources import envelope
from cdcflow.spec import ColumnSpec, TableSpec

ORDERS = TableSpec(
    name="orders",
    columns=(
        ColumnSpec("o_orderkey", "long", nullable=False),
        ColumnSpec("o_custkey", "long"),
        ColumnSpec("o_orderstatus", "string"),
        ColumnSpec("o_totalprice", "double"),
        ColumnSpec("o_orderpriority", "string"),
    ),
    primary_key=("o_orderkey",),
)
CUSTOMERS = TableSpec(
    name="customer",
    columns=(ColumnSpec("c_custkey", "long", nullable=False), ColumnSpec("c_name", "string")),
    primary_key=("c_custkey",),
    topic="crm-customers",
)
EVENTS = TableSpec(
    name="events",
    columns=(
        ColumnSpec("event_id", "long"),
        ColumnSpec("event_type", "string"),
        ColumnSpec("value", "double"),
    ),
    primary_key=("event_id",),
)
METRICS = TableSpec(name="dq_metrics", columns=(ColumnSpec("metric_name", "string"),), internal=True)


def order_messages(t: Tables, changes: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    changes = order_changes(t, spread(t.orders)) if changes is None else changes
    return envelope.encode(
        changes, ORDERS.column_names, operation=F.col("operation"), at=F.col("change_ts"), table="orders", keep=keep
    )


@query(
    "cdc_encode",
    """
    SELECT o_orderkey, 'orders' AS table_name, operation, strftime(change_ts, '%Y-%m-%d %H:%M:%S') AS at,
           CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS priority,
           o_orderpriority = '4-NOT SPECIFIED' AS null_is_written
    FROM order_changes""",
    ("order_changes",),
)
def cdc_encode(t: Tables) -> DataFrame:
    specified = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority"))
    messages = order_messages(t, order_changes(t, spread(t.orders)).withColumn("o_orderpriority", specified))
    parts = messages.select(F.json_tuple("value", "data", "metadata").alias("data", "metadata"))
    header = parts.select(
        "data",
        F.json_tuple("metadata", "table-name", "operation", "timestamp").alias("table_name", "operation", "at"),
    )
    return header.select(
        "table_name",
        "operation",
        "at",
        F.contains("data", F.lit('"o_orderpriority":null')).alias("null_is_written"),
        F.json_tuple("data", "o_orderkey", "o_orderpriority").alias("o_orderkey", "priority"),
    ).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query(
    "cdc_decode",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, _operation, change_ts AS _change_ts
    FROM order_ops""",
    ("order_ops",),
)
def cdc_decode(t: Tables) -> DataFrame:
    return envelope.decode(order_messages(t), ORDERS)


@query(
    "cdc_operation_map",
    """
    SELECT event_id,
           CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'purchase' THEN 'INSERT' WHEN 'click' THEN 'UPDATE'
                           WHEN 'error' THEN 'DELETE' ELSE 'UNKNOWN' END AS _operation
    FROM events""",
)
def cdc_operation_map(t: Tables) -> DataFrame:
    codes = F.create_map(
        *[F.lit(x) for x in ("signup", "insert", "purchase", "load", "click", "update", "error", "delete")]
    )
    code = F.try_element_at(codes, F.col("event_type"))
    return t.events.select("event_id", map_operation(code).alias("_operation"))


@query(
    "cdc_control_filter",
    """
    SELECT event_id, event_type, value, 'INSERT' AS _operation FROM events
    WHERE event_type NOT IN ('view', 'error')""",
)
def cdc_control_filter(t: Tables) -> DataFrame:
    """Views arrive as control messages without data, errors as malformed text."""
    data = F.when(F.col("event_type") != "view", F.struct("event_id", "event_type", "value"))
    text = F.to_json(F.struct(data.alias("data"), F.struct(F.lit("insert").alias("operation")).alias("metadata")))
    broken = F.when(F.col("event_type") == "error", F.substring(text, 3, 12)).otherwise(text)
    messages = t.events.select(broken.alias("value"))
    return envelope.decode(messages, EVENTS).drop(envelope.CHANGED_AT)


@query(
    "cdc_route_tables",
    """
    SELECT 'cdc-orders' AS topic, o_orderkey AS record_key, operation FROM order_changes
    UNION ALL SELECT 'crm-customers', c_custkey, 'load' FROM customer""",
    ("order_changes",),
)
def cdc_route_tables(t: Tables) -> DataFrame:
    """Four tables in one feed; only the two declared ones have a topic."""

    def loads(df: DataFrame, columns: list[str], table: str, schema: str = "public") -> DataFrame:
        return envelope.encode(
            df, columns, operation=F.lit("load"), at=moment("2024-01-01"), table=table, schema=schema
        )

    feed = (
        order_messages(t)
        .unionByName(loads(t.customer, CUSTOMERS.column_names, "customer"))
        .unionByName(loads(t.customer, CUSTOMERS.column_names, "customer", schema="staging"))
        .unionByName(loads(t.supplier, ["s_suppkey", "s_name"], "supplier"))
        .unionByName(loads(t.region, ["r_name"], "dq_metrics"))
    )
    key = F.coalesce(F.get_json_object("value", "$.data.o_orderkey"), F.get_json_object("value", "$.data.c_custkey"))
    return envelope.route(feed, [ORDERS, CUSTOMERS, METRICS]).select(
        "topic",
        key.cast("long").alias("record_key"),
        F.get_json_object("value", "$.metadata.operation").alias("operation"),
    )


@query(
    "cdc_full_load_then_changes",
    """
    SELECT o_orderkey, o_orderstatus, change_ts, 'INSERT' AS _operation, 0 AS _phase
    FROM order_ops WHERE _operation = 'INSERT'
    UNION ALL
    SELECT o_orderkey, o_orderstatus, change_ts, _operation, 1 FROM order_ops WHERE _operation <> 'INSERT'""",
    ("order_ops",),
)
def cdc_full_load_then_changes(t: Tables) -> DataFrame:
    snapshot = t.orders.select("o_orderkey", "o_orderstatus", F.col("o_orderdate").alias("change_ts"))
    changes = (
        order_changes(t)
        .filter(F.col("operation") != "load")
        .select("o_orderkey", "o_orderstatus", "change_ts", map_operation(F.col("operation")).alias("_operation"))
    )
    return envelope.full_load_then_changes(snapshot, changes)
