"""Registry, table access and the change feeds and dirty tables derived from the given data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given parquet tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, oracle: str | None = None, using: tuple[str, ...] = ()):
    """Register ``fn(tables)``; ``using`` names the derived tables its SQL starts from."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: without_zone(fn(Tables(spark, folder)))
        if oracle is not None:
            ORACLES[name] = with_ctes(oracle, using)
        return fn

    return add


def without_zone(df: DataFrame) -> DataFrame:
    """Zoned timestamps as plain ones, the type of the given tables."""
    zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


# --- derived tables, Spark side -------------------------------------------------------


def dirty(t: Tables) -> DataFrame:
    """Events with natural defects: missing codes, values and props, malformed references."""
    user = F.col("user_id").cast("string")
    return t.events.select(
        "event_id",
        "ts",
        "user_id",
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("code"),
        F.when(F.col("value") >= 1, F.col("value")).alias("value"),
        F.when(F.col("value") > 150, F.concat(F.lit("x-"), user))
        .otherwise(F.concat(F.lit("USR-"), F.lpad(user, 6, "0")))
        .alias("ref"),
        F.when(F.col("event_type") != "signup", F.col("props")).alias("props"),
    )


def event_changes(t: Tables) -> DataFrame:
    """Events as changes of their user: signup inserts, error deletes, view is unknown."""
    op = (
        F.when(F.col("event_type") == "signup", "INSERT")
        .when(F.col("event_type") == "error", "DELETE")
        .when(F.col("event_type") == "view", "UNKNOWN")
        .otherwise("UPDATE")
    )
    return t.events.select(
        "user_id", "event_type", "value", op.alias("_operation"), F.col("ts").alias("change_ts"), "event_id"
    )


def order_changes(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """Orders as a change log: all load, pending ones are filled a day later, low-priority
    ones are deleted a day after that."""
    orders = t.orders if orders is None else orders
    load = _change("load", 0, F.col("o_orderstatus"))
    fill = F.when(F.col("o_orderstatus") == "P", _change("update", 1, F.lit("F")))
    drop = F.when(F.col("o_orderpriority") == "5-LOW", _change("delete", 2, F.col("o_orderstatus")))
    return orders.select(
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
        "o_orderpriority",
        F.inline(F.array(load, fill, drop)),
    ).filter(F.col("operation").isNotNull())


def _change(operation: str, days: int, status: Column) -> Column:
    return F.struct(
        status.alias("o_orderstatus"),
        F.lit(operation).alias("operation"),
        (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(days))).alias("change_ts"),
        F.lit(days).alias("seq"),
    )


# --- derived tables, SQL side ---------------------------------------------------------


def history_sql(source: str, key: str, order: str, extra: str = "") -> str:
    """Reference form of a change log's history: one window over each key."""
    return f"""
        SELECT * EXCLUDE (_next), change_ts AS _effective_from, _next AS _effective_to,
               _next IS NULL AS _is_current, change_ts AS _ingested_at {extra}
        FROM (SELECT *, lead(change_ts) OVER (PARTITION BY {key} ORDER BY {order}) AS _next
              FROM {source} WHERE _operation IN ('INSERT', 'UPDATE', 'DELETE'))
        WHERE _operation <> 'DELETE' AND (_next IS NULL OR _next > change_ts)"""


CTES: dict[str, str] = {
    "dirty": """
        SELECT event_id, ts, user_id,
               CASE WHEN event_type <> 'error' THEN event_type END AS code,
               CASE WHEN value >= 1 THEN value END AS value,
               CASE WHEN value > 150 THEN 'x-' || CAST(user_id AS VARCHAR)
                    ELSE 'USR-' || lpad(CAST(user_id AS VARCHAR), 6, '0') END AS ref,
               CASE WHEN event_type <> 'signup' THEN props END AS props
        FROM events""",
    "event_changes": """
        SELECT user_id, event_type, value,
               CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE'
                               WHEN 'view' THEN 'UNKNOWN' ELSE 'UPDATE' END AS _operation,
               ts AS change_ts, event_id
        FROM events""",
    "order_changes": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
               'load' AS operation, o_orderdate AS change_ts, 0 AS seq FROM orders
        UNION ALL
        SELECT o_orderkey, o_custkey, 'F', o_totalprice, o_orderpriority,
               'update', o_orderdate + INTERVAL 1 DAY, 1 FROM orders WHERE o_orderstatus = 'P'
        UNION ALL
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
               'delete', o_orderdate + INTERVAL 2 DAY, 2 FROM orders WHERE o_orderpriority = '5-LOW'""",
    "order_ops": """
        SELECT * EXCLUDE (operation), CASE operation WHEN 'load' THEN 'INSERT' WHEN 'update' THEN 'UPDATE'
               ELSE 'DELETE' END AS _operation FROM order_changes""",
}
CTES["event_history"] = history_sql("event_changes", "user_id", "change_ts, event_id")
CTES["order_history"] = history_sql("order_ops", "o_orderkey", "change_ts, seq")

# Which derived tables a derived table is built from.
BUILT_FROM: dict[str, tuple[str, ...]] = {
    "event_history": ("event_changes",),
    "order_ops": ("order_changes",),
    "order_history": ("order_ops",),
}


def with_ctes(sql: str, using: tuple[str, ...]) -> str:
    names: list[str] = []

    def need(name: str) -> None:
        for source in BUILT_FROM.get(name, ()):
            need(source)
        if name not in names:
            names.append(name)

    for name in using:
        need(name)
    if not names:
        return sql
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
