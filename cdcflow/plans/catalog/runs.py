"""Whole batches from messages to history, as a batch job and as a stream."""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import replace
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, functions as F

from cdcflow.plans.batch import run_batch
from cdcflow.plans.catalog.base import BUILT_FROM, CTES, Tables, order_changes, query
from cdcflow.plans.catalog.feed import ORDERS, order_messages
from cdcflow.session import scratch_dir, spread, written
from cdcflow.sources.envelope import classify, encode
from cdcflow.sources.kafka import lost_offsets, messages_of, next_offsets
from cdcflow.sources.store import Store
from cdcflow.spec import Check, ColumnSpec, Rule, TableSpec, Transform
from cdcflow.streaming.streams import StreamFacts, retry_failed, start_all, start_routed, start_stream, wait_for_any, write_batch

CHECKED_ORDERS = TableSpec(
    name="orders",
    columns=ORDERS.columns,
    primary_key=ORDERS.primary_key,
    ordering=("offset",),
    rules=(
        Rule("ord_price", "range", "o_totalprice", {"min": 5000, "max": 450000}),
        Rule("ord_status", "allowed_values", "o_orderstatus", {"values": ["O", "F", "P"]}),
        Rule("ord_priority", "regex", "o_orderpriority", {"pattern": r"^\d-"}, severity="warning"),
    ),
    transforms=(
        Transform("lower", "o_orderpriority", order=2),
        Transform("mask_pii", "o_orderpriority", {"visible_chars": 3}, order=1),
    ),
    checks=(
        Check("completeness", "o_custkey", 0.95),
        Check("uniqueness", "o_orderkey", 1.0, "error"),
        Check("size", threshold=1),
    ),
)
OUTPUT = [
    "o_orderkey",
    "o_custkey",
    "o_orderstatus",
    "o_totalprice",
    "o_orderpriority",
    "_operation",
    "_effective_from",
    "_effective_to",
    "_is_current",
]

CTES["accepted"] = """
    SELECT * REPLACE (lower(substr(o_orderpriority, 1, 3)) || '****' AS o_orderpriority)
    FROM order_ops WHERE _operation = 'DELETE' OR o_totalprice BETWEEN 5000 AND 450000"""
CTES["accepted_second"] = """
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY change_ts DESC, seq DESC) AS rn
        FROM accepted WHERE _operation <> 'INSERT') WHERE rn = 1"""
BUILT_FROM |= {"accepted": ("order_ops",), "accepted_second": ("accepted",)}
AFTER_BOTH = """
    SELECT l.* EXCLUDE (change_ts, seq), l.change_ts AS _effective_from, s.change_ts AS _effective_to,
           s.o_orderkey IS NULL AS _is_current {first}
    FROM accepted l LEFT JOIN accepted_second s USING (o_orderkey) WHERE l._operation = 'INSERT'
    UNION ALL
    SELECT * EXCLUDE (change_ts, seq), change_ts, NULL, TRUE {second}
    FROM accepted_second WHERE _operation = 'UPDATE'"""
FIRST_TIME, SECOND_TIME = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


def batches(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Messages of the load and of all later changes; the position in the log is the offset."""
    changes = order_changes(t, spread(t.orders, kept=True)).withColumnRenamed("seq", "offset")
    messages = order_messages(t, changes, keep=("offset",))
    return messages.filter(F.col("offset") == 0), messages.filter(F.col("offset") > 0)


@query(
    "batch_orders_run",
    AFTER_BOTH.format(
        first=", TIMESTAMP '2024-01-01' AS _ingested_at", second=", TIMESTAMP '2024-01-02' AS _ingested_at"
    ),
    ("accepted_second",),
)
def batch_orders_run(t: Tables) -> DataFrame:
    """History of orders after a load and a batch of changes, low-quality rows set aside.

    The load is compacted into a base, the second batch is merged into it when read.
    """
    load, changes = batches(t)
    store = Store(t.spark, scratch_dir(t.spark))
    write_batch(CHECKED_ORDERS, load, 0, store, now=FIRST_TIME)
    store.compact(CHECKED_ORDERS)
    write_batch(CHECKED_ORDERS, changes, 1, store, now=SECOND_TIME)
    return store.history(CHECKED_ORDERS).select(*OUTPUT, "_ingested_at")


@query(
    "batch_orders_quarantine",
    """
    SELECT o_orderkey, o_totalprice, _operation, 'ord_price' AS _failed_rule,
           CASE _operation WHEN 'INSERT' THEN '2024-01-01T00:00:00' ELSE '2024-01-02T00:00:00' END AS run_date,
           'orders' AS table_name, CASE _operation WHEN 'INSERT' THEN 0 ELSE 1 END::BIGINT AS batch_id
    FROM order_ops WHERE _operation <> 'DELETE' AND o_totalprice NOT BETWEEN 5000 AND 450000""",
    ("order_ops",),
)
def batch_orders_quarantine(t: Tables) -> DataFrame:
    load, changes = batches(t)
    first = run_batch(CHECKED_ORDERS, load, 0, FIRST_TIME).quarantined
    second = run_batch(CHECKED_ORDERS, changes, 1, SECOND_TIME).quarantined
    return first.unionByName(second).select(
        "o_orderkey", "o_totalprice", "_operation", "_failed_rule", "run_date", "table_name", "batch_id"
    )


PLAIN_ORDERS = replace(CHECKED_ORDERS, rules=(), transforms=(), checks=())
WITHOUT_PRIORITY = replace(PLAIN_ORDERS, columns=tuple(c for c in ORDERS.columns if c.name != "o_orderpriority"))


@query(
    "store_added_column",
    """
    WITH h AS (SELECT l.o_orderkey, NULL AS o_orderpriority, l._operation, s.o_orderkey IS NULL AS _is_current
          FROM order_ops l LEFT JOIN second s USING (o_orderkey) WHERE l._operation = 'INSERT'
          UNION ALL SELECT o_orderkey, o_orderpriority, _operation, TRUE FROM second WHERE _operation = 'UPDATE')
    SELECT h.*, compacted FROM h CROSS JOIN (VALUES (FALSE), (TRUE)) c (compacted)""",
    ("second",),
)
def store_added_column(t: Tables) -> DataFrame:
    """A column joins the table with its second batch, with and without a compaction between and after."""
    load, changes = batches(t)
    found = []
    for compacted in (False, True):
        store = Store(t.spark, scratch_dir(t.spark))
        for number, (spec, messages) in enumerate(((WITHOUT_PRIORITY, load), (PLAIN_ORDERS, changes))):
            write_batch(spec, messages, number, store, now=FIRST_TIME)
            if compacted:
                store.compact(spec)
        history = store.history(PLAIN_ORDERS).select("o_orderkey", "o_orderpriority", "_operation", "_is_current")
        found.append(history.withColumn("compacted", F.lit(compacted)))
    return found[0].unionByName(found[1])


@query(
    "store_replayed_batch",
    """
    WITH n AS (SELECT count(*) AS a, count(*) FILTER (o_totalprice NOT BETWEEN 5000 AND 450000) AS b FROM orders)
    SELECT 'rules added' AS replay, a - b AS history, b AS quarantine, b AS counted FROM n
    UNION ALL SELECT 'rules dropped', a, 0, 0 FROM n""",
)
def store_replayed_batch(t: Tables) -> DataFrame:
    """The load is written again under other rules: nothing stays of what the first attempt wrote.

    Rules do not change what a message says, so the load is decoded once for all four batches.
    """
    load, _ = batches(t)
    decoded = written(classify(load, PLAIN_ORDERS, keep=PLAIN_ORDERS.ordering))
    found = []
    for replay, specs in (("rules added", (PLAIN_ORDERS, CHECKED_ORDERS)), ("rules dropped", (CHECKED_ORDERS, PLAIN_ORDERS))):
        store = Store(t.spark, scratch_dir(t.spark))
        for spec in specs:
            write_batch(spec, load, 0, store, now=FIRST_TIME, classified=decoded)
        parts = [
            store.history(PLAIN_ORDERS).agg(F.count("*").alias("history")),
            store.quarantine(PLAIN_ORDERS).agg(F.count("*").alias("quarantine")),
            store.summary().agg(F.sum("quarantined_count").alias("counted")),
        ]
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        found.append(whole.agg(F.lit(replay).alias("replay"), *[F.max(c).alias(c) for c in ("history", "quarantine", "counted")]))
    return found[0].unionByName(found[1])


@query(
    "batch_counts",
    """
    SELECT 'orders' AS table_name, o_orderkey % 3 AS batch_id, count(*) AS messages,
           count(*) FILTER (o_orderkey % 10 = 0) AS malformed_count, count(*) FILTER (o_orderkey % 10 = 1) AS control_count,
           count(*) FILTER (o_orderkey % 10 > 1) AS total_rows,
           count(*) FILTER (o_orderkey % 10 > 1 AND NOT o_totalprice BETWEEN 5000 AND 450000) AS quarantined_count,
           count(*) FILTER (o_orderkey % 10 = 2) AS unknown_count,
           count(*) FILTER (o_orderkey % 10 > 2 AND o_totalprice BETWEEN 5000 AND 450000) AS staged_count
    FROM orders GROUP BY ALL
    UNION ALL SELECT 'orders', 3, 0, 0, 0, 0, 0, 0, 0""",
)
def batch_counts(t: Tables) -> DataFrame:
    """Broken, control and unknown messages among the orders of three batches, and a batch without messages."""
    kind = F.col("o_orderkey") % 10
    header = F.to_json(F.struct(F.struct(F.lit("create-table").alias("operation")).alias("metadata")))
    whole = encode(
        t.orders, [c.name for c in ORDERS.columns], operation=F.when(kind == 2, "upsert").otherwise("insert"),
        at=F.col("o_orderdate"), table="orders", keep=("o_orderkey",),
    )
    value = F.when(kind == 0, F.lit("{broken")).when(kind == 1, header).otherwise(F.col("value"))
    messages = whole.select("o_orderkey", F.lit(0).cast("long").alias("offset"), value.alias("value"))
    found = [
        run_batch(CHECKED_ORDERS, messages.filter(F.col("o_orderkey") % 4 < 0 if n == 3 else F.col("o_orderkey") % 3 == n), n, FIRST_TIME).counts
        for n in range(4)
    ]
    return reduce(DataFrame.unionByName, found).drop("failed_rules", "path", "quarantined_at")


@query(
    "stream_orders_run",
    AFTER_BOTH.format(first="", second=""),
    ("accepted_second",),
)
def stream_orders_run(t: Tables) -> DataFrame:
    """The same two batches as files that a stream picks up, with a restart in between."""
    root = scratch_dir(t.spark)
    store = Store(t.spark, f"{root}/store")
    for messages in batches(t):
        messages.write.mode("append").parquet(f"{root}/messages")
        source = t.spark.readStream.schema("offset int, value string").parquet(f"{root}/messages")
        running = start_stream(
            CHECKED_ORDERS, source, store, f"{root}/checkpoints", trigger={"availableNow": True}
        )
        running.awaitTermination()
    return store.history(CHECKED_ORDERS).select(*OUTPUT)


CLIENTS = TableSpec("clients", (ColumnSpec("c_custkey", "bigint"), ColumnSpec("c_mktsegment", "string")), ("c_custkey",))
INNER = TableSpec("dq_metrics", (ColumnSpec("metric_name", "string"),), internal=True)


@query(
    "stream_two_tables",
    """
    SELECT 'orders' AS table_name, o_orderkey AS id, o_orderstatus AS state FROM order_ops WHERE _operation = 'INSERT'
    UNION ALL SELECT 'clients', c_custkey, c_mktsegment FROM customer""",
    ("order_ops",),
)
def stream_two_tables(t: Tables) -> DataFrame:
    """A query for each table that has a stream; an empty batch follows the first, the internal table has none."""
    root = scratch_dir(t.spark)
    store = Store(t.spark, f"{root}/store")
    load, _ = batches(t)
    clients = encode(
        t.customer, CLIENTS.column_names, operation=F.lit("load"), at=F.lit(FIRST_TIME), table="clients", keep=()
    )
    load.write.parquet(f"{root}/orders")
    clients.write.parquet(f"{root}/clients")
    shapes = {"orders": "offset int, value string", "clients": "value string"}

    def source(spec: TableSpec) -> DataFrame:
        return t.spark.readStream.schema(shapes[spec.name]).parquet(f"{root}/{spec.name}")

    for _ in range(2):
        for running in start_all([PLAIN_ORDERS, CLIENTS, INNER], source, store, f"{root}/checkpoints", trigger={"availableNow": True}):
            running.awaitTermination()
    orders = store.current(PLAIN_ORDERS).select(
        F.lit("orders").alias("table_name"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state")
    )
    return orders.unionByName(
        store.current(CLIENTS).select(
            F.lit("clients").alias("table_name"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("state")
        )
    )


@query(
    "source_messages",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS value, 'cdc-orders' AS topic,
           CAST(o_orderkey % 3 AS INTEGER) AS partition, o_orderkey AS offset, o_orderdate AS message_time FROM orders""",
)
def source_messages(t: Tables) -> DataFrame:
    """Orders in the shape that Spark's Kafka source has, as a stream of changes takes them."""
    kafka = t.orders.select(
        F.col("o_orderkey").cast("string").cast("binary").alias("key"),
        F.col("o_orderstatus").cast("binary").alias("value"),
        F.lit("cdc-orders").alias("topic"),
        (F.col("o_orderkey") % 3).cast("int").alias("partition"),
        F.col("o_orderkey").alias("offset"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )
    return messages_of(kafka)


@query(
    "source_gaps",
    """
    WITH m AS (SELECT CAST(o_orderkey % 3 AS INTEGER) AS partition, o_orderkey // 3 AS o FROM orders WHERE o_orderstatus <> 'P'),
    s AS (SELECT partition, o, lag(o) OVER (PARTITION BY partition ORDER BY o) AS before FROM m)
    SELECT 'cdc-orders' AS topic, partition, before + 1 AS first_lost, o - 1 AS last_lost FROM s WHERE o > before + 1""",
)
def source_gaps(t: Tables) -> DataFrame:
    """Pending orders were lost from a topic of three partitions, read in four batches with borders inside gaps too."""
    whole = t.orders.filter("o_orderstatus <> 'P'").select(
        F.lit("cdc-orders").alias("topic"), (F.col("o_orderkey") % 3).cast("int").alias("partition"), F.floor(F.col("o_orderkey") / 3).alias("offset")
    )
    most = t.orders.agg(F.max("o_orderkey")).scalar()
    numbered = written(whole.withColumn("batch", F.floor(F.col("offset") * 12 / (most + 1))))
    known, found = None, []
    for number in range(4):
        batch = numbered.filter(F.col("batch") == number).drop("batch")
        found.append(lost_offsets(batch, known, block=500))
        known = written(next_offsets(batch, known))
    return reduce(DataFrame.unionByName, found)


CHANGED_ORDERS = """
    WITH h AS (SELECT l.o_orderkey, l.o_orderstatus, l._operation, l.change_ts AS since, s.change_ts AS until
          FROM order_ops l LEFT JOIN second s USING (o_orderkey) WHERE l._operation = 'INSERT'
          UNION ALL SELECT o_orderkey, o_orderstatus, _operation, change_ts, NULL FROM second WHERE _operation = 'UPDATE')
    SELECT o_orderkey, o_orderstatus, _operation, since AS _effective_from {more} FROM h WHERE {which}"""


def compacted(t: Tables) -> Store:
    """Load and changes of orders in a store, the load compacted."""
    load, changes = batches(t)
    store = Store(t.spark, scratch_dir(t.spark))
    write_batch(PLAIN_ORDERS, load, 0, store, now=FIRST_TIME)
    store.compact(PLAIN_ORDERS)
    write_batch(PLAIN_ORDERS, changes, 1, store, now=SECOND_TIME)
    return store


@query(
    "store_as_of",
    CHANGED_ORDERS.format(more="", which="since <= TIMESTAMP '1998-06-01' AND coalesce(until > TIMESTAMP '1998-06-01', TRUE)"),
    ("second",),
)
def store_as_of(t: Tables) -> DataFrame:
    """What the stored history held on a day, read without what began later."""
    found = compacted(t).as_of(PLAIN_ORDERS, dt.datetime(1998, 6, 1))
    return found.select("o_orderkey", "o_orderstatus", "_operation", "_effective_from")


@query(
    "store_timeline",
    CHANGED_ORDERS.format(more=", until AS _effective_to", which="o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '5-LOW')"),
    ("second",),
)
def store_timeline(t: Tables) -> DataFrame:
    """The versions of the first pending order that stays, found by bloom filters of the key."""
    first = t.orders.filter("o_orderstatus = 'P' AND o_orderpriority <> '5-LOW'").agg(F.min("o_orderkey")).first()[0]
    found = compacted(t).timeline(PLAIN_ORDERS, [first])
    return found.select("o_orderkey", "o_orderstatus", "_operation", "_effective_from", "_effective_to")


def shared_feed(t: Tables) -> DataFrame:
    """Messages of orders and clients in one feed."""
    load, _ = batches(t)
    clients = encode(t.customer, CLIENTS.column_names, operation=F.lit("load"), at=F.lit(FIRST_TIME), table="clients")
    return load.select("offset", "value").unionByName(clients.withColumn("offset", F.lit(0)))


@query(
    "stream_routed_tables",
    """
    SELECT 'orders' AS table_name, o_orderkey AS id, o_orderstatus AS state, count(*) OVER () AS feed_rows, FALSE AS failed_first
    FROM order_ops WHERE _operation = 'INSERT'
    UNION ALL SELECT 'clients', c_custkey, c_mktsegment, count(*) OVER (), TRUE FROM customer""",
    ("order_ops",),
)
def stream_routed_tables(t: Tables) -> DataFrame:
    """One stream for two tables. Clients fail at first and are written by a second attempt, orders do not notice."""
    root = scratch_dir(t.spark)
    store = Store(t.spark, f"{root}/store")
    shared_feed(t).write.parquet(f"{root}/feed")
    source = t.spark.readStream.schema("offset int, value string").parquet(f"{root}/feed")
    broken = replace(CLIENTS, rules=(Rule("no_such", "regex", "c_mktsegment", {"pattern": "("}),))
    running = start_routed([PLAIN_ORDERS, broken, INNER], source, store, f"{root}/checkpoints", trigger={"availableNow": True})
    running.awaitTermination()
    failed = {s.name: bool(store.failed(s)) for s in (PLAIN_ORDERS, CLIENTS)}
    retry_failed(CLIENTS, store)
    parts = []
    for spec, key, state in ((PLAIN_ORDERS, "o_orderkey", "o_orderstatus"), (CLIENTS, "c_custkey", "c_mktsegment")):
        rows = store.summary().filter(F.col("table_name") == spec.name).agg(F.sum("messages")).scalar()
        parts.append(
            store.current(spec).select(
                F.lit(spec.name).alias("table_name"), F.col(key).alias("id"), F.col(state).alias("state"), rows.alias("feed_rows"),
                F.lit(failed[spec.name]).alias("failed_first"),
            )
        )
    return parts[0].unionByName(parts[1])


@query(
    "stream_progress",
    """
    SELECT 'stream_orders' AS query, 'progress' AS kind, count(*) AS input_rows FROM orders
    UNION ALL SELECT 'stream_orders', 'ended', NULL UNION ALL SELECT 'stream_clients', 'failed', NULL""",
)
def stream_progress(t: Tables) -> DataFrame:
    """What a listener tells of two streams, of which one cannot be written."""
    root = scratch_dir(t.spark)
    store, facts = Store(t.spark, f"{root}/store"), StreamFacts()
    shared_feed(t).write.parquet(f"{root}/feed")
    load, _ = batches(t)
    load.write.parquet(f"{root}/orders")
    source = lambda name: t.spark.readStream.schema("offset int, value string").parquet(f"{root}/{name}")
    broken = replace(CLIENTS, rules=(Rule("no_such", "regex", "c_mktsegment", {"pattern": "("}),))
    t.spark.streams.addListener(facts)
    try:
        for spec, folder in ((PLAIN_ORDERS, "orders"), (broken, "feed")):
            running = start_stream(spec, source(folder), store, f"{root}/checkpoints", trigger={"availableNow": True})
            try:
                running.awaitTermination()
            except StreamingQueryException:
                pass
        end = time.monotonic() + 30
        while len(facts.over()) < 2 and time.monotonic() < end:
            time.sleep(0.1)
        found = facts.rows(t.spark)
    finally:
        t.spark.streams.removeListener(facts)
    told = found.filter("kind IN ('progress', 'ended', 'failed') AND (kind <> 'progress' OR input_rows > 0)")
    return told.groupBy("query", "kind").agg(F.sum("input_rows").alias("input_rows"))


@query("stream_wait_for_any", "SELECT c_custkey, c_mktsegment FROM customer")
def stream_wait_for_any(t: Tables) -> DataFrame:
    """Clients as a stream; the wait for any query to end is over when it has written them."""
    root = scratch_dir(t.spark)
    store = Store(t.spark, f"{root}/store")
    encode(t.customer, CLIENTS.column_names, operation=F.lit("load"), at=F.lit(FIRST_TIME), table="clients").write.parquet(f"{root}/clients")
    source = t.spark.readStream.schema("value string").parquet(f"{root}/clients")
    t.spark.streams.resetTerminated()
    start_all([CLIENTS, INNER], lambda spec: source, store, f"{root}/checkpoints", trigger={"availableNow": True})
    wait_for_any(t.spark)
    return store.current(CLIENTS).select("c_custkey", "c_mktsegment")
