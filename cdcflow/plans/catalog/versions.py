"""De-duplication and type 2 history over the event and order change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cdcflow.functions.columns import map_operation
from cdcflow.operators import history as H, skew
from cdcflow.plans.catalog.base import BUILT_FROM, CTES, Tables, event_changes, history_sql, moment, order_changes, query
from cdcflow.session import scratch_dir
from cdcflow.sources.buckets import BucketedVersions

KEY = ["o_orderkey"]
VERSION = ["o_orderkey", "o_orderstatus", "_operation", "_effective_from", "_effective_to", "_is_current"]
VERSION_SQL = "o_orderkey, o_orderstatus, _operation, _effective_from, _effective_to, _is_current"

# Second batch: the last change per order after its load.
CTES["second"] = """
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY change_ts DESC, seq DESC) AS rn
        FROM order_ops WHERE _operation <> 'INSERT') WHERE rn = 1"""
CTES["merged"] = """
    SELECT l.o_orderkey, l.o_orderstatus, l._operation, l.change_ts AS _effective_from,
           s.change_ts AS _effective_to, s.o_orderkey IS NULL AS _is_current
    FROM order_ops l LEFT JOIN second s USING (o_orderkey) WHERE l._operation = 'INSERT'
    UNION ALL
    SELECT o_orderkey, o_orderstatus, _operation, change_ts, NULL, TRUE FROM second WHERE _operation = 'UPDATE'"""
BUILT_FROM |= {"second": ("order_ops",), "merged": ("second",)}


def order_ops(t: Tables) -> DataFrame:
    return order_changes(t).withColumn("_operation", map_operation(F.col("operation"))).drop("operation")


def order_history(t: Tables) -> DataFrame:
    return H.from_changelog(order_ops(t), KEY, ["change_ts", "seq"])


def event_history(t: Tables) -> DataFrame:
    return H.from_changelog(event_changes(t), ["user_id"], ["change_ts", "event_id"])


def loaded(t: Tables) -> DataFrame:
    """History after the first batch, the initial load."""
    first = H.add_version_columns(order_ops(t).filter(F.col("_operation") == "INSERT"), F.col("change_ts"))
    return H.apply_changes(None, first, KEY)


def merged(t: Tables) -> DataFrame:
    """History after both batches."""
    return H.apply_changes(loaded(t), second_batch(t), KEY)


def second_batch(t: Tables) -> DataFrame:
    later = order_ops(t).filter(F.col("_operation") != "INSERT")
    return H.add_version_columns(H.latest_per_key(later, KEY, ["change_ts", "seq"]), F.col("change_ts"))


@query(
    "dedup_latest",
    """
    SELECT user_id, event_type, event_id, change_ts FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY change_ts DESC, event_id DESC) AS rn
        FROM event_changes) WHERE rn = 1""",
    ("event_changes",),
)
def dedup_latest(t: Tables) -> DataFrame:
    changes = event_changes(t).select("user_id", "event_type", "event_id", "change_ts")
    return H.latest_per_key(changes, ["user_id", "event_type"], ["change_ts", "event_id"])


@query(
    "scd2_columns",
    """
    SELECT o_orderkey, TIMESTAMP '2024-01-01 06:00:00' AS _effective_from, NULL::TIMESTAMP AS _effective_to,
           TRUE AS _is_current, TIMESTAMP '2024-01-01 06:00:00' AS _ingested_at FROM orders""",
)
def scd2_columns(t: Tables) -> DataFrame:
    return H.add_version_columns(t.orders.select("o_orderkey"), moment("2024-01-01 06:00:00"))


@query(
    "scd2_initial_load",
    """
    SELECT user_id, event_type, change_ts AS _effective_from, TRUE AS _is_current FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY change_ts DESC, event_id DESC) AS rn
        FROM event_changes WHERE _operation <> 'UNKNOWN') WHERE rn = 1 AND _operation = 'INSERT'""",
    ("event_changes",),
)
def scd2_initial_load(t: Tables) -> DataFrame:
    """The strict first batch: only inserts open a version in an empty history."""
    key = ["user_id", "event_type"]
    last = H.latest_per_key(H.known_changes(event_changes(t)), key, ["change_ts", "event_id"])
    staged = H.add_version_columns(last, F.col("change_ts"))
    created = H.apply_changes(None, staged, key, initial="insert_only")
    return created.select("user_id", "event_type", "_effective_from", "_is_current")


@query(
    "scd2_close",
    """SELECT o_orderkey, _effective_from, _effective_to, _is_current FROM merged WHERE NOT _is_current""",
    ("merged",),
)
def scd2_close(t: Tables) -> DataFrame:
    closed = merged(t).filter(~F.col(H.CURRENT))
    return closed.select("o_orderkey", "_effective_from", "_effective_to", "_is_current")


@query("scd2_merge", "SELECT * FROM merged", ("merged",))
def scd2_merge(t: Tables) -> DataFrame:
    return merged(t).select(*VERSION)


@query("scd2_merge_bucketed", "SELECT * FROM merged", ("merged",))
def scd2_merge_bucketed(t: Tables) -> DataFrame:
    """The same with the loaded versions in a bucketed table, which the merge neither exchanges nor sorts."""
    table = BucketedVersions(t.spark, scratch_dir(t.spark), KEY, 8)
    table.write("load", loaded(t))
    return table.merged("load", second_batch(t)).select(*VERSION)


@query(
    "scd2_registered_views",
    """
    SELECT _operation, count(*) AS versions, count(*) FILTER (_is_current) AS open_versions,
           (SELECT count(*) FROM order_history WHERE _is_current) AS all_open FROM order_history GROUP BY 1""",
    ("order_history",),
)
def scd2_registered_views(t: Tables) -> DataFrame:
    """A history queried by name in SQL, whole, as history and as its current slice."""
    H.register_views(t.spark, "registered_orders", order_history(t))
    return t.spark.sql(
        """SELECT h._operation, count(*) AS versions, count_if(h._is_current) AS open_versions,
                  (SELECT count(*) FROM registered_orders_current) AS all_open
           FROM registered_orders_history h GROUP BY h._operation"""
    )


@query(
    "scd2_upsert_unseen",
    f"""
    SELECT {VERSION_SQL} FROM merged
    WHERE _operation = 'UPDATE' OR o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""",
    ("merged",),
)
def scd2_upsert_unseen(t: Tables) -> DataFrame:
    """Pending orders were never loaded: their UPDATE opens a version, their DELETE does nothing."""
    seen = loaded(t).filter(F.col("o_orderstatus") != "P")
    return H.apply_changes(seen, second_batch(t), KEY).select(*VERSION)


@query(
    "scd2_delete",
    """SELECT o_orderkey, count(*) AS versions, count(*) FILTER (_is_current) AS open_versions
       FROM merged GROUP BY 1""",
    ("merged",),
)
def scd2_delete(t: Tables) -> DataFrame:
    """A deleted order keeps its closed versions and has no open one."""
    return merged(t).groupBy("o_orderkey").agg(
        F.count("*").alias("versions"), F.count_if("_is_current").alias("open_versions")
    )


@query(
    "scd2_unknown_ignored",
    """
    SELECT user_id, event_id, _operation FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY change_ts DESC, event_id DESC) AS rn
        FROM event_changes WHERE _operation <> 'UNKNOWN') WHERE rn = 1 AND _operation <> 'DELETE'""",
    ("event_changes",),
)
def scd2_unknown_ignored(t: Tables) -> DataFrame:
    """A user's last known change decides, even when unknown ones follow it."""
    last = H.latest_per_key(H.known_changes(event_changes(t)), ["user_id"], ["change_ts", "event_id"])
    staged = H.add_version_columns(last, F.col("change_ts"))
    return H.apply_changes(None, staged, ["user_id"]).select("user_id", "event_id", "_operation")


@query(
    "scd2_unchanged_skipped",
    """
    SELECT s.o_orderkey, s._operation FROM second s JOIN orders o USING (o_orderkey)
    WHERE s._operation <> 'UPDATE' OR o.o_orderpriority <> '1-URGENT'""",
    ("second",),
)
def scd2_unchanged_skipped(t: Tables) -> DataFrame:
    """Urgent orders were loaded as filled already, so their update repeats the values."""
    target = loaded(t).withColumn(
        "o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", "F").otherwise(F.col("o_orderstatus"))
    )
    values = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    return H.drop_unchanged(target, second_batch(t), KEY, values).select("o_orderkey", "_operation")


@query(
    "scd2_from_changelog",
    """SELECT user_id, event_type, value, event_id, _operation, _effective_from, _effective_to, _is_current
       FROM event_history""",
    ("event_history",),
)
def scd2_from_changelog(t: Tables) -> DataFrame:
    return event_history(t).drop("change_ts", "_ingested_at")


@query(
    "scd2_current",
    f"SELECT {VERSION_SQL} FROM order_history WHERE _is_current",
    ("order_history",),
)
def scd2_current(t: Tables) -> DataFrame:
    return H.current(order_history(t)).select(*VERSION)


@query(
    "scd2_timeline",
    """SELECT event_type, _operation, _effective_from, _effective_to, _is_current FROM event_history
       WHERE user_id = 7""",
    ("event_history",),
)
def scd2_timeline(t: Tables) -> DataFrame:
    one = H.timeline(event_history(t), F.col("user_id") == 7)
    return one.select("event_type", "_operation", "_effective_from", "_effective_to", "_is_current")


@query(
    "scd2_as_of",
    f"""
    SELECT {VERSION_SQL} FROM order_history
    WHERE _effective_from <= TIMESTAMP '1998-06-01' AND coalesce(_effective_to > TIMESTAMP '1998-06-01', TRUE)""",
    ("order_history",),
)
def scd2_as_of(t: Tables) -> DataFrame:
    return H.as_of(order_history(t), moment("1998-06-01")).select(*VERSION)


@query(
    "scd2_as_of_join",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, h.o_orderstatus, h._operation
    FROM lineitem JOIN order_history h ON l_orderkey = o_orderkey AND h._effective_from <= l_shipdate
         AND (h._effective_to IS NULL OR h._effective_to > l_shipdate)""",
    ("order_history",),
)
def scd2_as_of_join(t: Tables) -> DataFrame:
    """Each shipped line with its order's state on the day of shipping."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return H.as_of_join(
        lines, order_history(t), ["l_orderkey"], KEY, "l_shipdate", ["o_orderstatus", "_operation"]
    )


def staged_at(changes: DataFrame) -> DataFrame:
    return H.add_version_columns(changes, F.col("change_ts"))


@query("scd2_late_after_delete", f"SELECT {VERSION_SQL} FROM order_history", ("order_history",))
def scd2_late_after_delete(t: Tables) -> DataFrame:
    """Deletes arrive first and find nothing; the loads and updates before them come in later batches."""
    changes = order_ops(t)
    history = None
    for operation in ("DELETE", "INSERT", "UPDATE"):
        batch = staged_at(changes.filter(F.col("_operation") == operation))
        history = H.apply_changes(history, batch, KEY, order=["seq"], keep_deletes=True)
    return H.versions(history).select(*VERSION)


@query(
    "scd2_unchanged_sequence",
    """
    SELECT o_orderkey, 1 AS step FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'""",
)
def scd2_unchanged_sequence(t: Tables) -> DataFrame:
    """Each order holds ('x', NULL) from its first day to the tenth and ('y', NULL) from then on.

    Pending ones change to (NULL, 'x') and back, open ones change and repeat, filled ones
    repeat. A late update of low pending orders, before their first day, has nothing to repeat.
    """
    day = lambda n: F.col("o_orderdate") + F.make_dt_interval(days=F.lit(n))
    version = lambda begin, end, a: F.struct(
        F.lit(a).alias("a"), F.lit(None).cast("string").alias("b"), F.lit("INSERT").alias("_operation"),
        day(begin).alias(H.FROM), (day(end) if end else F.lit(None).cast("timestamp_ntz")).alias(H.TO),
        F.lit(end is None).alias(H.CURRENT), day(begin).alias(H.INGESTED),
    )
    target = t.orders.select("o_orderkey", F.inline(F.array(version(0, 10, "x"), version(10, None, "y"))))

    def change(step: int, n: int, a: str | None, b: str | None, when: str):
        held = F.struct(
            F.lit(step).alias("step"), F.lit(a).cast("string").alias("a"), F.lit(b).cast("string").alias("b"),
            F.lit("UPDATE").alias("_operation"), day(n).alias("change_ts"),
        )
        return F.when(F.expr(when), held)

    steps = F.array(
        change(0, -1, "x", None, "o_orderstatus = 'P' AND o_orderpriority = '5-LOW'"),
        change(1, 1, None, "x", "o_orderstatus <> 'F'"),
        change(2, 2, "x", None, "o_orderstatus = 'P'"),
        change(3, 3, "x", None, "o_orderstatus <> 'O'"),
        change(4, 3, None, "x", "o_orderstatus = 'O'"),
    )
    staged = staged_at(t.orders.select("o_orderkey", F.inline(F.filter(steps, lambda s: s.isNotNull()))))
    return H.drop_unchanged(target, staged, KEY, ["a", "b"], ["step"]).select("o_orderkey", "step")


# Changes of few users at few instants: a third of all rows may share one day, some have no user.
CTES["burst_changes"] = """
    SELECT CASE WHEN user_id % 7 <> 0 THEN user_id % 3 END AS who, event_type, event_id,
           CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS _operation,
           CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-15' ELSE date_trunc('hour', ts) END AS change_ts
    FROM events"""
CTES["burst_history"] = f"""SELECT * FROM ({history_sql("burst_changes", "who", "change_ts, event_id")}) WHERE who IS NOT NULL"""
BUILT_FROM |= {"burst_history": ("burst_changes",)}
SPANS = skew.HotKeys(rows=200, depth=20)


def burst_history(t: Tables) -> DataFrame:
    at = F.when(F.col("event_id") % 3 == 0, moment("2024-01-15")).otherwise(F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    operation = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE")
    changes = t.events.select(
        F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 3).alias("who"),
        "event_type",
        "event_id",
        operation.otherwise("UPDATE").alias("_operation"),
        at.alias("change_ts"),
    )
    return H.from_changelog(changes, ["who"], ["change_ts", "event_id"], SPANS)


@query(
    "scd2_hot_burst",
    "SELECT who, event_id, _operation, _effective_from, _effective_to, _is_current FROM burst_history",
    ("burst_history",),
)
def scd2_hot_burst(t: Tables) -> DataFrame:
    """Three hot keys with bursts and single instants, cut into spans of some 200 rows."""
    return burst_history(t).select("who", "event_id", "_operation", "_effective_from", "_effective_to", "_is_current")


@query(
    "scd2_as_of_left",
    """
    SELECT f.event_id AS fact, h.event_id AS version, h._operation
    FROM (SELECT event_id, ts, CASE WHEN user_id % 5 <> 0 THEN user_id % 4 END AS who FROM events) f
    LEFT JOIN burst_history h ON f.who = h.who AND h._effective_from <= f.ts AND coalesce(h._effective_to > f.ts, TRUE)""",
    ("burst_history",),
)
def scd2_as_of_left(t: Tables) -> DataFrame:
    """Every event with the state of its hot user; some have none, some users no history."""
    facts = t.events.select(
        F.col("event_id").alias("fact"), "ts", F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 4).alias("user")
    )
    versions = burst_history(t).withColumnRenamed("event_id", "version")
    joined = H.as_of_join(facts, versions, ["user"], ["who"], "ts", ["version", "_operation"], how="left", hot=SPANS)
    return joined.select("fact", "version", "_operation")
