"""Database constraints on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cdcflow.operators import constraints as C, history as H
from cdcflow.plans.catalog.base import Tables, dirty, moment, query
from cdcflow.plans.catalog.versions import order_history, order_ops
from cdcflow.session import written
from cdcflow.spec import ColumnSpec, ForeignKey, TableSpec


@query(
    "constraint_primary_key",
    """
    SELECT code, value, count(*) AS rows,
           CASE WHEN code IS NULL OR value IS NULL THEN 'null' ELSE 'duplicate' END AS violation
    FROM dirty GROUP BY code, value HAVING count(*) > 1 OR code IS NULL OR value IS NULL""",
    ("dirty",),
)
def constraint_primary_key(t: Tables) -> DataFrame:
    return C.primary_key(dirty(t), ["code", "value"])


@query(
    "constraint_not_null",
    """
    SELECT 'code' AS column_name, count(*) FILTER (code IS NULL) AS null_rows FROM dirty
    UNION ALL SELECT 'value', count(*) FILTER (value IS NULL) FROM dirty
    UNION ALL SELECT 'user_id', count(*) FILTER (user_id IS NULL) FROM dirty""",
    ("dirty",),
)
def constraint_not_null(t: Tables) -> DataFrame:
    return C.not_null(dirty(t), ["code", "value", "user_id"])


@query(
    "constraint_unique_composite",
    """
    SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem
    WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
)
def constraint_unique_composite(t: Tables) -> DataFrame:
    return C.unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "constraint_foreign_key",
    """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM order_history WHERE _is_current AND o_orderkey = l_orderkey)""",
    ("order_history",),
)
def constraint_foreign_key(t: Tables) -> DataFrame:
    """Lines whose order has been deleted."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return C.foreign_key(lines, "l_orderkey", H.current(order_history(t)), "o_orderkey")


@query(
    "constraint_default",
    """
    SELECT event_id, coalesce(code, 'unknown') AS code, coalesce(value, 0) AS value,
           CASE WHEN props IS NULL THEN TIMESTAMP '2024-02-01' ELSE ts END AS seen_at
    FROM dirty""",
    ("dirty",),
)
def constraint_default(t: Tables) -> DataFrame:
    seen = F.when(F.col("props").isNotNull(), F.col("ts")).alias("seen_at")
    rows = dirty(t).select("event_id", "code", "value", seen)
    return C.defaults(rows, {"code": "unknown", "value": 0, "seen_at": "NOW()"}, moment("2024-02-01"))


DESCRIBED = TableSpec(
    name="described",
    columns=(
        ColumnSpec("o_orderkey", "bigint", nullable=False),
        ColumnSpec("o_custkey", "bigint", nullable=False),
        ColumnSpec("o_orderstatus", "string", default="N"),
        ColumnSpec("o_totalprice", "double", unique=True),
        ColumnSpec("o_orderpriority", "string"),
    ),
    primary_key=("o_orderkey",),
    unique_keys=(("o_custkey", "o_orderpriority"),),
    foreign_keys=(ForeignKey("o_custkey", "customer", "c_custkey"),),
)


@query(
    "constraint_from_spec",
    """
    WITH a AS (SELECT o_orderkey, nullif(o_custkey, 7) AS o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
                      floor(o_totalprice / 10) AS o_totalprice, o_orderpriority FROM orders),
    r AS (FROM a UNION ALL FROM a WHERE o_orderkey % 100 = 0 UNION ALL SELECT * REPLACE (NULL AS o_orderkey) FROM a WHERE o_orderkey = 5),
    s AS (SELECT count(*) FILTER (o_orderkey IS NULL) AS no_key, count(*) FILTER (o_custkey IS NULL) AS no_customer FROM r),
    k AS (SELECT count(*) AS n FROM r WHERE o_orderkey IS NULL OR o_orderkey % 100 = 0),
    p AS (SELECT count(*) AS n FROM r WHERE o_totalprice IN (SELECT o_totalprice FROM r GROUP BY 1 HAVING count(*) > 1)),
    u AS (SELECT count(*) AS n FROM r WHERE (o_custkey, o_orderpriority) IN (
              SELECT (o_custkey, o_orderpriority) FROM r WHERE o_custkey IS NOT NULL GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1)),
    f AS (SELECT count(*) AS n FROM r WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
    SELECT * FROM (
        SELECT 'primary_key' AS constraint, 'o_orderkey' AS columns, n AS rows FROM k
        UNION ALL SELECT 'not_null', 'o_orderkey', no_key FROM s UNION ALL SELECT 'not_null', 'o_custkey', no_customer FROM s
        UNION ALL SELECT 'unique', 'o_totalprice', n FROM p UNION ALL SELECT 'unique', 'o_custkey,o_orderpriority', n FROM u
        UNION ALL SELECT 'foreign_key', 'o_custkey', n FROM f)
    WHERE rows > 0""",
)
def constraint_from_spec(t: Tables) -> DataFrame:
    """Orders with repeated and missing keys, customers that lack or are unknown, and coarse prices."""
    rows = t.orders.select(
        "o_orderkey",
        F.nullif("o_custkey", F.lit(7)).alias("o_custkey"),
        F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        F.floor(F.col("o_totalprice") / 10).cast("double").alias("o_totalprice"),
        "o_orderpriority",
    )
    keyless = rows.filter("o_orderkey = 5").withColumn("o_orderkey", F.lit(None).cast("bigint"))
    whole = rows.unionByName(rows.filter("o_orderkey % 100 = 0")).unionByName(keyless)
    return C.violations(DESCRIBED, whole, {"customer": t.customer.filter("c_acctbal > 0")})


@query(
    "constraint_unique_stored",
    """
    WITH state AS (
        SELECT b.batch, o_orderkey, o_custkey, o_orderstatus, _operation,
               row_number() OVER (PARTITION BY b.batch, o_orderkey ORDER BY seq DESC) AS rn
        FROM order_ops JOIN (VALUES (0), (1), (2)) AS b(batch) ON seq <= b.batch)
    SELECT CAST(batch AS BIGINT) AS batch_id, o_custkey, o_orderstatus, count(*) AS rows FROM state
    WHERE rn = 1 AND _operation <> 'DELETE' GROUP BY ALL HAVING count(*) > 1""",
    ("order_ops",),
)
def constraint_unique_stored(t: Tables) -> DataFrame:
    """Customers with several open orders of one status, kept up to date by load, updates and deletes."""
    changes = order_ops(t)
    columns, repeated, current, found = ["o_custkey", "o_orderstatus"], None, None, []
    for number in range(3):
        staged = H.add_version_columns(changes.filter(F.col("seq") == number), F.col("change_ts"))
        repeated = written(C.unique_after(repeated, current, staged, ["o_orderkey"], columns))
        found.append(repeated.withColumn("batch_id", F.lit(number).cast("long")))
        current = written(H.current(H.apply_changes(current, staged, ["o_orderkey"])))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "constraint_foreign_key_history",
    """
    WITH alive AS (
        SELECT o_orderkey, o_orderdate AS since, CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate + INTERVAL 2 DAY END AS until
        FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0),
    lines AS (SELECT l_orderkey, l_linenumber, l_shipdate, CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate + INTERVAL 30 DAY END AS ends FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_shipdate AS orphan_from, ends AS orphan_to FROM lines ANTI JOIN alive ON o_orderkey = l_orderkey
    UNION ALL SELECT l_orderkey, l_linenumber, l_shipdate, least(since, ends) FROM lines JOIN alive ON o_orderkey = l_orderkey WHERE since > l_shipdate
    UNION ALL SELECT l_orderkey, l_linenumber, greatest(l_shipdate, until), ends FROM lines JOIN alive ON o_orderkey = l_orderkey
    WHERE until IS NOT NULL AND (ends IS NULL OR ends > until)""",
)
def constraint_foreign_key_history(t: Tables) -> DataFrame:
    """When lines stood without their order: it came later, was deleted, or was never there."""
    parents = order_history(t).filter("o_orderstatus <> 'P' OR o_orderkey % 2 = 0 OR _operation = 'UPDATE'")
    pending = t.orders.filter("o_orderstatus = 'P' AND o_orderkey % 2 = 1").select("o_orderkey")
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").alias(H.FROM),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate") + F.make_dt_interval(days=F.lit(30))).alias(H.TO),
    )
    found = C.orphan_intervals(lines, "l_orderkey", parents.join(pending, "o_orderkey", "left_anti"), "o_orderkey")
    return found.drop(H.FROM, H.TO)
