"""Batch metrics. A batch is a day of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cdcflow.operators import metrics as M, value_state as V
from cdcflow.plans.catalog.base import CTES, BUILT_FROM, Tables, dirty, moment, query
from cdcflow.plans.catalog.quality import DAY_SQL, day
from cdcflow.session import scratch_dir
from cdcflow.spec import Check

COMPLETE = [Check("completeness", "code", 0.8), Check("completeness", "value", 0.95, "error")]
UNIQUE = [Check("uniqueness", "value", 0.9), Check("uniqueness", "event_id", 1.0, "error")]
PATTERN = [Check("compliance", "ref", 0.95, pattern=r"^USR-\d{6}$")]
EXPRESSION = [Check("compliance", threshold=0.5, expression="value <= 100 AND code IS NOT NULL", name="usable")]
ALL = [*COMPLETE, *UNIQUE, *PATTERN, *EXPRESSION, Check("size", threshold=300, severity="error")]

CTES["daily"] = f"SELECT *, {DAY_SQL} AS day FROM dirty"
CTES["value_counts"] = """
    SELECT 'value' AS c, day, count(*) AS n FROM daily WHERE value IS NOT NULL GROUP BY day, value
    UNION ALL SELECT 'event_id', day, count(*) FROM daily GROUP BY day, event_id"""
CTES["metric_rows"] = """
    SELECT day AS batch_id, 'Completeness' AS metric_name, 'code' AS column_name,
           count(code) / count(*) AS metric_value, 0.8::DOUBLE AS threshold, 'warning' AS severity
    FROM daily GROUP BY day
    UNION ALL SELECT day, 'Completeness', 'value', count(value) / count(*), 0.95, 'error' FROM daily GROUP BY day
    UNION ALL SELECT day, 'Uniqueness', c, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / sum(n),
                     CASE c WHEN 'value' THEN 0.9 ELSE 1.0 END, CASE c WHEN 'value' THEN 'warning' ELSE 'error' END
              FROM value_counts GROUP BY c, day
    UNION ALL SELECT day, 'Compliance', 'ref_compliance',
                     count(*) FILTER (regexp_matches(ref, '^USR-[0-9]{6}$')) / count(*), 0.95, 'warning'
              FROM daily GROUP BY day
    UNION ALL SELECT day, 'Compliance', 'usable', count(*) FILTER (value <= 100 AND code IS NOT NULL) / count(*),
                     0.5, 'warning' FROM daily GROUP BY day
    UNION ALL SELECT day, 'Size', NULL, count(*), 300, 'error' FROM daily GROUP BY day"""
CTES["metrics"] = """
    SELECT 'events' AS table_name, batch_id, metric_name, column_name, round(metric_value, 6) AS metric_value,
           threshold, metric_value >= threshold AS passed,
           TIMESTAMP '2024-01-01' + to_days(CAST(batch_id AS INTEGER)) AS "timestamp", severity
    FROM metric_rows"""
BUILT_FROM |= {
    "daily": ("dirty",),
    "value_counts": ("daily",),
    "metric_rows": ("value_counts",),
    "metrics": ("metric_rows",),
}

VALUE_SQL = "SELECT batch_id, metric_name, column_name, metric_value FROM metrics WHERE metric_name = '{}'"


def daily(t: Tables) -> DataFrame:
    return dirty(t).withColumn("day", day())


def end_of_batch() -> Column:
    return moment("2024-01-01") + F.make_dt_interval(days=F.col("batch_id").cast("int"))


def measured(t: Tables, checks: list[Check] = ALL) -> DataFrame:
    found = M.compute_metrics(daily(t), checks, "events", "day", end_of_batch())
    return found.withColumn("metric_value", F.round("metric_value", 6))


def just_values(metrics: DataFrame) -> DataFrame:
    return metrics.select("batch_id", "metric_name", "column_name", "metric_value")


@query("metric_completeness", VALUE_SQL.format("Completeness"), ("metrics",))
def metric_completeness(t: Tables) -> DataFrame:
    return just_values(measured(t, COMPLETE))


@query("metric_uniqueness", VALUE_SQL.format("Uniqueness"), ("metrics",))
def metric_uniqueness(t: Tables) -> DataFrame:
    return just_values(measured(t, UNIQUE))


@query(
    "metric_compliance", VALUE_SQL.format("Compliance") + " AND column_name = 'ref_compliance'", ("metrics",)
)
def metric_compliance(t: Tables) -> DataFrame:
    return just_values(measured(t, PATTERN))


@query("metric_compliance_expr", VALUE_SQL.format("Compliance") + " AND column_name = 'usable'", ("metrics",))
def metric_compliance_expr(t: Tables) -> DataFrame:
    return just_values(measured(t, EXPRESSION))


@query("metric_size", VALUE_SQL.format("Size"), ("metrics",))
def metric_size(t: Tables) -> DataFrame:
    return just_values(measured(t, [Check("size")]))


@query(
    "metric_size_empty",
    """SELECT 3::BIGINT AS batch_id, 'Size' AS metric_name, NULL::VARCHAR AS column_name, 0::DOUBLE AS metric_value,
              1::DOUBLE AS threshold, count(*) > 0 AS passed FROM dirty WHERE value < 0""",
    ("dirty",),
)
def metric_size_empty(t: Tables) -> DataFrame:
    """A batch without rows reports its size and breaches; ratios over nothing are left out."""
    nothing = dirty(t).filter(F.col("value") < 0)
    checks = [Check("completeness", "code", 0.9), Check("uniqueness", "value", 0.9), Check("size", threshold=1)]
    return M.compute_metrics(nothing, checks, "events", 3, moment("2024-01-01")).select(
        "batch_id", "metric_name", "column_name", "metric_value", "threshold", "passed"
    )


@query("metric_threshold", "SELECT batch_id, metric_name, column_name, threshold, passed FROM metrics", ("metrics",))
def metric_threshold(t: Tables) -> DataFrame:
    return measured(t).select("batch_id", "metric_name", "column_name", "threshold", "passed")


@query(
    "metric_breaches",
    "SELECT batch_id, metric_name, column_name, metric_value, threshold, severity FROM metrics WHERE NOT passed",
    ("metrics",),
)
def metric_breaches(t: Tables) -> DataFrame:
    return M.breaches(measured(t)).select(
        "batch_id", "metric_name", "column_name", "metric_value", "threshold", "severity"
    )


@query("metrics_table", "SELECT * EXCLUDE (severity) FROM metrics", ("metrics",))
def metrics_table(t: Tables) -> DataFrame:
    return measured(t).select(*M.METRIC_COLUMNS)


@query(
    "metrics_latest",
    """
    WITH again AS (
        SELECT day AS batch_id, 'Completeness' AS metric_name, 'code' AS column_name,
               round(count(*) FILTER (code <> 'view') / count(*), 6) AS metric_value,
               TIMESTAMP '2024-03-01' AS at FROM daily WHERE day < 10 GROUP BY day)
    SELECT m.batch_id, m.metric_name, m.column_name, coalesce(a.metric_value, m.metric_value) AS metric_value,
           coalesce(a.at, m."timestamp") AS "timestamp"
    FROM metrics m LEFT JOIN again a USING (batch_id, metric_name, column_name)
    WHERE m.metric_name = 'Completeness'""",
    ("metrics",),
)
def metrics_latest(t: Tables) -> DataFrame:
    """The first ten days are measured again after views lost their code; the newer result counts."""
    recoded = daily(t).withColumn("code", F.when(F.col("code") != "view", F.col("code"))).filter(F.col("day") < 10)
    again = M.compute_metrics(recoded, COMPLETE[:1], "events", "day", moment("2024-03-01"))
    both = measured(t, COMPLETE).unionByName(again.withColumn("metric_value", F.round("metric_value", 6)))
    return M.latest(both).select("batch_id", "metric_name", "column_name", "metric_value", "timestamp")


@query(
    "metrics_running",
    """
    WITH counts AS (
        SELECT day, count(*) AS n, count(code) AS m0, count(value) AS m1,
               count(*) FILTER (regexp_matches(ref, '^USR-[0-9]{6}$')) AS m2,
               count(*) FILTER (value <= 100 AND code IS NOT NULL) AS m3
        FROM daily GROUP BY day),
    so_far AS (
        SELECT day, sum(n) OVER w AS n, sum(m0) OVER w AS m0, sum(m1) OVER w AS m1, sum(m2) OVER w AS m2,
               sum(m3) OVER w AS m3 FROM counts WINDOW w AS (ORDER BY day))
    SELECT 'events' AS table_name, day AS batch_id, 'Completeness' AS metric_name, 'code' AS column_name,
           round(m0 / n, 6) AS running_value FROM so_far
    UNION ALL SELECT 'events', day, 'Completeness', 'value', round(m1 / n, 6) FROM so_far
    UNION ALL SELECT 'events', day, 'Compliance', 'ref_compliance', round(m2 / n, 6) FROM so_far
    UNION ALL SELECT 'events', day, 'Compliance', 'usable', round(m3 / n, 6) FROM so_far
    UNION ALL SELECT 'events', day, 'Size', NULL, n::DOUBLE FROM so_far""",
    ("daily",),
)
def metrics_running(t: Tables) -> DataFrame:
    return M.running(M.metric_counts(daily(t), ALL, "day"), "events").withColumn(
        "running_value", F.round("running_value", 6)
    )


@query(
    "metrics_summary",
    """
    SELECT table_name, metric_name, column_name, round(avg(metric_value), 6) AS avg_metric,
           min(metric_value) AS min_metric, count(*) AS batch_count,
           count(*) FILTER (NOT passed) AS failed_batches
    FROM metrics GROUP BY ALL""",
    ("metrics",),
)
def metrics_summary(t: Tables) -> DataFrame:
    return M.summarise(measured(t)).withColumn("avg_metric", F.round("avg_metric", 6))


@query(
    "metrics_trend",
    """
    SELECT table_name, metric_name, column_name, round(avg(metric_value), 6) AS avg_value,
           min(metric_value) AS min_value, max(metric_value) AS max_value,
           count(*) FILTER (NOT passed) AS failures
    FROM metrics WHERE "timestamp" > TIMESTAMP '2024-01-28' - INTERVAL 168 HOUR GROUP BY ALL""",
    ("metrics",),
)
def metrics_trend(t: Tables) -> DataFrame:
    return M.trend(measured(t), moment("2024-01-28"), hours=168).withColumn("avg_value", F.round("avg_value", 6))


@query(
    "metric_selection",
    """SELECT 'Completeness' AS metric_name, 'code' AS column_name, round(count(code) / count(*), 6) AS metric_value FROM dirty""",
    ("dirty",),
)
def metric_selection(t: Tables) -> DataFrame:
    """Checks that cannot be measured are left out, the usable one is not."""
    checks = [Check("median", "value"), Check("uniqueness", "no_such_column"), Check("completeness"), COMPLETE[0]]
    found = M.compute_metrics(dirty(t), checks, "events", 0, moment("2024-01-01"), strict=False)
    return found.select("metric_name", "column_name", F.round("metric_value", 6).alias("metric_value"))


RECOUNT = """
    WITH v AS (
        SELECT {batch} AS batch, 'value' AS c, CAST(value AS VARCHAR) AS v FROM daily WHERE value IS NOT NULL
        UNION ALL SELECT {batch}, 'code', code FROM daily WHERE code IS NOT NULL
        UNION ALL SELECT {batch}, 'event_id', CAST(CASE WHEN event_id % 97 = 0 THEN 1 ELSE event_id END AS VARCHAR) FROM daily),
    n AS (SELECT b.batch, c, v, count(*) AS n FROM (SELECT DISTINCT batch FROM v) b JOIN v ON v.batch <= b.batch GROUP BY ALL)
    SELECT 'events' AS table_name, batch AS batch_id, 'Uniqueness' AS metric_name, c AS column_name,
           round(count(*) FILTER (n = 1) / sum(n), 6) AS running_value FROM n GROUP BY ALL"""
VALUED = ["value", "code", "event_id"]


def with_repeats(t: Tables) -> DataFrame:
    """Days of events; some ids are one and the same."""
    return daily(t).withColumn("event_id", F.when(F.col("event_id") % 97 == 0, 1).otherwise(F.col("event_id")))


@query("metrics_running_uniqueness", RECOUNT.format(batch="day // 8"), ("daily",))
def metrics_running_uniqueness(t: Tables) -> DataFrame:
    """Uniqueness over all batches so far, each batch of eight days absorbed into the state of those before."""
    state = V.ValueState(t.spark, scratch_dir(t.spark))
    events = with_repeats(t)
    for number in range(4):
        state.absorb("events", number, events.filter(F.floor(F.col("day") / 8) == number), VALUED)
        if number == 1:
            state.compact("events")
    return state.running("events").withColumn("running_value", F.round("running_value", 6))


@query("metrics_running_backfill", RECOUNT.format(batch="day"), ("daily",))
def metrics_running_backfill(t: Tables) -> DataFrame:
    """The same of all days at once, in one pass over their value counts."""
    changes = V.changes_of(V.value_counts(with_repeats(t), VALUED, "day"))
    return V.running_uniqueness(changes, "events").withColumn("running_value", F.round("running_value", 6))
