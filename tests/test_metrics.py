import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from cdcflow.operators import constraints as C, metrics as M
from cdcflow.spec import Check, ColumnSpec, ForeignKey, TableSpec

CHECKS = [
    Check("completeness", "v", 0.75),
    Check("Uniqueness", "v", 1.0, "error"),
    Check("compliance", "s", 0.9, pattern=r"^\d$"),
    Check("compliance", "s", 0.1, expression="v > 1 OR s = 'x'"),
    Check("size", threshold=1),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        [(1, 1, "1"), (1, 2, "x"), (1, 2, None), (1, None, "22"), (2, 5, "3")], "b int, v int, s string"
    )


def measure(df, checks=CHECKS, batch=7, **options):
    return M.compute_metrics(df, checks, "t", batch, F.lit(at(0)), **options)


def test_one_batch(table):
    found = measure(table.filter("b = 1"))
    assert found.columns == [*M.METRIC_COLUMNS, "severity"]
    assert rows(found, "metric_name", "column_name", "metric_value", "passed") == [
        ("Completeness", "v", 0.75, True),
        ("Compliance", "s_compliance", 0.25, False),
        ("Compliance", "s_custom", 0.5, True),
        ("Size", None, 4.0, True),
        ("Uniqueness", "v", 1 / 3, False),
    ]
    assert rows(M.breaches(found), "metric_name", "severity") == [("Compliance", "warning"), ("Uniqueness", "error")]


def test_all_checks_share_one_scan(spark, tmp_path, table):
    table.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    found = measure(stored, [*CHECKS, Check("uniqueness", "s"), Check("uniqueness", "b")])
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert rows(found.filter("metric_name = 'Uniqueness'"), "column_name", "metric_value") == [("b", 0.2), ("s", 1.0), ("v", 0.5)]


def test_a_violated_description(spark):
    spec = TableSpec(
        "t", (ColumnSpec("id", "int", nullable=False), ColumnSpec("a", "string", unique=True), ColumnSpec("b", "int", default=9)), ("id",),
        unique_keys=(("a", "b"),), foreign_keys=(ForeignKey("b", "p", "k"),),
    )
    df = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (None, "y", 2), (4, None, None)], "id int, a string, b int")
    parents = {"p": spark.createDataFrame([(1,)], "k int")}
    assert rows(C.violations(spec, df, parents)) == [
        ("foreign_key", "b", 1), ("not_null", "id", 1), ("primary_key", "id", 3), ("unique", "a", 2), ("unique", "a,b", 2)]
    with pytest.raises(ValueError):
        C.violations(spec, df)
    assert rows(C.described_defaults(spec, df, F.lit(at(0))), "b") == [(1,), (1,), (2,), (9,)]
    assert C.violations(TableSpec("e", (ColumnSpec("id", "int"),), internal=True), df.select("id")).count() == 0


def test_several_batches_in_one_pass(table):
    found = measure(table, CHECKS, "b")
    assert rows(found.filter("metric_name = 'Size'"), "batch_id", "metric_value") == [(1, 4.0), (2, 1.0)]
    assert rows(found.filter("metric_name = 'Uniqueness'"), "batch_id", "metric_value") == [(1, 1 / 3), (2, 1.0)]


def test_empty_batch_reports_its_size_only(table):
    found = measure(table.limit(0))
    assert rows(found, "metric_name", "metric_value", "passed") == [("Size", 0.0, False)]


def test_no_threshold_passes(table):
    assert rows(measure(table, [Check("completeness", "v")]), "threshold", "passed") == [(None, True)]


def test_unusable_checks(table):
    for check in (Check("median", "v"), Check("completeness", "nope"), Check("uniqueness")):
        with pytest.raises(ValueError):
            measure(table, [check])
        assert measure(table, [check], strict=False).count() == 0
    assert measure(table, []).count() == 0


def test_running_and_latest(table):
    counts = M.metric_counts(table, CHECKS, "b")
    assert rows(M.running(counts, "t").filter("metric_name = 'Completeness'"), "batch_id", "running_value") == [
        (1, 0.75), (2, 0.8)]
    old, new = measure(table), measure(table.filter("v IS NOT NULL")).withColumn("timestamp", F.lit(at(1)))
    both = M.latest(old.unionByName(new))
    assert rows(both.filter("metric_name = 'Completeness'"), "metric_value") == [(1.0,)]
    assert both.count() == 5


def test_reports(table):
    found = measure(table, CHECKS, "b")
    summary = M.summarise(found).filter("metric_name = 'Completeness'")
    assert rows(summary, "avg_metric", "min_metric", "batch_count", "failed_batches") == [(0.875, 0.75, 2, 0)]
    assert M.trend(found, F.lit(at(2)), hours=24).count() == 0
    assert M.trend(found, F.lit(at(0, 12)), hours=24).count() == 5


def test_constraints(spark, table):
    assert rows(C.primary_key(table, ["v"])) == [(2, 2, "duplicate"), (None, 1, "null")]
    assert rows(C.not_null(table, ["v", "s"])) == [("s", 1), ("v", 1)]
    twice = table.unionByName(table)
    assert rows(C.unique(twice, ["v", "s"])) == [(1, "1", 2), (2, "x", 2), (5, "3", 2)]
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    assert rows(C.foreign_key(table, "v", parent, "id"), "v", "s") == [(5, "3")]
    filled = C.defaults(table.withColumn("t", F.lit(None).cast("timestamp_ntz")), {"v": 0, "t": "now()"}, F.lit(at(3)))
    assert rows(filled.filter("s = '22'"), "v", "t") == [(0, at(3))]


@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_rows_are_counted_by_the_values_of_one_unique_column(spark, kind):
    """No row is copied for its value; NULLs are rows but no values, 0.0 and -0.0 are one."""
    values = [("1", 1), ("2", 1), ("2", None), (None, 1), (None, None), ("0", 2), ("-0", 2)]
    df = spark.createDataFrame(values, "v string, w int").select(F.col("v").cast("string" if kind == "string" else "double").cast(kind).alias("v"), "w")
    found = measure(df, [Check("uniqueness", "v", 1.0), Check("completeness", "w"), Check("size")])
    once = 3 if kind == "string" else 1
    assert rows(found, "metric_name", "metric_value") == [("Completeness", 5 / 7), ("Size", 7.0), ("Uniqueness", once / 5)]
    assert found._jdf.queryExecution().executedPlan().toString().count("Generate ") == 1
    empty = measure(df.filter("w > 9"), [Check("uniqueness", "v", 1.0), Check("size")])
    assert rows(empty, "metric_name", "metric_value") == [("Size", 0.0)]
    by_batch = measure(df.filter("w IS NOT NULL"), [Check("uniqueness", "v", 1.0)], "w")
    assert rows(by_batch, "batch_id", "metric_value") == ([(1, 1.0), (2, 1.0)] if kind == "string" else [(1, 1.0), (2, 0.0)])
