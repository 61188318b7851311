import json

from conftest import at, rows
from pyspark.sql import functions as F

from cdcflow.functions.columns import map_operation
from cdcflow.sources import envelope
from cdcflow.spec import ColumnSpec, TableSpec

SPEC = TableSpec(
    "readings",
    (ColumnSpec("id", "int", nullable=False), ColumnSpec("v", "double"), ColumnSpec("note", "string")),
    ("id",),
)


def message(data, operation="insert", table="readings", schema="public"):
    header = {"timestamp": "2024-01-02T03:04:05Z", "operation": operation, "schema-name": schema, "table-name": table}
    return json.dumps({"data": data, "metadata": header})


def frame(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_decode_types_and_operations(spark):
    texts = [message({"id": i, "v": 1.5, "note": None}, op) for i, op in enumerate(
        ["insert", "load", "update", "delete", "create-table"])]
    out = envelope.decode(frame(spark, *texts), SPEC)
    assert out.columns == ["id", "v", "note", "_operation", "_change_ts"]
    assert [r[1] for r in rows(out, "id", "_operation")] == ["INSERT", "INSERT", "UPDATE", "DELETE", "UNKNOWN"]
    assert {r[0].isoformat() for r in rows(out, "_change_ts")} == {"2024-01-02T03:04:05"}


def test_binary_values_and_kept_columns(spark):
    raw = frame(spark, message({"id": 1})).select(F.col("value").cast("binary").alias("value"), F.lit(9).alias("offset"))
    assert rows(envelope.decode(raw, SPEC, keep=("offset",)), "offset", "id") == [(9, 1)]


def test_malformed_and_control_messages_are_left_out(spark):
    control = json.dumps({"metadata": {"operation": "create-table", "record-type": "control"}})
    out = envelope.decode(frame(spark, "garbage", control, message({}), message({"note": "kept"}), ""), SPEC)
    assert rows(out, "id", "note") == [(None, "kept")]


def test_a_bad_field_does_not_lose_its_row(spark):
    out = envelope.decode(frame(spark, message({"id": "oops", "v": 2.5})), SPEC)
    assert rows(out, "id", "v") == [(None, 2.5)]


def test_messages_are_parsed_once(spark, tmp_path):
    frame(spark, message({"id": 1})).write.parquet(f"{tmp_path}/m")
    plan = envelope.decode(spark.read.parquet(f"{tmp_path}/m"), SPEC)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_missing_operation_is_unknown(spark):
    out = spark.range(1).select(map_operation(F.lit(None).cast("string")).alias("op"))
    assert rows(out) == [("UNKNOWN",)]


def test_encode_keeps_nulls_and_round_trips(spark):
    source = spark.createDataFrame([(1, None, "a"), (2, 2.25, None)], SPEC.schema)
    sent = envelope.encode(
        source, SPEC.column_names, operation=F.lit("update"), at=F.lit(at(0)), table="readings"
    )
    assert all('"v":null' in r.value or '"note":null' in r.value for r in sent.collect())
    back = envelope.decode(sent, SPEC)
    assert rows(back, *SPEC.column_names) == rows(source)


def test_route_uses_schema_table_and_skips_internal(spark):
    inner = TableSpec("dq_metrics", (ColumnSpec("x", "int"),), internal=True)
    feed = frame(
        spark,
        message({"id": 1}),
        message({"id": 2}, table="other"),
        message({"id": 3}, schema="staging"),
        message({"id": 4}, table="dq_metrics"),
        "garbage",
    )
    out = envelope.route(feed, [SPEC, inner])
    assert rows(out, "topic") == [("cdc-readings",)]


def test_snapshot_comes_before_changes(spark):
    snapshot = spark.createDataFrame([(1,)], "id int")
    changes = spark.createDataFrame([(1, "UPDATE")], "id int, _operation string")
    out = envelope.full_load_then_changes(snapshot, changes)
    assert rows(out, "_phase", "_operation") == [(0, "INSERT"), (1, "UPDATE")]
