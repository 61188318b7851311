import datetime as dt

import pytest
from pyspark.sql import types as T

from cdcflow.sources.kafka import kafka_options, messages_of
from cdcflow.spec import ColumnSpec, TableSpec, parse_type, streamed


@pytest.mark.parametrize(
    "text, expected",
    [
        ("VARCHAR", T.StringType()),
        ("text", T.StringType()),
        ("int", T.IntegerType()),
        ("bigint", T.LongType()),
        ("real", T.DoubleType()),
        ("timestamp", T.TimestampType()),
        ("date", T.DateType()),
        ("Boolean", T.BooleanType()),
        ("decimal(12,4)", T.DecimalType(12, 4)),
        ("decimal( 10, 4 )", T.DecimalType(10, 4)),
        ("decimal", T.DecimalType(10, 2)),
    ],
)
def test_types(text, expected):
    assert parse_type(text) == expected


@pytest.mark.parametrize("text", ["blob", "decimal(10)", "decimal(a,b)", ""])
def test_unknown_type_raises(text):
    with pytest.raises(ValueError):
        parse_type(text)


def conf(**extra):
    base = {
        "name": "berths",
        "primary_key": "berth_no",
        "schema": [
            {"name": "berth_no", "type": "bigint"},
            {"name": "quay", "type": "varchar", "unique": True},
            {"name": "depth_m", "type": "decimal(5,2)", "nullable": False, "default": 4},
            {"name": "free_from", "type": "date"},
        ],
    }
    return base | extra


def test_from_dict():
    spec = TableSpec.from_dict(
        conf(
            dq_rules=[
                {"id": "r1", "type": "range", "column": "depth_m", "params": {"min": 0}, "severity": "warning"},
                {"id": "r2", "type": "range"},
                {"column": "depth_m"},
            ],
            transforms=[{"id": "t1", "type": "round", "column": "depth_m", "order": 3}, {"type": "trim"}],
            metric_checks=[{"metric": "size", "threshold": 1}],
            health_checks={"url": "http://h"},
            smoke_checks=["ping", {"path": "/"}],
            foreign_keys=[{"column": "quay", "references": {"table": "quays", "column": "code"}}],
            indexes=[{"columns": ["quay", "free_from"], "unique": True}, {"columns": ["depth_m"]}],
        )
    )
    assert spec.topic == "cdc-berths"
    assert spec.primary_key == ("berth_no",)
    assert [r.id for r in spec.rules] == ["r1"]
    assert [t.order for t in spec.transforms] == [3]
    assert spec.checks[0].threshold == 1
    assert spec.foreign_keys[0].ref_column == "code"
    assert spec.unique_keys == (("quay", "free_from"),)
    assert spec.schema.names == ["berth_no", "quay", "depth_m", "free_from"]
    assert [f.nullable for f in spec.schema] == [True, True, False, True]


def test_internal_tables_have_no_stream():
    inner = TableSpec.from_dict({"name": "dq_metrics", "internal": True, "primary_key": None, "schema": []})
    outer = TableSpec.from_dict(conf(topic="t1"))
    assert streamed([inner, outer]) == [outer]
    assert outer.topic == "t1"


@pytest.mark.parametrize(
    "change",
    [{"primary_key": "nope"}, {"primary_key": None}, {"schema": [{"name": "id", "type": "int"}] * 2}],
)
def test_bad_specs_raise(change):
    with pytest.raises(ValueError):
        TableSpec.from_dict(conf() | change)


def test_names_topics_and_rule_ids_must_differ():
    spec = TableSpec.from_dict(conf())
    with pytest.raises(ValueError):
        streamed([spec, spec])
    with pytest.raises(ValueError):
        streamed([spec, TableSpec.from_dict(conf(name="other", topic="cdc-berths"))])
    twice = [{"id": "r", "type": "not_null", "column": "quay"}] * 2
    with pytest.raises(ValueError):
        TableSpec.from_dict(conf(dq_rules=twice))
    unnamed = [{"type": "not_null", "column": "quay"}] * 2
    assert [r.id for r in TableSpec.from_dict(conf(dq_rules=unnamed)).rules] == ["unknown"] * 2


def test_specs_are_values():
    assert ColumnSpec("a", "int") == ColumnSpec("a", "int")


def test_kafka_options():
    options = kafka_options("b1:9096", "cdc-orders", username="u", password="p")
    assert options["subscribe"] == "cdc-orders"
    assert options["startingOffsets"] == "earliest"
    assert options["failOnDataLoss"] == "false"
    assert 'username="u"' in options["kafka.sasl.jaas.config"]
    assert "kafka.sasl.jaas.config" not in kafka_options("b1:9092", "t")


def test_what_a_change_needs_of_a_message(spark):
    """The stream's plan on a frame of the source's shape; the package itself is not at hand here."""
    kind = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int"
    row = (bytearray(b"k"), bytearray(b"{}"), "t", 3, 7, dt.datetime(2024, 1, 1), 0)
    found = messages_of(spark.createDataFrame([row], kind))
    assert tuple(found.first()) == ("k", "{}", "t", 3, 7, dt.datetime(2024, 1, 1))
    assert found.columns == ["key", "value", "topic", "partition", "offset", "message_time"]
