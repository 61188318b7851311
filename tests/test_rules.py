import math

import pytest
from conftest import at, rows
from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from cdcflow.operators import quarantine as Q, rules as R
from cdcflow.spec import Rule


def failed_ids(df, *rules, **options):
    tagged = R.tag_failures(df, rules, **options)
    return [r[0] for r in rows(tagged.filter(F.col("_failed_rule").isNotNull()), "id")]


@pytest.fixture(scope="module")
def numbers(spark):
    values = [(1, -90.0), (2, 90.0), (3, 90.1), (4, -91.0), (5, None), (6, math.nan), (7, 0.0)]
    return spark.createDataFrame(values, "id int, v double")


def test_range_is_inclusive_and_fails_null_and_nan(numbers):
    assert failed_ids(numbers, Rule("r", "range", "v", {"min": -90, "max": 90})) == [3, 4, 5, 6]


def test_range_with_min_only_lets_nan_pass(numbers):
    assert failed_ids(numbers, Rule("r", "range", "v", {"min": -90})) == [4, 5]


def test_range_on_text_judges_its_number(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, "50")], "id int, v string")
    assert failed_ids(df, Rule("r", "range", "v", {"max": 10})) == [2, 3]


@pytest.fixture(scope="module")
def words(spark):
    values = [(1, "delivered"), (2, "lost"), (3, None), (4, "delivered"), (5, None), (6, "")]
    return spark.createDataFrame(values, "id int, s string")


def test_allowed_values_and_null_choice(words):
    rule = Rule("r", "allowed_values", "s", {"values": ["delivered"]})
    assert failed_ids(words, rule) == [2, 3, 5, 6]
    assert failed_ids(words, Rule("r", "allowed_values", "s", rule.params, on_null="pass")) == [2, 6]
    assert failed_ids(words, Rule("r", "allowed_values", "s", {"values": []})) == []


def test_allowed_values_of_another_type(numbers):
    assert failed_ids(numbers, Rule("r", "allowed_values", "v", {"values": ["90", 0]})) == [1, 3, 4, 5, 6]


@pytest.mark.parametrize("on_null, failed", [("fail", [2, 3]), ("pass", [2])])
def test_on_null_is_about_the_column_alone(spark, on_null, failed):
    df = spark.createDataFrame([(1, 1), (2, 5), (3, None)], "id int, v int")
    assert failed_ids(df, Rule("r", "allowed_values", "v", {"values": [1, "7"]}, on_null=on_null)) == failed


@pytest.mark.parametrize(
    "rule",
    [
        Rule("r", "allowed_values", "v", {"values": ["1", "x"]}), Rule("r", "allowed_values", "v", {"values": [1.5]}),
        Rule("r", "range", "v", {"max": "abc"}), Rule("r", "length", "v", {"min": "x"}),
    ],
)
def test_parameters_that_no_value_can_meet(spark, rule):
    df = spark.createDataFrame([(1, 5)], "id int, v int")
    with pytest.raises(ValueError):
        R.tag_failures(df, [rule])
    assert failed_ids(df, rule, strict=False) == []


def test_unique_on_columns_with_any_name(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (2, 1, 2, 2), (3, 2, 2, 3)], "id int, _value int, _hit int, _repeated int")
    rules = [Rule(f"u{c}", "unique", c) for c in ("_value", "_hit", "_repeated")]
    assert rows(R.tag_failures(df, rules), "id", "_failed_rule") == [(1, "u_value"), (2, "u_value"), (3, None)]


def test_cost_of_unique_rules_is_linear(spark):
    df = spark.range(100).selectExpr("id", "id % 50 AS a", "id % 30 AS b", "id % 20 AS c", "id % 10 AS d")
    joins = []
    for n in (1, 2, 3, 4):
        tagged = R.tag_failures(df, [Rule(f"u{c}", "unique", c) for c in "abcd"[:n]])
        joins.append(tagged._jdf.queryExecution().optimizedPlan().toString().count("Join "))
    assert max(joins) == 1


def test_regex_finds_anywhere(words):
    assert failed_ids(words, Rule("r", "regex", "s", {"pattern": "liv"})) == [2, 3, 5, 6]
    assert failed_ids(words, Rule("r", "regex", "s", {})) == [3, 5]


def test_record_number_pattern(spark):
    bad = ["MRN123456", "mrn-123456", "MRN-12345", "MRN-1234567", "PATIENT-000001", "123456", ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*bad, "MRN-000001"])], "id int, s string")
    assert failed_ids(df, Rule("pat_001", "regex", "s", {"pattern": r"^MRN-\d{6}$"})) == list(range(len(bad)))


def test_not_null_and_length(words):
    assert failed_ids(words, Rule("r", "not_null", "s")) == [3, 5]
    assert failed_ids(words, Rule("r", "length", "s", {"min": 1, "max": 4})) == [1, 3, 4, 5, 6]


def test_unique_fails_every_member_and_treats_nulls_as_one_group(words):
    assert failed_ids(words, Rule("r", "unique", "s")) == [1, 3, 4, 5]


def test_unique_counts_only_rows_still_valid(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", -1), (3, "b", 1), (4, "b", 1)], "id int, s string, v int")
    first, second = Rule("r1", "range", "v", {"min": 0}), Rule("r2", "unique", "s")
    tagged = R.tag_failures(df, [first, second])
    assert rows(tagged, "id", "_failed_rule") == [(1, None), (2, "r1"), (3, "r2"), (4, "r2")]
    assert failed_ids(df, second, first) == [1, 2, 3, 4]


def test_only_first_failure_is_kept(spark):
    df = spark.createDataFrame([(1, 200.0, 400.0)], "id int, lat double, speed double")
    sequence = [Rule("tel_001", "range", "lat", {"max": 90}), Rule("tel_003", "range", "speed", {"max": 350})]
    assert rows(R.tag_failures(df, sequence), "_failed_rule") == [("tel_001",)]


def test_warnings_remove_nothing(words):
    sequence = [
        Rule("w1", "not_null", "s", severity="warning"),
        Rule("e1", "allowed_values", "s", {"values": ["delivered", "lost", ""]}),
        Rule("w2", "length", "s", {"min": 5}, severity="warning"),
    ]
    tagged = R.tag_failures(words, sequence)
    assert rows(tagged, "id", "_failed_rule", "_warned_rules") == [
        (1, None, []), (2, None, ["w2"]), (3, "e1", ["w1"]), (4, None, []), (5, "e1", ["w1"]), (6, None, ["w2"])]


def test_deletes_are_not_judged_by_default(spark):
    df = spark.createDataFrame([(1, None, "DELETE"), (2, None, "UPDATE"), (3, None, None)], "id int, v int, _operation string")
    rule = Rule("r", "not_null", "v")
    assert failed_ids(df, rule) == [2, 3]
    assert failed_ids(df, rule, apply_to_deletes=True) == [1, 2, 3]
    assert failed_ids(df, Rule("r", "not_null", "v", deletes=True)) == [1, 2, 3]


def test_custom_rules(words):
    R.register_rule("starts", lambda c, p: c.startswith(p["text"]))
    R.register_rule("starts", lambda c, p: c.startswith(p["text"]))
    assert "starts" in R.list_rules()
    assert failed_ids(words, Rule("r", "starts", "s", {"text": "d"})) == [2, 3, 5, 6]
    with pytest.raises(ValueError):
        R.register_rule("range", lambda c, p: c.isNull())
    with pytest.raises(ValueError):
        R.register_rule("unique", lambda c, p: c.isNull())


def test_unusable_rules_raise_or_are_skipped(words):
    for rule in (Rule("r", "no_such", "s"), Rule("r", "not_null", "nope")):
        with pytest.raises(ValueError):
            R.tag_failures(words, [rule])
        assert failed_ids(words, rule, strict=False) == []


def test_no_rules_and_no_rows(words):
    assert failed_ids(words) == []
    assert failed_ids(words.limit(0), Rule("r", "unique", "s"), Rule("q", "not_null", "s")) == []


def test_split_and_summary(words):
    sequence = [Rule("a", "not_null", "s"), Rule("b", "length", "s", {"min": 1}), Rule("w", "unique", "s", severity="warning")]
    tagged = R.tag_failures(words, sequence)
    valid, failed = R.split(tagged)
    assert valid.columns == words.columns and "_failed_rule" in failed.columns
    assert rows(R.rule_summary(words, sequence), "rule_id", "evaluated", "failed", "pass_rate") == [
        ("a", 6, 2, 4 / 6), ("b", 4, 1, 0.75), ("w", 3, 2, 1 / 3)]


def test_quarantine_frame_and_summary(words):
    tagged = R.tag_failures(words, [Rule("b", "length", "s", {"min": 1}), Rule("a", "regex", "s", {"pattern": "d"})])
    moment = F.lit(at(0, 13))
    frame = Q.quarantine_frame(tagged, "words", 4, moment)
    assert rows(frame, "id", "run_date", "table_name", "batch_id")[0] == (2, "2024-01-01T13:00:00", "words", 4)
    facts = Q.summary(tagged, "words", 4, moment).collect()[0]
    assert (facts.total_rows, facts.quarantined_count, facts.failed_rules) == (6, 4, ["a", "b"])
    assert Q.summary(tagged.filter("id = 1"), "words", 4, moment).count() == 0
    assert rows(Q.by_rule(frame), "_failed_rule", "rows") == [("a", 1), ("b", 3)]


def test_quarantine_of_different_tables_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, only_a string")
    b = spark.createDataFrame([(2, 5.0)], "id int, only_b double")
    assert rows(Q.union_tables(a, b), "id", "only_a", "only_b") == [(1, "x", None), (2, None, 5.0)]


values = st.one_of(st.none(), st.integers(-3, 3))


@settings(
    max_examples=12, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.tuples(values, values, st.sampled_from(["INSERT", "DELETE"])), max_size=30))
def test_every_row_is_valid_or_quarantined_and_agrees_with_a_loop(spark, data):
    """Rows judged one rule after the other in plain Python."""
    table = [(i, *row) for i, row in enumerate(data)]
    df = spark.createDataFrame(table, "id int, a int, b int, _operation string")
    tagged = R.tag_failures(
        df, [Rule("r1", "range", "a", {"min": -2}), Rule("r2", "unique", "b"), Rule("r3", "allowed_values", "a", {"values": [0, 1]})]
    )
    alive, expected = list(table), {}

    def keep(rule, good):
        nonlocal alive
        expected.update({r[0]: rule for r in alive if r[3] != "DELETE" and not good(r)})
        alive = [r for r in alive if r[0] not in expected]

    keep("r1", lambda r: r[1] is not None and r[1] >= -2)
    judged = [r[2] for r in alive if r[3] != "DELETE"]
    keep("r2", lambda r: judged.count(r[2]) == 1)
    keep("r3", lambda r: r[1] in (0, 1))
    assert {r.id: r._failed_rule for r in tagged.collect()} == {r[0]: expected.get(r[0]) for r in table}
