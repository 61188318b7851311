import pytest
from conftest import rows
from pyspark.sql import functions as F

from cdcflow.operators import transforms as X
from cdcflow.spec import Transform


def one(spark, given, kind, ddl="v string", **params):
    df = spark.createDataFrame([(given,)], ddl)
    return X.apply_transforms(df, [Transform(kind, "v", params)]).collect()[0][0]


def test_text(spark):
    assert one(spark, "  a b ", "trim") == "a b"
    assert one(spark, "\ta ", "trim") == "\ta"
    assert one(spark, "aB", "lower") == "ab"
    assert one(spark, "aB", "upper") == "AB"
    assert one(spark, None, "upper") is None


@pytest.mark.parametrize("value, places, expected", [(2.5, 0, 3.0), (-2.5, 0, -3.0), (1.005, 2, 1.01), (1.234, None, 1.23)])
def test_round_is_half_up(spark, value, places, expected):
    params = {} if places is None else {"decimals": places}
    assert one(spark, value, "round", "v double", **params) == expected


def test_mask(spark):
    assert one(spark, "5551234", "mask_pii") == "5551****"
    assert one(spark, "5551234", "mask_pii", visible_chars=0) == "****"
    assert one(spark, "55", "mask_pii") == "55****"
    assert one(spark, None, "mask_pii") is None
    assert one(spark, "5551234", "mask_pii", visible_chars=3, keep="last") == "****234"
    assert one(spark, "5551234", "mask_pii", visible_chars=0, keep="last") == "****"
    with pytest.raises(ValueError):
        one(spark, "x", "mask_pii", keep="middle")


def test_cast_gives_null_for_bad_values(spark):
    assert one(spark, "12", "cast", target_type="integer") == 12
    assert one(spark, " 12.9 ", "cast", target_type="int") == 12
    assert one(spark, "x", "cast", target_type="int") is None
    assert one(spark, "99999999999", "cast", to_type="int") is None
    assert one(spark, 7.9, "cast", "v double", target_type="long") == 7
    assert str(one(spark, "1.239", "cast", target_type="decimal(10, 2)")) == "1.24"
    with pytest.raises(ValueError):
        one(spark, "x", "cast", target_type="blob")


def test_default_fills_only_null(spark):
    assert one(spark, None, "default_value", value="n/a") == "n/a"
    assert one(spark, "", "default_value", value="n/a") == ""
    assert one(spark, None, "default_value", "v double", value=1) == 1.0
    assert one(spark, None, "default_value", value=True) == "true"


def test_order_decides_and_ties_keep_their_place(spark):
    df = spark.createDataFrame([(" Ab ",)], "v string")
    steps = [
        Transform("upper", "w", order=9),
        Transform("rename", "v", {"new_name": "w"}, order=5),
        Transform("trim", "v"),
        Transform("mask_pii", "v", {"visible_chars": 1}),
    ]
    assert rows(X.apply_transforms(df, steps), "w") == [("A****",)]


def test_unusable_transforms_raise_or_are_skipped(spark):
    df = spark.createDataFrame([("a",)], "v string")
    for step in (Transform("nope", "v"), Transform("upper", "missing"), Transform("cast", "v"), Transform("cast", "v", {"target_type": "?"})):
        with pytest.raises(ValueError):
            X.apply_transforms(df, [step])
        assert rows(X.apply_transforms(df, [step], strict=False)) == [("a",)]


def test_custom(spark):
    X.register_transform("twice", lambda df, c, p: df.withColumn(c, F.concat(c, c)))
    assert "twice" in X.list_transforms()
    assert one(spark, "ab", "twice") == "abab"
    with pytest.raises(ValueError):
        X.register_transform("trim", lambda df, c, p: df)
