import pytest
from conftest import at, rows
from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from cdcflow.operators import history as H, skew

DDL = "id int, v int, _operation string, t timestamp_ntz, seq int"
# Every key with more than three rows is hot, and every row is looked at.
TINY = skew.HotKeys(rows=3)


def log(spark, *changes):
    data = [(k, v, op, at(0, 0) if t is None else at(t), i) for i, (k, v, op, t) in enumerate(changes)]
    return spark.createDataFrame(data, DDL)


def staged(spark, *changes):
    frame = log(spark, *changes)
    return H.add_version_columns(frame, F.col("t"))


def versions(history):
    """(key, value, first day, last day) of each version."""
    return [
        (r.id, r.v, (r._effective_from - at(0)).days, r._effective_to and (r._effective_to - at(0)).days)
        for r in sorted(history.collect(), key=lambda r: (r.id, r._effective_from))
    ]


def check_invariants(history):
    assert history.filter("_is_current <> (_effective_to IS NULL)").count() == 0
    assert history.filter("_effective_to <= _effective_from").count() == 0
    assert H.current(history).groupBy("id").count().filter("count > 1").count() == 0
    pairs = history.alias("a").join(history.alias("b"), "id").filter(
        "a._effective_from < b._effective_from AND coalesce(a._effective_to > b._effective_from, true)"
    )
    assert pairs.count() == 0


def test_latest_per_key_follows_the_ordering(spark):
    df = log(spark, (1, 1, "UPDATE", 1), (1, 2, "UPDATE", 3), (1, 3, "UPDATE", 2), (2, 9, "UPDATE", 0))
    assert rows(H.latest_per_key(df, ["id"], ["t", "seq"]), "id", "v") == [(1, 2), (2, 9)]
    same = log(spark, (1, 1, "UPDATE", 1), (1, 2, "UPDATE", 1))
    assert rows(H.latest_per_key(same, ["id"], ["t", "seq"]), "v") == [(2,)]


def test_latest_per_key_prunes_before_the_shuffle(spark):
    df = log(spark, (1, 1, "UPDATE", 1))
    plan = H.latest_per_key(df, ["id"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_unknown_operations_cannot_displace_a_change(spark):
    df = log(spark, (1, 1, "INSERT", 1), (1, 2, "UNKNOWN", 2))
    assert versions(H.from_changelog(df, ["id"], ["t", "seq"])) == [(1, 1, 1, None)]


def test_changelog(spark):
    df = log(
        spark,
        (1, 1, "INSERT", 0), (1, 2, "UPDATE", 3), (1, None, "DELETE", 5), (1, 3, "INSERT", 8),
        (2, 1, "UPDATE", 2), (3, None, "DELETE", 1), (4, 1, "INSERT", 1), (4, 2, "INSERT", 1),
    )
    history = H.from_changelog(df, ["id"], ["t", "seq"])
    assert versions(history) == [(1, 1, 0, 3), (1, 2, 3, 5), (1, 3, 8, None), (2, 1, 2, None), (4, 2, 1, None)]
    check_invariants(history)


def test_merge(spark):
    first = H.apply_changes(None, staged(spark, (1, 1, "INSERT", 0), (2, 1, "INSERT", 0), (9, 1, "UPDATE", 0)), ["id"])
    second = staged(spark, (1, 2, "UPDATE", 2), (2, None, "DELETE", 2), (3, 1, "UPDATE", 2), (4, None, "DELETE", 2), (5, 1, "UNKNOWN", 2))
    history = H.apply_changes(first, second, ["id"])
    assert versions(history) == [(1, 1, 0, 2), (1, 2, 2, None), (2, 1, 0, 2), (3, 1, 2, None), (9, 1, 0, None)]
    check_invariants(history)
    reinserted = H.apply_changes(history, staged(spark, (1, 7, "INSERT", 4), (2, 7, "INSERT", 4)), ["id"])
    assert versions(reinserted)[:4] == [(1, 1, 0, 2), (1, 2, 2, 4), (1, 7, 4, None), (2, 1, 0, 2)]
    check_invariants(reinserted)


def test_first_batch_may_take_inserts_only(spark):
    batch = staged(spark, (1, 1, "INSERT", 0), (2, 1, "UPDATE", 0))
    assert versions(H.apply_changes(None, batch, ["id"], initial="insert_only")) == [(1, 1, 0, None)]


def test_late_changes_are_placed_between_versions(spark):
    base = H.from_changelog(
        log(spark, (1, 1, "INSERT", 2), (1, 2, "UPDATE", 6), (1, None, "DELETE", 8), (1, 3, "INSERT", 12)), ["id"], ["t", "seq"]
    ).select("id", "v", "_operation", "t", "seq", *H.VERSION_COLUMNS)
    apply = lambda *c: versions(H.apply_changes(base, staged(spark, *c), ["id"]))
    assert apply((1, 9, "UPDATE", 4)) == [(1, 1, 2, 4), (1, 9, 4, 6), (1, 2, 6, 8), (1, 3, 12, None)]
    assert apply((1, 9, "UPDATE", 0)) == [(1, 9, 0, 2), (1, 1, 2, 6), (1, 2, 6, 8), (1, 3, 12, None)]
    assert apply((1, 9, "UPDATE", 10)) == [(1, 1, 2, 6), (1, 2, 6, 8), (1, 9, 10, 12), (1, 3, 12, None)]
    assert apply((1, None, "DELETE", 7)) == [(1, 1, 2, 6), (1, 2, 6, 7), (1, 3, 12, None)]
    assert apply((1, 9, "UPDATE", 15)) == [(1, 1, 2, 6), (1, 2, 6, 8), (1, 3, 12, 15), (1, 9, 15, None)]


def test_replay_changes_nothing(spark):
    first = H.apply_changes(None, staged(spark, (1, 1, "INSERT", 0), (2, 1, "INSERT", 0)), ["id"])
    second = staged(spark, (1, 2, "UPDATE", 2), (2, None, "DELETE", 3))
    once = H.apply_changes(first, second, ["id"])
    assert versions(H.apply_changes(once, second, ["id"])) == versions(once)


def test_unchanged_updates_can_be_dropped(spark):
    target = H.apply_changes(None, staged(spark, (1, 1, "INSERT", 0), (2, None, "INSERT", 0)), ["id"])
    batch = staged(spark, (1, 1, "UPDATE", 2), (2, None, "UPDATE", 2), (3, 1, "UPDATE", 2), (1, 1, "DELETE", 3))
    assert rows(H.drop_unchanged(target, batch, ["id"], ["v"]), "id", "_operation") == [(1, "DELETE"), (3, "UPDATE")]


def test_reads(spark):
    history = H.from_changelog(log(spark, (1, 1, "INSERT", 0), (1, 2, "UPDATE", 3), (2, 5, "INSERT", 2)), ["id"], ["t", "seq"])
    assert rows(H.current(history), "id", "v") == [(1, 2), (2, 5)]
    assert [r.v for r in H.timeline(history, F.col("id") == 1).collect()] == [1, 2]
    for day, expected in ((0, [(1, 1)]), (2, [(1, 1), (2, 5)]), (3, [(1, 2), (2, 5)])):
        assert rows(H.as_of(history, F.lit(at(day))), "id", "v") == expected
    assert rows(H.counts_by_state({"a": history})) == [("a", 2, 1)]
    assert rows(H.operation_counts(history)) == [("INSERT", 2), ("UPDATE", 1)]
    H.register_views(spark, "things", history)
    assert spark.sql("SELECT count(*) FROM things_current").first()[0] == 2
    assert spark.sql("SELECT count(*) FROM things_history").first()[0] == 3


def test_as_of_join(spark):
    history = H.from_changelog(log(spark, (1, 1, "INSERT", 1), (1, None, "DELETE", 3), (1, 2, "INSERT", 5)), ["id"], ["t", "seq"])
    facts = spark.createDataFrame([(n, k, None if d is None else at(d)) for n, k, d in
                                   [(0, 1, 0), (1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 9), (5, 2, 9), (6, None, 9), (7, 1, None)]],
                                  "n int, k int, at timestamp_ntz")
    for hot in (skew.DEFAULT, TINY):
        join = lambda how: H.as_of_join(facts, history, ["k"], ["id"], "at", ["v"], how=how, hot=hot)
        assert rows(join("inner"), "n", "v") == [(1, 1), (2, 1), (4, 2)]
        assert rows(join("left"), "n", "v") == [(0, None), (1, 1), (2, 1), (3, None), (4, 2), (5, None), (6, None), (7, None)]
    with pytest.raises(ValueError):
        join("outer")


def test_hot_keys_are_split_and_give_the_same_history(spark):
    """One key holds a third of all rows."""
    df = spark.range(3000).selectExpr(
        "cast(if(id % 3 = 0, 0, id) as int) AS id",
        "cast(id as int) AS v",
        "element_at(array('INSERT', 'UPDATE', 'UPDATE', 'DELETE'), cast(pmod(hash(id), 4) + 1 as int)) AS _operation",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(pmod(hash(id, 1), 5000) as int)) AS t",
        "cast(id as int) AS seq",
    )
    hot = skew.HotKeys(rows=50)
    spread = skew.with_spans(df, ["id"], ["t", "seq"], hot)
    assert spread.filter("_hot").select("id").distinct().count() == 1
    sizes = [r[0] for r in spread.filter("_hot").groupBy("_span").count().select("count").collect()]
    assert len(sizes) == 20 and max(sizes) == 50
    plain = H.from_changelog(df, ["id"], ["t", "seq"], None)
    for choice in (hot, skew.HotKeys(rows=200, depth=50)):
        split = H.from_changelog(df, ["id"], ["t", "seq"], choice)
        assert split.count() == plain.count()
        assert split.exceptAll(plain).count() == 0
    facts = spark.range(2000).selectExpr(
        "id AS n", "cast(if(id % 3 = 0, 0, id) as int) AS k",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(pmod(hash(id, 2), 6000) as int)) AS at",
    )
    keyed = (facts, plain, ["k"], ["id"], "at", ["v", "_operation"])
    joined = H.as_of_join(*keyed, hot=hot)
    brute = facts.join(
        plain, F.expr("k = id AND _effective_from <= at AND coalesce(_effective_to > at, true)")
    ).select("n", "k", "at", "v", "_operation")
    assert joined.count() == brute.count() > 0
    assert joined.exceptAll(brute).count() == 0


@pytest.mark.parametrize("shape", ["burst", "instant", "even"])
def test_no_span_holds_twice_its_rows(spark, shape):
    """One key with 100,000 rows: nearly all in two minutes of ten years, all at one instant, or evenly."""
    second = {"burst": "if(id % 100 = 0, id * 3000, 300000000 + id % 120)", "instant": "0", "even": "id"}[shape]
    df = spark.range(100_000).selectExpr("1 AS k", f"timestamp_seconds({second}) AS t", "id AS seq")
    spans = skew.with_spans(df, ["k"], ["t", "seq"], skew.HotKeys(rows=2000))
    sizes = [r[1] for r in spans.groupBy("_span").count().collect()]
    assert len(sizes) > 25 and max(sizes) <= 4000


def test_spans_are_dealt_to_tasks_of_their_own(spark):
    """Also where the join with the cut points has dealt the rows by key."""
    df = spark.range(1000).selectExpr("id % 2 AS k", "id AS t")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (
            skew.next_time(df, ["k"], ["t"], "n", skew.HotKeys(rows=100)),
            skew.neighbours(df, ["k"], ["t"], F.col("t"), skew.HotKeys(rows=100)),
            skew.last_seen(df, ["k"], ["t"], "t", "n", skew.HotKeys(rows=100)),
        ):
            plan = found._jdf.queryExecution().executedPlan().toString()
            windows = [line for line in plan.split("\n") if "Window [" in line and "_span" in line]
            assert windows and "hashpartitioning(k#" in plan and "_span#" in plan.split("hashpartitioning(k#")[1][:60]
            assert found.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_rows_without_a_key_are_never_hot(spark):
    df = spark.range(1000).selectExpr("cast(if(id % 2 = 0, null, 1) as int) AS k", "id AS t")
    spans = skew.with_spans(df, ["k"], ["t"], skew.HotKeys(rows=100))
    assert spans.filter("k IS NULL AND _span <> 0").count() == 0 and spans.filter("_hot").count() == 500
    log_ = spark.createDataFrame([(None, 1, "INSERT", at(0), 1), (None, 2, "UPDATE", at(1), 2)], "id int, v int, _operation string, t timestamp_ntz, seq int")
    assert H.from_changelog(log_, ["id"], ["t", "seq"]).count() == 0


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "int"])
def test_spans_rise_with_time(spark, kind):
    cast = "cast(id as int)" if kind == "int" else f"cast(timestamp_ntz'2023-12-20' + make_dt_interval(cast(id as int)) as {kind})"
    df = spark.range(40).selectExpr("1 AS k", f"{cast} AS t")
    spans = [r._span for r in skew.with_spans(df, ["k"], ["t"], TINY).orderBy("t").collect()]
    assert spans == sorted(spans) and len(set(spans)) > 5


change = st.tuples(
    st.integers(1, 3), st.integers(0, 9), st.sampled_from(["INSERT", "UPDATE", "DELETE", "UNKNOWN"]), st.integers(0, 40)
)


@settings(
    max_examples=8, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(change, min_size=1, max_size=25, unique_by=lambda c: (c[0], c[3])), st.integers(1, 3), st.booleans())
def test_batches_in_any_order_give_the_history_of_the_log(spark, changes, parts, use_spans):
    """Changes arrive in arbitrary batches, late writes and late deletes included."""
    hot = TINY if use_spans else None
    whole = H.from_changelog(log(spark, *changes), ["id"], ["t", "seq"], skew.DEFAULT if hot is None else hot)
    check_invariants(whole)
    history = None
    for part in range(parts):
        batch = [c for i, c in enumerate(changes) if i % parts == part]
        if batch:
            merged = H.apply_changes(history, staged(spark, *batch), ["id"], order=["seq"], hot=hot, keep_deletes=True)
            history = spark.createDataFrame(merged.collect(), merged.schema)
    assert versions(H.versions(history)) == versions(whole)


def test_unchanged_updates_are_compared_with_what_came_before(spark):
    """A value that moves between columns, one that comes back, and a late repeat of an older version."""
    kind = "id int, a string, b string, _operation string, t timestamp_ntz, seq int"

    def rows_at(*changes):
        return H.add_version_columns(spark.createDataFrame([(*c, i) for i, c in enumerate(changes)], kind), F.col("t"))

    target = H.apply_changes(None, rows_at((1, "x", None, "INSERT", at(0)), (2, "A", "", "INSERT", at(0))), ["id"])
    target = H.apply_changes(target, rows_at((2, "B", "", "UPDATE", at(10))), ["id"])
    batch = rows_at(
        (1, None, "x", "UPDATE", at(1)), (1, "x", None, "UPDATE", at(2)), (1, "x", None, "UPDATE", at(3)),
        (2, "A", "", "UPDATE", at(5)), (2, "B", "", "UPDATE", at(11)), (2, "A", "", "UPDATE", at(12)), (3, "n", "", "UPDATE", at(1)),
        (2, "A", "", "DELETE", at(13)), (2, "A", "", "UPDATE", at(14)),
    )
    for hot in (None, TINY):
        kept = H.drop_unchanged(target, batch, ["id"], ["a", "b"], ["seq"], hot)
        assert rows(kept, "seq") == [(0,), (1,), (5,), (6,), (7,), (8,)]


@pytest.mark.parametrize("hot", [None, TINY])
def test_a_delete_without_a_version_ends_what_arrives_later(spark, hot):
    history = None
    for change in ((1, None, "DELETE", 5), (1, 7, "INSERT", 2), (1, None, "DELETE", 5)):
        merged = H.apply_changes(history, staged(spark, change), ["id"], hot=hot, keep_deletes=True)
        history = spark.createDataFrame(merged.collect(), merged.schema)
        wanted = [] if change[2] == "DELETE" and change[3] == 5 and history.count() == 1 else [(7, at(2), at(5))]
        assert rows(H.versions(history), "v", "_effective_from", "_effective_to") == wanted


def test_many_cut_points_are_searched_in_two_steps(spark):
    """One key of all rows with more cut points than one array holds, adaptive execution off."""
    df = spark.range(60_000).selectExpr("1 AS k", "timestamp_seconds(pmod(hash(id), 1000)) AS t", "id AS seq")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spans = skew.with_spans(df, ["k"], ["t", "seq"], skew.HotKeys(rows=200, depth=200))
        sizes = spans.groupBy("_span").agg(F.count("*").alias("n"), F.min(F.struct("t", "seq")).alias("a"), F.max(F.struct("t", "seq")).alias("b"))
        found = sizes.orderBy("_span").collect()
        assert [r["_span"] for r in found] == list(range(300)) and {r["n"] for r in found} == {200}
        assert all(x["b"] < y["a"] for x, y in zip(found, found[1:]))
        following = skew.next_time(df, ["k"], ["t", "seq"], "n", skew.HotKeys(rows=200, depth=200))
        assert following.exceptAll(skew.next_time(df, ["k"], ["t", "seq"], "n", None)).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_cut_points_and_split_keys_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST", 10)
    df = spark.range(6_000).selectExpr("id % 20 AS k", "id AS t")
    spans = skew.with_spans(df, ["k"], ["t"], skew.HotKeys(rows=100, depth=100))
    found = spans.filter("_hot").groupBy("k").agg(F.countDistinct("_span").alias("n")).collect()
    assert len(found) <= 10 and sum(r["n"] - 1 for r in found) <= 10
    plain = skew.neighbours(df, ["k"], ["t"], F.col("t"), None)
    assert skew.neighbours(df, ["k"], ["t"], F.col("t"), skew.HotKeys(rows=100, depth=100)).exceptAll(plain).count() == 0


def test_small_frames_are_not_sampled(spark):
    df = spark.range(1000).selectExpr("id % 2 AS k", "id AS t")
    assert not skew.DEFAULT.possible(df, df) and skew.HotKeys(rows=100).possible(df)
    for hot, sampled in ((skew.DEFAULT, False), (skew.HotKeys(rows=100), True)):
        plan = skew.next_time(df, ["k"], ["t"], "n", hot)._jdf.queryExecution().optimizedPlan().toString()
        assert ("_apart" in plan) == sampled


@settings(
    max_examples=4, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(change, min_size=6, max_size=24, unique_by=lambda c: (c[0], c[3])), st.sampled_from([-1, 1 << 40]))
def test_few_rows_a_key_give_the_same_history(spark, changes, large):
    """One change a key and batch, late ones included: with the bound on rows, by one exchange and by join, and without."""
    batches: list[list] = []
    for c in changes:
        mine = next((b for b in batches if all(c[0] != x[0] for x in b)), None)
        batches.append([c]) if mine is None else mine.append(c)
    before, H.LARGE = H.LARGE, large
    try:
        history = None
        for number, batch in enumerate(batches[:4]):
            given_ = staged(spark, *batch)
            kept = lambda **bound: H.apply_changes(history, given_, ["id"], order=["seq"], keep_deletes=True, **bound)  # noqa: B023, E731
            plain = kept()
            found = rows(plain)
            assert rows(kept(hot=TINY, deepest=number + 1)) == found
            # No key has more rows than batches.
            assert all(n <= number + 1 for _, n in rows(plain.groupBy("id").count()))
            history = spark.createDataFrame(plain.collect(), plain.schema)
    finally:
        H.LARGE = before


def test_few_rows_a_key_are_neither_sampled_nor_exchanged_twice(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(H, "LARGE", -1)
    batch = staged(spark, (1, 2, "UPDATE", 1), (2, 1, "INSERT", 1))
    alone = H.apply_changes(None, batch, ["id"], hot=TINY, deepest=1)
    assert "Window" not in plan(alone) and "Exchange" not in plan(alone)
    target = spark.createDataFrame(alone.collect(), alone.schema)
    merged = H.apply_changes(target, staged(spark, (1, 3, "DELETE", 5), (2, 3, "UPDATE", 0)), ["id"], hot=TINY, deepest=2)
    assert "Join" not in plan(merged) and plan(merged).count("hashpartitioning(id") == 1 and "_apart" not in plan(merged)
    assert versions(merged) == [(1, 2, 1, 5), (2, 3, 0, 1), (2, 1, 1, None)]
