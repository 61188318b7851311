"""Batches, store and streams."""

import datetime as dt
import json
from dataclasses import replace

import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from cdcflow.operators import history as H, quarantine as Q, skew
from cdcflow.plans.batch import run_batch
from cdcflow.session import spread
from cdcflow.sources.store import Store
from cdcflow.spec import Check, ColumnSpec, Rule, TableSpec, Transform
from cdcflow.streaming.streams import start_all, start_stream, wait_for_any, write_batch

DRIVERS = TableSpec(
    name="drivers",
    columns=(ColumnSpec("id", "int", nullable=False), ColumnSpec("phone", "string"), ColumnSpec("score", "double")),
    primary_key=("id",),
    rules=(Rule("drv_score", "range", "score", {"min": 0, "max": 10}),),
    transforms=(Transform("mask_pii", "phone", {"visible_chars": 2}),),
    checks=(Check("completeness", "phone", 0.9), Check("size", threshold=1)),
)
ALERTS = TableSpec("alerts", (ColumnSpec("id", "int"), ColumnSpec("kind", "string")), ("id",))
INTERNAL = TableSpec("dq_metrics", (ColumnSpec("metric_name", "string"),), internal=True)
OUTPUT = ["id", "phone", "score", "_operation", "_effective_from", "_effective_to", "_is_current"]


def message(op, when, table="drivers", **data):
    header = {"timestamp": when.isoformat(sep=" "), "operation": op, "schema-name": "public", "table-name": table}
    return json.dumps({"data": data, "metadata": header})


def frame(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


LOAD = [
    message("load", at(0), id=1, phone="5551", score=5.0),
    message("load", at(0), id=2, phone=None, score=5.0),
    message("load", at(0), id=3, phone="5553", score=50.0),
    message("load", at(0), id=None, phone="5550", score=1.0),
    message("heartbeat", at(0), id=1, phone="9999", score=1.0),
    "garbage",
]
CHANGES = [
    message("update", at(1), id=1, phone="6661", score=6.0),
    message("update", at(2), id=1, phone="7771", score=7.0),
    message("delete", at(2), id=2),
    message("update", at(2), id=4, phone="8884", score=1.0),
]
AFTER = [
    (1, "55****", 5.0, "INSERT", at(0), at(2), False),
    (1, "77****", 7.0, "UPDATE", at(2), None, True),
    (2, None, 5.0, "INSERT", at(0), at(2), False),
    (4, "88****", 1.0, "UPDATE", at(2), None, True),
]


def test_run_batch(spark):
    first = run_batch(DRIVERS, frame(spark, *LOAD), 0, at(10))
    assert rows(first.quarantined, "id", "_failed_rule", "batch_id") == [(3, "drv_score", 0), (None, "primary_key", 0)]
    assert rows(first.metrics, "metric_name", "metric_value") == [("Completeness", 0.8), ("Size", 5.0)]
    facts = first.summary.collect()[0]
    assert (facts.total_rows, facts.quarantined_count, facts.failed_rules) == (5, 2, ["drv_score", "primary_key"])
    second = run_batch(DRIVERS, frame(spark, *CHANGES), 1, at(11), target=first.history)
    assert rows(second.history, *OUTPUT) == AFTER
    assert {r[0] for r in rows(second.history, "_ingested_at")} == {at(10), at(11)}


def test_intermediate_changes_can_be_kept(spark):
    first = run_batch(DRIVERS, frame(spark, *LOAD), 0, at(10))
    second = run_batch(DRIVERS, frame(spark, *CHANGES), 1, at(11), target=first.history, keep_intermediate=True)
    assert [r[1] for r in rows(second.history.filter("id = 1"), "_effective_from", "phone")] == ["55****", "66****", "77****"]


def test_unchanged_updates_can_be_skipped(spark):
    first = run_batch(DRIVERS, frame(spark, *LOAD), 0, at(10))
    same = message("update", at(3), id=1, phone="5559", score=5.0)
    other = message("update", at(3), id=2, phone="1234", score=5.0)
    options = {"target": first.history, "skip_unchanged": True}
    second = run_batch(DRIVERS, frame(spark, same, other), 1, at(11), **options)
    assert rows(second.staged, "id") == [(2,)]
    assert second.history.count() == 3


def test_batches_without_usable_rows(spark):
    for texts in ([], ["garbage", "{}"]):
        empty = run_batch(DRIVERS, frame(spark, *texts), 0, at(10))
        assert empty.history.count() == empty.quarantined.count() == empty.summary.count() == 0
        assert rows(empty.metrics, "metric_name", "metric_value", "passed") == [("Size", 0.0, False)]
        counts = empty.counts.first()
        assert (counts.messages, counts.malformed_count, counts.total_rows, counts.staged_count) == (len(texts), len(texts), 0, 0)
        assert counts.failed_rules == []


def test_first_batch_without_inserts(spark):
    only_update = frame(spark, CHANGES[0])
    assert run_batch(DRIVERS, only_update, 0, at(1)).history.count() == 1
    assert run_batch(DRIVERS, only_update, 0, at(1), initial="insert_only").history.count() == 0


@pytest.mark.parametrize("compact", [False, True])
def test_store(spark, tmp_path, compact):
    store = Store(spark, str(tmp_path))
    assert store.history(DRIVERS) is None and store.current(DRIVERS) is None and store.quarantine(DRIVERS) is None
    assert store.compact(DRIVERS) == -1
    write_batch(DRIVERS, frame(spark, *LOAD), 0, store, now=at(10))
    if compact:
        assert store.compact(DRIVERS) == 0
        assert store.compact(DRIVERS) == 0
    write_batch(DRIVERS, frame(spark, *CHANGES), 1, store, now=at(11))
    assert rows(store.history(DRIVERS), *OUTPUT) == AFTER
    if compact:
        assert store.compact(DRIVERS) == 1
        assert rows(store.history(DRIVERS), *OUTPUT) == AFTER
    assert rows(store.current(DRIVERS), "id") == [(1,), (4,)]
    assert rows(store.metrics(), "batch_id", "metric_name") == [
        (0, "Completeness"), (0, "Size"), (1, "Completeness"), (1, "Size")]
    assert rows(store.quarantine(DRIVERS), "id", "run_date") == [(3, "2024-01-11T00:00:00"), (None, "2024-01-11T00:00:00")]
    facts = ["batch_id", "messages", "malformed_count", "control_count", "total_rows", "quarantined_count", "unknown_count", "staged_count"]
    assert rows(store.summary(), *facts) == [(0, 6, 1, 0, 5, 2, 1, 2), (1, 4, 0, 0, 4, 0, 0, 3)]
    assert store.summary().first()["path"].endswith("/quarantine/table_name=drivers")
    assert rows(Q.by_rule(store.quarantine_facts()), "table_name", "_failed_rule", "rows") == [
        ("drivers", "drv_score", 1), ("drivers", "primary_key", 1)]
    kinds = {f.name: f.dataType.simpleString() for f in store.history(DRIVERS).schema}
    assert kinds["_is_current"] == "boolean" and kinds["_effective_to"] == "timestamp"


def test_writing_a_batch_again_replaces_its_own_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for now in (at(10), at(12)):
        write_batch(DRIVERS, frame(spark, *LOAD), 0, store, now=now)
    write_batch(DRIVERS, frame(spark, *CHANGES), 1, store, now=at(13))
    before = rows(store.history(DRIVERS))
    write_batch(DRIVERS, frame(spark, *CHANGES), 1, store, now=at(14))
    assert rows(store.history(DRIVERS)) == before
    assert store.quarantine(DRIVERS).count() == 2 and store.metrics().count() == 4 and store.summary().count() == 2
    assert store.batch_time("drivers", 0) == at(10)


def test_compaction_leaves_closed_versions_where_they_are(spark, tmp_path):
    store, plain = Store(spark, f"{tmp_path}/a"), Store(spark, f"{tmp_path}/b")
    folder = tmp_path / "a" / "drivers" / "base"

    def closed_files(version):
        return len(list((folder / f"version={version}" / "_is_current=false").glob("*.parquet")))

    batches = [
        LOAD,
        CHANGES,
        [message("update", at(5), id=1, phone="9991", score=1.0), message("insert", at(5), id=7, phone="7", score=1.0)],
        [message("delete", at(6), id=7)],
        [message("update", at(1), id=1, phone="late", score=2.0)],
        [message("update", at(9), id=4, phone="4444", score=2.0)],
    ]
    for number, texts in enumerate(batches):
        staged = run_batch(DRIVERS, frame(spark, *texts), number, at(10 + number)).staged
        for target in (store, plain):
            target.write_changes(DRIVERS, number, staged)
        assert store.compact(DRIVERS) == number
        chain = [r["version"] for r in store._chain(DRIVERS)]
        # The late change of batch 4 starts a new whole base.
        assert chain == (list(range(number + 1)) if number < 4 else list(range(4, number + 1)))
        if number >= 3:
            assert rows(store.base(DRIVERS), *OUTPUT) == rows(plain.history(DRIVERS), *OUTPUT)
    assert closed_files(0) == 0 and closed_files(1) > 0 and closed_files(3) > 0
    assert plain.base(DRIVERS) is None


def test_the_marker_chain_is_bounded(spark, tmp_path):
    store, plain = Store(spark, f"{tmp_path}/a", chain=2), Store(spark, f"{tmp_path}/b")
    for number in range(5):
        staged = run_batch(DRIVERS, frame(spark, message("update", at(number), id=1, phone=f"{number}", score=1.0)), number, at(10)).staged
        for target in (store, plain):
            target.write_changes(DRIVERS, number, staged)
        store.compact(DRIVERS)
        assert len(store._chain(DRIVERS)) <= 2
    assert rows(store.history(DRIVERS), *OUTPUT) == rows(plain.history(DRIVERS), *OUTPUT)


def test_current_reads_no_closed_folder_for_changes_in_order(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for number, texts in enumerate((LOAD, CHANGES, [message("update", at(9), id=4, phone="4444", score=2.0)])):
        write_batch(DRIVERS, frame(spark, *texts), number, store, now=at(10 + number))
        if number < 2:
            store.compact(DRIVERS)
    current = store.current(DRIVERS)
    assert rows(current, "id", "phone") == [(1, "77****"), (4, "44****")]
    plan = current._jdf.queryExecution().executedPlan().toString()
    filters = [line.split("PartitionFilters: [")[1].split("]")[0] for line in plan.split("\n") if "FileScan" in line]
    of_base = [f for f in filters if "version" in f]
    assert of_base and all("_is_current" in f for f in of_base), plan
    # A late change has to meet the closed versions again.
    write_batch(DRIVERS, frame(spark, message("update", at(1), id=4, phone="1111", score=2.0)), 3, store, now=at(20))
    assert rows(store.current(DRIVERS), "id", "phone") == [(1, "77****"), (4, "44****")]
    of_4 = store.history(DRIVERS).filter("id = 4").orderBy("_effective_from").collect()
    assert [r["phone"] for r in of_4] == ["11****", "88****", "44****"]


@pytest.mark.parametrize("compact", [False, True])
def test_a_delete_before_its_version_is_remembered(spark, tmp_path, compact):
    store = Store(spark, str(tmp_path))
    late = [message("insert", at(0), id=5, phone="5", score=1.0), message("update", at(1), id=6, phone="6", score=1.0)]
    for number, texts in enumerate(([message("delete", at(3), id=5), message("delete", at(4), id=6)], late)):
        write_batch(DRIVERS, frame(spark, *texts), number, store, now=at(10 + number))
        if compact:
            store.compact(DRIVERS)
    assert rows(store.history(DRIVERS), "id", "_effective_from", "_effective_to") == [(5, at(0), at(3)), (6, at(1), at(4))]
    assert store.current(DRIVERS).count() == 0


def test_a_column_that_joins_later(spark, tmp_path):
    from dataclasses import replace

    store = Store(spark, str(tmp_path))
    wider = replace(DRIVERS, columns=(*DRIVERS.columns, ColumnSpec("town", "string")))
    write_batch(DRIVERS, frame(spark, *LOAD), 0, store, now=at(10))
    store.compact(DRIVERS)
    write_batch(wider, frame(spark, message("update", at(2), id=1, phone="1", score=9.0, town="x"), message("update", at(2), id=2, score=99.0, town="y")), 1, store, now=at(11))
    for _ in range(2):
        assert rows(store.history(wider), "id", "town") == [(1, "x"), (1, None), (2, None)]
        store.compact(wider)
    assert rows(store.quarantine(wider), "id", "town") == [(2, "y"), (3, None), (None, None)]


def test_an_unfinished_base_is_not_read(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    write_batch(DRIVERS, frame(spark, *LOAD), 0, store, now=at(10))
    store.history(DRIVERS).limit(1).write.parquet(f"{tmp_path}/drivers/base/version=0")
    assert store.base_version(DRIVERS) == -1
    assert store.history(DRIVERS).count() == 2


def source(spark, folder):
    return lambda spec: spark.readStream.text(f"{folder}/{spec.name}")


def feed(folder, name, part, *texts):
    target = folder / name
    target.mkdir(parents=True, exist_ok=True)
    (target / f"{part}.json").write_text("\n".join(texts) + "\n")


def test_two_tables_with_restart(spark, tmp_path):
    messages, store = tmp_path / "in", Store(spark, f"{tmp_path}/store")
    feed(messages, "drivers", 0, *LOAD)
    feed(messages, "alerts", 0, message("insert", at(0), "alerts", id=1, kind="speeding"))

    def run():
        queries = start_all(
            [DRIVERS, INTERNAL, ALERTS], source(spark, messages), store, f"{tmp_path}/checkpoints",
            trigger={"availableNow": True},
        )
        for query in queries:
            assert query.awaitTermination(120)
            assert query.exception() is None
        return queries

    assert [q.name for q in run()] == ["stream_drivers", "stream_alerts"]
    first = rows(store.history(DRIVERS))
    run()
    assert rows(store.history(DRIVERS)) == first
    feed(messages, "drivers", 1, *CHANGES)
    run()
    assert rows(store.history(DRIVERS), *OUTPUT) == AFTER
    assert rows(store.current(ALERTS), "id", "kind") == [(1, "speeding")]
    assert wait_for_any(spark, 1) in (True, False)


def test_one_failing_stream_does_not_stop_the_others(spark, tmp_path):
    messages, store = tmp_path / "in", Store(spark, f"{tmp_path}/store")
    feed(messages, "alerts", 0, message("insert", at(0), "alerts", id=1, kind="speeding"))

    def choose(spec):
        if spec is DRIVERS:
            raise RuntimeError("no topic")
        return source(spark, messages)(spec)

    queries = start_all([DRIVERS, ALERTS], choose, store, f"{tmp_path}/checkpoints", trigger={"availableNow": True})
    assert [q.name for q in queries] == ["stream_alerts"]
    assert queries[0].awaitTermination(120)
    assert store.history(ALERTS).count() == 1


def test_a_failed_batch_is_repeated_after_restart(spark, tmp_path, monkeypatch):
    """The first attempt dies after quarantine and metrics were written."""
    messages, store = tmp_path / "in", Store(spark, f"{tmp_path}/store")
    feed(messages, "drivers", 0, *LOAD)
    options = {"trigger": {"availableNow": True}}
    with monkeypatch.context() as patch:
        patch.setattr(Store, "write_changes", lambda *a: (_ for _ in ()).throw(RuntimeError("executor lost")))
        broken = start_stream(DRIVERS, source(spark, messages)(DRIVERS), store, f"{tmp_path}/cp", **options)
        with pytest.raises(Exception, match="executor lost"):
            broken.awaitTermination(120)
    again = start_stream(DRIVERS, source(spark, messages)(DRIVERS), store, f"{tmp_path}/cp", **options)
    assert again.awaitTermination(120)
    assert rows(store.current(DRIVERS), "id") == [(1,), (2,)]
    assert store.quarantine(DRIVERS).count() == 2 and store.metrics().count() == 2


def test_batch_time_is_fixed_by_the_first_attempt(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.batch_time("t", 0, at(1)) == at(1)
    assert store.batch_time("t", 0, at(2)) == at(1)
    assert abs((store.batch_time("t", 1) - dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).total_seconds()) < 60
    assert spark.sql("SELECT 1").select(F.lit(at(1))).first()[0] == at(1)


def test_scratch_tables_can_be_deleted(spark):
    import os

    from cdcflow import session

    kept = written_to(session.written(spark.range(3)))
    assert all(map(os.path.exists, kept))
    session.clear_scratch()
    assert not any(map(os.path.exists, kept))


def written_to(df):
    return [f.removeprefix("file://") for f in df.inputFiles()]


def test_store_needs_utc(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        with pytest.raises(ValueError):
            Store(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_replayed_load_is_decoded_once(spark, tmp_path, monkeypatch):
    from cdcflow.plans.catalog import QUERIES, runs
    from cdcflow.streaming import streams

    decoded = []

    def counting(module):
        real = module.classify
        monkeypatch.setattr(module, "classify", lambda *args, **options: decoded.append(1) or real(*args, **options))

    monkeypatch.setattr(runs, "classify", streams.classify, raising=False)
    counting(runs)
    counting(streams)
    orders = [(1, 10, "O", 6000.0, at(0), "1-URGENT"), (2, 11, "F", 4000.0, at(0), "5-LOW"), (3, 12, "P", 5000.0, at(1), None)]
    kind = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(orders, kind).write.parquet(str(tmp_path / "orders.parquet"))
    found = QUERIES["store_replayed_batch"](spark, str(tmp_path))
    assert rows(found, "replay", "history", "quarantine", "counted") == [("rules added", 2, 1, 1), ("rules dropped", 3, 0, 0)]
    assert len(decoded) == 1


@pytest.mark.parametrize("unique", [False, True])
def test_a_batch_keeps_its_messages_once(spark, tmp_path, monkeypatch, unique):
    """Built-in rules are repeated on the kept messages; what a rule joins is kept beside them."""
    spec = replace(DRIVERS, rules=(*DRIVERS.rules, *([Rule("drv_phone", "unique", "phone")] if unique else [])))
    store, kept = Store(spark, str(tmp_path)), []
    held = lambda: {i for i in spark.sparkContext._jsc.getPersistentRDDs()}
    before, real = held(), store.write_changes
    monkeypatch.setattr(store, "write_changes", lambda *args: real(*args) if not kept.append(len(held() - before)) else None)
    write_batch(spec, frame(spark, *LOAD), 0, store, now=at(10))
    assert kept == [1 + unique] and held() <= before
    facts = ["messages", "malformed_count", "control_count", "total_rows", "quarantined_count", "unknown_count", "staged_count", "failed_rules"]
    assert rows(store.summary(), *facts) == [(6, 1, 0, 5, 2, 1, 2, ["drv_score", "primary_key"])]
    assert rows(store.quarantine(spec), "id", "_failed_rule") == [(3, "drv_score"), (None, "primary_key")]


def test_quarantine_and_counts_come_from_one_read(spark, tmp_path, monkeypatch):
    store, plans = Store(spark, str(tmp_path)), []
    real = store.write_quarantine

    def seen(spec, batch_id, quarantined, when):
        plans.append(quarantined._jdf.queryExecution().executedPlan().toString())
        real(spec, batch_id, quarantined, when)

    monkeypatch.setattr(store, "write_quarantine", seen)
    write_batch(DRIVERS, frame(spark, *LOAD), 0, store, now=at(10))
    assert plans[0].count("InMemoryTableScan") == 1
    assert "_kind" not in store.quarantine(DRIVERS).columns
    facts = ["messages", "malformed_count", "control_count", "total_rows", "quarantined_count", "unknown_count"]
    assert rows(store.summary(), *facts) == [(6, 1, 0, 5, 2, 1)]


def test_rows_of_a_file_with_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    """Such a file has many splits by its size, but one of them gets all rows."""
    path = str(tmp_path / "orders.parquet")
    spark.range(50_000).selectExpr("id", "uuid() AS text").coalesce(1).write.parquet(path)
    sizes = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        source = spark.read.parquet(path)
        held = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert source.rdd.getNumPartitions() > 8 and held(source) == [50_000]
        for kept in (False, True):
            dealt = spread(source, kept=kept)
            assert max(held(dealt)) <= 1.5 * 50_000 / 4
            assert dealt.count() == 50_000 and dealt.exceptAll(source).count() == 0
        assert spread(dealt) is dealt
        assert spread(source.filter("id < 0")).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("large", [False, True])
def test_the_store_knows_how_many_rows_a_key_may_have(spark, tmp_path, monkeypatch, large):
    """Windows and samples for hot keys go where each batch brought one change a key; other batches keep them."""
    wide, depths = Store(spark, f"{tmp_path}/a"), []
    real = H.apply_changes
    monkeypatch.setattr(H, "apply_changes", lambda *args, **options: depths.append(options["deepest"]) or real(*args, **options))
    monkeypatch.setattr(skew.HotKeys, "possible", lambda *frames: large)
    monkeypatch.setattr(H, "LARGE", -1)
    write_batch(DRIVERS, frame(spark, *LOAD), 0, wide, now=at(10))
    assert wide.compact(DRIVERS) == 0 and [r["deepest"] for r in wide._chain(DRIVERS)] == [1]
    write_batch(DRIVERS, frame(spark, *CHANGES), 1, wide, now=at(11))
    assert rows(wide.history(DRIVERS), *OUTPUT) == AFTER
    assert depths == [1, 2 if large else None]
    assert wide.changes(DRIVERS).columns == [*wide.base(DRIVERS).columns, "batch_id"]
    # Of another key the changes tell nothing: two rows of one score and instant are one version.
    other, by_score = Store(spark, f"{tmp_path}/b"), replace(DRIVERS, primary_key=("score",))
    write_batch(DRIVERS, frame(spark, *LOAD), 0, other, now=at(10))
    assert other.history(DRIVERS).count() == 2 and other.history(by_score).count() == 1
    assert depths[2:] == [1 if large else None, None]
    write_batch(DRIVERS, frame(spark, message("update", at(3), id=1, phone="1", score=1.0)), 2, wide, keep_intermediate=True, now=at(12))
    assert wide.compact(DRIVERS) == 2 and depths[-1] is None and wide._chain(DRIVERS)[-1]["deepest"] is None
    assert wide.history(DRIVERS).count() == len(AFTER) + 1


def test_intermediate_changes_of_a_first_batch_are_versions_of_one_key(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    twice = [message("load", at(0), id=1, phone="5551", score=5.0), message("update", at(1), id=1, phone="6661", score=6.0)]
    write_batch(DRIVERS, frame(spark, *twice), 0, store, keep_intermediate=True, now=at(10))
    store.compact(DRIVERS)
    assert rows(store.history(DRIVERS), "_effective_from", "_effective_to") == [(at(0), at(1)), (at(1), None)]
