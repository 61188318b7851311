"""State that batches add to, checks against stored rows, reads that pass over what they do not need."""

import collections
import datetime as dt
import random

import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from cdcflow.operators import constraints as C, history as H, value_state as V
from cdcflow.plans.batch import run_batch
from cdcflow.session import folders_in
from cdcflow.sources.kafka import lost_offsets, next_offsets
from cdcflow.sources.store import Store
from cdcflow.spec import ColumnSpec, TableSpec
from cdcflow.streaming.streams import write_batch
from test_runs import CHANGES, DRIVERS, LOAD, frame, message


def recount(batches, column):
    """(batch, share of non-NULL values seen once) over all batches so far."""
    out, seen = [], collections.Counter()
    for number, batch in enumerate(batches):
        seen.update(r[column] for r in batch if r[column] is not None)
        if seen:
            out.append((number, sum(n == 1 for n in seen.values()) / sum(seen.values())))
    return out


def test_running_uniqueness_equals_a_recount(spark, tmp_path):
    rng = random.Random(1)
    batches = [[(rng.choice([None, rng.randrange(60)]), float(rng.randrange(200))) for _ in range(n)] for n in (40, 0, 60, 30, 1)]
    batches.append([(7, -0.0), (7, 0.0), (None, None)])
    state = V.ValueState(spark, str(tmp_path))
    frames = [spark.createDataFrame(b, "k int, v double") for b in batches]
    assert state.running("t") is None and state.compact("t") == -1
    for number, df in enumerate(frames):
        state.absorb("t", number, df, ["k", "v"])
        # The last batch comes again, once after other rows.
        state.absorb("t", number, frames[0].limit(5) if number == 2 else df, ["k", "v"])
        state.absorb("t", number, df, ["k", "v"])
        if number in (2, 3):
            assert state.compact("t") == state.compact("t") == number
    found = {c: [(r[0], r[1]) for r in rows(state.running("t").filter(F.col("column_name") == c), "batch_id", "running_value")] for c in ("k", "v")}
    for i, c in enumerate(("k", "v")):
        wanted = recount(batches, i)
        assert [b for b, _ in found[c]] == [b for b, _ in wanted]
        assert [v for _, v in found[c]] == pytest.approx([v for _, v in wanted])
    whole = spark.createDataFrame([(n, *r) for n, b in enumerate(batches) for r in b], "n int, k int, v double")
    backfill = V.running_uniqueness(V.changes_of(V.value_counts(whole, ["k", "v"], "n")), "t")
    # A batch without rows is not known there.
    assert rows(backfill) == rows(state.running("t").filter("batch_id <> 1"))
    before = rows(state.running("t"))
    assert state.expire("t") > 0 and state.expire("t") == 0
    state.absorb("t", 5, frames[5], ["k", "v"])
    assert rows(state.running("t")) == before


def test_a_batch_joins_only_its_own_values(spark, tmp_path):
    state = V.ValueState(spark, str(tmp_path))
    state.absorb("t", 0, spark.range(1000).selectExpr("id AS k"), ["k"])
    state.absorb("t", 1, spark.range(998, 1002).selectExpr("id AS k"), ["k"])
    told = spark.read.parquet(f"{tmp_path}/t/seen/batch_id=1")
    assert rows(told, "value", "once") == [("1000", True), ("1001", True), ("998", False), ("999", False)]


@pytest.mark.parametrize("block", [1, 3, 1_000_000])
def test_lost_offsets(spark, block):
    rng = random.Random(2)
    kept = {(t, p): sorted(rng.sample(range(100), 40)) for t in "ab" for p in (0, 1)}
    known, found, wanted = None, [], []
    for low, high in ((0, 30), (30, 31), (31, 90), (60, 100)):
        # Messages come twice, and the last batch repeats some of the one before.
        batch = [(t, p, o) for (t, p), offsets in kept.items() for o in offsets if low <= o < high for _ in range(2)]
        df = spark.createDataFrame(batch, "topic string, partition int, offset long")
        found += rows(lost_offsets(df, known, block))
        known = spark.createDataFrame(next_offsets(df, known).collect(), "topic string, partition int, next_offset long")
    for (t, p), offsets in kept.items():
        wanted += [(t, p, a + 1, b - 1) for a, b in zip(offsets, offsets[1:]) if b > a + 1]
    assert sorted(found) == sorted(wanted)
    assert rows(known) == sorted((t, p, o[-1] + 1) for (t, p), o in kept.items())


def test_unique_after_every_batch(spark):
    rng = random.Random(3)
    current, repeated, held = None, None, {}
    kind = "id int, a string, b int, _operation string, t timestamp_ntz"
    for day in range(5):
        batch = []
        for k in rng.sample(range(12), 6):
            op = rng.choice(["INSERT", "UPDATE", "DELETE"])
            batch.append((k, rng.choice(["x", "y", None]), rng.randrange(2), op, at(day)))
            held.pop(k, None)
            if op != "DELETE":
                held[k] = batch[-1][1:3]
        staged = H.add_version_columns(spark.createDataFrame(batch, kind), F.col("t"))
        repeated = spark.createDataFrame(C.unique_after(repeated, current, staged, ["id"], ["a", "b"]).collect(), "a string, b int, rows long")
        merged = H.apply_changes(current, staged, ["id"])
        current = spark.createDataFrame(H.current(merged).collect(), merged.schema)
        counts = collections.Counter(v for v in held.values() if None not in v)
        assert rows(repeated) == sorted((*v, n) for v, n in counts.items() if n > 1)


def test_orphan_intervals(spark):
    """Day by day: a child is an orphan on each day of its own that no version of its parent covers."""
    rng = random.Random(4)
    last = 20

    def spans(n):
        cuts = sorted(rng.sample(range(last), 2 * n))
        return [(a, b if rng.random() < 0.8 or (a, b) != (cuts[-2], cuts[-1]) else None) for a, b in zip(cuts[::2], cuts[1::2])]

    parents = [(p, a, b) for p in range(6) for a, b in spans(rng.randint(1, 3))] + [(6, 3, 5), (6, 5, 9)]
    children = [(c, rng.choice([*range(8), None]), *rng.choice(spans(1))) for c in range(60)]
    day = lambda n: None if n is None else at(n)
    child = spark.createDataFrame([(c, p, day(a), day(b)) for c, p, a, b in children], "c int, p int, _effective_from timestamp_ntz, _effective_to timestamp_ntz")
    parent = spark.createDataFrame([(p, day(a), day(b)) for p, a, b in parents], "k int, _effective_from timestamp_ntz, _effective_to timestamp_ntz")
    end = lambda b: last + 1 if b is None else b
    wanted = []
    for c, p, a, b in children:
        alone = [d for d in range(a, end(b)) if p is not None and not any(q == p and x <= d < end(y) for q, x, y in parents)]
        wanted += [(c, d) for d in alone]
    found = []
    for r in C.orphan_intervals(child, "p", parent, "k").collect():
        since, until = (r["orphan_from"] - at(0)).days, last + 1 if r["orphan_to"] is None else (r["orphan_to"] - at(0)).days
        assert since < until
        found += [(r["c"], d) for d in range(since, until)]
    assert sorted(found) == sorted(wanted) and len(set(found)) == len(found)


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("PartitionFilters: [")[1].split("]")[0] for line in plan.split("\n") if "FileScan" in line]


def test_as_of_passes_over_folders(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    batches = [
        LOAD, CHANGES,
        [message("update", at(5), id=1, phone="9991", score=1.0), message("insert", at(5), id=7, phone="7", score=1.0)],
        [message("delete", at(6), id=7)],
        [message("update", at(1), id=4, phone="late", score=2.0)],
        [message("update", at(9), id=4, phone="4444", score=2.0)],
    ]
    for number, texts in enumerate(batches):
        write_batch(DRIVERS, frame(spark, *texts), number, store, now=at(10 + number))
        if number < 4:
            store.compact(DRIVERS)
    history = store.history(DRIVERS)
    for day in (0, 1, 2, 4, 5, 7, 20):
        wanted = rows(H.as_of(history, F.lit(at(day))), "id", "phone", "score", "_operation", "_effective_from")
        assert rows(store.as_of(DRIVERS, at(day))) == wanted, day
    # After the last end no closed folder but what the late change of batch 4 may meet; before it, no later batch.
    early = store.as_of(DRIVERS, at(0) + dt.timedelta(hours=1))
    assert not any("changes" in str(s) for s in scans(early))
    kept = [f for f in scans(early) if "version" in f]
    assert kept and all("3" in f for f in kept)
    store.compact(DRIVERS)
    late = store.as_of(DRIVERS, at(20))
    assert rows(late, "id") == [(1,), (4,)]
    assert all("false" not in f.lower() or "version" in f for f in scans(late))


def test_one_key_reads_as_much_however_large_the_base(spark, tmp_path):
    """Rows that scans give for one key, with files of some hundred rows each."""
    table = TableSpec("t", (ColumnSpec("id", "string"), ColumnSpec("v", "int")), ("id",))
    read = []
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for n in (500, 4000):
            store = Store(spark, f"{tmp_path}/{n}")
            texts = spark.range(n).select(
                F.format_string('{"data": {"id": "%s", "v": %d}, "metadata": {"timestamp": "2024-01-01 00:00:00", "operation": "load"}}', F.md5(F.col("id").cast("string")), F.col("id")).alias("value")
            )
            store.write_changes(table, 0, run_batch(table, texts, 0, at(10)).staged)
            store.compact(table)
            one = store.timeline(table, [texts.select(F.get_json_object("value", "$.data.id")).first()[0]])
            plan = one._jdf.queryExecution().executedPlan()
            assert one.collect()[0]["v"] == 0
            leaves = plan.collectLeaves()
            scanned = [leaves.apply(i) for i in range(leaves.size())]
            given = [p.metrics().apply("numOutputRows").value() for p in scanned if "version" in p.toString()]
            read.append(sum(given) / len(given))
        # A scan gives the rows of the file that holds the key, and of few others.
        assert 0 < read[1] <= 4000 / 16 * 2 and read[0] > 0, read
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_expired_folders_are_not_missed(spark, tmp_path):
    store = Store(spark, str(tmp_path), chain=2)
    assert store.expire(DRIVERS) == 0
    for number in range(5):
        write_batch(DRIVERS, frame(spark, message("update", at(number), id=1, phone=f"{number}", score=1.0)), number, store, now=at(10))
        if number < 4:
            store.compact(DRIVERS)
    before = rows(store.history(DRIVERS))
    assert store.expire(DRIVERS) > 0 and store.expire(DRIVERS) == 0
    assert rows(store.history(DRIVERS)) == before and folders_in(f"{tmp_path}/drivers/changes") == ["batch_id=4"]
    store.compact(DRIVERS)
    assert rows(store.history(DRIVERS)) == before


def test_counts_cost_no_jobs_of_their_own(spark, tmp_path):
    """A batch without checks: its time, quarantine, changes and the row of counts are written, nothing is counted apart."""
    store = Store(spark, str(tmp_path))
    plain = TableSpec("plain", DRIVERS.columns, ("id",), rules=DRIVERS.rules)
    write_batch(plain, frame(spark, *LOAD), 0, store, now=at(1))
    group, tracker = "counted", spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, "one batch")
    try:
        write_batch(plain, frame(spark, *CHANGES, "garbage"), 1, store, now=at(2))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Time, quarantine, two stages of changes, counts; the deletion of duplicates is one shuffle.
    assert len(tracker.getJobIdsForGroup(group)) <= 6
    facts = ["messages", "malformed_count", "control_count", "total_rows", "quarantined_count", "unknown_count", "staged_count", "failed_rules"]
    assert rows(store.summary().filter("batch_id = 1"), *facts) == [(5, 1, 0, 4, 0, 0, 3, [])]
    assert rows(store.summary().filter("batch_id = 0"), *facts) == [(6, 1, 0, 5, 2, 1, 2, ["drv_score", "primary_key"])]


def test_a_merge_leaves_the_bucketed_table_where_it_is(spark, tmp_path):
    from cdcflow.sources.buckets import BucketedVersions

    kind = "id int, v string, _operation string, t timestamp_ntz"
    staged = lambda *c: H.add_version_columns(spark.createDataFrame(list(c), kind), F.col("t"))
    base = H.apply_changes(None, staged(*[(i, "a", "INSERT", at(0)) for i in range(50)]), ["id"])
    table = BucketedVersions(spark, str(tmp_path), ["id"], 3)
    table.write("0", base)
    batch = staged((1, "b", "UPDATE", at(2)), (2, None, "DELETE", at(2)), (3, "c", "UPDATE", at(0)), (70, "n", "UPDATE", at(1)), (71, None, "DELETE", at(1)), (4, "?", "UNKNOWN", at(1)))
    merged = table.merged("0", batch)
    assert rows(merged) == rows(H.apply_changes(base, batch, ["id"]).select(*merged.columns))
    plan = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    above, _, scan = plan.partition("FileScan parquet")
    assert "ShuffledHashJoin" in plan and "Bucketed: true" in scan.split("\n")[0] and "SortMergeJoin" not in plan
    # The base is the first child of the join; the only exchange deals the changes.
    assert "Exchange" not in above.split("ShuffledHashJoin")[1] and plan.count("Exchange") == 1
    table.write("1", H.current(merged))
    again = table.merged("1", staged((1, "d", "UPDATE", at(5))))
    assert rows(again.filter("id = 1"), "v", "_is_current") == [("b", False), ("d", True)]
    with pytest.raises(Exception, match="older than its key"):
        table.merged("1", staged((1, "late", "UPDATE", at(1)))).collect()


def test_a_shared_feed_is_read_once_and_tables_fail_alone(spark, tmp_path):
    from dataclasses import replace

    from cdcflow.spec import Rule
    from cdcflow.streaming.streams import StreamFacts, retry_failed, start_routed
    from test_runs import ALERTS, INTERNAL

    store = Store(spark, str(tmp_path / "store"))
    broken = replace(ALERTS, rules=(Rule("bad", "regex", "kind", {"pattern": "("}),))
    texts = [*LOAD, message("insert", at(0), "alerts", id=9, kind="x"), message("insert", at(0), "elsewhere", id=1)]
    frame(spark, *texts).coalesce(1).write.parquet(str(tmp_path / "feed"))
    source = spark.readStream.schema("value string").parquet(str(tmp_path / "feed"))
    run = lambda specs: start_routed(specs, source, store, str(tmp_path / "points"), trigger={"availableNow": True})
    facts = StreamFacts()
    spark.streams.addListener(facts)
    try:
        running = run([DRIVERS, broken, INTERNAL])
        running.awaitTermination()
        assert sum(p["numInputRows"] for p in running.recentProgress) == len(texts)
        assert rows(store.current(DRIVERS), "id") == [(1,), (2,)] and store.current(ALERTS) is None
        assert store.failed(broken) == [0] and store.failed(DRIVERS) == []
        with pytest.raises(Exception):
            retry_failed(broken, store)
        assert retry_failed(ALERTS, store) == [0] and store.failed(ALERTS) == []
        assert rows(store.current(ALERTS), "id", "kind") == [(9, "x")]
        frame(spark, message("insert", at(1), "alerts", id=10, kind="y"), *CHANGES).write.mode("append").parquet(str(tmp_path / "feed"))
        run([DRIVERS, ALERTS]).awaitTermination()
        assert sorted(r["id"] for r in store.current(ALERTS).collect()) == [9, 10] and rows(store.current(DRIVERS), "id") == [(1,), (4,)]
    finally:
        spark.streams.removeListener(facts)
    assert all(r["query"] == "stream_routed" for r in facts.rows(spark).collect())
