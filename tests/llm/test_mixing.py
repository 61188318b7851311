"""Targets, words taken and training order against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cdcflow.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_chars long, size string"


def some_rows(seed=1):
    r = random.Random(seed)
    rows = []
    for source, n in (("b", 40), ("a", 3), (None, 10), ("é", 1), ("zero", 2), ("c", 200)):
        for _ in range(n):
            words = 0 if source == "zero" else r.choice((0, 1, 5, 50, 200))
            rows.append((len(rows), " \n".join(["wé"] * words) if words else r.choice((None, "", " \t ")), source, 7, "x"))
    return rows


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {**target, **share}
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over


def test_words_taken_meet_the_targets(spark):
    rows = some_rows()
    out, names = mixing.mixed(spark.createDataFrame(rows, SCHEMA))
    found = out.select("doc_id", "source", *names.values()).collect()
    sizes, size = {}, {}
    for doc_id, text, source, *_ in rows:
        size[doc_id] = len((text or "").split())
        sizes[source] = sizes.get(source, 0) + size[doc_id]
    wanted = plain_targets(sizes)
    taken = {}
    for x in found:
        doc_id, source, n, whole, target, took, uses, position = x
        assert n == size[doc_id] and whole == sizes[source] and target == pytest.approx(wanted[source])
        assert 0 <= took <= 3 * n and took == sum(u["words"] for u in uses)
        assert (position is None) == (took == 0)
        assert all(0 <= u["position"] <= 1 for u in uses)
        taken[source] = taken.get(source, 0) + took
    assert len(found) == len(rows)
    assert all(abs(taken[s] - wanted[s]) <= 0.5 for s in wanted)


def place(row):
    of = lambda x: hashlib.md5(x.encode()).hexdigest()
    return of(("" if row[0] is None else str(row[0])) + ":" + of(row[1] or ""))


def test_rows_without_id_are_dealt_by_their_text(spark):
    rows = [(None, "w " * (i % 7 + 1) + str(i), "abc"[i % 3], 1, "x") for i in range(900)]
    frame = spark.createDataFrame(rows, SCHEMA)
    keys = frame.select(F.substring(mixing.digest(), 1, 2).alias("bucket")).groupBy("bucket").count().collect()
    assert len(keys) > 200 and max(k["count"] for k in keys) < 20
    runs = []
    for parts in (1, 5):
        out, names = mixing.mixed(frame.repartition(parts))
        runs.append({x["text"]: x[names["taken"]] for x in out.collect()})
    assert runs[0] == runs[1] and len(runs[0]) == 900
    for source in "abc":
        own = sorted((r for r in rows if r[2] == source), key=place)
        ratio = [runs[0][r[1]] / len(r[1].split()) for r in own]
        assert ratio == sorted(ratio, reverse=True)


def test_order_is_that_of_md5_and_reruns_agree(spark):
    rows = some_rows(2)
    runs = []
    for parts in (1, 7):
        out, names = mixing.mixed(spark.createDataFrame(rows[:: 1 if parts == 1 else -1], SCHEMA).repartition(parts))
        runs.append(sorted(map(tuple, out.select("doc_id", names["taken"], names["position"]).collect()), key=repr))
    assert runs[0] == runs[1]
    taken = {d: t for d, t, _ in runs[0]}
    of_c = sorted((r for r in rows if r[2] == "c" and (r[1] or "").split()), key=place)
    ratio = [taken[r[0]] / len(r[1].split()) for r in of_c]
    assert ratio == sorted(ratio, reverse=True)


def test_positions_invert_the_integrated_schedule(spark):
    steps = 2000
    for rank, knots in enumerate(mixing.SCHEDULES):
        shares = [0.0, 0.1, 0.37, 0.5, 0.93, 1.0]
        frame = spark.createDataFrame([(s,) for s in shares], "share double")
        found = [r[0] for r in frame.select(mixing.position(F.col("share"), F.lit(rank))).collect()]

        def weight(t, knots=knots):
            for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
                if t <= t1:
                    return w0 + (w1 - w0) * (t - t0) / (t1 - t0)

        done = [0.0]
        for i in range(steps):
            done.append(done[-1] + weight((i + 0.5) / steps) / steps)
        for share, t in zip(shares, found, strict=True):
            assert done[round(t * steps)] / done[-1] == pytest.approx(share, abs=2e-3)


def test_training_order_holds_the_mix(spark):
    rows = some_rows(3)
    frame = spark.createDataFrame(rows, SCHEMA)
    out, names = mixing.mixed(frame)
    taken = {r[0]: r[1] for r in out.select("doc_id", names["taken"]).collect()}
    ordered = mixing.training_order(frame)
    assert ordered.columns == frame.columns
    words = {}
    for x in ordered.collect():
        words[x["doc_id"]] = words.get(x["doc_id"], 0) + len(x["text"].split())
    assert words == {d: t for d, t in taken.items() if t}


def test_rows_that_repeat_and_lack_ids(spark):
    rows = [(1, "a b c", "s", 1, ""), (1, "a b c", "s", 1, ""), (None, "d e", "s", 1, ""), (None, None, None, None, None)]
    out, names = mixing.mixed(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, out.select("doc_id", names["size"], names["taken"]).collect()), key=repr) == sorted(
        [(1, 3, 3), (1, 3, 3), (None, 2, 2), (None, 0, 0)], key=repr
    )


def test_no_rows_and_no_words(spark):
    for rows in ([], [(1, None, "a", 1, ""), (2, "", None, 1, "")]):
        out, names = mixing.mixed(spark.createDataFrame(rows, SCHEMA))
        assert [r[0] for r in out.select(names["taken"]).collect()] == [0] * len(rows)
        assert mixing.training_order(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_plan_has_no_python(spark):
    out, _ = mixing.mixed(spark.createDataFrame(some_rows(), SCHEMA))
    assert "Python" not in out._jdf.queryExecution().toString()
