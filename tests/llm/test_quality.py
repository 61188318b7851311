"""Models, keys and the exact border against plain Python; junk goes and clean texts stay."""

import math
import random

import numpy as np
import pytest

from cdcflow.llm import quality

SCHEMA = "doc_id long, text string, mark string, kept string"
LABELS = "doc_id long, quality int, toxic int"


def some_rows(n=600, seed=1):
    r = random.Random(seed)
    clean = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        junk = i % 6 == 0
        size = r.choice((3, 30, 300))
        text = " ".join(("!!" + r.choice(clean) + "##" if junk else r.choice(clean)) for _ in range(size))
        rows.append((i, text, "x", "y"))
        if i % 2 or junk and i % 4 == 0:
            labels.append((i, 0 if junk else 1, 0))
    return rows, labels


def test_n_grams_stay_within_texts():
    together, ends = quality.grams(["a b", "c", "", None, "d e f"])
    apart = [quality.grams([t])[0] for t in ("a b", "c", "", "", "d e f")]
    for i, own in enumerate(apart):
        part = together[ends[i] : ends[i + 1]]
        assert part[part >= 0].tolist() == own[own >= 0].tolist()
    assert [int((a >= 0).sum()) for a in apart] == [3, 1, 0, 0, 5]


def test_weights_are_those_of_the_two_models(spark):
    rows, labels = some_rows(120)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    target, _ = quality.target_sample(spark.createDataFrame(labels, LABELS))
    ratios = quality.log_ratios(docs, target)
    raw, good = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for doc_id, text, *_ in rows:
        found = quality.grams([text])[0]
        counts = np.bincount(found[found >= 0], minlength=quality.BUCKETS)
        raw += counts
        good += counts * (doc_id in set(target.tolist()))
    p_raw = (raw + quality.PRIOR) / (raw.sum() + quality.PRIOR * quality.BUCKETS)
    wanted = np.log((good + quality.PRIOR * quality.BUCKETS * p_raw) / (good.sum() + quality.PRIOR * quality.BUCKETS)) - np.log(p_raw)
    assert np.allclose(ratios, wanted)
    for row in quality.weighed(docs, ratios).collect():
        found = quality.grams([rows[row["doc_id"]][1]])[0]
        assert row["log_weight"] == pytest.approx(quality.GRAMS * ratios[found[found >= 0]].mean())


def test_junk_goes_and_clean_texts_stay(spark):
    rows, labels = some_rows()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    kept = quality.accepted(docs, marks)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert sum(i not in ids for i in range(0, 600, 6)) >= 60
    assert sum(i in ids for i in range(600) if i % 6) >= 490
    again = {r["doc_id"] for r in quality.accepted(docs.repartition(5), marks).collect()}
    assert again == ids


@pytest.mark.parametrize("values", [[1.0] * 500, list(range(3000)), [0.0] * 900 + [5.0, 5.0, 7.0] + [-1e300], [math.sin(i) for i in range(25_000)]])
def test_the_border_is_exact(spark, values):
    frame = spark.createDataFrame([(float(v),) for v in values], "x double")
    ordered = sorted(map(float, values), reverse=True)
    for k in (1, 2, len(values) // 2, len(values)):
        assert quality.kth_largest(frame, "x", k) == ordered[k - 1]


def test_sampling_follows_the_weights():
    """Gumbel keys of equal weights keep each row equally often; a heavier one more often."""
    r = np.random.default_rng(0)
    weights = np.log(np.array([1.0, 1.0, 2.0]))
    first = [(weights - np.log(-np.log(r.random(3)))).argmax() for _ in range(4000)]
    assert np.bincount(first) / 4000 == pytest.approx([0.25, 0.25, 0.5], abs=0.04)


def test_rows_of_all_kinds(spark):
    rows = [(1, None, "", ""), (1, None, "", ""), (None, "", "", ""), (2, "word " * 100_000, "", ""), (None, "a b", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(2, 1, 0), (2, 1, None), (None, 1, 0), (1, None, 0), (7, 0, 0)], LABELS)
    assert quality.sampled(docs, none).where("kept").count() == 5
    found = quality.sampled(docs, odd, share=1.0)
    assert found.count() == 5 and found.where("kept").count() == 5
    assert quality.sampled(docs, odd, share=0.0).where("kept").count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.sampled(empty, odd).count() == 0 and quality.accepted(empty, odd).count() == 0


def test_the_kept_share_follows_the_rows_not_the_labels(spark):
    """Half of the labels are bad, one row in twenty is: nearly all clean rows stay and the junk goes."""
    r = random.Random(3)
    words = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1000):
        junk = i % 20 == 0
        rows.append((i, " ".join(f"!!{w}##" if junk else w for w in r.choices(words, k=100)), "x", "y"))
        if junk or i % 20 == 7:
            labels.append((i, int(not junk), 0))
    kept = {x["doc_id"] for x in quality.accepted(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()}
    assert sum(i in kept for i in range(1000) if i % 20) >= 940
    assert sum(i in kept for i in range(0, 1000, 20)) <= 5
