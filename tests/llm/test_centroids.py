"""Centroid clustering against plain integer arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest

from cdcflow.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def brute(rows, k=16, rounds=3, dim=64):
    kept = [
        (i, [math.floor(64 * float(np.float32(x))) for x in v])
        for i, v in rows
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    pick = lambda v: min((away(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(pick(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    found = [(i, *pick(v)[::-1]) for i, v in kept]
    of = {n: sum(d for _, c, d in found if c == n) for n in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, of[c], sum(of.values()), sha[c]) for i, c, d in found), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_dot_products_by_planes_are_exact():
    rng = np.random.default_rng(1)
    for reach in (1, 30, 1 << 20, centroids.LARGEST - 1):
        for dim in (64, 3, 100):
            a, b = (rng.integers(-reach, reach, (n, dim), endpoint=True) for n in (50, 7))
            left, right = centroids.planes(a), centroids.planes(b)
            assert (centroids.dots(left, right) == a @ b.T).all()
            assert (centroids.squares(left) == (a * a).sum(axis=1)).all()
            assert (centroids.sums(left, dim) == a.sum(axis=0)).all()


def test_clusters_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(i % 5, 1) for _ in range(64)]) for i in range(300)]
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [None] + [1.0] * 63), (304, [math.nan] + [0.0] * 63), (305, [math.inf] * 64)]
    # Repeated rows, one id with two vectors, a wide vector, rows without id, a vector that is common.
    rows += [rows[7]] * 3 + [(7, [0.5] * 64), (306, [1e4] * 64), (None, [0.25] * 64)] + [(400 + i, [0.125] * 64) for i in range(200)]
    df = spark.createDataFrame([(i, v, "own") for i, v in rows], SCHEMA).repartition(3)
    assert result(centroids.clustered(df)) == brute(rows)


def test_fewer_vectors_than_centres_and_ties(spark):
    rows = [(1, [0.0] * 64), (2, [0.0] * 64), (3, [1.0] * 64)]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    assert result(centroids.clustered(df)) == brute(rows)


def test_empty_table_and_all_unfit(spark):
    assert centroids.clustered(spark.createDataFrame([], SCHEMA)).collect() == []
    assert centroids.clustered(spark.createDataFrame([(1, None, "x"), (2, [1.0], "y")], SCHEMA)).collect() == []


def test_components_beyond_the_range_raise(spark):
    df = spark.createDataFrame([(1, [3e38] * 64, "x")], SCHEMA)
    with pytest.raises(Exception, match="in magnitude"):
        centroids.clustered(df).collect()
