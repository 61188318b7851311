"""Neighbours against brute force, with ties, nulls and repeats."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cdcflow.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score int, v string"


def plain(rows, k=10, every=100):
    good = []
    for vec_id, e, *_ in rows:
        if vec_id is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            good.append((vec_id, [math.floor(1024 * x) for x in e]))
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in good if i % every == 0}):
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def some_rows(n, dims, seed, values=None):
    r = random.Random(seed)
    draw = (lambda: r.choice(values)) if values else (lambda: r.gauss(0, 0.125))
    return [(i, [draw() for _ in range(dims)], 0, "") for i in range(n)]


def found(df):
    return sorted(map(tuple, df.collect()))


def single(rows):
    """Components as 32-bit floats hold them."""
    import numpy as np

    return [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], *rest) for i, e, *rest in rows]


def test_neighbours_are_those_of_brute_force(spark):
    rows = single(some_rows(1500, 16, 1))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(topk.embedding_neighbours(frame)) == plain(rows)


def test_ties_and_zero_vectors(spark):
    rows = single(some_rows(700, 4, 2, values=(0.0, 0.5, -0.5)) + [(100_000 + i, [0.0] * 4, 0, "") for i in range(20)])
    assert found(topk.embedding_neighbours(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_blocks_of_any_size_find_the_same(spark):
    rows = single(some_rows(900, 8, 3))
    frame = spark.createDataFrame(rows, SCHEMA).select("vec_id", topk.scaled("embedding").alias("v"))
    queries = frame.where(F.col("vec_id") % 100 == 0)
    for block, query_block in ((64, 2), (5000, 5000)):
        assert found(topk.top_k(frame, queries, 7, block, query_block)) == plain(rows, 7)


def test_rows_that_take_no_part_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 0, ""), (100, [0.25, -1.0], 0, ""), (100, [0.25, -1.0], 0, ""), (1, None, 0, ""), (2, [1.0, None], 0, ""),
        (3, [nan, 1.0], 0, ""), (4, [inf, 1.0], 0, ""), (None, [1.0, 1.0], 0, ""), (5, [1.0, 1.0, 1.0], 0, ""), (6, [-0.0003, 2.5], 0, ""),
        (200, None, 0, ""), (7, [], 0, ""), (300, [], 0, ""),
    ]
    assert found(topk.embedding_neighbours(spark.createDataFrame(rows, SCHEMA))) == plain(single(rows))


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**18 + i), float(i)], 0, "") for i in range(50)]
    assert found(topk.embedding_neighbours(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_no_rows(spark):
    assert topk.embedding_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0


def test_reading_stops_early():
    """On lists with one clear winner the bound ends the search long before the lists do."""
    import numpy as np

    class Counting(np.ndarray):
        rows = 0

        def __getitem__(self, item):
            if isinstance(item, np.ndarray):
                Counting.rows += len(item)
            return np.asarray(super().__getitem__(item))

    r = np.random.default_rng(0)
    vectors = r.integers(-50, 50, (5000, 4)).astype(float)
    vectors[17] = 1000
    lists = topk.Lists(np.arange(5000), vectors)
    lists.vectors = vectors.view(Counting)
    assert lists.top(np.ones(4), -1, 1, []) == [(4000, 17)]
    assert Counting.rows < 1000


class Read(np.ndarray):
    """Counts the vectors that are read to be scored."""

    rows = 0

    def __getitem__(self, item):
        if isinstance(item, np.ndarray):
            Read.rows += len(item)
        return np.asarray(super().__getitem__(item))


def test_a_block_is_read_once_for_all_its_queries():
    """Where no bound ends the lists early, as in many dimensions, queries share the rows they read."""
    r = np.random.default_rng(1)
    vectors = np.floor(r.normal(0, 128, (3000, 64)))
    lists = topk.Lists(np.arange(3000), vectors)
    Read.rows, lists.vectors = 0, vectors.view(Read)
    asked, scores, ids = lists.tops(vectors[::100], np.arange(0, 3000, 100), 10)
    assert Read.rows <= 3000
    for q in range(30):
        plainly = sorted((-int(s), i) for i, s in enumerate(vectors @ vectors[100 * q]) if i != 100 * q)[:10]
        assert [(-s, i) for s, i in zip(scores[asked == q].tolist(), ids[asked == q].tolist(), strict=True)] == plainly


@pytest.mark.parametrize("kind", [np.int64, np.float64])
@pytest.mark.parametrize("high", [1, 3, 50, 1500, 2**22])
def test_queries_read_together_find_what_each_finds(kind, high):
    r = np.random.default_rng(high)
    for n, d, m, k in ((1, 2, 3, 2), (5, 0, 2, 3), (400, 1, 7, 10), (300, 3, 40, 4), (700, 8, 9, 1), (900, 40, 5, 10)):
        vectors, queries = r.integers(-high, high + 1, (n, d)).astype(kind), r.integers(-high, high + 1, (m, d)).astype(kind)
        queries[0] = 0
        ids, own = r.integers(0, max(1, n * 3 // 4), n), r.integers(0, n, m)
        asked, scores, found = topk.Lists(ids, vectors).tops(queries, own, k)
        for q in range(m):
            sums = vectors.astype(np.int64) @ queries[q].astype(np.int64)
            plainly = sorted((-int(s), int(i)) for s, i in zip(sums, ids, strict=True) if i != own[q])[:k]
            assert [(-int(s), int(i)) for s, i in zip(scores[asked == q], found[asked == q], strict=True)] == plainly


def test_many_vectors_of_the_query_id_leave_room_for_the_others(spark):
    """Of 60 rows of the query's own id, all better than any other row, none takes a place."""
    rows = single([(100, [1.0, 1.0], 0, "")] * 60 + [(i, [0.5, i / 1024], 0, "") for i in range(301, 400)])
    assert found(topk.embedding_neighbours(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
