"""Exact top-k inner products by Fagin's threshold algorithm, block by block."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cdcflow.llm.common import partitions
from cdcflow.session import written

#: Vectors of one block of lists, and queries of one block: as many, so that both sides are copied equally often.
BLOCK, QUERIES = 8192, 8192
#: Queries that read a block's lists together.
TOGETHER = 256
#: A bar below every score.
NONE = np.iinfo(np.int64).min + 1


def scaled(vector: Column | str, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as double; null if the vector is null or holds null or non-finite ones."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    vector = vector.cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x * scale).cast("long")))


class Lists:
    """Per-dimension lists of a block, each sorted by component, and the threshold algorithm over them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        columns = np.ascontiguousarray(self.vectors.T)
        self.order = np.argsort(columns, axis=1)  # dimension, rank: row, smallest first
        self.sorted = np.take_along_axis(columns, self.order, axis=1)

    def top(self, query: np.ndarray, own: int, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """``best`` (score, id; best first) after this block's vectors; the query's own row takes no part."""
        least = np.array([best[-1][0] if len(best) == k else NONE])
        _, scores, ids = self.tops(query[None], np.array([own]), k, least)
        return sorted(best + list(zip(scores.tolist(), ids.tolist(), strict=True)), key=lambda x: (-x[0], x[1]))[:k]

    def tops(
        self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of the query, score and id of the k best of every query, best first; rows of its ``own`` id take no part.

        Lists are read from their best end (the last for positive weights, the first for negative ones), some ranks
        of all lists at a time, for all queries at once. Every new row is scored in full at once, for all queries that
        are not done, in one product. What no list has shown yet scores at most the sum of the values where the lists
        stand; once that is below a query's kth score, or below ``least``, the query is done. Equality does not stop
        it, as a tie may have a smaller id.
        """
        n, d = self.vectors.shape
        positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
        kind = _sums(self.vectors, queries)
        seen, own_rows = np.zeros(n, dtype=bool), np.isin(self.ids, own)
        kth = np.full(len(queries), NONE) if least is None else least.astype(np.int64)
        asked = scores = ids = np.empty(0, dtype=np.int64)
        alive = np.arange(len(queries))
        at, step = 0, max(4, 256 // max(d, 1))
        while at < n and len(alive):
            stop = min(n, at + step)
            new = np.full(n, stop == n)  # the last step takes what no list with a weight has shown
            new[self.order[(positive[alive] > 0).any(axis=0), n - stop : n - at]] = True
            new[self.order[(negative[alive] < 0).any(axis=0), at:stop]] = True
            rows = np.flatnonzero(new & ~seen)
            seen[rows] = True
            if len(rows):
                found = queries[alive].astype(kind) @ self.vectors[rows].astype(kind).T
                mine = np.flatnonzero(own_rows[rows])
                lowest = -np.inf if found.dtype.kind == "f" else NONE - 1
                found[:, mine] = np.where(own[alive, None] == self.ids[rows[mine]], lowest, found[:, mine])
                of, row = _good(found, kth[alive], k)
                asked = np.concatenate([asked, alive[of]])
                scores = np.concatenate([scores, found[of, row].astype(np.int64)])
                ids = np.concatenate([ids, self.ids[rows[row]]])
                order = np.lexsort((ids, -scores, asked))
                rank = np.arange(len(order)) - np.searchsorted(asked[order], asked[order])
                order, rank = order[rank < k], rank[rank < k]
                asked, scores, ids = asked[order], scores[order], ids[order]
                full = rank == k - 1
                kth[asked[full]] = np.maximum(kth[asked[full]], scores[full])
            if seen.all():
                break
            bound = positive[alive] @ self.sorted[:, n - stop - 1] + negative[alive] @ self.sorted[:, stop]
            alive = alive[bound >= kth[alive]]
            at, step = stop, step * 2
        return asked, scores, ids


def _sums(vectors: np.ndarray, queries: np.ndarray) -> type:
    """What holds all sums of a product exactly: no partial sum is above the product of the two vectors' lengths."""
    if vectors.dtype.kind == "f" and vectors.size and queries.size:
        squared = [float(np.einsum("ij,ij->i", x, x).max()) for x in (vectors, queries)]
        if max(squared[0], squared[1], squared[0] * squared[1]) < 2**46:  # half of what 32 bits hold exactly
            return np.float32
    return vectors.dtype.type


def _good(found: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and row of the scores that may be among the k best, at most 4 k + 4 of a query.

    Of more, k - 1 at most are above the kth, and of those that equal it the first k count, rows being in the order of
    their ids.
    """
    bar = kth.astype(found.dtype)[:, None]
    good = found >= bar
    many = np.flatnonzero(np.count_nonzero(good, axis=1) > 4 * k + 4)
    if len(many):
        some = found[many]
        bars = np.maximum(bar[many], np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k, None])
        level = some == bars
        good[many] = (some > bars) | (level & (np.cumsum(level, axis=1) <= k))
    return np.nonzero(good)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query with all vectors but its own.

    ``vectors`` and ``queries`` hold vec_id and v (array<long>, as of ``scaled``); rows with null id or null v take
    no part, vectors of another length than a query's are no candidates of it. Ties go to the smaller id; repeated
    ids are vectors of their own and all are skipped for the query of that id; a query repeated in full is asked
    once, and an id with several vectors gets one ranking of all their answers. Both sides are cut into blocks by the
    hash of their id, each query block meets each vector block in a task of its own, which holds one block of lists
    and one of queries, and the blocks' answers of at most k rows are merged by rank. Sums must fit 63 bits.
    """
    vectors = vectors.where("vec_id is not null and v is not null").select("vec_id", "v")
    queries = queries.where("vec_id is not null and v is not null").select("vec_id", "v").distinct()
    n_blocks, n_queries = (max(1, -(-df.count() // size)) for df, size in ((vectors, block), (queries, query_block)))
    deal = lambda df, side, mine, own, other, theirs: df.select(
        F.pmod(F.xxhash64("vec_id", "v"), F.lit(mine)).cast("int").alias(own),
        F.explode(F.sequence(F.lit(0), F.lit(theirs - 1))).alias(other),
        F.lit(side).alias("side"), "vec_id", "v",
    ).select("block", "part", "side", "vec_id", "v")
    both = deal(vectors, 0, n_blocks, "block", "part", n_queries).unionByName(
        deal(queries, 1, n_queries, "part", "block", n_blocks)
    )
    keys = ["block", "part"]
    dealt = both.repartition(max(partitions(vectors), 1), *keys).sortWithinPartitions(*keys, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            ids, sides = rows.column("vec_id").to_numpy(), rows.column("side").to_numpy()
            v = rows.column("v").combine_chunks()
            lengths = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for d in np.unique(lengths):
                of = lambda side: np.flatnonzero((lengths == d) & (sides == side))  # noqa: B023, E731
                some, asked = of(0), of(1)
                if not len(some) or not len(asked):
                    continue
                matrix = lambda where: flat[starts[where][:, None] + np.arange(d)].astype(np.int64)  # noqa: B023, E731
                held = matrix(some)
                exact = d * max(1, np.abs(held).max(initial=0)) * max(1, np.abs(flat).max(initial=0)) < 1 << 53
                kind = np.float64 if exact else np.int64  # doubles are exact below 2 ** 53, and faster
                lists, wanted = Lists(ids[some], held.astype(kind)), matrix(asked).astype(kind)
                for at in range(0, len(asked), TOGETHER):
                    own = ids[asked[at : at + TOGETHER]]
                    row, score, vec_id = lists.tops(wanted[at : at + TOGETHER], own, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.int64()) for x in (own[row], vec_id, score)], ["query_id", "vec_id", "score"]
                    )

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one (block, part) at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not batch.num_rows:
            continue
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1])) + 1
        if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (block[0], part[0]):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def embedding_neighbours(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """``top_k`` of the rows whose vec_id is divisible by ``every``, over all rows of (vec_id, embedding)."""
    whole = written(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), scaled("embedding").alias("v")))
    return top_k(whole, whole.where(F.col("vec_id") % every == 0), k)
