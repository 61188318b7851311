"""Centroid clustering on integer vectors held as bit planes.

A vector of 64 integer components is kept as one 64-bit word per binary digit: bit i of plane b is digit b of
component i, in two's complement. The dot product of two vectors is then a weighted sum of AND-popcounts over all
pairs of their planes, so distances are exact and a comparison reads some six words instead of 64 numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cdcflow.session import written

#: Magnitude of integer components up to which a squared distance over 64 of them fits into a long.
LARGEST = 1 << 27
#: Vectors of one numpy step.
ROWS = 8_192


def planes(numbers: np.ndarray) -> np.ndarray:
    """Bit planes (rows, digits, words) of integer rows (rows, components); the last digit is the sign."""
    digits = max(int(np.abs(numbers).max(initial=0)).bit_length(), 1) + 1
    width = -numbers.shape[1] % 64
    bits = (numbers[:, None, :] >> np.arange(digits)[None, :, None]) & 1
    bits = np.pad(bits.astype(np.uint8), ((0, 0), (0, 0), (0, width)))
    return np.packbits(bits, axis=2).view(">u8").astype(np.uint64)


def weights(digits: int) -> np.ndarray:
    """What each plane counts: powers of two, the sign plane negative."""
    out = np.int64(1) << np.arange(digits, dtype=np.int64)
    out[-1] = -out[-1]
    return out


def dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dot products (left rows, right rows) of two sets of planes."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for i, a in enumerate(weights(left.shape[1])):
        for j, b in enumerate(weights(right.shape[1])):
            both = np.bitwise_count(left[:, None, i, :] & right[None, :, j, :])
            out += a * b * both.sum(axis=2, dtype=np.int64)
    return out


def squares(sets: np.ndarray) -> np.ndarray:
    """Squared length of each vector."""
    out = np.zeros(len(sets), dtype=np.int64)
    for i, a in enumerate(weights(sets.shape[1])):
        for j, b in enumerate(weights(sets.shape[1])):
            out += a * b * np.bitwise_count(sets[:, i] & sets[:, j]).sum(axis=1, dtype=np.int64)
    return out


def sums(sets: np.ndarray, dim: int) -> np.ndarray:
    """Componentwise sum of vectors: how many have each bit, by plane."""
    bits = np.unpackbits(sets.astype(">u8").view(np.uint8).reshape(len(sets), sets.shape[1], -1), axis=2)
    return weights(sets.shape[1]) @ bits.sum(axis=0, dtype=np.int64)[:, :dim]


def nearest(sets: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre (ties: the smaller) and the squared distance to it."""
    away = squares(sets)[:, None] + squares(centres)[None, :] - 2 * dots(sets, centres)
    best = away.argmin(axis=1)
    return best, away[np.arange(len(sets)), best]


def packed(embeddings: DataFrame, vector: str, scale: int, dim: int) -> DataFrame:
    """vec_id, digits and planes of the rows whose vector has exactly ``dim`` finite components.

    Each component x becomes floor(scale * x), x as double; one of 2 ** 27 or more raises, since distances
    could leave the range of a long. Rows are packed batch by batch, so one wide vector widens its own batch only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dim)
                kept = np.isfinite(flat).all(axis=1)
                with np.errstate(over="ignore"):
                    whole = np.floor(flat[kept] * scale)
                if (np.abs(whole) >= LARGEST).any():
                    raise ValueError(f"a component times {scale} is not below {LARGEST} in magnitude")
                found = planes(whole.astype(np.int64))
                words = pa.array(found.reshape(-1).view(np.int64))
                per_row = found.shape[1] * found.shape[2]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * per_row), words)
                digits = pa.array(np.full(len(found), found.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(kept)), digits, lists], ["vec_id", "digits", "planes"])

    wide = embeddings.where(F.size(vector) == dim)
    return wide.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(
        run, "vec_id long, digits int, planes array<long>"
    )


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows with equally many digits, some ROWS at a time, and their planes."""
    digits = batch.column(1).to_numpy()
    for d in np.unique(digits):
        same = batch.filter(pa.array(digits == d))
        for start in range(0, same.num_rows, ROWS):
            part = same.slice(start, ROWS)
            flat = part.column(2).flatten().to_numpy().view(np.uint64)
            yield part, flat.reshape(part.num_rows, d, -1)


def first_centres(sets: DataFrame, k: int, seed: int, dim: int) -> list[list[int]]:
    """Components of the k vectors with the smallest sha256 of ``seed:vec_id``; at most k rows reach the driver.

    Rows of one id are ordered by their planes; rows without vec_id come last.
    """
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = sets.select(order.alias("o"), "digits", "planes").orderBy(F.asc_nulls_last("o"), "digits", "planes").limit(k).collect()
    out = []
    for row in rows:
        found = np.array(row["planes"], dtype=np.int64).view(np.uint64).reshape(1, row["digits"], -1)
        out.append([int(x) for x in sums(found, dim)])
    return out


def moved(sets: DataFrame, centres: list[list[int]]) -> list[list[int]]:
    """Centres after one round: the exact floor of each cluster's mean; an empty cluster's stays.

    A task returns one row per cluster that it meets, whatever its vectors; k rows reach the driver.
    """
    dim, ours = len(centres[0]), planes(np.array(centres, dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(ours), dtype=np.int64)
        totals = np.zeros((len(ours), dim), dtype=np.int64)
        for batch in batches:
            for _, part in _sets(batch):
                best, _ = nearest(part, ours)
                for c in np.unique(best):
                    mine = part[best == c]
                    counts[c] += len(mine)
                    totals[c] += sums(mine, dim)
        met = np.flatnonzero(counts)
        lists = pa.array(list(totals[met]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(counts[met]), lists], ["c", "n", "s"])

    partial = sets.mapInArrow(run, "c int, n long, s array<long>")
    each = [F.sum(F.element_at("s", i + 1).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    out = [list(c) for c in centres]
    for row in partial.groupBy("c").agg(F.sum("n").alias("n"), *each).collect():
        out[row["c"]] = [int(row[f"s{i}"]) // int(row["n"]) for i in range(dim)]
    return out


def assigned(sets: DataFrame, centres: list[list[int]]) -> DataFrame:
    """vec_id, cluster and distance of every vector."""
    ours = planes(np.array(centres, dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, part in _sets(batch):
                best, away = nearest(part, ours)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(best.astype(np.int32)), pa.array(away)], ["vec_id", "cluster", "distance"])

    return sets.mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(
    embeddings: DataFrame, *, vector: str = "embedding", k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, seed: int = 1
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    Vectors that are null, of another length than ``dim`` or hold null or non-finite components take no part. The
    first centres are the k vectors with the smallest hash of ``seed:vec_id`` (fewer vectors: fewer centres); in each
    round every vector goes to the nearest centre, ties to the smaller number, and every non-empty centre moves to
    the floor of its vectors' mean. Repeated rows count as often as they come; rows without vec_id are clustered and
    are the last to be a first centre. An empty table gives no rows. Other columns are not looked at.

    The planes are written once to the shared folder, about a fifth of the vectors' size; each round reads them,
    and a lost executor costs its tasks of one round. No group is ever gathered: a task adds up what it reads.
    """
    sets = written(packed(embeddings, vector, scale, dim))
    centres = first_centres(sets, k, seed, dim)
    if not centres:
        spark = embeddings.sparkSession
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centres = moved(sets, centres)
    found = written(assigned(sets, centres))
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    facts = [(c, inertia.get(c, 0), sum(inertia.values()), digest[c]) for c in range(len(centres))]
    # One row for each of the k centres.
    names = embeddings.sparkSession.createDataFrame(facts, "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(names), found.cluster == names.c).drop("c")
