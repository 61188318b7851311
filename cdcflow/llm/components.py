"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cdcflow.session import written


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long); the component is its smallest node.

    Alternating large and small stars: each round links every node to the smallest neighbour it knows. A round is
    grouping and joins of the edge list, written to the shared folder, and the number of rounds grows with the
    logarithm of the longest chain. Only a count and a checksum of each round reach the driver. No edges give no
    rows; self links and repeated edges are ignored.
    """
    now = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    )
    seen = None
    while (mark := _mark(now)) != seen:
        seen = mark
        if not mark[0]:
            break
        now = written(_small(_large(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v") % 1_000_003)).first())


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are linked to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
    return both.join(least, both.u == least.n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, are linked to the smallest of them."""
    least = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    rest = edges.join(least, edges.u == least.n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
