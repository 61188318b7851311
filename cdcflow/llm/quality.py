"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cdcflow.llm.common import fresh
from cdcflow.session import written

#: Buckets that unigrams and bigrams are hashed to, and labelled target documents at most, chosen by hash.
BUCKETS, TARGET_ROWS = 1 << 16, 20_000
#: Pseudo-count of a bucket, shared out by the raw model, and n-grams that every text is weighed as having.
PRIOR, GRAMS = 1.0, 512
#: Rows of the bin of keys that holds the border, below which they are sorted.
FINAL_ROWS = 10_000


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of neighbouring words of the texts, and where each text begins."""
    words, ends = [], [0]
    for text in texts:
        words += (text or "").encode("utf-8", "surrogatepass").lower().split()
        ends.append(len(words))
    hashes = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    mixed = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % BUCKETS
    ends = np.array(ends)
    out = np.full(2 * len(words), -1, dtype=np.int64)
    out[0::2] = mixed(hashes)
    if len(words) > 1:
        pairs = mixed(hashes[:-1] * np.uint64(31) + hashes[1:] + np.uint64(1 << 32))
        inside = np.ones(len(words) - 1, dtype=bool)
        inside[ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(words))] - 1] = False
        out[1:-1:2] = np.where(inside, pairs, -1)
    return out, 2 * ends


def pieces(texts: pa.Array, size: int = 8 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch, some megabytes at a time, with the place of the first."""
    start, held, total = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.as_py())
        total += len(held[-1] or "")
        if total > size:
            yield start, held
            start, held, total = i + 1, [], 0
    if held:
        yield start, held


def target_sample(labels: DataFrame, rows: int = TARGET_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Ids of labelled target documents (quality 1 in all their labels), and of the other labelled ones.

    At most about ``rows`` of each, a share by hash of the id: the first train the target model, both fit the border.
    """
    marked = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    each = marked.agg(F.min("quality").alias("quality")).withColumn("good", F.col("quality") == 1)
    sizes = {r["good"]: r["count"] for r in each.groupBy("good").count().collect()}
    out = []
    for good in (True, False):
        part = min(1.0, rows / sizes.get(good, 1))
        chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * part)
        ids = [r[0] for r in each.where(F.col("good") == good).where(chosen).select("doc_id").collect()]
        out.append(np.sort(np.array(ids, dtype=np.int64)))
    return out[0], out[1]


def fitted_border(good: np.ndarray, bad: np.ndarray) -> tuple[float, float, float]:
    """The value that best tells two samples apart, and the shares of both at or above it.

    The sum of the shares on the wrong side is least; of equal borders the lowest is taken, just above a bad one, so
    that rather too many documents count as good. The mix of the samples plays no part.
    """
    if not len(bad) or not len(good):
        return -math.inf, 1.0, 1.0
    values = np.unique(np.concatenate([good, bad]))
    borders = np.append(values, np.inf)
    above = lambda x: 1 - np.searchsorted(np.sort(x), borders) / len(x)
    of_good, of_bad = above(good), above(bad)
    best = int(np.argmax(of_good - of_bad > np.max(of_good - of_bad) - 1e-12))
    border = borders[best] if best == 0 else np.nextafter(values[best - 1], np.inf)
    return float(border), float(of_good[best]), float(of_bad[best])


def good_rows(scored: DataFrame, good: np.ndarray, bad: np.ndarray) -> int:
    """How many rows are good: those at or above the border fitted between labelled good and bad documents.

    The count is raised by what the border misses, known from the labelled ones, if that is more than the bad rows
    it lets in; so it follows the rows, not the mix of the labels.
    """
    sent = scored.sparkSession.sparkContext.broadcast(np.union1d(good, bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(-(1 << 63)).to_numpy()
            yield batch.filter(pa.array(np.isin(ids, sent.value) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)))

    found = scored.select("doc_id", "log_weight").mapInArrow(run, "doc_id long, log_weight double")
    # One row for each labelled id.
    weights = dict(map(tuple, found.groupBy("doc_id").agg(F.avg("log_weight")).collect()))
    border, of_good, of_bad = fitted_border(*(np.array([weights[i] for i in ids.tolist() if i in weights]) for ids in (good, bad)))
    rows, above = scored.agg(F.count("*"), F.coalesce(F.sum((F.col("log_weight") >= F.lit(border)).cast("long")), F.lit(0))).first()
    true = (above - of_bad * rows) / (of_good - of_bad) if of_good > of_bad else rows
    return min(rows, max(above, math.ceil(true)))


def log_ratios(docs: DataFrame, target: np.ndarray) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), from counts over all of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-(1 << 63)).to_numpy()
            chosen = np.isin(ids, sent.value)
            for start, texts in pieces(batch.column(1)):
                found, ends = grams(texts)
                raw += np.bincount(found[found >= 0], minlength=BUCKETS)
                inside = np.repeat(chosen[start : start + len(texts)], np.diff(ends)) & (found >= 0)
                good += np.bincount(found[inside], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], ["bucket", "raw", "good"])

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "bucket long, raw long, good long")
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, a, b in counted.groupBy("bucket").agg(F.sum("raw"), F.sum("good")).collect():  # at most BUCKETS rows
        raw[bucket], good[bucket] = a, b
    p_raw = (raw + PRIOR) / (raw.sum() + PRIOR * BUCKETS)
    p_good = (good + PRIOR * BUCKETS * p_raw) / (good.sum() + PRIOR * BUCKETS)
    return np.log(p_good) - np.log(p_raw)


def weighed(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, mark (a hash of id and text), log_weight and sample_key.

    The log weight is the mean log ratio of the whole text's n-grams times GRAMS: texts of all lengths are weighed as
    if they had that many, since a sum would let length decide, against long texts with rare words above all.

    The key adds Gumbel noise drawn from the hash, so reruns draw alike; the k largest keys are a sample without
    replacement in proportion to the weights.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.append(sent.value, 0.0)  # place -1: no n-gram
        for batch in batches:
            parts = []
            for _, texts in pieces(batch.column(2)):
                found, ends = grams(texts)
                values = np.append(table[found], 0.0)
                some = np.append((found >= 0).astype(np.int64), 0)
                sums, count = (np.add.reduceat(x, ends[:-1]) for x in (values, some))
                parts.append(np.where(np.diff(ends) > 0, GRAMS * sums / np.maximum(count, 1), 0.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.concatenate(parts) if parts else np.zeros(0))],
                ["doc_id", "mark", "log_weight"],
            )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("mark"), "text")
    scored = keyed.mapInArrow(run, "doc_id long, mark long, log_weight double")
    uniform = (F.pmod(F.xxhash64("mark"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return scored.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(uniform)))


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The exact k-th largest value, by histograms that close in on it; 1024 counts a round reach the driver."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while True:
        part = df.where(F.col(column).between(low, high))
        width = (high - low) / 1024
        if width <= 0 or low + width == low:
            return low if width <= 0 else sorted((r[0] for r in part.select(column).distinct().collect()), reverse=True)[0]
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(1023))
        counts = part.groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b"))
        for _, n, a, b in sorted(map(tuple, counts.collect()), reverse=True):
            if k <= n:
                low, high, rows = a, b, n
                break
            k -= n
        if rows <= FINAL_ROWS:
            held = df.where(F.col(column).between(low, high)).select(column).collect()
            return sorted((r[0] for r in held), reverse=True)[k - 1]


def sampled(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, mark, log_weight, sample_key and kept of every row of ``docs`` (doc_id, text).

    Importance resampling: each document weighs the ratio of two bags of hashed words and word pairs, the target one
    (documents labelled quality 1) and the raw one (all rows), both counted over whole texts; Gumbel top-k keeps
    ``share`` of all rows, by default as many as lie on the good side of a border fitted between labelled good and
    bad documents (``good_rows``). Junk, of n-grams that
    the target lacks, falls far behind. Null and empty texts weigh 1 (log 0). Repeated rows share a key and
    its fate, so ties at the border are kept. Without target labels every row is kept.
    """
    target, other = target_sample(labels)
    scored = written(weighed(docs, log_ratios(docs, target)))
    rows = scored.count()
    k = math.ceil(share * rows) if share is not None else good_rows(scored, target, other) if len(target) else rows
    border = kth_largest(scored, "sample_key", k) if 0 < k < rows else -math.inf if k else math.inf
    return scored.withColumn("kept", F.col("sample_key") >= F.lit(border))


def accepted(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """The rows of ``docs`` that ``sampled`` keeps."""
    other, key = fresh(docs, "_mark", "_key")
    gone = sampled(docs, labels, share).where("not kept").select(F.col("mark").alias(other)).distinct()
    marked = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    return marked.join(gone, F.col(key) == F.col(other), "left_anti").select(*docs.columns)
