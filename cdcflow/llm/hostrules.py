"""Quality rules judged host by host: failures of a host's documents, shrunk towards what is usual among hosts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cdcflow.llm.common import fresh
from cdcflow.session import written

#: Words of a window; code points of text that one numpy step takes.
WINDOW, CHUNK = 8, 4_000_000
#: White space and symbols of the rules.
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: A host with more than one document in so many is heavy, so fewer hosts than that are.
HEAVY = 1_000


def repeated_words(texts: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """For each text the words that lie in windows found twice or more in it.

    Windows are told apart exactly: words get numbers, then pairs of neighbours, pairs of pairs and so on.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    total = int(lengths.sum())
    if total < window:
        return np.zeros(len(texts), dtype=np.int64)
    rank = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    size = 1
    while size < window:
        # The last step may overlap, where the window is no power of two.
        step = min(size, window - size)
        rank = pd.factorize(rank[:-step] * (int(rank.max()) + 1) + rank[step:])[0].astype(np.int64)
        size += step
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(texts)), lengths)
    starts = np.flatnonzero(np.arange(total) + window <= ends[text])
    if not len(starts):
        return np.zeros(len(texts), dtype=np.int64)
    known = pd.factorize(text[starts] * (int(rank.max()) + 1) + rank[starts])[0]
    often = starts[np.bincount(known)[known] > 1]
    change = np.zeros(total + 1, dtype=np.int64)
    np.add.at(change, often, 1)
    np.add.at(change, often + window, -1)
    return np.bincount(text[np.cumsum(change[:-1]) > 0], minlength=len(texts)).astype(np.int64)


def counts_of(texts: list[str | None]) -> np.ndarray:
    """COUNTS of each text (null: empty), one row each."""
    out = np.zeros((len(texts), len(COUNTS)), dtype=np.int64)
    words: list[list[bytes]] = []
    first = held = 0
    for i, text in enumerate(texts):
        text = text or ""
        words.append(text.encode("utf-8", "surrogatepass").split())
        lines = [line for line in text.split("\n") if line.strip(SPACES)]
        out[i, 0] = len(words[-1])
        out[i, 1] = len(text) - sum(text.count(c) for c in SPACES)
        out[i, 2] = sum(text.count(c) for c in SYMBOLS)
        out[i, 3] = len(lines) - len(set(lines))
        out[i, 5] = len(lines)
        held += len(text)
        if held >= CHUNK or i + 1 == len(texts):
            out[first : i + 1, 4] = repeated_words(words)
            words, first, held = [], i + 1, 0
    return out


def measured(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, host and COUNTS of every row; texts are taken whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = counts_of(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(found[:, i]) for i in range(len(COUNTS)))], ["doc_id", "host", *COUNTS]
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    return picked.mapInArrow(run, ", ".join(["doc_id long", "host string", *(f"{c} long" for c in COUNTS)]))


def failures() -> dict[str, Column]:
    """The rules, each a condition on the counts; the first two are those of the single document."""
    return {
        "short": F.col("n_words") < 20,
        "repetitive": F.col("n_repeat_words") * 100 > F.col("n_words") * 30,
        "symbols": F.col("n_symbols") * 10 > F.col("n_words"),
        "lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * 30,
    }


def prior(hosts: int, rows: int, squares: float, failed: int, spread: float) -> tuple[float, float]:
    """Mean and strength of the beta prior of a rule's rate, by moments; strength infinite where hosts do not differ.

    ``squares`` is the sum of squared host sizes, ``spread`` that of failed ** 2 / size. The sum of squares between
    hosts, compared with what equal hosts would show by chance, gives the share of variance that lies between them.
    """
    mean = failed / rows
    room = rows - squares / rows - (hosts - 1)
    if not 0 < mean < 1 or room <= 0:
        return mean, float("inf")
    between = (spread - failed * mean) / (mean * (1 - mean))
    share = min(1.0, (between - (hosts - 1)) / room)
    return mean, 1 / share - 1 if share > 0 else float("inf")


def host_verdicts(measures: DataFrame, limit: float) -> tuple[DataFrame, int]:
    """host, documents, each rule's shrunk rate and ``host_kept`` for every host, and the number of rows with one.

    A host is kept unless some rule's rate, shrunk by that rule's prior, is above ``limit`` by more than the standard
    deviation of what its documents leave open: a host of few documents needs more than a majority of failures.
    Hosts are counted before the shuffle, so a hot one sends a row per task; one row of sums reaches the driver.
    """
    rules = failures()
    named = measures.where("host is not null")
    hosts = written(named.groupBy("host").agg(F.count("*").alias("documents"), *[F.count_if(c).alias(f"n_{r}") for r, c in rules.items()]))
    n = F.col("documents").cast("double")
    sums = hosts.agg(
        F.count("*").alias("hosts"), F.sum("documents").alias("rows"), F.sum(n * n).alias("squares"),
        *[F.sum(f"n_{r}").alias(f"f_{r}") for r in rules],
        *[F.sum(F.col(f"n_{r}") * F.col(f"n_{r}").cast("double") / n).alias(f"s_{r}") for r in rules],
    ).first()
    rates, kept = {}, F.lit(True)
    for r in rules:
        mean, strength = prior(sums["hosts"], sums["rows"], sums["squares"], sums[f"f_{r}"], sums[f"s_{r}"]) if sums["rows"] else (0.0, 1.0)
        pooled = F.lit(float(mean))
        rates[r] = pooled if strength == float("inf") else (F.col(f"n_{r}") + F.lit(strength) * pooled) / (n + F.lit(strength))
        open_ = F.lit(0.0) if strength == float("inf") else F.sqrt(rates[r] * (1 - rates[r]) / (n + F.lit(strength + 1)))
        kept = kept & (rates[r] - open_ <= limit)
    return hosts.select("host", "documents", *[v.alias(f"rate_{r}") for r, v in rates.items()], kept.alias("host_kept")), sums["rows"] or 0


def judged(docs: DataFrame, *, host: str = "source", limit: float = 0.5) -> DataFrame:
    """doc_id, COUNTS, base_failed, host, host_kept and kept of every row of ``docs``.

    A document fails by itself if it has under 20 words or over 30 % of its words stand in repeated windows of eight.
    It is kept if it does not and its host is kept (``host_verdicts``). A null or empty text has no words, so it
    fails; a row without host is judged by itself alone and counts for no host; repeated rows count as often as they
    come; an empty table gives no rows; other columns are not looked at.

    The verdicts of heavy hosts, fewer than a thousand whatever the input, are broadcast; all other hosts, each with
    at most a thousandth of the rows, are joined by shuffle. Rows that need no such join are dealt by their id.
    """
    measures = written(measured(docs, host))
    verdicts, rows = host_verdicts(measures, limit)
    heavy = verdicts.where(F.col("documents") * HEAVY > rows).select(F.col("host").alias("heavy"), F.col("host_kept").alias("heavy_kept"))
    light = verdicts.where(F.col("documents") * HEAVY <= rows).select(
        F.col("host").alias("light"), F.lit(0).cast("long").alias("light_salt"), F.col("host_kept").alias("light_kept")
    )
    key, salt = fresh(measures, "_key", "_salt")
    rest = F.col("heavy").isNull() & F.col("host").isNotNull()
    met = measures.join(F.broadcast(heavy), measures.host == F.col("heavy"), "left").withColumns(
        {key: F.when(rest, F.col("host")).otherwise(""), salt: F.when(rest, F.lit(0)).otherwise(F.shiftrightunsigned(F.xxhash64("doc_id", *COUNTS), 1) + 1)}
    )
    joined = met.join(light, (F.col(key) == F.col("light")) & (F.col(salt) == F.col("light_salt")), "left")
    rules = failures()
    failed, host_kept = rules["short"] | rules["repetitive"], F.coalesce("heavy_kept", "light_kept", F.lit(True))
    return joined.select(
        "doc_id", *COUNTS, failed.alias("base_failed"), "host", host_kept.alias("host_kept"), (~failed & host_kept).alias("kept")
    )
