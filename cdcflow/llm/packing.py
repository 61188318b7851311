"""Documents packed into sequences of fixed capacity by the linear grouping scheme."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cdcflow.llm.common import bucket_bits, running_before
from cdcflow.llm.tokens import Encoder
from cdcflow.session import written

CAPACITY = 2048
#: Groups that large lengths are rounded in; lengths up to this share of the capacity are small.
GROUPS, SMALL = 96, 1 / 4
#: Pivots of the configuration program at most; what it leaves fractional goes to best fit.
PIVOTS = 4000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, ranks: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ids (little-endian unsigned 32-bit) of every row of ``docs``.

    A document is the ids of its whole text (null: empty) and ``end_id``. One longer than ``capacity`` is cut into
    pieces of that length, of which the first may be shorter.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    end = np.array([end_id], dtype="<u4").tobytes()
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, ranks)
        out, size = [], 0
        pack = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names
        )
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                total = len(ids) // 4
                first = total % capacity or capacity
                cuts = [0, *range(first, total + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    out.append((doc_id, piece, a, b - a, zlib.crc32(part), part))
                size += len(ids)
                if size > 4 << 20:
                    yield pack(out)
                    out, size = [], 0
        yield pack(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


# --- the plan: lengths only, at most one entry for each length ---------------------------


class Bins:
    """Groups of equal sequences: (copies, lengths in order), found by the room they have left."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        self.some = np.zeros(capacity + 1, dtype=bool)

    def add(self, copies: int, lengths: tuple[int, ...]) -> None:
        if copies:
            room = self.capacity - sum(lengths)
            self.by_room.setdefault(room, []).append((copies, lengths))
            self.some[room] = True

    def best_fit(self, length: int, count: int) -> None:
        """Places ``count`` documents of one length where least room is left, opening sequences only when none fits."""
        while count:
            fits = self.some[length:]
            room = length + int(fits.argmax())
            if not self.some[room]:
                each = self.capacity // length
                self.add(count // each, (length,) * each)
                self.add(int(count % each > 0), (length,) * (count % each))
                return
            copies, lengths = self.by_room[room].pop()
            self.some[room] = bool(self.by_room[room])
            each = room // length
            full = min(copies, count // each)
            self.add(full, lengths + (length,) * each)
            count -= full * each
            if full < copies:
                # fewer than one filling is left
                self.add(int(count > 0), lengths + (length,) * count)
                self.add(copies - full - int(count > 0), lengths)
                count = 0

    def groups(self) -> list[tuple[int, tuple[int, ...]]]:
        return [g for room in sorted(self.by_room) for g in self.by_room[room]]


def configurations(sizes: np.ndarray, wanted: np.ndarray, capacity: int) -> list[tuple[float, np.ndarray]]:
    """(how often, slots of each size) that hold ``wanted`` documents in the fewest sequences: a linear program.

    Columns are made as needed: the sequence worth most at the present prices, a knapsack over the capacity with as
    many rounds as a sequence can hold documents. It ends when no sequence is worth more than one.
    """
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.linalg.inv(basis)
    amounts = inverse @ wanted
    room = np.arange(capacity + 1)[None, :] - sizes[:, None]
    rounds = int(capacity // sizes.min())
    fits = room >= 0
    place = np.maximum(room, 0)
    for pivot in range(PIVOTS):
        prices = np.maximum(inverse.sum(axis=0), 0.0)
        value, choice = np.zeros(capacity + 1), []
        for _ in range(rounds):
            worth = np.where(fits, prices[:, None] + value[place], -1.0)
            best = worth.argmax(axis=0)
            top = worth[best, np.arange(capacity + 1)]
            better = top > value + 1e-12
            choice.append(np.where(better, best, -1))
            value = np.where(better, top, value)
        if value[capacity] <= 1 + 1e-6:
            break
        column, c = np.zeros(k), capacity
        for picks in reversed(choice):
            if picks[c] >= 0:
                column[picks[c]] += 1
                c -= int(sizes[picks[c]])
        step = inverse @ column
        ratio = np.full(k, np.inf)
        np.divide(amounts, step, out=ratio, where=step > 1e-9)
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        basis[:, leaves] = column
        if pivot % 50 == 49:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[leaves] / step[leaves]
            inverse = inverse - np.outer(step, row)
            inverse[leaves] = row
        amounts = np.maximum(inverse @ wanted, 0.0)
    return [(float(amounts[i]), basis[:, i].astype(int)) for i in range(k)]


def plan(lengths: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> list[tuple[int, tuple[int, ...]]]:
    """(copies, lengths) of the sequences for ``lengths`` (length to number of documents).

    Linear grouping: the large lengths, in descending order, are cut into groups of equal cardinality and rounded up
    to the largest of their group; the configurations of these few sizes are optimised; whole numbers of them get
    the actual documents of each group, the longest first; what the whole numbers leave over and then the small
    ones go, longest first, where least room is left. The input has at most ``capacity`` entries, whatever the
    number of documents, and so has this function's work.
    """
    bins = Bins(capacity)
    bins.add(lengths.get(capacity, 0), (capacity,))
    large = [(n, c) for n, c in sorted(lengths.items(), reverse=True) if small * capacity < n < capacity and c]
    total = sum(c for _, c in large)
    k = min(groups, len(large))
    runs: list[list[list[int]]] = [[] for _ in range(k)]
    done = 0
    for length, count in large:
        while count:
            g = min(done * k // total, k - 1)
            take = min(count, -(-(g + 1) * total // k) - done) if g < k - 1 else count
            runs[g].append([length, take])
            done, count = done + take, count - take
    runs = [r for r in runs if r]
    if runs:
        sizes = np.array([r[0][0] for r in runs])
        # Groups that round to one length are one size.
        sizes, where = np.unique(sizes, return_inverse=True)
        merged: list[list[list[int]]] = [[] for _ in sizes]
        for g, r in zip(where, runs, strict=True):
            merged[g] += r
        wanted = np.array([sum(c for _, c in r) for r in merged], dtype=float)
        for times, column in configurations(sizes, wanted, capacity):
            _fill(bins, merged, column, int(times + 1e-6))
        left = Counter()
        for r in merged:
            for length, count in r:
                left[length] += count
        for length in sorted(left, reverse=True):
            bins.best_fit(length, left[length])
    for length, count in sorted(lengths.items(), reverse=True):
        if length <= small * capacity and count:
            bins.best_fit(length, count)
    return bins.groups()


def _fill(bins: Bins, runs: list[list[list[int]]], column: np.ndarray, copies: int) -> None:
    """Puts actual documents into ``copies`` sequences with ``column`` slots of each group, all but the smallest slot.

    That one stays open: what rounding up left free is known only now, and best fit uses it.
    """
    slots = [g for g in np.flatnonzero(column) for _ in range(int(column[g]))][1:]
    if not slots:
        return
    for g in set(slots):
        copies = min(copies, sum(c for _, c in runs[g]) // int(column[g]))
    if not copies:
        return
    parts = []
    for g in slots:
        need, taken = copies, []
        while need:
            length, count = runs[g][0]
            take = min(need, count)
            taken.append((length, take))
            need -= take
            if take == count:
                runs[g].pop(0)
            else:
                runs[g][0][1] -= take
        parts.append(taken)
    at = [0] * len(parts)
    rest = [p[0][1] for p in parts]
    while copies:
        step = min(rest)
        bins.add(step, tuple(p[i][0] for p, i in zip(parts, at, strict=True)))
        copies -= step
        for i in range(len(parts)):
            rest[i] -= step
            if not rest[i] and copies:
                at[i] += 1
                rest[i] = parts[i][at[i]][1]


def places(groups: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For each length, stretches of ranks: first, how many in a sequence, offset there and first sequence."""
    used: Counter = Counter()
    rows, base = [], 0
    for copies, lengths in groups:
        offset = 0
        for length, many in sorted(Counter(lengths).items(), reverse=True):
            rows.append((length, used[length], many, offset, base))
            used[length] += copies * many
            offset += length * many
        base += copies
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(len(rows), 5)
    return dict(zip(("length", "first", "many", "offset", "base"), table.T, strict=True))


def packed(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL, tokens: bool = False, **vocabulary) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of ``docs``; ids with ``tokens``.

    Texts are tokenised once and the pieces written to the shared folder. The driver sees how many pieces have each
    length, at most ``capacity`` numbers, and plans sequences for them. A piece then takes the place that its rank
    among the pieces of its length has in the plan; ranks are running counts over hash buckets, so that a hot length
    is never one task. Empty texts are one token long. Rows without doc_id and repeated rows are packed like others.
    """
    whole = written(pieces(docs, capacity, **vocabulary))
    counts = {r[0]: r[1] for r in whole.groupBy("length").count().collect()}
    table = places(plan(counts, capacity, groups, small))
    sent = docs.sparkSession.sparkContext.broadcast(table)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if tokens else [])]
    keyed = whole.select(*columns, F.xxhash64("doc_id", "piece", "ids_crc32").alias("key"), F.lit(1).cast("long").alias("one"))
    ranked = running_before(keyed, ["length"], "key", ["doc_id", "piece", "start", "ids_crc32"], "one", "rank", bucket_bits(sum(counts.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_of = sent.value
        keys = (plan_of["length"] << 44) + plan_of["first"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            within = rank - plan_of["first"][at]
            many = plan_of["many"][at]
            sequence = plan_of["base"][at] + within // many
            offset = plan_of["offset"][at] + within % many * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"]
            )

    schema = ", ".join(f"{c} {whole.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.select(*columns, "rank").mapInArrow(run, f"{schema}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of each sequence, from ``packed(..., tokens=True)``.

    Pieces of a sequence meet in one task: at most ``capacity`` ids.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["ids"])).alias("ids")
    )
