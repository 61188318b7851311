"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from cdcflow.llm.common import fresh, partitions
from cdcflow.llm.components import connected
from cdcflow.session import written

#: Rows of one side that a comparison task holds at once, and comparisons made in one numpy call.
STRIP, CELLS = 32_768, 1 << 20
#: The same where rows carry their parity, and the shingles of one side that a task counts at once, 16 MB of hashes.
OPEN_STRIP, SHINGLES = 8_192, 2_000_000
#: Columns of a text's parity, 64 bits each, and of the rows that are still to be compared.
PARITY = [f"p{i}" for i in range(8)]
OPEN = ["pair", "left", "right", "left_block", "right_block", "side", "node"]
#: Bits kept for each tile coordinate; coordinates are shifted so that neighbours stay positive.
SHIFT, BASE = 10, 64


def shingle_hashes(words: list[bytes], shingle: int, bits: int, start: int, stop: int) -> np.ndarray:
    """Hash words (uint64, ``bits`` / 64 for each shingle) of shingles start to stop."""
    if bits == 64:
        h = xxhash.xxh64_digest
        found = b"".join(h(b" ".join(words[i : i + shingle]), 42) for i in range(start, stop))
    else:
        h = xxhash.xxh3_128_digest
        found = b"".join(h(b" ".join(words[i : i + shingle]), 42) for i in range(start, stop))
    return np.frombuffer(found, dtype=np.uint8).reshape(stop - start, bits // 8)


def fingerprint(text: str | None, shingle: int = 3, bits: int = 64) -> tuple[list[int], int]:
    """The fingerprint as 64-bit words, most significant first, and the number of shingles.

    A-Z are lower-cased; words are runs without ASCII white space; a text with fewer words than a shingle is one
    shingle; a text without words (or null) has fingerprint zero and no shingles. A bit is 1 if it is set in more
    than half of the shingles' hashes, repeats included. The text is taken whole, whatever its length.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    if not n:
        return [0] * (bits // 64), 0
    ones = np.zeros(bits, dtype=np.int64)
    for start in range(0, n, 32_768):
        hashes = shingle_hashes(words, shingle, bits, start, min(n, start + 32_768))
        ones += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.uint32)
    packed = np.packbits(ones * 2 > n)
    return [int(x) for x in packed.view(">u8")], n


def fingerprints(docs: DataFrame, shingle: int = 3, bits: int = 64) -> DataFrame:
    """doc_id, f (the fingerprint's 64-bit words as signed longs) and n (shingles) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle, bits) for t in batch.column(1)]
            words = np.array([f for f, _ in found], dtype=np.uint64).astype(np.int64).reshape(len(found), bits // 64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(words[:, i]) for i in range(bits // 64)), pa.array([n for _, n in found], pa.int64())],
                ["doc_id", *(f"f{i}" for i in range(bits // 64)), "n"],
            )

    schema = ", ".join(["doc_id long", *(f"f{i} long" for i in range(bits // 64)), "n long"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def tile_offsets(parts: int, width: int, radius: int) -> list[tuple[int, ...]]:
    """Steps between tiles whose population counts can differ by at most ``radius`` in all; half of them, with zero."""
    reach = math.ceil(radius / width)
    gap = lambda d: max(0, (abs(d) - 1) * width + 1) if d else 0
    steps = itertools.product(range(-reach, reach + 1), repeat=parts)
    return [s for s in steps if sum(map(gap, s)) <= radius and s >= (0,) * parts]


def _coordinates(bits: int, parts: int, width: int) -> list[Column]:
    """Population counts of ``parts`` stretches of the fingerprint, in units of ``width``."""
    if parts == 1:
        total = sum((F.bit_count(F.col(f"f{i}")) for i in range(1, bits // 64)), F.bit_count(F.col("f0")))
        return [F.floor(total / width).cast("long")]
    edges = [64 * i // parts for i in range(parts + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return [F.bit_count(F.col("f0").bitwiseAND(F.lit(m).cast("long"))).cast("long") for m in signed]


def near_links(nodes: DataFrame, bits: int, radius: int, ratio: float, strip: int = STRIP) -> DataFrame:
    """Links (u, v) that join all nodes with fingerprints within ``radius`` bits; ``nodes``: node, f0.., n.

    With ``ratio`` above 0 two nodes are linked only if the smaller shingle count is at least that share of the
    larger one. A tile holds the nodes of equal population counts (of three stretches of a 64-bit fingerprint, or of
    the whole in units of radius + 1) and of one class of shingle counts. Tiles are compared exactly, by exclusive
    or and bit counts, with themselves and with those tiles whose counts are within the radius; all others are
    skipped. Large tiles are cut into strips, so that a task holds two strips whatever the input. A task returns a
    spanning forest of the links it finds: no more rows than nodes, with the same components; each is a pair within
    the radius, and closer pairs come first.
    """
    kind = _Kind(bits // 64, radius, ratio, sum(c in PARITY for c in nodes.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _groups(batches, 3):
            u, v = _forest(columns, kind)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return _in_tiles(nodes, bits, radius, ratio, strip).mapInArrow(run, "u long, v long")


def _in_tiles(nodes: DataFrame, bits: int, radius: int, ratio: float, strip: int) -> DataFrame:
    """pair, left, right, side and the nodes' columns: each row once for every strip it has to be compared with."""
    parts, width = (3, 1) if bits == 64 and radius <= 8 else (1, radius + 1)
    step = math.log(1 / ratio) if ratio > 0 else 0.0
    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / step).cast("long") if step else F.lit(0).cast("long")
    coordinates = [band, *_coordinates(bits, parts, width)]
    place = lambda values: sum((v * F.lit(1 << SHIFT * i).cast("long") for i, v in enumerate(values[1:], 1)), values[0])
    fields = [f"f{i}" for i in range(bits // 64)]
    more = [c for c in nodes.columns if c in PARITY or c == "label"]
    tiled = nodes.select("node", *fields, "n", *more, place([c + BASE for c in coordinates]).alias("tile"))
    # At most 65 ** 3 tiles, or some dozens: the fingerprint's length bounds this table, whatever the input.
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / strip).cast("int").alias("strips"))
    pops = tile_offsets(parts, width, radius)
    steps = sorted({(b, *p) for p in pops for b in ((-1, 0, 1) if step else (0,)) if (p, b) >= ((0,) * parts, 0)})
    moves = [sum(s << SHIFT * i for i, s in enumerate(d)) for d in steps]
    sides = F.array(
        *(
            F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), F.lit(m if side == 0 else -m).cast("long").alias("move"))
            for k, m in enumerate(moves)
            for side in (0, 1)
        )
    )
    own = sizes.select(F.col("tile").alias("own_tile"), F.col("strips").alias("own"))
    other = sizes.select(F.col("tile").alias("other_tile"), F.col("strips").alias("other"))
    placed = (
        tiled.withColumn("s", F.explode(sides))
        .withColumn("to", F.col("tile") + F.col("s.move"))
        .join(F.broadcast(own), F.col("tile") == F.col("own_tile"))
        .join(F.broadcast(other), F.col("to") == F.col("other_tile"))
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))
        .withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
        .select(
            (F.when(F.col("s.side") == 0, F.col("tile")).otherwise(F.col("to")) * 64 + F.col("s.k")).alias("pair"),
            F.when(F.col("s.side") == 0, F.col("mine")).otherwise(F.col("theirs")).alias("left"),
            F.when(F.col("s.side") == 0, F.col("theirs")).otherwise(F.col("mine")).alias("right"),
            F.col("s.side").alias("side"),
            "node",
            *fields,
            "n",
            *more,
        )
    )
    group = ["pair", "left", "right"]
    return placed.repartition(partitions(nodes), *group).sortWithinPartitions(*group)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows with equal keys; one run is held at a time."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows = batch.num_rows
        if not rows:
            continue
        change = np.zeros(rows, dtype=bool)
        for c in columns[:keys]:
            change[1:] |= c[1:] != c[:-1]
        if held and any(h[-1] != c[0] for h, c in zip(held[-1][:keys], columns[:keys], strict=True)):
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), rows]
        for a, b in itertools.pairwise(cuts):
            held.append([c[a:b] for c in columns])
            if b < rows:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


@dataclass(frozen=True)
class _Kind:
    """What pairs are wanted: words of a fingerprint, bits and share of shingles they may differ in, words of parity."""

    words: int
    radius: int
    ratio: float
    parity: int = 0


def _pairs(columns: list[np.ndarray], kind: _Kind, first: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs (a left row, a right row) within the radius, closest first, some CELLS comparisons at a time.

    ``columns`` has side, node, fingerprint, n and parity from ``first`` on. Two sets that share ``ratio`` differ in at most
    (1 - ratio) / (1 + ratio) of their sizes' sum, and in no fewer members than their parities differ in bits.
    """
    words, radius, ratio = kind.words, kind.radius, kind.ratio
    side = columns[first]
    prints = [c.astype(np.int64).view(np.uint64) for c in columns[first + 2 : first + 2 + words]]
    n = columns[first + 2 + words]
    parity = [c.astype(np.int64).view(np.uint64) for c in columns[first + 3 + words : first + 3 + words + kind.parity]]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return
    rights = [p[right] for p in prints]
    rows = max(1, CELLS // len(right))
    for start in range(0, len(left), rows):
        some = left[start : start + rows]
        away = np.bitwise_count(prints[0][some][:, None] ^ rights[0][None, :])
        for p, r in zip(prints[1:], rights[1:], strict=True):
            away += np.bitwise_count(p[some][:, None] ^ r[None, :])
        i, j = np.nonzero(away <= radius)
        order = np.argsort(away[i, j], kind="stable")
        i, j = some[i[order]], right[j[order]]
        if ratio > 0 and len(i):
            fits = np.minimum(n[i], n[j]) >= ratio * np.maximum(n[i], n[j])
            i, j = i[fits], j[fits]
            if parity and len(i):
                apart = sum(np.bitwise_count(p[i] ^ p[j]).astype(np.int64) for p in parity)
                fits = apart * (1 + ratio) <= (n[i] + n[j]) * (1 - ratio) + 1e-6
                i, j = i[fits], j[fits]
        yield i, j


def _forest(columns: list[np.ndarray], kind: _Kind) -> tuple[list[int], list[int]]:
    node = columns[4]
    ids, place = np.unique(node, return_inverse=True)
    parent = np.arange(len(ids))
    out_u: list[int] = []
    out_v: list[int] = []
    for i, j in _pairs(columns, kind):
        a, b = _roots(parent, place[i]), _roots(parent, place[j])
        apart = np.flatnonzero(a != b)
        # Of the pairs that join the same two trees the closest is enough.
        ends = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[apart]
        first = np.sort(np.unique(ends, axis=0, return_index=True)[1]) if len(apart) else apart
        for at in apart[first].tolist():
            x, y = _root(parent, a[at]), _root(parent, b[at])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out_u.append(int(node[i[at]]))
                out_v.append(int(node[j[at]]))
    return out_u, out_v


def _open(columns: list[np.ndarray], kind: _Kind, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the rows that have a partner of another label, and the left and right block where they meet one.

    Blocks hold about ``most`` shingles. Rows are put into blocks by what they may be joined with, so that few blocks
    have to meet; a row is named once for each block of the other side with a partner of its own.
    """
    label, n, side = columns[-1], columns[5 + kind.words], columns[3]
    parent = np.arange(len(side))
    met = np.zeros(len(side), dtype=bool)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in _pairs(columns, kind):
            apart = label[i] != label[j]
            yield i[apart], j[apart]

    for i, j in pairs():
        met[i] = met[j] = True
        a, b = _roots(parent, i), _roots(parent, j)
        for x, y in np.unique(np.stack([a, b], axis=1)[a != b], axis=0).tolist():
            x, y = _root(parent, x), _root(parent, y)
            parent[max(x, y)] = min(x, y)
    block = np.zeros(len(side), dtype=np.int64)
    group = _roots(parent, np.arange(len(side)))
    for s in (0, 1):
        mine = np.flatnonzero(met & (side == s))
        mine = mine[np.argsort(group[mine], kind="stable")]
        block[mine] = np.cumsum(n[mine]) // most
    wide = int(block.max(initial=0)) + 1
    if wide == 1:
        where = np.flatnonzero(met)
        return where, np.zeros(len(where), dtype=np.int64), np.zeros(len(where), dtype=np.int64)
    meets = set()
    for i, j in pairs():
        meets.update(np.unique(i * wide + block[j]).tolist(), np.unique(j * wide + block[i]).tolist())
    where, other = np.divmod(np.array(sorted(meets), dtype=np.int64), wide)
    left = side[where] == 0
    return where, np.where(left, block[where], other), np.where(left, other, block[where])


def _verified(columns: list[np.ndarray], kind: _Kind) -> tuple[list[int], list[int]]:
    """Links between rows that share enough shingles, as few as join their labels; ``columns`` end in label and shingles.

    A pair whose labels are joined already is not looked at; every other one within the radius is counted exactly.
    """
    node, label, has = columns[6], columns[-2], columns[-1]
    names, place = np.unique(label, return_inverse=True)
    parent = np.arange(len(names))
    out_u: list[int] = []
    out_v: list[int] = []
    for i, j in _pairs(columns, kind, 5):
        a, b = _roots(parent, place[i]), _roots(parent, place[j])
        for at in np.flatnonzero(a != b).tolist():
            x, y = _root(parent, a[at]), _root(parent, b[at])
            if x == y:
                continue
            u, v = has[i[at]], has[j[at]]
            if len(u) > len(v):
                u, v = v, u
            common = int((v[np.minimum(v.searchsorted(u), len(v) - 1)] == u).sum()) if len(u) else 0
            if common >= kind.ratio * (len(u) + len(v) - common):
                parent[max(x, y)] = min(x, y)
                out_u.append(int(node[i[at]]))
                out_v.append(int(node[j[at]]))
    return out_u, out_v


def _root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return int(x)


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 64, radius: int = 2, ratio: float = 0.0) -> DataFrame:
    """doc_id, f0.., n and component_id (smallest doc_id reachable over links) for every row of ``docs``.

    Rows of one fingerprint (and, with ``ratio``, one shingle count) are one class from the start, so exact copies
    are counted, not compared. Texts without words share fingerprint zero. A row without doc_id takes no part: its
    component is that of the class it falls in, or null. Repeated rows are returned as often as they come.
    """
    prints = written(fingerprints(docs, shingle, bits))
    fields = [f"f{i}" for i in range(bits // 64)]
    alike = [*fields, "n"] if ratio > 0 else fields
    classes = written(prints.groupBy(*alike).agg(F.min("doc_id").alias("node"), F.max("n").alias("size")))
    nodes = classes.where("node is not null").select("node", *fields, F.col("size").alias("n"))
    # Where one doc_id has several texts, its classes share a node and so a component.
    labels = connected(near_links(nodes, bits, radius, ratio)).withColumnRenamed("node", "linked")
    named = classes.join(labels, classes.node == labels.linked, "left").select(
        *(F.col(c).alias(f"class_{c}") for c in alike), F.coalesce("component", "node").alias("component_id")
    )
    test = [F.col(c) == F.col(f"class_{c}") for c in alike]
    return prints.join(named, test).select("doc_id", *fields, "n", "component_id")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Hashes (128 bits, as two words) of the distinct shingles of a text, sorted; a text without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(shingle_hashes(words, shingle, 128, 0, n).view(">u8").astype(np.uint64), axis=0)


def shingle_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, mark, f0, f1, n, d0, d1 and PARITY of every row of ``docs`` (doc_id, mark, text): each distinct shingle counts once.

    f0 and f1 are the SimHash, n the number of distinct shingles; d0 and d1 are a digest of all of them. The parity says
    of each of 512 classes of shingles whether the text has an odd number of them.
    """
    names = ["f0", "f1", "n", "d0", "d1", *PARITY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, len(names)), dtype=np.uint64)
            for i, text in enumerate(batch.column(2)):
                hashes = shingle_set(text.as_py(), shingle)
                ones = np.zeros(128, dtype=np.int64)
                for start in range(0, len(hashes), 32_768):
                    some = hashes[start : start + 32_768].astype(">u8").view(np.uint8).reshape(-1, 16)
                    ones += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.uint32)
                found[i, :2] = np.packbits(ones * 2 > len(hashes)).view(">u8")
                found[i, 2] = len(hashes)
                found[i, 3:5] = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes(), 42), dtype=np.uint64)
                odd = np.bincount((hashes[:, 1] % np.uint64(64 * len(PARITY))).astype(np.int64), minlength=64 * len(PARITY)) & 1
                found[i, 5:] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
            words = [pa.array(found[:, i].astype(np.int64)) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *words], ["doc_id", "mark", *names])

    return docs.select("doc_id", "mark", "text").mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "mark", *names)))


def shingle_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """node and its distinct shingles (64-bit hashes, sorted) for the distinct ``nodes`` (node); only their texts are read again.

    ``classes`` names one row (doc_id, mark) of ``docs`` for each node.
    """
    ends = nodes.select(F.col("node").alias("end")).distinct()
    wanted = classes.join(ends, classes.node == ends.end).select(
        "node", F.col("first.doc_id").alias("of"), F.col("first.mark").alias("of_mark")
    )
    # Rows that are equal in id and text come once: any of them will do.
    texts = docs.join(wanted, docs.doc_id.eqNullSafe(wanted.of) & (docs.mark == wanted.of_mark)).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.sort(shingle_set(text.as_py(), shingle)[:, 0].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([found], pa.list_(pa.int64()))], ["node", "has"])

    return written(texts.mapInArrow(run, "node long, has array<long>").dropDuplicates(["node"]))


def shared(pairs: DataFrame, sets: DataFrame, ratio: float) -> DataFrame:
    """The pairs (u, v) of nodes whose texts share at least ``ratio`` of their distinct shingles, counted exactly."""
    left, right = (sets.select(F.col("node").alias(f"{x}_node"), F.col("has").alias(f"{x}_has")) for x in "uv")
    both = pairs.join(left, F.col("u") == F.col("u_node")).join(right, F.col("v") == F.col("v_node"))
    common = both.withColumn("common", F.size(F.array_intersect("u_has", "v_has")))
    union = F.size("u_has") + F.size("v_has") - F.col("common")
    return common.where(F.col("common") >= ratio * union).select("u", "v")


def similar_links(
    classes: DataFrame, docs: DataFrame, shingle: int, radius: int, ratio: float, strip: int = STRIP, most: int = SHINGLES
) -> DataFrame:
    """Links (u, v) that join all nodes within ``radius`` bits whose texts share ``ratio`` of their shingles.

    The links of the spanning forests are checked first, which joins most of what is alike. Then tasks look for rows
    that still have a partner of another component within the radius, by fingerprint and parity, and name those rows,
    not the pairs. They come together again with their shingles, block by block of at most about ``most`` shingles a
    side, and a task counts the pairs that are still apart and returns a forest of those that share enough. So no pairs
    leave a task: large groups of texts that are alike, or nearly so, cost rows in proportion to their size.
    """
    pairs = written(near_links(classes.select("node", "f0", "f1", "n"), 128, radius, ratio, strip).distinct())
    # A forest names every node that has a partner at all, so all others are done.
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))
    sets = shingle_sets(ends, classes, docs, shingle)
    first = written(shared(pairs, sets, ratio))
    joined = connected(first).withColumnRenamed("node", "linked")
    nodes = classes.select("node", "f0", "f1", "n", *PARITY).join(sets.select("node"), "node", "left_semi")
    labelled = nodes.join(joined, nodes.node == joined.linked, "left").select(*nodes.columns, F.coalesce("component", "node").alias("label"))
    kind = _Kind(2, radius, ratio, len(PARITY))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _groups(batches, 3):
            where, left, right = _open(columns, kind, most)
            own = [pa.array(columns[c][where]) for c in range(5)]
            yield pa.RecordBatch.from_arrays([*own[:3], pa.array(left), pa.array(right), *own[3:]], OPEN)

    labelled = written(labelled)
    types = "pair long, left int, right int, left_block long, right_block long, side int, node long"
    rest = written(_in_tiles(labelled, 128, radius, ratio, min(strip, OPEN_STRIP)).mapInArrow(name, types))
    known = labelled.withColumnRenamed("node", "of")
    counted = sets.withColumnRenamed("node", "set_of")
    told = rest.join(known, rest.node == known.of).join(counted, rest.node == counted.set_of)
    group = OPEN[:5]
    met = told.select(*OPEN, "f0", "f1", "n", *PARITY, "label", "has").repartition(partitions(nodes), *group).sortWithinPartitions(*group)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _groups(batches, 5):
            u, v = _verified(columns, kind)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return first.unionByName(met.mapInArrow(verify, "u long, v long"))


def deduplicated(docs: DataFrame, shingle: int = 5, radius: int = 32, ratio: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that with the smallest doc_id.

    Two texts are near-duplicates if they share ``ratio`` of their distinct five-word shingles, counted exactly for
    all pairs whose 128-bit SimHash differs in 32 bits or fewer. Texts that share 0.8 differ in 19.4 bits with a
    deviation of 4.1, so about one such pair in a thousand is not looked at; no pair below 0.8 is linked.
    What goes is a row, named by its doc_id and a hash of its text: unlike texts with one doc_id are documents of
    their own, and equal rows are one. Among alike texts with one doc_id the first by that hash stays. Rows without
    doc_id are compared like all others and stay only where no alike row has one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    prints = written(shingle_prints(rows, shingle))
    alike = ["d0", "d1"]
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    found = prints.groupBy(*alike).agg(F.min(place).alias("first"), *(F.first(c).alias(c) for c in ("f0", "f1", "n", *PARITY)))
    classes = written(found.withColumn("node", F.monotonically_increasing_id()))
    labels = connected(similar_links(classes, rows, shingle, radius, ratio)).withColumnRenamed("node", "linked")
    named = classes.join(labels, classes.node == labels.linked, "left").withColumn("group", F.coalesce("component", "node"))
    heads = named.groupBy(F.col("group").alias("head")).agg(F.min("first").alias("stays"))
    of = named.join(heads, F.col("group") == F.col("head")).select(*(F.col(c).alias(f"class_{c}") for c in alike), "stays")
    test = [F.col(c) == F.col(f"class_{c}") for c in alike]
    placed = prints.join(of, test)
    gone = placed.where(place > F.col("stays")).select(F.col("doc_id").alias("gone"), F.col("mark").alias("gone_mark")).distinct()
    order, key, mark = fresh(docs, "_order", "_key", "_mark")
    keyed = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(mark, F.xxhash64("text"))
    kept = keyed.join(gone, F.col(key).eqNullSafe(F.col("gone")) & (F.col(mark) == F.col("gone_mark")), "left_anti")
    alone = Window.partitionBy(key, mark).orderBy("text")
    return kept.withColumn(order, F.row_number().over(alone)).where(F.col(order) == 1).select(*docs.columns)
