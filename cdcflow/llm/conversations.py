"""Conversation repair by weighted interval parsing.

A good conversation has the roles ``(s?(ua)+)?`` by their initials. Its grammar is kept in Chomsky normal form with one
nonterminal for each way a span can lead the alternation from one state to another: X[p,q] becomes a single turn, edited
in one of the allowed ways, or X[p,r] X[r,q]. A cell of the chart holds, for one span of turns and each nonterminal,
the least (cost, audit) of all repairs of that span; audits are the initials of the edits and break ties. Inserted turns
belong to no position: the cells of single turns are closed under insertion on both sides, and spans inherit that.

Spans are combined bottom-up by length: 1, 2, 4 and so on. As the nonterminals are pairs of states, X[p,r] X[r,q] over
all r gives the same cell wherever a span is cut, so each span is cut once and a conversation of n turns takes n - 1
combinations. The same rule joins spans that different tasks parsed.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cdcflow.llm.common import partitions
from cdcflow.session import written

#: Costs of the edits, initials of the roles, white space, ends of a whole sentence.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
SPACES, ENDS, LEGAL = b" \t\n\v\f\r", b".!?", (b"su", b"ua", b"au")
#: States: nothing yet, after system, after user, after assistant. A repair ends in the first or the last.
START, PRIMED, ASKED, ANSWERED = range(4)
NEXT = {(START, "s"): PRIMED, **{(p, "u"): ASKED for p in (START, PRIMED, ANSWERED)}, (ASKED, "a"): ANSWERED}
#: Turns and bytes of text of one conversation that a task holds; longer ones are parsed part by part.
TURNS, BYTES = 50_000, 32 << 20
#: Spans of up to so many turns are parsed once and remembered.
REMEMBERED = 16

Cell = list  # sixteen entries (cost, audit) or None, X[p,q] at 4 * p + q


def _combinations() -> list[tuple[int, list[tuple[int, int]]]]:
    """For each nonterminal the pairs it may become; states are only reached from states before them."""
    reach = {(p, p) for p in range(4)} | {(START, q) for q in range(4)} | {(PRIMED, ASKED), (PRIMED, ANSWERED), (ASKED, ANSWERED), (ANSWERED, ASKED)}
    return [(4 * p + q, [(4 * p + r, 4 * r + q) for r in range(4) if {(p, r), (r, q)} <= reach]) for p, q in sorted(reach)]


COMBINATIONS = _combinations()


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: Cell = [None] * 16
    for whole, cuts in COMBINATIONS:
        best = None
        for i, j in cuts:
            a, b = left[i], right[j]
            if a is None or b is None:
                continue
            cost = a[0] + b[0]
            if best is None or cost < best[0]:
                best = (cost, a[1] + b[1])
            elif cost == best[0]:
                best = min(best, (cost, a[1] + b[1]))
        out[whole] = best
    return out


def _insertions() -> Cell:
    """Cheapest insertions that lead from one state to another."""
    out: Cell = [None] * 16
    for p in range(4):
        state, audit = p, ""
        while out[4 * p + state] is None:
            out[4 * p + state] = (INSERT * len(audit), audit)
            state, audit = NEXT[state, "a" if state == ASKED else "u"], audit + "I"
    return out


INSERTED = _insertions()


def _turn(kind: str) -> Cell:
    """The cell of one turn: ``x`` has to go; else the initial of its role (``o`` for others), upper case if cut off."""
    out: Cell = [None] * 16
    cut = CUT if kind.isupper() else 0
    for p in range(4):
        out[4 * p + p] = (DELETE, "D")
        if kind == "x":
            continue
        for initial in "ua":
            if (p, initial) in NEXT:
                out[4 * p + NEXT[p, initial]] = (REROLE + cut, "R")
        if (p, kind.lower()) in NEXT:
            out[4 * p + NEXT[p, kind.lower()]] = (KEEP + cut, "K")
    return combined(combined(INSERTED, out), INSERTED)


KINDS = {k: _turn(k) for k in "xsuaoSUAO"}


def parsed(kinds: str, known: dict[str, Cell] | None = None) -> Cell:
    """The cell of a span of turns; ``known`` remembers short spans from one conversation to the next."""
    known = {} if known is None else known
    if not kinds:
        return INSERTED
    length = 1
    cells = [KINDS[k] for k in kinds]
    while len(cells) > 1:
        above = []
        for n in range(0, len(cells) - 1, 2):
            span = kinds[n * length : (n + 2) * length]
            if len(span) > REMEMBERED:
                above.append(combined(cells[n], cells[n + 1]))
                continue
            if span not in known:
                if len(known) > 1 << 16:
                    known.clear()
                known[span] = combined(cells[n], cells[n + 1])
            above.append(known[span])
        if len(cells) % 2:
            above.append(cells[-1])
        cells, length = above, 2 * length
    return cells[0]


def cheapest(cell: Cell, empty: bool) -> tuple[int, str]:
    """Cost and audit of the whole conversation."""
    if empty:
        return 0, ""
    return min(cell[4 * START + q] for q in (START, ANSWERED) if cell[4 * START + q] is not None)


def repaired(audit: Iterable[str], turns: Iterable[tuple[bytes, bytes]]) -> Iterator[tuple[bytes, bytes, str]]:
    """Role, text and edit of every turn that stays or is put in. The state tells which role an edit gives."""
    state, source = START, iter(turns)
    for edit in audit:
        role, text = next(source) if edit != "I" else (b"", b"")
        if edit == "D":
            continue
        if edit != "K":
            role = b"assistant" if state == ASKED else b"user"
        state = NEXT[state, role[:1].decode("latin-1")]
        yield role, text, edit


@dataclass
class Span:
    """Consecutive turns of one conversation: what is known of them, and the turns while they are held."""

    conv: int | None
    kinds: list[str] = field(default_factory=list)
    turns: list[tuple[bytes, bytes]] = field(default_factory=list)
    size: int = 0
    faults: list[int] = field(default_factory=lambda: [0, 0, 0])
    illegal: int = 0
    ends: tuple[bytes, bytes] | None = None
    days: list = field(default_factory=lambda: [None, None, 0])

    def add(self, turn: int | None, role: bytes, text: bytes, first: bool) -> None:
        held = text.strip(SPACES)
        fault = 0 if not held else 1 if not first else 2 if held[-1:] not in ENDS else None
        initial = role[:1]
        if fault is not None:
            self.faults[fault] += 1
        kind = initial.decode("latin-1") if initial in (b"s", b"u", b"a") else "o"
        self.kinds.append("x" if fault in (0, 1) else kind.upper() if fault == 2 else kind)
        self.illegal += self.ends is not None and self.ends[1] + initial not in LEGAL
        self.ends = (initial if self.ends is None else self.ends[0], initial)
        if turn is not None:
            low, high, n = self.days
            self.days = [turn if low is None else low, turn, n + (turn != high)]
        self.turns.append((role, text))
        self.size += len(role) + len(text)


def gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else min(high - low + 1 - distinct, (1 << 63) - 1)


FACTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PARTS = "part long, first_role binary, last_role binary, low long, high long, days long, costs array<long>, audits array<string>"


def _done(span: Span, known: dict[str, Cell]) -> dict:
    cost, audit = cheapest(parsed("".join(span.kinds), known), not span.kinds)
    digest = hashlib.sha256(b"\n".join(r + b":" + t for r, t, _ in repaired(audit, span.turns))).hexdigest()
    return {"cost": cost, "audit": audit, "repaired_sha256": digest, "gaps": gaps(*span.days)}


def _part(span: Span, number: int, known: dict[str, Cell]) -> dict:
    cell = parsed("".join(span.kinds), known)
    low, high, days = span.days
    ends = span.ends or (None, None)
    return {
        "part": number, "first_role": ends[0], "last_role": ends[1], "low": low, "high": high, "days": days,
        "costs": [-1 if c is None else c[0] for c in cell], "audits": ["" if c is None else c[1] for c in cell],
    }


def _spans(batches: Iterator[pa.RecordBatch], limits: tuple[int, int]) -> Iterator[tuple[Span, bool]]:
    """The conversations of a sorted task and whether each is surely whole: the first, the last and long ones are not."""
    span, inner, first = None, False, False
    for batch in batches:
        for conv, turn, kind, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if span is None or conv != span.conv:
                if span is not None:
                    yield span, inner
                inner, span = span is not None, Span(conv)
                first = False
            if kind == 1:
                first = True
            elif kind == 2:
                if span.kinds and (len(span.kinds) >= limits[0] or span.size >= limits[1]):
                    yield span, False
                    span, inner = Span(conv), False
                span.add(turn, role, text, first)
                first = False
    if span is not None:
        yield span, False


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, 1_000)):
        yield pa.RecordBatch.from_pylist(some, schema)


_TYPES = {
    "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in schema.split(", "))])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that tells by ``crc32(conv_id:turn) % 20``; nulls are one space.

    0 drops a row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats the row, 4 sets its role to user.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    return (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            name("role").alias("role"), name("text").alias("text"), way.alias("way"),
        )
        .where("way <> 0")
        .select(
            "conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


ORDER = ["turn", "digest", "row"]


def ordered(turns: DataFrame) -> DataFrame:
    """``turns`` with a digest of role and text and a number of its own for every row, in the shared folder.

    Turns of one number stand in the order of that digest, so equal ones are neighbours and it does not matter which
    of them is which; their own numbers let a range sort cut between them.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return written(
        turns.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.cast("binary").alias("role"),
            text.cast("binary").alias("text"), digest.alias("digest"), F.monotonically_increasing_id().alias("row"),
        )
    )


def repairs(turns: DataFrame, ids: DataFrame | None = None, *, limits: tuple[int, int] = (TURNS, BYTES)) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation and its cheapest repair; and the turns in the order they were read.

    The first frame has conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 for every
    conversation of ``turns`` (conv_id, turn, role, text), and of ``ids`` (conv_id) if given: those without turns have
    zeros, an empty audit and the hash of nothing. Null roles and texts are one space; rows without conv_id are one
    conversation; rows without turn come first and have no part in gaps; equal turns are in a fixed order; repeated
    rows are duplicates; an empty table gives no rows; other columns are not looked at.

    Turns are range-sorted over whole tasks by (conversation, turn), so a conversation with a third of all turns fills
    many tasks. What a task sees whole is finished there. A conversation at a task's border, or one too long to hold,
    gives one cell for each part; the parts are joined by the rule that joins spans. Which turns repeat an earlier one
    is found by grouping, before the sort, and sorts in as a mark before the first of them. The digest of a repaired
    text reads its turns in order by nature, so for such a conversation they stream through one task, none held.
    """
    rows = ordered(turns)
    first = rows.groupBy("conv_id", "digest").agg(F.min(F.struct("turn", "row")).alias("at"))
    named = rows.select("conv_id") if ids is None else ids.select(F.col("conv_id").cast("long").alias("conv_id"))
    marks = first.select("conv_id", "at.turn", "digest", "at.row", F.lit(1).alias("kind"))
    heads = named.distinct().select("conv_id", F.lit(0).alias("kind"))
    whole = rows.withColumn("kind", F.lit(2)).unionByName(marks, allowMissingColumns=True).unionByName(heads, allowMissingColumns=True)
    keys = ["conv_id", *ORDER]
    sort = whole.repartitionByRange(partitions(rows), *keys).sortWithinPartitions(*keys, "kind")
    schema = _arrow(f"{FACTS}, repaired_sha256 string, {PARTS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Cell] = {}
        start = TaskContext.get().partitionId() << 32

        def found() -> Iterator[dict]:
            for number, (span, inner) in enumerate(_spans(batches, limits)):
                facts = dict(zip(("blank", "duplicate", "truncated"), span.faults, strict=True))
                more = _done(span, known) if inner else _part(span, start + number, known)
                yield {"conv_id": span.conv, **facts, "illegal": span.illegal, **more}

        yield from _batched(found(), schema)

    picked = sort.select("conv_id", "turn", "kind", "role", "text")
    out = written(picked.mapInArrow(run, f"{FACTS}, repaired_sha256 string, {PARTS}"))
    answer = ["conv_id", *(f.split()[0] for f in FACTS.split(", ")[1:]), "repaired_sha256"]
    joined = written(_joined(out.where("part is not null")))
    return out.where("part is null").select(*answer).unionByName(digested(rows, joined).select(*answer)), rows


def _joined(parts: DataFrame) -> DataFrame:
    """Facts, cost and audit of conversations that come in parts; one part after the other, none held but the last cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())

        def found() -> Iterator[dict]:
            for conv, group in itertools.groupby(rows, key=lambda r: r["conv_id"]):
                cell, empty, last, days, out = INSERTED, True, None, [None, None, 0], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
                for r in group:
                    if r["first_role"] is None:
                        continue
                    for name in out:
                        out[name] += r[name]
                    if not empty:
                        out["illegal"] += last + r["first_role"] not in LEGAL
                    here = [None if c < 0 else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)]
                    cell, last, empty = here if empty else combined(cell, here), r["last_role"], False
                    if r["low"] is not None:
                        met = days[2] + r["days"] - (days[1] == r["low"])
                        days = [r["low"] if days[0] is None else days[0], r["high"], met]
                cost, audit = cheapest(cell, empty)
                yield {"conv_id": conv, **out, "gaps": gaps(*days), "cost": cost, "audit": audit}

        yield from _batched(found(), _arrow(FACTS))

    dealt = parts.repartition(partitions(parts), "conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(run, FACTS)


def _with_audits(rows: DataFrame, facts: DataFrame, each: Callable[[dict, Iterator], Iterator[dict]], schema: str) -> DataFrame:
    """``each`` applied to the facts of every conversation and its turns, which stream by in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))

        def found() -> Iterator[dict]:
            for conv, group in itertools.groupby(source, key=lambda r: r[0]):
                head = next(group)
                yield from each({"conv_id": conv, **head[3]}, ((r[1], r[2]) for r in group))

        yield from _batched(found(), _arrow(schema))

    names = [c for c in facts.columns if c != "conv_id"]
    heads = facts.select("conv_id", F.lit(0).alias("kind"), F.struct(*names).alias("facts"))
    whole = rows.withColumn("kind", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    sort = whole.repartition(partitions(rows), "conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    return sort.select("conv_id", "role", "text", "facts").mapInArrow(run, schema)


def digested(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``facts`` with the hash of each repaired text, read turn by turn.

    ``facts`` are conversations that came in parts: at most two for each task of the sort and one for each BYTES of
    text or TURNS rows. So many ids are broadcast to pick their turns.
    """
    picked = facts.select(F.col("conv_id").alias("of"))
    mine = rows.join(F.broadcast(picked), rows.conv_id.eqNullSafe(picked.of), "left_semi")

    def each(fact: dict, turns: Iterator[tuple[bytes, bytes]]) -> Iterator[dict]:
        digest, mark = hashlib.sha256(), b""
        for role, text, _ in repaired(fact["audit"], turns):
            digest.update(mark + role + b":" + text)
            mark = b"\n"
        yield {**fact, "repaired_sha256": digest.hexdigest()}

    return _with_audits(mine, facts, each, f"{FACTS}, repaired_sha256 string")


def repaired_turns(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text and edit (K, R or I) of each of their turns.

    ``rows`` and ``facts`` are what ``repairs`` returns.
    """

    def each(fact: dict, turns: Iterator[tuple[bytes, bytes]]) -> Iterator[dict]:
        for place, (role, text, edit) in enumerate(repaired(fact["audit"], turns)):
            yield {"conv_id": fact["conv_id"], "place": place, "role": role, "text": text, "edit": edit}

    found = _with_audits(rows, facts.select("conv_id", "audit"), each, "conv_id long, place long, role binary, text binary, edit string")
    return found.withColumns({c: F.col(c).cast("string") for c in ("role", "text")})
