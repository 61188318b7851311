"""Conversation repair against a search over all edits, whole and in parts."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from cdcflow.llm import conversations as C

GOOD = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, kind int, part string"


def search(kinds):
    """Least (cost, audit) by trying every edit of every turn with up to two insertions in each place."""
    best = None
    options = [
        [("D", 3, "")] if k == "x" else [("D", 3, ""), *(("R", 2 + k.isupper(), i) for i in "ua"), *([("K", int(k.isupper()), k.lower())])]
        for k in kinds
    ]
    inserts = [("", 0, ""), *(("I", 2, i) for i in "ua"), *(("II", 4, i) for i in ("ua", "au"))]
    for edits in itertools.product(*options):
        for put in itertools.product(inserts, repeat=len(kinds) + 1):
            cost = sum(e[1] for e in edits) + sum(p[1] for p in put)
            if best is not None and cost > best[0]:
                continue
            if GOOD.fullmatch(put[0][2] + "".join(e[2] + p[2] for e, p in zip(edits, put[1:]))):
                found = cost, put[0][0] + "".join(e[0] + p[0] for e, p in zip(edits, put[1:]))
                best = found if best is None else min(best, found)
    return best


def walk(kinds):
    """The same by one state after the other, for long conversations."""
    close = lambda cells: {
        q: min((cells[p][0] + c, cells[p][1] + a) for p in cells for c, a, r in [(0, "", p), *extra(p)] if r == q) for q in range(4)
        if any(r == q for p in cells for _, _, r in [(0, "", p), *extra(p)])
    }
    extra = lambda p: [(2, "I", 3), (4, "II", 2)] if p == 2 else [(2, "I", 2), (4, "II", 3)]
    cells = close({0: (0, "")})
    for k in kinds:
        after = {}
        for p, (cost, audit) in cells.items():
            moves = [(3, "D", p)]
            if k != "x":
                cut = int(k.isupper())
                moves += [(2 + cut, "R", q) for i in "ua" if (q := C.NEXT.get((p, i))) is not None]
                moves += [(cut, "K", q) for q in [C.NEXT.get((p, k.lower()))] if q is not None]
            for c, a, q in moves:
                after.setdefault(q, []).append((cost + c, audit + a))
        cells = close({q: min(v) for q, v in after.items()})
    return min(cells[q] for q in (0, 3) if q in cells) if kinds else (0, "")


def report(rows, damage):
    """The contract's rows for (conv_id, turn, role, text), turn by turn."""
    out = []
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            if way:
                role = "user" if way == 4 else role
                text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
                turns += [(turn, role, text)] * (2 if way == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0], hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()))
        seen, kinds, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            kinds += "x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        days = {t[0] for t in turns} - {None}
        cost, audit = walk(kinds)
        out.append(
            (conv, max(days) - min(days) + 1 - len(days) if days else 0, *faults.values(), illegal, cost, audit, hashlib.sha256(fixed(audit, turns).encode()).hexdigest())
        )
    return sorted(out, key=repr)


def fixed(audit, turns):
    lines, rest = [], iter(turns)
    for e in audit:
        role, text = next(rest)[1:] if e != "I" else ("", "")
        if e == "D":
            continue
        if e != "K":
            role = "assistant" if lines and lines[-1].startswith("u") else "user"
        lines.append(f"{role}:{text}")
    assert GOOD.fullmatch("".join(x[0] for x in lines))
    return "\n".join(lines)


def result(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "own") for r in rows], SCHEMA)


def made(rng, conv, n):
    """Turns with every fault: blank, repeated, cut off, of odd roles, without number."""
    rows = []
    for turn in range(n):
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
        text = rng.choice(["", " \t", "Yes.", "No", "Wait... ", "ok?\n", None, f"All {turn}.", f"Cut {turn}", "é 日本。"])
        rows.append((conv, rng.choice([turn, turn, turn + 3, turn - 1, None]), role, text))
    return rows


@pytest.mark.parametrize("length", range(4))
def test_short_conversations_are_repaired_at_least_cost(length):
    for kinds in map("".join, itertools.product("xsuaoSUA", repeat=length)):
        assert C.cheapest(C.parsed(kinds), not kinds) == search(kinds) == walk(kinds), kinds


def test_the_cut_of_a_span_does_not_matter():
    rng = random.Random(6)
    for _ in range(200):
        kinds = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randint(1, 40)))
        whole = C.parsed(kinds)
        assert C.cheapest(whole, False) == walk(kinds)
        at = rng.randint(0, len(kinds))
        assert C.combined(C.parsed(kinds[:at]), C.parsed(kinds[at:])) == whole


@pytest.mark.parametrize("limits", [(C.TURNS, C.BYTES), (1, C.BYTES), (5, 30)])
def test_reports_match_a_plain_version(spark, limits):
    rng = random.Random(7)
    rows = [r for conv in range(25) for r in made(rng, conv, rng.randint(1, 30))] + made(rng, 99, 300) + made(rng, None, 12)
    rows += [(50, 1, "user", "Hi.")] * 40
    rng.shuffle(rows)
    found, _ = C.repairs(frame(spark, rows).drop("kind", "part").repartition(5), limits=limits)
    assert result(found) == report(rows, damage=False)


def test_damage_and_conversations_without_turns(spark):
    rng = random.Random(8)
    gone = [c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows = [r for conv in range(40) for r in made(rng, conv, rng.randint(1, 12))] + [(c, 0, "user", "Hi.") for c in gone] + made(rng, None, 9)
    turns = frame(spark, rows)
    assert result(C.repairs(C.damaged(turns), turns)[0]) == report(rows, damage=True)


def test_repaired_turns_are_good_conversations(spark):
    rng = random.Random(9)
    rows = [r for conv in range(10) for r in made(rng, conv, 14)]
    facts, ordered = C.repairs(frame(spark, rows))
    digests = {r["conv_id"]: r["repaired_sha256"] for r in facts.collect()}
    turns = sorted(C.repaired_turns(ordered, facts).collect(), key=lambda r: (r["conv_id"], r["place"]))
    for conv, group in itertools.groupby(turns, key=lambda r: r["conv_id"]):
        group = list(group)
        assert GOOD.fullmatch("".join(r["role"][0] for r in group)) and [r["place"] for r in group] == list(range(len(group)))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in group).encode()).hexdigest() == digests.pop(conv)
    assert set(digests.values()) <= {hashlib.sha256(b"").hexdigest()}


def test_empty_table(spark):
    turns = frame(spark, [])
    assert C.repairs(C.damaged(turns), turns)[0].collect() == []
