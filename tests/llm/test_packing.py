"""Pieces against the tokenizer, plans against their bounds, places against the contract."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cdcflow.llm import packing
from cdcflow.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, length long, rank string"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = [
    "", None, "a", " lead and  double ", "tab\tand\n\nlines\r\n", "it's we'll 12345 ½ ² Ⅷ", "é́ ñ ü ß 漢字 \U0001f600", "<|endoftext|> x <|endoftext|>",
    "\x00\x1c\x85   odd", "###&&&$$$ %%% !!!", "UPPER lower", "a​b", "x" * 3000, "many words " * 5000,
]


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_both_libraries_give_the_same_ids():
    slow = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    fast = Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in TEXTS:
        wanted = np.array(ids_of(text), dtype="<u4").tobytes()
        assert slow.encode(text or "") == wanted and fast.encode(text or "") == wanted


def check(placed, rows, capacity=2048):
    """Every document's ids are there once, sequences are gapless and full enough; returns their number."""
    docs = {}
    for doc_id, text, *_ in rows:
        docs.setdefault(doc_id, []).append(ids_of(text) + [0])
    sequences = {}
    for p in placed:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        (ids, *_) = docs[p["doc_id"]]
        part = ids[p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] <= capacity
        assert p["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    wanted = Counter()
    for doc_id, copies in docs.items():
        n = len(copies[0])
        first = n % capacity or capacity
        starts = [0, *range(first, n, capacity)]
        wanted += Counter({(doc_id, i, s): len(copies) for i, s in enumerate(starts)})
    assert Counter((p["doc_id"], p["piece"], p["start"]) for p in placed) == wanted
    return len(sequences)


def test_documents_are_packed(spark):
    r = random.Random(1)
    rows = [(i, t, 1, "") for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(f"word{r.randrange(900)}" for _ in range(r.choice((1, 20, 150, 400, 900)))), 2, "") for i in range(150)]
    rows += [rows[-1], (None, "no id", None, None)]
    placed = packing.packed(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    used = check(placed, rows)
    total = sum(len(ids_of(t)) + 1 for _, t, *_ in rows)
    assert used <= 1.03 * math.ceil(total / 2048) + 1


def test_small_capacity_and_assembled_sequences(spark):
    rows = [(i, "a b c d e f g"[: 2 * i + 1], 0, "") for i in range(7)] + [(50, "x y z " * 20, 0, "")]
    placed = packing.packed(spark.createDataFrame(rows, SCHEMA), capacity=8, tokens=True)
    check(placed.collect(), rows, 8)
    whole = packing.sequences(placed).collect()
    parts = {}
    for p in placed.collect():
        parts.setdefault(p["sequence_id"], []).append((p["offset"], bytes(p["ids"])))
    for s in whole:
        assert bytes(s["ids"]) == b"".join(x for _, x in sorted(parts[s["sequence_id"]])) and len(s["ids"]) == 4 * s["length"]


def test_no_rows(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_all_documents_in_few_sequences(seed):
    r = random.Random(seed)
    top = (2048, 2048, 700, 2047, 1100, 300)[seed]
    lengths = Counter(max(1, min(top, int(r.lognormvariate(6, 1.2)))) for _ in range(r.choice((5, 300, 5000))))
    groups = packing.plan(dict(lengths))
    held = Counter()
    for copies, parts in groups:
        assert sum(parts) <= 2048
        held.update({n: copies * m for n, m in Counter(parts).items()})
    assert held == lengths
    least = math.ceil(sum(n * c for n, c in lengths.items()) / 2048)
    greedy = packing.Bins(2048)
    for n in sorted(lengths, reverse=True):
        greedy.best_fit(n, lengths[n])
    assert sum(c for c, _ in groups) <= max(1.005 * sum(c for c, _ in greedy.groups()), least) + 1


def test_configurations_solve_the_program():
    """Sizes 1000 and 700 of capacity 2048, 30 of each: 10 times (1000, 1000), ... no fewer than the volume bound."""
    found = packing.configurations(np.array([700, 1000]), np.array([30.0, 30.0]), 2048)
    assert sum(t for t, _ in found) == pytest.approx(30 / 2 + 30 / 2)
    for size, wanted in ((0, 30), (1, 30)):
        assert sum(t * c[size] for t, c in found) == pytest.approx(wanted)


def test_places_cover_every_rank():
    lengths = {2048: 3, 1000: 7, 500: 9, 24: 40, 1: 5}
    table = packing.places(packing.plan(lengths))
    for n, count in lengths.items():
        mine = table["length"] == n
        firsts = table["first"][mine]
        assert firsts[0] == 0 and (np.diff(firsts) > 0).all() and firsts[-1] < count
