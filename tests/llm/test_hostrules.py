"""Counts of texts and verdicts of hosts against plain versions."""

import random
import re

import pytest

from cdcflow.llm import hostrules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, source string, text string, host string, documents long, kept boolean"


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return [len(words), sum(map(len, words)), symbols, dup, len(covered), len(lines)]


def texts():
    rng = random.Random(3)
    words = ["ab", "c", "dé", "fü", "#x", "<b>", "日本", "."]
    made = [" ".join(rng.choice(words[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    made += ["\n".join(rng.choice(["one line", " one line", "", "\t", "other"]) for _ in range(9)) for _ in range(20)]
    return [*made, "", None, "  \t\r\n", "a b c", "x " * 8, "x " * 7, "a b c d e f g h " * 2, "\x0b\x0c\x1cword"]


@pytest.mark.parametrize("chunk", [1, 300, hostrules.CHUNK])
def test_counts_match_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(hostrules, "CHUNK", chunk)
    assert hostrules.counts_of(texts()).tolist() == [brute(t) for t in texts()]


def test_counts_of_a_long_text_take_linear_time():
    rng = random.Random(4)
    text = " ".join(str(rng.randrange(50_000)) for _ in range(400_000)) + " tail" * 16
    assert hostrules.counts_of([text])[0, 4] == 16


def docs_of(spark, hosts):
    """``hosts``: name to (good, short) numbers of documents."""
    rng = random.Random(5)
    good = lambda: " ".join(str(rng.random()) for _ in range(25))
    rows = []
    for name, (fine, bad) in hosts.items():
        rows += [(len(rows) + i, name, good(), "x", 1, False) for i in range(fine)]
        rows += [(len(rows) + i, name, "too short", None, 1, None) for i in range(bad)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def verdicts(df, **options):
    found = hostrules.judged(df, **options).collect()
    assert all(r["kept"] == (r["host_kept"] and not r["base_failed"]) for r in found)
    return {r["host"]: r["host_kept"] for r in found}, found


def test_hosts_are_judged_by_shrunk_rates(spark):
    hosts = {f"fine{i}": (40, 1) for i in range(10)} | {"bad": (5, 60), "tiny": (0, 1), "mixed": (30, 20), None: (3, 9)}
    found, rows = verdicts(docs_of(spark, hosts))
    assert found.pop("bad") is False
    # One failing document says little about its host, and no host is no evidence.
    assert all(found.values()) and len(rows) == 10 * 41 + 65 + 1 + 50 + 12
    assert sum(r["kept"] for r in rows) == 10 * 40 + 30 + 3


def test_every_host_light_or_heavy_gets_its_verdict(spark, monkeypatch):
    hosts = {f"h{i}": (3, 0) for i in range(40)} | {"bad": (1, 30), "hot": (400, 10)}
    expected, _ = verdicts(docs_of(spark, hosts))
    for heavy in (1, 10, 10**9):
        monkeypatch.setattr(hostrules, "HEAVY", heavy)
        assert verdicts(docs_of(spark, hosts))[0] == expected


def test_prior_follows_how_much_hosts_differ():
    mean, strength = hostrules.prior(4, 400, 40_000.0, 40, 4 * 100 / 100)
    assert mean == 0.1 and strength == float("inf")
    mean, strength = hostrules.prior(4, 400, 40_000.0, 100, 100.0)
    assert mean == 0.25 and strength == pytest.approx(0.0)
    even, wide = (hostrules.prior(3, 300, 30_000.0, f, s)[1] for f, s in ((60, (10**2 + 20**2 + 30**2) / 100), (60, (2**2 + 8**2 + 50**2) / 100)))
    assert wide < even < float("inf")


def test_no_rows_no_hosts(spark):
    assert hostrules.judged(docs_of(spark, {})).collect() == []
    found, rows = verdicts(docs_of(spark, {None: (2, 1)}))
    assert found == {None: True} and sorted(r["kept"] for r in rows) == [False, True, True]
    found, rows = verdicts(docs_of(spark, {"only": (0, 3)}))
    assert found == {"only": False}


def test_null_columns_and_repeated_rows(spark):
    rows = [(None, None, None, None, None, None)] * 2 + [(1, "a", "w " * 30, "z", 5, True)] * 3
    found = hostrules.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), r["n_repeat_words"], r["base_failed"]) for r in found) == [("1", 30, True)] * 3 + [("None", 0, True)] * 2
