"""Fingerprints, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cdcflow.llm import simhash
from cdcflow.llm.components import connected

SCHEMA = "doc_id long, text string, f0 string, component_id string"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=2):
    prints = [plain_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius or rows[i][0] == rows[j][0]:
                up[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted((d, f"{prints[i]:016x}", least[root(i)]) for i, (d, _) in enumerate(rows))


def some_rows(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(60):
        text = [r.choice(words) for _ in range(r.choice((1, 2, 3, 40, 200, 400)))]
        for _ in range(r.choice((1, 1, 2, 6))):
            rows.append(" ".join(text))
            text = list(text)
            text[r.randrange(len(text))] = r.choice(words)
    rows += ["", " \t\n", None, "A b C", "a B c", "É é", "x" * 200_000, "one " * 30_000]
    return [(3 * i + 1, t) for i, t in enumerate(r.sample(rows, len(rows)))]


def found_rows(df):
    hexed = F.lpad(F.lower(F.hex("f0")), 16, "0")
    return sorted(map(tuple, df.select("doc_id", hexed, "component_id").collect()))


def test_components_are_those_of_all_pairs(spark):
    rows = some_rows()
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(5)
    found = found_rows(simhash.near_duplicates(frame))
    assert found == plain_components(rows)
    assert len({c for *_, c in found}) < len(rows)


def test_strips_of_any_length_find_the_same(spark):
    rows = some_rows(8)
    prints = simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    nodes = prints.groupBy("f0").agg(F.min("doc_id").alias("node"), F.max("n").alias("n"))
    links = [connected(simhash.near_links(nodes, 64, 2, 0.0, strip)).collect() for strip in (2, 32_768)]
    assert sorted(links[0]) == sorted(links[1]) and links[0]


def test_repeated_rows_and_rows_without_id(spark):
    rows = [(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (2, "A B C D"), (None, "q r s t u"), (7, None)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found if r["doc_id"] is not None) == [(2, 2), (4, 2), (4, 2), (7, 7)]
    assert sorted((r["component_id"] for r in found if r["doc_id"] is None), key=str) == [2, None]


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicated(empty).columns == empty.columns


def test_one_of_each_group_stays(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    rows, groups = [], []
    for g in range(40):
        text = [r.choice(words) for _ in range(300)]
        for copy in range(r.choice((1, 2, 5))):
            new = list(text)
            for _ in range(copy):
                new[r.randrange(len(new))] = r.choice(words)
            rows.append((len(rows), " ".join(new), "a", "b"))
            groups.append(g)
    rows += [(0, rows[0][1], "a", "b"), (None, "without id", "a", "b"), (None, "without id too, other", "a", "b")]
    kept = simhash.deduplicated(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "f0", "component_id"]
    found = [x["doc_id"] for x in kept.collect()]
    assert sorted(x for x in found if x is not None) == sorted(groups.index(g) for g in range(40))
    assert found.count(None) == 2


def test_similar_texts_are_found_and_others_left(spark):
    """Texts that share 0.85 of their five-word shingles are linked nearly always, 0.5 nearly never."""
    r = random.Random(9)
    texts, wanted = [], []
    for share, replaced in ((0.85, 9), (0.5, 50)):
        for _ in range(40):
            text = [f"{r.random():.9f}" for _ in range(600)]
            other = list(text)
            for i in r.sample(range(600), replaced):
                other[i] = f"{r.random():.9f}"
            a, b = ({tuple(t[i : i + 5]) for i in range(596)} for t in (text, other))
            assert abs(len(a & b) / len(a | b) - share) < 0.08
            texts += [" ".join(text), " ".join(other)]
            wanted.append(share)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x[0] for x in simhash.deduplicated(frame).select("doc_id").collect()}
    gone = [2 * i + 1 not in kept for i in range(len(wanted))]
    assert sum(g for g, w in zip(gone, wanted, strict=True) if w == 0.85) >= 36
    assert sum(g for g, w in zip(gone, wanted, strict=True) if w == 0.5) <= 2
    assert all(2 * i in kept for i in range(len(wanted)))


def test_long_chains_are_one_component(spark):
    edges = [(i, i + 1) for i in range(0, 500)] + [(1000, 2000), (5, 5), (2000, 1000)]
    found = dict(connected(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == {**{i: 0 for i in range(501)}, 1000: 1000, 2000: 1000}


def test_links_follow_the_exact_share_of_shingles(spark):
    """Pairs just above 0.8 of distinct five-word shingles are all linked, pairs below it never."""
    r = random.Random(11)
    texts, wanted = [], []
    for replaced in (12, 30):  # blocks of neighbours: each takes its own shingles and four more
        for _ in range(60):
            text = [f"{r.random():.9f}" for _ in range(300)]
            at = r.randrange(10, 250)
            other = text[:at] + [f"{r.random():.9f}" for _ in range(replaced + 12)] + text[at + replaced + 12 :]
            a, b = ({tuple(t[i : i + 5]) for i in range(296)} for t in (text, other))
            wanted.append(len(a & b) / len(a | b) >= 0.8)
            texts += [" ".join(text), " ".join(other)]
    assert sum(wanted) == 60
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x[0] for x in simhash.deduplicated(frame).select("doc_id").collect()}
    assert [2 * i + 1 not in kept for i in range(len(wanted))] == wanted
    assert all(2 * i in kept for i in range(len(wanted)))


def test_unlike_texts_with_one_id_are_kept_apart(spark):
    r = random.Random(12)
    a, b, c = (" ".join(f"{r.random():.6f}" for _ in range(200)) for _ in range(3))
    rows = [(1, a), (5, a + " end"), (5, b), (7, b), (8, c), (8, c), (8, c.replace(" ", "\n")), (9, None), (9, a + " other")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((x["doc_id"], (x["text"] or "").split()) for x in simhash.deduplicated(frame).collect())
    assert kept == sorted((i, (t or "").split()) for i, t in [(1, a), (5, b), (8, c), (9, None)])


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("strip, most", [(simhash.STRIP, simhash.SHINGLES), (16, 300)])
def test_groups_around_the_border_give_links_not_pairs(spark, strip, most):
    """Many texts that share 0.6 to 0.9 with each other: components equal those of all pairs, and links are few."""
    r = random.Random(13)
    base = [f"{r.random():.9f}" for _ in range(120)]
    texts = []
    for n in range(120):
        text = list(base)
        for _ in range(r.randrange(8)):
            at = r.randrange(110)
            text[at : at + 4] = [f"{r.random():.9f}" for _ in range(4)]
        texts.append(text)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    frame = spark.createDataFrame([(i, i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, mark long, text string")
    prints = simhash.shingle_prints(frame, 5)
    classes = prints.withColumn("first", F.struct("doc_id", "mark")).withColumnRenamed("doc_id", "node").drop("mark")
    found = simhash.similar_links(classes, frame, 5, 32, 0.8, strip, most).collect()
    assert all(jaccard(sets[x["u"]], sets[x["v"]]) >= 0.8 for x in found)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    prints_of = {x["node"]: (x["f0"], x["f1"]) for x in classes.collect()}
    bits = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(prints_of[a], prints_of[b]))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 and bits(i, j) <= 32:
                parent[root(i)] = root(j)
    names = dict(connected(spark.createDataFrame([tuple(x) for x in found], "u long, v long")).collect())
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(names.get(i, i), set()).add(i)
    wanted = {}
    for i in range(len(texts)):
        wanted.setdefault(root(i), set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))
    assert 1 < len(wanted) < len(texts)


def test_parity_refuses_no_true_pair():
    r = random.Random(14)
    for size in (1, 30, 400, 3000):
        for _ in range(20):
            a = {r.getrandbits(64) for _ in range(size)}
            b = {x for x in a if r.random() > 0.1} | {r.getrandbits(64) for _ in range(r.randrange(size // 10 + 1))}
            if not b or jaccard(a, b) < 0.8:
                continue
            odd = [np.bincount(np.array([x % 512 for x in s]), minlength=512) & 1 for s in (a, b)]
            assert (odd[0] ^ odd[1]).sum() * 1.8 <= (len(a) + len(b)) * 0.2 + 1e-6


def test_rows_without_id_are_compared(spark):
    r = random.Random(15)
    a, b = (" ".join(f"{r.random():.6f}" for _ in range(200)) for _ in range(2))
    rows = [(None, a), (None, a + " end"), (3, a + " tail"), (None, b), (None, b + " end"), (None, b)]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [x["doc_id"] for x in kept if x["text"].startswith(a)] == [3]
    assert len([x for x in kept if x["text"].startswith(b)]) == 1 and len(kept) == 2
