"""Anchors, neighbours and edited texts against plain Python."""

import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from cdcflow.llm import catalog, syncmers

SCHEMA = "doc_id long, text string, anchors string, mark int"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def positions(text):
    words = (text or "").split()
    out = stretches_of(words)
    if len(words) < syncmers.SHORT or len(text or "") > len(words) * syncmers.UNSPACED:
        out += [p + syncmers.CHARACTERS for p in stretches_of("".join(words))]
    return out or ([0] if words else [])


def stretches_of(tokens, k=syncmers.K, s=syncmers.S):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in tokens]

    def chained(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), seed)
        return signed(seed)

    inner = words if s == 1 else [chained(words[i : i + s]) for i in range(len(words) - s + 1)]
    width = k - s + 1
    out = []
    for i in range(len(inner) - width + 1):
        stretch = inner[i : i + width]
        if min(stretch) == stretch[0] or stretch[-1] < min(stretch[:-1]):
            out.append(i)
    return out


def some_texts(seed=1):
    r = random.Random(seed)
    texts = [None, "", " \n", "one", "two words", " ".join(map(str, range(11))), " ".join(map(str, range(12))), "same " * 50, "é" * 100]
    texts += [" ".join(f"w{r.randrange(500)}" for _ in range(r.choice((13, 60, 300)))) for _ in range(30)]
    texts += [" ".join(f"u{r.randrange(10**6)}" for _ in range(n)) for n in (12, 13, 14, 15, 16, 17, 18, 19, 20, 24) * 6]
    texts += [texts[-1], "long text " + " ".join(f"v{r.randrange(500)}" for _ in range(30_000))]
    return texts


def found_rows(df):
    return [r.asDict() for r in catalog.op9(df, "").collect()]


def test_pairs_are_those_of_the_contract(spark):
    rows = [(7 * i % 211, t, "x", 0) for i, t in enumerate(some_texts())]
    found = {r["doc_id"]: r for r in found_rows(spark.createDataFrame(rows, SCHEMA).repartition(5))}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(found) == len(rows)
    for row, after in zip(order, order[1:] + order[:1], strict=True):
        text, other = row[1] or "", after[1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        r = found[row[0]]
        assert r["n_chars"] == len(text) and r["next_id"] == after[0] and r["next_chars"] == len(other)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, of in (("fingerprint", text), ("edited_fingerprint", edited)):
            assert [int(a.split(":")[0]) for a in r[name].split(",") if a] == positions(of)
        hashes = lambda name: {a.split(":")[1] for a in name.split(",") if a}
        for name, left, right in (
            ("near_edited", r["fingerprint"], r["edited_fingerprint"]),
            ("near_next", r["fingerprint"], found[after[0]]["fingerprint"]),
        ):
            a, b = hashes(left), hashes(right)
            assert r[name] == (len(a & b) / len(a | b) if a | b else 1.0)


def test_equal_texts_have_equal_fingerprints_and_edits_are_local(spark):
    r = random.Random(3)
    words = [f"w{r.randrange(10**6)}" for _ in range(1000)]
    other = words[:]
    other[500] = "changed"
    rows = [(1, " ".join(words), "", 0), (2, "\n".join(words), "", 0), (3, " ".join(other), "", 0), (4, " ".join(["new"] * 100 + words), "", 0)]
    frame = syncmers.with_anchors(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text"), "text", "a")
    found = {x["doc_id"]: x["a"] for x in frame.collect()}
    assert found[1] == found[2]
    assert len(set(found[1]) ^ set(found[3])) <= 2 * syncmers.K
    pair = spark.createDataFrame([(found[1], found[4])], "x array<long>, y array<long>")
    places = pair.select(syncmers.shared_places(F.col("x"), F.col("y"))).first()[0]
    assert len(places) == len(found[1]) and all(p["right"] - p["left"] == 100 for p in places)
    density = len(found[1]) / 1000
    assert 0.34 < density < 0.46  # two in five stretches


def test_rows_that_repeat_and_lack_ids(spark):
    rows = [(5, "a b c", "", 0), (5, "a b c", "", 0), (5, "other", "", 0), (None, "x y z", "", 0), (None, None, "", 0)]
    found = found_rows(spark.createDataFrame(rows, SCHEMA))
    assert len(found) == 5
    same = [r for r in found if r["n_chars"] == 5 and r["doc_id"] == 5 and r["fingerprint"] == found[0]["fingerprint"]]
    assert len({tuple(r.items()) for r in found}) == 4 and len(same) in (0, 1, 2)


def test_one_row_and_no_rows(spark):
    (only,) = found_rows(spark.createDataFrame([(1, "abcdef", "", 0)], SCHEMA))
    assert only["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and only["near_next"] == 1.0
    assert found_rows(spark.createDataFrame([], SCHEMA)) == []


def test_texts_are_exchanged_once(spark, tmp_path):
    """Both joins on the texts read one exchange; its rows carry no anchors."""
    spark.createDataFrame([(i, f"text {i} " * 20, "", 0) for i in range(50)], SCHEMA).write.parquet(str(tmp_path / "d"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = syncmers.edited_pairs(spark.read.parquet(str(tmp_path / "d")))
        assert len(found.collect()) == 50
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("ReusedExchange") >= 1


def test_plan_has_no_python(spark):
    frame = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert "Python" not in catalog.op9(frame, "")._jdf.queryExecution().toString()


def test_edited_texts_are_nearer_than_others_at_every_length(spark):
    """Short, ordinary and unspaced texts: two thirds of a text are kept, nothing of it stands in the next."""
    r = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 9)))
    made = [" ".join(word() for _ in range(n)) for n in (4, 6, 8, 10, 12, 15, 18, 20, 25, 30, 38, 41, 45, 60, 100, 400) for _ in range(6)]
    made += ["".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(n)) for n in (15, 30, 60, 200, 3000) for _ in range(4)]
    rows = [(i, t, "", 0) for i, t in enumerate(made)]
    found = found_rows(spark.createDataFrame(rows, SCHEMA))
    assert len(found) == len(rows)
    by_words = {}
    for row in found:
        text = made[row["doc_id"]]
        by_words.setdefault(min(len(text.split()), 41), []).append(row["near_edited"])
        assert row["near_edited"] > row["near_next"], (text[:60], row["near_edited"], row["near_next"])
    assert all(sum(v) / len(v) > 0.25 for v in by_words.values())
