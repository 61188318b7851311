"""The corpus pipeline: each stage's columns and effect, and the whole against what its parts give by brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cdcflow.session import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(1)
    words = [f"word{i}" for i in range(3000)]
    rows, labels = [], []
    for i in range(300):
        kind = "junk" if i % 7 == 0 else "copy" if i % 11 == 0 else "secret" if i % 5 == 0 else "clean"
        text = [r.choice(words) for _ in range(r.choice((60, 200, 500)))]
        if kind == "junk":
            text = [f"!!{w}##" for w in text]
        if kind == "copy" and (last := [x for x in rows if x[2] == "clean"]):
            text = last[-1][1].split()
        if kind == "secret":
            text.insert(7, "password=abcdefgh12")
        rows.append((i, " ".join(text), kind, f"s{i % 3}", len(" ".join(text))))
        if i % 2 == 0:
            labels.append((i, int(kind != "junk"), 0))
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder))
        assert docs.columns == first.columns and docs.dtypes == first.dtypes, name
        seen[name] = docs
    count = lambda df, kind: df.where(F.col("lang") == kind).count()
    good, unique, clean, mixed = seen.values()
    # The kept share is that of 150 labels raised by a standard error, some 3.5 %: about 11 of 300 rows.
    assert count(good, "junk") <= 13 and count(good, "clean") >= 0.97 * count(first, "clean")
    assert count(unique, "copy") + count(unique, "clean") <= count(good, "clean") + 1
    assert count(unique, "clean") >= 0.97 * count(good, "clean")
    assert unique.count() == clean.count() and clean.where("contains(text, 'abcdefgh12')").count() == 0
    assert clean.where("contains(text, '[secret]')").count() == count(unique, "secret")
    assert clean.where("n_chars <> char_length(text)").count() == 0
    sizes = {r[0]: r[1] for r in clean.groupBy("source").agg(F.sum(F.size(F.split("text", " ")))).collect()}
    taken = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " ")))).collect()}
    total = sum(sizes.values())
    for source, weight in (("s0", 5), ("s1", 2), ("s2", 1)):
        assert taken[source] == pytest.approx(min(total * weight / 8, 3 * sizes[source]), rel=0.01)


def test_run_packs_what_the_stages_leave(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    per_sequence = found.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert per_sequence.where("n > 2048 or n <> end").count() == 0
    assert found.count() > 0


def test_rows_are_those_of_plain_python(spark, folder):
    """Near-dedup, secrets and packing row by row: what each gives for the rows its predecessor kept."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder))
        seen.append([(r["doc_id"], r["text"]) for r in docs.collect()])
    good, unique, clean, mixed = seen
    shingles = {i: {tuple(w[n : n + 5]) for n in range(max(1, len(w) - 4))} for i, t in good for w in [t.lower().split()]}
    kept = []
    for i in sorted(shingles):
        # Copies here are exact, so groups need no chains.
        if not any(len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]) for j in kept):
            kept.append(i)
    assert sorted(i for i, _ in unique) == kept and dict(unique) == {i: t for i, t in good if i in set(kept)}
    marked = lambda t: " ".join("[secret]" if "password=" in w or "[secret]" in w else w for w in t.split())
    assert sorted((i, marked(t)) for i, t in clean) == sorted((i, marked(t)) for i, t in unique)
    assert {t for _, t in mixed} <= {" ".join(t.split()[:n]) for _, t in clean for n in range(len(t.split()) + 1)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = []
    for i, text in mixed:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        wanted += [
            (i, n, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))
        ]
    found = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(wanted)
    room = {}
    for r in found:
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in room.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048


def test_stages_run_on_no_rows(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0 and docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0


def test_stages_take_odd_rows_and_extra_columns(spark, folder):
    rows = [(1, None, None, None, None, 5), (1, None, None, None, None, 5), (None, "", "en", "s", 0, None), (2, "x " * 50_000, "en", "s", 100_000, 1),
            (2, "x " * 50_000, "en", "s", 100_000, 1), (None, "token=abcdefgh99", "en", None, 16, 2)]
    docs = spark.createDataFrame(rows, SCHEMA + ", size int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder))
        assert docs.columns[-1] == "size"
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0


def test_given_tables(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
