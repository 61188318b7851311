"""Archives: contract, bytes, rolling, recovery."""

import glob
import gzip
import hashlib
import os

from cdcflow.llm import warc

LONG, OTHER = "x" * 1500 + "é", "<p>" + "y" * 2000
ROWS = [
    (5, "http://a/5", LONG, "z"), (9, "http://a/9", LONG, "z"), (7, "http://a/7", LONG, "z"), (9, "http://a/9", LONG, "z"),
    (1, "http://a/1", "short", "z"), (2, "http://a/2", "short", "z"), (3, None, None, None), (4, "", "", "z"),
    (None, "http://a/n", OTHER, "z"), (11, "a\r\nb", OTHER, "z"), (12, "http://a/12", "single " * 300, "z"),
]
SCHEMA = "page_id long, url string, html string, _digest string"


def expected(rows):
    data = [(r[0], (r[2] or "").encode()) for r in rows]
    out = []
    for page_id, payload in data:
        equal = [i for i, p in data if p == payload and i is not None] if len(payload) >= 1000 else []
        home = max(equal) if len([1 for _, p in data if p == payload]) > 1 and equal else None
        refers = home if home is not None and home != page_id else None
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def digest_rows(df):
    found = df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    return sorted(map(tuple, found), key=repr)


def test_records_come_back_with_their_contract(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    assert digest_rows(warc.archived(pages)) == expected(ROWS)


def test_every_byte_depends_on_the_rows_alone(spark, tmp_path):
    rows = [(i * 7 % 101 if i % 9 else None, f"http://h/{i}", f"{i % 13} " * 400, None) for i in range(101)]
    seen = []
    for name, parts in (("a", 1), ("b", 5)):
        folder = str(tmp_path / name)
        frame = spark.createDataFrame(rows if parts == 1 else rows[::-1], SCHEMA).repartition(parts)
        warc.write_archives(frame, folder, roll_bytes=2000, shard_bytes=20_000)
        files = sorted(glob.glob(f"{folder}/*.warc.gz"))
        seen.append([(os.path.basename(f), open(f, "rb").read()) for f in files])
        assert not glob.glob(f"{folder}/.*.tmp")
        assert digest_rows(warc.read_archives(spark, folder)) == expected(rows)
    assert seen[0] == seen[1] and len({n[:14] for n, _ in seen[0]}) > 1 and any("-00001." in n for n, _ in seen[0])


def test_what_an_unfinished_attempt_left_is_not_read(spark, tmp_path):
    folder = str(tmp_path / "c")
    warc.write_archives(spark.createDataFrame(ROWS, SCHEMA), folder)
    (tmp_path / "c" / ".shard-00000000-00000.warc.gz.dead.tmp").write_bytes(b"half a record")
    (tmp_path / "c" / "shard-00000099-00000.warc.gz").write_bytes(warc.member(warc.record(99, "u", b"lost", None, hashlib.sha1(b"lost").digest())))
    assert digest_rows(warc.read_archives(spark, folder)) == expected(ROWS)


def test_records_are_plain_warc(spark, tmp_path):
    folder = str(tmp_path / "d")
    manifest = warc.write_archives(spark.createDataFrame(ROWS[:3], SCHEMA), folder).collect()
    (entry,) = manifest
    data = open(f"{folder}/{entry['file']}", "rb").read()
    assert entry["sha1"] == hashlib.sha1(data).hexdigest() and entry["records"] == 3
    assert (entry["first_id"], entry["last_id"]) == (5, 9)
    text = gzip.decompress(data)
    assert text.count(b"WARC/1.1\r\n") == 3 and text.count(b"WARC-Type: revisit") == 2 and text.count(LONG.encode()) == 1
    payloads = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, folder).collect()}
    assert bytes(payloads[9]) == LONG.encode() and payloads[5] is None


def test_no_rows_give_no_records(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0
