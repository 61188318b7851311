"""Sharded WARC archives: written deterministically, committed by a manifest, read back record by record."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from cdcflow.llm.common import partitions
from cdcflow.session import scratch_dir, written

#: Date of every record unless the caller names another; nothing in an archive depends on the clock.
DATE = "2024-01-01T00:00:00Z"
#: Payloads of at least so many bytes are stored once and revisited.
REVISIT_BYTES = 1000
#: A file is closed once its compressed size reaches this.
ROLL_BYTES = 8 << 20
#: A shard is planned to hold about so many payload bytes.
SHARD_BYTES = 32 << 20

ENTRY = "shard long, file string, records long, bytes long, sha1 string, first_id long, last_id long"
RECORD = (
    "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string,"
    " payload binary, file string, offset long"
)


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a plain path; local, HDFS and object stores alike."""
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def record_id(page_id: int | None, digest: bytes) -> str:
    """A URN that names a record by its page and payload alone."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest.hex()}')}>"


def record(page_id: int | None, uri: str, payload: bytes, refers_to: int | None, digest: bytes, date: str = DATE) -> bytes:
    """One WARC/1.1 record, headers and digests made anew. A revisit keeps the HTTP headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"Refers-To-Page-ID: {refers_to}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with an empty time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of each gzip member of a binary stream, read in pieces."""
    offset, rest = 0, b""
    while True:
        unpacker, found, taken = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            piece = rest or stream.read(1 << 20)
            if not piece:
                if taken:
                    raise ValueError(f"a record at {offset} is cut off")
                return
            rest = b""
            found.append(unpacker.decompress(piece))
            taken += len(piece)
            if unpacker.eof:
                rest = unpacker.unused_data
                taken -= len(rest)
        yield offset, b"".join(found)
        offset += taken


def parsed(data: bytes) -> dict:
    """Fields of one record; digests and lengths are checked against its block."""
    head, block = data.split(b"\r\n\r\n", 1)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    block = block[: int(fields["Content-Length"])]
    digest = lambda name: base64.b32decode(fields[name].removeprefix("sha1:"))
    if hashlib.sha1(block).digest() != digest("WARC-Block-Digest"):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not fit")
    http, payload = block.split(b"\r\n\r\n", 1)
    stored = fields["WARC-Type"] == "response"
    if stored and hashlib.sha1(payload).digest() != digest("WARC-Payload-Digest"):
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} does not fit")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("Page-ID"),
        "target_uri": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("Refers-To-Page-ID"),
        "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]),
        "payload_digest": digest("WARC-Payload-Digest").hex(),
        "payload": payload if stored else None,
    }


class _File:
    """One archive under a temporary name of its own; nothing sees it before ``close`` moves it."""

    def __init__(self, folder: str, shard: int, number: int) -> None:
        self.system, base = located(folder)
        self.name = f"shard-{shard:08d}-{number:05d}.warc.gz"
        self.temporary, self.final = f"{base}/.{self.name}.{uuid.uuid4().hex}.tmp", f"{base}/{self.name}"
        self.stream = self.system.open_output_stream(self.temporary)
        self.shard, self.records, self.bytes, self.digest, self.ids = shard, 0, 0, hashlib.sha1(), []

    def add(self, page_id: int | None, data: bytes) -> None:
        self.stream.write(data)
        self.digest.update(data)
        self.records, self.bytes = self.records + 1, self.bytes + len(data)
        self.ids = [self.ids[0] if self.ids else page_id, page_id]

    def close(self) -> tuple:
        self.stream.close()
        self.system.move(self.temporary, self.final)
        return self.shard, self.name, self.records, self.bytes, self.digest.hexdigest(), *self.ids


def write_archives(
    pages: DataFrame,
    folder: str,
    least: int = REVISIT_BYTES,
    roll_bytes: int = ROLL_BYTES,
    shard_bytes: int = SHARD_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Writes a record for every row of ``pages`` (page_id, url, html) below ``folder``; returns the manifest.

    Records are range-sorted by page_id (ties by a hash of the payload, then URL). Shard borders are every so-many-th
    key of a sample taken by hash, so they, the files and every byte depend on the rows alone, not on how Spark
    dealt them, and a rerun writes the same. Rows without page_id have no place in that order; they are dealt to
    all shards by hash and stand first in each. A shard is one task's work; it rolls to a new file at ``roll_bytes``
    compressed bytes. A file is written under a name of its attempt and moved when complete, so a lost executor
    leaves only hidden files; the manifest, written last, names what belongs to the archive, and readers open
    nothing else. Borders are one key for each ``shard_bytes`` of payload; only they reach the driver.

    Rows whose payload (null html: empty) has at least ``least`` bytes and an equal one on a larger page_id become
    revisits of the largest. Rows that repeat the largest page_id stay responses, as do rows without page_id unless
    a page_id shares their payload. No rows give no files and an empty manifest.
    """
    spark = pages.sparkSession
    system, base = located(folder)
    system.create_dir(base, recursive=True)
    base_columns = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    borders = shard_borders(base_columns, shard_bytes)
    shard = F.lit(0).cast("long")
    if borders:
        keys = np.array(borders, dtype=np.int64)
        place = F.pandas_udf(lambda x: pd.Series(np.searchsorted(keys, x.to_numpy(), side="right")), "long")
        spread = F.pmod(F.xxhash64("url", "html"), F.lit(len(borders) + 1))
        shard = F.when(F.col("page_id").isNull(), spread).otherwise(place(F.coalesce("page_id", F.lit(0))))
    placed = base_columns.withColumn("shard", shard)
    long = placed.where(F.octet_length("html") >= least).select("shard", "page_id", F.sha1(F.col("html").cast("binary")).alias("digest"))
    homes = long.groupBy(F.col("digest").alias("key")).agg(F.max("page_id").alias("home"), F.count("*").alias("copies"))
    homes = homes.where("copies > 1 and home is not null")
    # One row for each repeated payload and shard that holds a copy: the payloads themselves are not joined.
    marks = long.select("shard", "digest").distinct().join(homes, F.col("digest") == F.col("key")).select(
        "shard", F.lit(0).alias("kind"), F.col("home").alias("page_id"), F.col("digest").alias("url"), F.lit(None).cast("string").alias("html")
    )
    records = placed.select("shard", F.lit(1).alias("kind"), "page_id", "url", "html")
    dealt = (
        records.unionByName(marks)
        .repartitionById(len(borders) + 1, F.col("shard").cast("int"))
        .sortWithinPartitions("shard", "kind", "page_id", F.xxhash64("html"), "url")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, entries, home, of = None, 0, [], {}, None
        for batch in batches:
            for at, kind, page_id, url, html in zip(*(c for c in batch.columns[:4]), batch.column(4), strict=True):
                at, page_id, url = at.as_py(), page_id.as_py(), url.as_py()
                if at != of:
                    of, home = at, {}
                if not kind.as_py():
                    home[url] = page_id
                    continue
                if now is not None and (now.shard != at or now.bytes >= roll_bytes):
                    number = number + 1 if now.shard == at else 0
                    entries.append(now.close())
                    now = None
                if now is None:
                    now = _File(folder, at, number)
                payload = html.as_py().encode("utf-8", "surrogatepass")
                digest = hashlib.sha1(payload).digest()
                refers_to = home.get(digest.hex()) if len(payload) >= least else None
                refers_to = None if refers_to == page_id else refers_to
                now.add(page_id, member(record(page_id, clean_uri(url), payload, refers_to, digest, date)))
        if now is not None:
            entries.append(now.close())
        fields = [f.split()[0] for f in ENTRY.split(", ")]
        kinds = [pa.string() if f.endswith("string") else pa.int64() for f in ENTRY.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([e[k] for e in entries], kind) for k, kind in enumerate(kinds)], fields
        )

    manifest = dealt.mapInArrow(run, ENTRY)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(ENTRY).parquet(f"{folder}/manifest")


def clean_uri(url: str) -> str:
    """Header values cannot hold line breaks."""
    return re.sub(r"[\r\n]+", " ", url).strip()


def shard_borders(pages: DataFrame, shard_bytes: int) -> list[int]:
    """Keys at which shards begin: of the keys whose hash falls in a share of the table, every 64th in order.

    The sample is sorted and numbered in Spark; one key for each shard reaches the driver.
    """
    total = pages.agg(F.sum(F.octet_length("html").cast("long")), F.count("page_id")).first()
    shards = max(1, -(-(total[0] or 0) // shard_bytes))
    if shards == 1:
        return []
    every = max(1, total[1] // (shards * 64))
    keys = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0).select("page_id").distinct()
    # Written with the number of its part, so that parts and the places within them are fixed from here on.
    parts = written(keys.where("page_id is not null").sort("page_id").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("part").alias("of"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("page_id")) - 1 + F.col("start")
    ranked = parts.join(starts, F.col("part") == F.col("of")).withColumn("place", place)
    step = max(1, parts.count() // shards)
    chosen = ranked.where((F.col("place") > 0) & (F.col("place") % step == 0)).select("page_id")
    return sorted(r[0] for r in chosen.collect())


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the files that the manifest names; digests are checked on the way. Revisits have no payload."""
    manifest = spark.read.schema(ENTRY).parquet(f"{folder}/manifest").select("file")
    fields = [f.strip().split()[0] for f in RECORD.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(f, kinds[x.strip().split()[1]]) for f, x in zip(fields, RECORD.split(","), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = located(folder)
        for name in itertools.chain.from_iterable(b.column(0).to_pylist() for b in batches):
            held, size = [], 0
            with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                for offset, data in members(stream):
                    row = {**parsed(data), "file": name, "offset": offset}
                    if not payloads:
                        row["payload"] = None
                    held.append(row)
                    size += len(data)
                    if size > 8 << 20 or len(held) >= 10_000:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return manifest.repartition(partitions(manifest)).mapInArrow(run, RECORD)


def archived(pages: DataFrame, **options) -> DataFrame:
    """Records of ``pages`` as read back from archives written to a new folder of the shared store."""
    folder = f"{scratch_dir(pages.sparkSession)}"
    write_archives(pages, folder, **options)
    return read_archives(pages.sparkSession, folder, payloads=False)
