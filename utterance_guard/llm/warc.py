"""WARC: a deterministic sharded writer, and a reader.

Shards are ranges of page ids. Their borders are quantiles of the ids with the smallest hashes,
a sample that is the same in every run. Records travel to their shard once, in one shuffle, and
are sorted there; what is known about a repeated payload travels as a small row of its own that
sorts right before its record. The writer regenerates all headers and digests, compresses each
record as one gzip member and rolls to the next file when the compressed size is reached.

Commit: a task writes under a temporary name that no other attempt uses. Rows of the attempts
that succeed become the table ``pending``; a second job moves those files to their final names,
which follow from shard and sequence number, and writes ``manifest``. Both jobs can be repeated
at any point. Readers open what the manifest lists, and check size and digest of each file.

Defined results: null html is an empty payload. Of equal payloads the smallest page_id is the
response, null ids last; rows that share payload and smallest id are all responses. Rows are
never merged: a repeated row is a record of its own. A null url leaves its header out; control
characters in urls are percent-encoded. An empty table gives archives without files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterance_guard.llm.common import scratch, small_batches, written

FILE_BYTES = 32 << 20
SAMPLE_PER_SHARD = 64
#: Payloads below this size are responses even when they repeat.
MIN_PAYLOAD = 0
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "name string, temp string, records long, bytes long, sha1 string"
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, name string"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"


def clean_url(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


@dataclass
class First:
    """The response that a revisit points to."""

    page_id: int
    url: str | None


def record(page_id: int | None, url: str | None, payload: bytes, first: First | None) -> bytes:
    """One record: headers, HTTP headers, and the payload of a response."""
    digest = base32_sha1(payload)
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if first else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if first else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {clean_url(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if first:
        lines += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {record_id(first.page_id, first.url, digest)}",
            f"X-Refers-To-Page-ID: {first.page_id}",
        ]
        if first.url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {clean_url(first.url)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class RollingFiles:
    """Files of one shard after another, each under a temporary name until it is committed."""

    def __init__(self, folder: str, limit: int):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.limit, self.attempt = limit, uuid.uuid4().hex
        self.shard, self.sequence, self.out, self.done = None, 0, None, []
        self.store.create_dir(f"{self.root}/temporary", recursive=True)

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.sequence = shard, 0
        packer = zlib.compressobj(6, wbits=31)
        packed = packer.compress(data) + packer.flush()
        if self.out is not None and self.size + len(packed) > self.limit:
            self.close()
        if self.out is None:
            self.name = f"shard-{shard:06d}-{self.sequence:06d}.warc.gz"
            self.temp = f"temporary/{self.name}.{self.attempt}"
            self.out = self.store.open_output_stream(f"{self.root}/{self.temp}", compression=None)
            self.size, self.records, self.digest = 0, 0, hashlib.sha1()
            self.sequence += 1
        self.out.write(packed)
        self.digest.update(packed)
        self.size += len(packed)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            row = (self.name, self.temp, self.records, self.size, self.digest.hexdigest())
            self.done.append(dict(zip(("name", "temp", "records", "bytes", "sha1"), row)))
            self.out = None

    def finished(self) -> pa.RecordBatch | None:
        rows, self.done = self.done, []
        return pa.RecordBatch.from_pylist(rows, FILES_ARROW) if rows else None


FILES_ARROW = pa.schema(
    [("name", pa.string()), ("temp", pa.string())]
    + [("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]
)


def writer(folder: str, limit: int) -> Callable:
    """Write sorted rows ``shard, page_id, digest, kind, url, html, first_id, first_url``; a row
    of kind 0 says what the next rows of its page_id and digest refer to."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = RollingFiles(folder, limit)
        known: tuple | None = None
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["page_id"], row["digest"])
                if row["kind"] == 0:
                    known = (key, First(row["first_id"], row["first_url"]))
                    continue
                first = known[1] if known and known[0] == key else None
                files.add(row["shard"], record(row["page_id"], row["url"], row["html"], first))
            if (ready := files.finished()) is not None:
                yield ready
        files.close()
        if (ready := files.finished()) is not None:
            yield ready

    return write


def committer(folder: str) -> Callable:
    """Move files to their final names; does nothing where that has been done."""

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if store.get_file_info(f"{root}/{row['temp']}").type == fs.FileType.File:
                    store.move(f"{root}/{row['temp']}", f"{root}/{row['name']}")
            yield batch

    return commit


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, unpacked, one at a time."""
    packer, parts = zlib.decompressobj(wbits=31), []
    rest = stream.read(size)
    while rest:
        parts.append(packer.decompress(rest))
        rest = packer.unused_data
        if packer.eof:
            yield b"".join(parts)
            packer, parts = zlib.decompressobj(wbits=31), []
        rest = rest or stream.read(size)
    if parts:
        raise ValueError("a record is cut off")


def parse(data: bytes) -> dict:
    """A record's fields. Lengths and digests are checked, of revisits those of the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    full = fields["WARC-Type"] == "response"
    if (
        fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}"
        or rest[len(block) :] != b"\r\n\r\n"
        or full
        and (len(payload), base32_sha1(payload)) != (length, digest)
    ):
        raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
    number = lambda key: int(fields[key]) if key in fields else None
    return {
        "page_id": number("X-Page-ID"),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"),
    }


class Checked:
    """A stream that counts and digests what is read."""

    def __init__(self, stream):
        self.stream, self.size, self.digest = stream, 0, hashlib.sha1()

    def read(self, size: int) -> bytes:
        data = self.stream.read(size)
        self.size += len(data)
        self.digest.update(data)
        return data


def reader(folder: str) -> Callable:
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
    names = [c.split()[0] for c in RECORDS.split(", ")]
    schema = pa.schema([(c, types.get(c, pa.string())) for c in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(f"{root}/{row['name']}", compression=None) as raw:
                    stream, rows, n = Checked(raw), [], 0
                    for data in members(stream):
                        rows.append(parse(data) | {"name": row["name"]})
                        n += 1
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema)
                found = (n, stream.size, stream.digest.hexdigest())
                if found != (row["records"], row["bytes"], row["sha1"]):
                    raise ValueError(f"{row['name']} is not the file of the manifest")

    return read


def sha1_hex(html: str) -> Column:
    return F.sha1(payload_bytes(html))


def payload_bytes(html: str) -> Column:
    return F.coalesce(F.col(html), F.lit("")).cast("binary")


def write_archives(
    pages: DataFrame,
    folder: str,
    shards: int,
    file_bytes: int = FILE_BYTES,
    min_payload: int = MIN_PAYLOAD,
) -> DataFrame:
    """Write a record per row of ``pages`` (``page_id, url, html``); returns the manifest."""
    spark = pages.sparkSession
    small_batches(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    keyed = written(
        pages.select(
            "page_id",
            "url",
            sha1_hex("html").alias("digest"),
            F.octet_length(payload_bytes("html")).alias("size"),
        ),
        "warc-keys",
    )
    # struct order puts null ids first, so they are ranked by a flag
    rank = F.struct(F.isnull("page_id").alias("absent"), "page_id", "url")
    firsts = (
        keyed.filter(F.col("size") >= min_payload)
        .groupBy("digest")
        .agg(F.min(rank).alias("first"), F.count("*").alias("n"))
        .filter("n > 1 AND NOT first.absent")
        .select("digest", "first.page_id", F.col("first.url").alias("first_url"))
        .withColumnRenamed("page_id", "first_id")
    )
    revisits = (
        keyed.join(firsts, "digest")
        .filter("page_id IS NULL OR page_id > first_id")
        .select("page_id", "digest", "first_id", "first_url")
        .distinct()
    )
    sample = [
        r[0]
        for r in keyed.filter("page_id IS NOT NULL")
        .select("page_id", F.xxhash64("page_id", "digest", "url").alias("h"))
        .orderBy("h", "page_id")
        .limit(SAMPLE_PER_SHARD * shards)
        .collect()
    ]
    borders = np.sort(np.array(sample, np.int64))[SAMPLE_PER_SHARD::SAMPLE_PER_SHARD]

    @F.arrow_udf("long")
    def shard(ids: pa.Array) -> pa.Array:
        values = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(borders, values, side="right"), pa.int64())

    records = pages.select(
        "page_id",
        sha1_hex("html").alias("digest"),
        F.lit(1).alias("kind"),
        "url",
        payload_bytes("html").alias("html"),
        F.lit(None).cast("long").alias("first_id"),
        F.lit(None).cast("string").alias("first_url"),
    )
    notes = revisits.select(
        "page_id",
        "digest",
        F.lit(0).alias("kind"),
        F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("binary").alias("html"),
        "first_id",
        "first_url",
    )
    pending = written(
        records.unionByName(notes)
        .withColumn("shard", shard("page_id"))
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
        .mapInArrow(writer(folder, file_bytes), FILES),
        "warc-pending",
    )
    manifest = f"{folder}/manifest"
    pending.mapInArrow(committer(folder), FILES).write.parquet(manifest)
    return spark.read.schema(FILES).parquet(manifest)


def read_archives(manifest: DataFrame, folder: str, tasks: int) -> DataFrame:
    """The records of all files in the manifest."""
    return manifest.repartition(tasks, "name").mapInArrow(reader(folder), RECORDS)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives into the shared folder and read them back: a row per page."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_archives(write_archives(pages, folder, shards), folder, shards)
