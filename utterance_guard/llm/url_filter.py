"""URL filters: rules for hosts and paths, and a blocklist held as a sorted digest array.

The blocklist is cut by the first bits of the keys' 64-bit XXH64. Spark tasks sort a cut each
and write it as one file: digests in order, offsets, then the full keys. ``SparkContext.addFile``
brings the files to the executors, where workers map them into memory; nothing of them goes
through the driver's memory or a broadcast. Urls are probed a batch at a time by binary search
over the mapped digests; a digest that is found counts only if a stored key is the same string.

Keys are domains, which block themselves and all subdomains, or a host with a path, which
blocks that page. A rule that fits comes first; the longest one wins.

Defined results: a null url, or one without ``://``, has an empty host and path and is allowed.
Repeated rows are judged one by one. Null and empty keys are left out, repeated ones merged. An
empty list blocks nothing. Columns beside those named are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterance_guard.llm.common import scratch

#: Verdict and rule, a host followed by the start of a path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
KEYS_PER_FILE = 1 << 21
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MADE = "shard long, name string, n long"


def url_host(url: str = "url") -> Column:
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def url_path(url: str = "url") -> Column:
    return F.regexp_extract(
        F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1
    )


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    found = None
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
    return F.lit(None).cast("string") if found is None else found


def rule_verdict(rule: Column, rules=RULES) -> Column:
    return F.create_map(*[F.lit(x) for v, r in rules for x in (r, v)])[rule]


def pack(keys: list[bytes]) -> bytes:
    """One file: count, digests in order, offsets, keys."""
    digest = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
    order = np.argsort(digest, kind="stable")
    keys = [keys[i] for i in order.tolist()]
    offsets = np.zeros(len(keys) + 1, np.int64)
    np.cumsum([len(k) for k in keys], out=offsets[1:])
    head = np.array([len(keys)], np.int64).tobytes()
    return head + digest[order].tobytes() + offsets.tobytes() + b"".join(keys)


class MappedFile:
    """A packed file in mapped memory."""

    def __init__(self, path: str):
        n = int(np.fromfile(path, np.int64, 1)[0])
        self.digests = np.memmap(path, np.uint64, "r", 8, (n,))
        self.offsets = np.memmap(path, np.int64, "r", 8 + 8 * n, (n + 1,))
        size = int(self.offsets[-1])
        at = 16 + 16 * n
        self.keys = np.memmap(path, np.uint8, "r", at, (size,)) if size else np.zeros(0, np.uint8)

    def contains(self, keys: list[bytes], digests: np.ndarray) -> np.ndarray:
        first = np.searchsorted(self.digests, digests, side="left")
        end = np.searchsorted(self.digests, digests, side="right")
        found = np.zeros(len(keys), bool)
        for i in np.flatnonzero(end > first).tolist():
            stored = (
                self.keys[self.offsets[j] : self.offsets[j + 1]].tobytes()
                for j in range(first[i], end[i])
            )
            found[i] = keys[i] in stored
        return found


_OPEN: dict[str, MappedFile] = {}


@dataclass
class DigestIndex:
    """File names by the first ``bits`` bits of the digests they hold."""

    bits: int = 0
    names: dict[int, str] = field(default_factory=dict)

    def contains(self, keys: list[bytes]) -> np.ndarray:
        digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        shard = digests >> np.uint64(64 - self.bits) if self.bits else np.zeros_like(digests)
        found = np.zeros(len(keys), bool)
        for s in np.unique(shard).tolist():
            if (name := self.names.get(s)) is None:
                continue
            if name not in _OPEN:
                _OPEN[name] = MappedFile(SparkFiles.get(name))
            own = np.flatnonzero(shard == s)
            found[own] = _OPEN[name].contains([keys[i] for i in own.tolist()], digests[own])
        return found


def build_index(keys: DataFrame, keys_per_file: int = KEYS_PER_FILE) -> DigestIndex:
    """Index the strings of column ``key``. The driver sees a row per file."""
    spark = keys.sparkSession
    keys = keys.select("key").filter("key <> ''").distinct()
    n = keys.count()
    bits = max(0, -(-n // keys_per_file) - 1).bit_length()
    folder = scratch(spark, "url-index")

    @F.arrow_udf("long")
    def shard_of(column: pa.Array) -> pa.Array:
        digests = (xxhash.xxh64_intdigest(k.as_buffer()) for k in column.cast(pa.large_binary()))
        return pa.array([d >> (64 - bits) if bits else 0 for d in digests], pa.int64())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def save(shard: int, held: list[bytes]) -> pa.RecordBatch:
            name = f"urls-{uuid.uuid4().hex}"  # the row that lists it commits the file
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(pack(held))
            row = {"shard": shard, "name": name, "n": len(held)}
            return pa.RecordBatch.from_pylist([row])

        shard, held = None, []
        for batch in batches:
            for s, key in zip(batch.column("shard").to_pylist(), batch.column("key").to_pylist()):
                if s != shard and held:
                    yield save(shard, held)
                    held = []
                shard = s
                held.append(key)
        if held:
            yield save(shard, held)

    made = (
        keys.withColumn("shard", shard_of("key"))
        .withColumn("key", F.col("key").cast("binary"))
        .repartition(max(1, 1 << bits), "shard")
        .sortWithinPartitions("shard", "key")
        .mapInArrow(write, MADE)
        .collect()
    )
    for row in made:
        spark.sparkContext.addFile(f"{folder}/{row['name']}")
    return DigestIndex(bits, {r["shard"]: r["name"] for r in made})


def probes(host: str, path: str) -> list[str]:
    """What a page is looked up as: its host, all parent domains, and host with path."""
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] + [host + path]


def blocked_by(index: DigestIndex):
    @F.arrow_udf("boolean")
    def blocked(host: pa.Array, path: pa.Array) -> pa.Array:
        keys, owner = [], []
        for i, (h, p) in enumerate(zip(host.to_pylist(), path.to_pylist())):
            if h:
                own = [k.encode() for k in probes(h, p)]
                keys += own
                owner += [i] * len(own)
        out = np.zeros(len(host), bool)
        if keys:
            out[np.array(owner)[index.contains(keys)]] = True
        return pa.array(out)

    return blocked


def filter_urls(pages: DataFrame, index: DigestIndex, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` for every row of ``pages``."""
    split = pages.select(
        F.col("page_id"), url_host("url").alias("host"), url_path("url").alias("path")
    )
    ruled = split.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = ruled.withColumn("listed", blocked_by(index)("host", "path"))
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return ruled.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce(rule_verdict(F.col("rule"), rules), own).alias("verdict"),
        "listed",
    )


#: What marks a host as unwanted when a list is made from hosts alone.
UNWANTED = ("ads", "adult", "bets", "casino", "pills", "spam")


def unwanted_hosts(pages: DataFrame, words: tuple[str, ...] = UNWANTED) -> DataFrame:
    """A blocklist, column ``key``: hosts that have one of ``words`` between dots or hyphens."""
    pattern = rf"(^|[.-])({'|'.join(words)})([.-]|$)"
    return pages.select(url_host("url").alias("key")).distinct().filter(
        F.col("key").rlike(pattern)
    )
