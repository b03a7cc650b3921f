"""Benchmark decontamination by the q-gram lemma.

Benchmark texts are cut into overlapping segments. Within ``k`` edits of a segment of n bytes
lies only text that shares at least n - q + 1 - k q of its q-grams, on diagonals that differ by
at most k. So a document's q-grams are looked up, hits are counted per segment in overlapping
diagonal bands, and bands that reach the bound become regions. A region counts if banded
alignment finds the segment in it within its edit budget.

Text is compared without case (A-Z) and with white space runs as one space. One segment found
makes a document contaminated.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` of text, each one broadcast index and
one pass over the documents; the size is measured first. Documents never meet in a shuffle.

Defined results: a null text contains nothing. A segment of fewer than q bytes has no q-gram and
is left out. Null benchmark texts are left out; a match of a null item_id counts but is not
listed. Rows are judged one by one. Empty tables on either side find nothing. Columns of the
documents are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterance_guard.llm.common import LOWER, small_batches, text_bytes, written

Q = 8
SEGMENT, STEP = 80, 40
EDIT_SHARE = 0.08
BLOCK_BYTES = 32 << 20
CHUNK = 1 << 20
FILTER_BITS = 22
SPREAD = np.uint64(0x9E3779B97F4A7C15)
LEAKS = T.StructType(
    [T.StructField("found", T.BooleanType()), T.StructField("items", T.ArrayType(T.LongType()))]
)


def plain(data: bytes) -> bytes:
    return b" ".join(data.translate(LOWER).split())


def grams(data: bytes) -> np.ndarray:
    """The q-gram at each byte as a number."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.ndarray((n,), np.dtype("<u8"), data, 0, (1,)).copy()


def budget(n: int) -> int:
    """Edits allowed for a segment of n bytes; few enough to leave one q-gram to share."""
    return min(int(n * EDIT_SHARE), (n - Q) // Q)


def segments(text: bytes) -> list[bytes]:
    if len(text) <= SEGMENT:
        return [text] if len(text) >= Q else []
    starts = [*range(0, len(text) - SEGMENT, STEP), len(text) - SEGMENT]
    return [text[s : s + SEGMENT] for s in starts]


#: Diagonals of one match differ by at most its edits; a band of two widths holds them all.
BAND = budget(SEGMENT) + 1


@dataclass
class Index:
    """Segments and their q-grams."""

    texts: list[bytes]
    items: list[int | None]
    need: np.ndarray
    codes: np.ndarray
    first: np.ndarray
    segment: np.ndarray
    place: np.ndarray
    likely: np.ndarray

    @classmethod
    def of(cls, rows: list[Row]) -> Index:
        pairs = [(s, r["item_id"]) for r in rows for s in segments(plain(r["text"].encode()))]
        texts = [s for s, _ in pairs]
        size = np.array([len(s) for s in texts], np.int64)
        code = np.concatenate([grams(s) for s in texts] or [np.zeros(0, np.uint64)])
        segment = np.repeat(np.arange(len(texts)), size - Q + 1)
        begin = np.concatenate(([0], np.cumsum(size - Q + 1)))[:-1].astype(np.int64)
        place = np.arange(len(code)) - begin[segment]
        order = np.argsort(code, kind="stable")
        codes, first = np.unique(code[order], return_index=True)
        likely = np.zeros(1 << FILTER_BITS, bool)
        likely[slot(codes)] = True
        edits = np.array([budget(len(s)) for s in texts], np.int64)
        return cls(
            texts,
            [i for _, i in pairs],
            size - Q + 1 - edits * Q,
            codes,
            np.append(first, len(code)),
            segment[order],
            place[order],
            likely,
        )

    def regions(self, data: bytes) -> Iterator[tuple[int, int]]:
        """Segments and bands of ``data`` with enough shared q-grams."""
        code = grams(data)
        at = np.flatnonzero(self.likely[slot(code)])
        if not at.size:
            return
        row = np.searchsorted(self.codes, code[at])
        row = np.minimum(row, len(self.codes) - 1)
        real = self.codes[row] == code[at]
        at, row = at[real], row[real]
        n = self.first[row + 1] - self.first[row]
        hit = np.repeat(self.first[row] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        hit = hit + np.arange(len(hit))
        segment = self.segment[hit]
        diagonal = np.repeat(at, n) - self.place[hit] + SEGMENT  # never negative
        band = diagonal // BAND
        wide = (len(data) + SEGMENT) // BAND + 2
        key = np.concatenate((segment * wide + band, segment * wide + band - 1))
        key, count = np.unique(key, return_counts=True)
        for k in key[count >= self.need[key // wide]].tolist():
            yield k // wide, (k % wide) * BAND - SEGMENT

    def leaks(self, text: bytes) -> set[int]:
        """Numbers of the segments that ``text`` contains."""
        data, found = plain(text), set()
        margin = 2 * (SEGMENT + 2 * BAND)
        for start in range(0, max(1, len(data)), CHUNK):
            part = data[start : start + CHUNK + margin]
            for segment, diagonal in self.regions(part):
                if segment in found:
                    continue
                wanted = self.texts[segment]
                k = budget(len(wanted))
                region = part[max(0, diagonal - k) : max(0, diagonal + 2 * BAND + len(wanted) + k)]
                if wanted in region or aligned(wanted, region) <= k:
                    found.add(segment)
        return found


def slot(code: np.ndarray) -> np.ndarray:
    return (code * SPREAD >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def aligned(wanted: bytes, region: bytes) -> int:
    """Least edits between ``wanted`` and any part of ``region``, which is one band wide."""
    across = np.arange(len(region) + 1)
    symbols = np.frombuffer(region, np.uint8)
    row = np.zeros(len(region) + 1, np.int64)
    for byte in wanted:
        best = row + 1
        best[1:] = np.minimum(best[1:], row[:-1] + (symbols != byte))
        row = np.minimum.accumulate(best - across) + across
    return int(row.min())


def finder(index):
    """A function that judges texts by a broadcast index."""

    @F.arrow_udf(LEAKS)
    def find(texts: pa.Array) -> pa.Array:
        own, found, items = index.value, [], []
        for text in texts.to_pylist():
            hits = own.leaks(text)
            found.append(bool(hits))
            items.append(sorted({own.items[h] for h in hits} - {None}))
        return pa.StructArray.from_arrays(
            [pa.array(found, pa.bool_()), pa.array(items, pa.list_(pa.int64()))],
            names=["found", "items"],
        )

    return find


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[list[Row]]:
    """The benchmark in parts that each hold few enough bytes to be collected."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(
        "text IS NOT NULL"
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield rows.filter(part == i).collect()


def with_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    column: str,
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with a struct ``found, items`` in a new column of the given name."""
    spark = docs.sparkSession
    small_batches(spark)
    out, blocks = None, blocks_of(benchmark, block_bytes)
    for rows in blocks:
        index = spark.sparkContext.broadcast(Index.of(rows))
        found = finder(index)(text_bytes(text))
        if out is None:
            out = docs.withColumn(column, found)
            continue
        # one index at a time on the executors: the passes so far are written first
        out = written(out, "leaks")
        old = F.col(column)
        out = out.withColumn("_more" + column, found)
        new = F.col("_more" + column)
        out = out.withColumn(
            column,
            F.struct(
                (old["found"] | new["found"]).alias("found"),
                F.array_sort(F.array_union(old["items"], new["items"])).alias("items"),
            ),
        ).drop("_more" + column)
    return out


def free_name(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken or "_more" + name in taken:
        name = "_" + name
    return name


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, contaminated, items, n_items`` for every row of ``docs``."""
    plain_docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), "text")
    found = with_leaks(plain_docs, benchmark, "leaks")
    return found.select(
        "doc_id",
        F.col("leaks.found").alias("contaminated"),
        F.col("leaks.items").alias("items"),
        F.size("leaks.items").cast("long").alias("n_items"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no segment of the benchmark is found, with all their columns."""
    name = free_name(docs, "_leaks")
    return with_leaks(docs, benchmark, name).filter(~F.col(name)["found"]).drop(name)
