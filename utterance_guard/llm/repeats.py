"""Repeated byte strings across documents, by blockwise sorting of suffixes.

A suffix is looked at to a depth of 50 bytes. It is removed (all 50 bytes) if an equal one
starts in a document with a smaller id. Suffixes are not all sorted: a cover of sample positions
is ranked first and settles most ties, and only what it leaves open is sorted, one bucket at a
time.

1. Cover. In every 50 bytes the 16-gram of smallest hash is a sample; the suffixes that share a
   sample form a stretch. So equal suffixes have equal samples at equal distance, as with a
   difference cover, but one in 17 positions is a sample and not one in five: a cover of
   residues modulo v would have to carry four times as many ranks through the shuffle.
2. Ranks. Stretches are named by a digest of all their bytes. Per sample, the documents of each
   name are ranked by id: a stretch whose name occurs in a smaller document is removed whole,
   with no comparison of bytes.
3. Buckets. Where a sample has several names, their stretches may still share some suffixes.
   Those of the smallest document of each name are cut into buckets by the 33 bytes on either
   side of the sample, each bucket's suffixes are sorted by their 50 bytes, and of equal ones
   those in larger documents are removed.

Names and samples travel as packed arrays, one entry per name and task: of a passage that a
third of all documents share, a task sends one entry. Text travels to its ranges by document.

Defined results: a null text is empty. A null doc_id is larger than any other; rows that share
a doc_id don't count as smaller to each other and are judged one by one (their ranges are told
apart by 16 bits of a text digest). Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterance_guard.llm.common import small_batches, text_bytes, written

DEPTH = 50
GRAM = 16
STRETCH = DEPTH - GRAM + 1
SIDE = (DEPTH + GRAM) // 2
CHUNK_BITS = 20
CHUNK = (1 << CHUNK_BITS) - DEPTH
NAME_BITS = 48
#: Entries a task holds before it ranks and packs them.
FLUSH = 400_000
SORTED_AT_ONCE = 200_000
LAST_ID = np.iinfo(np.int64).max
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
TO_NAME = np.uint64(64 - NAME_BITS)

# Columns of packed entries: name, type, bytes kept of each value.
COLUMNS = {
    "sample": (np.uint64, 6),
    "name": (np.uint64, 6),
    "doc": (np.int64, 8),
    "row": (np.uint16, 2),
    "begin": (np.uint32, 4),  # the stretch's first suffix
    "size": (np.uint8, 1),  # its suffixes
    "at": (np.uint8, 1),  # the sample, counted from begin
}
RANGE = ("doc", "row", "begin", "size")
ASKED = ("sample", "doc", "row", "begin", "size", "at")
SHUFFLED = "bucket long, kind int, packed binary"
RANGES, ENTRIES, TEXT = 0, 1, 2
Entries = dict[str, np.ndarray]


def pack(entries: Entries, names: tuple[str, ...], tail: bytes = b"") -> bytes:
    """Columns as planes of bytes, which compress well where the values are alike."""
    n = len(entries[names[0]])
    parts = [np.array([n], np.int64).tobytes()]
    for name in names:
        kind, width = COLUMNS[name]
        values = np.ascontiguousarray(entries[name], kind)
        parts.append(values.view(np.uint8).reshape(n, -1)[:, :width].T.tobytes())
    return b"".join(parts) + tail


def unpack(data: bytes, names: tuple[str, ...]) -> tuple[Entries, bytes]:
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, {}
    for name in names:
        kind, width = COLUMNS[name]
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        values = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        values[:, :width] = planes.T
        out[name] = values.view(kind).reshape(n)
        at += n * width
    return out, data[at:]


def join_entries(parts: list[Entries], names: tuple[str, ...]) -> Entries:
    empty = {n: np.zeros(0, COLUMNS[n][0]) for n in names}
    return {n: np.concatenate([p[n] for p in parts or [empty]]) for n in names}


def taken(entries: Entries, which: np.ndarray) -> Entries:
    return {n: v[which] for n, v in entries.items()}


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    return np.minimum(values[: len(values) - width + span], values[width - span :])


def stretches(data: bytes) -> tuple[Entries, list[int]]:
    """Samples and stretches of a text: ``sample, begin, size, at``, and names."""
    parts, names = [], []
    for start in range(0, max(0, len(data) - DEPTH + 1), CHUNK):
        part = data[start : start + CHUNK + DEPTH - 1]
        n = len(part) - GRAM + 1
        words = np.ndarray((n + 8,), np.dtype("<u8"), part + b"\0" * 7, 0, (1,))
        gram = words[:n] * M1
        gram ^= gram >> np.uint64(29)
        gram *= M2
        gram ^= words[8 : n + 8] * M2
        gram *= M1
        gram ^= gram >> np.uint64(32)
        gram *= M2
        place = np.arange(n, dtype=np.uint64)
        # the position breaks ties, the leftmost first
        low = np.uint64(CHUNK_BITS)
        least = least_in_windows((gram >> low << low) | place, STRETCH)
        at = (least & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.int64)
        begin = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        size = np.diff(np.append(begin, len(at)))
        # the least of many hashes has small first digits: mix again before it names a bucket
        sample = gram[at[begin]] * M1
        sample ^= sample >> np.uint64(32)
        sample *= M2
        parts.append(
            {
                "sample": sample >> TO_NAME,
                "begin": (begin + start).astype(np.uint32),
                "size": size.astype(np.uint8),
                "at": (at[begin] - begin).astype(np.uint8),
            }
        )
        ends = (begin + size + (DEPTH - 1)).tolist()
        names += [xxhash.xxh3_64_intdigest(part[b:e]) for b, e in zip(begin.tolist(), ends)]
    return join_entries(parts, ("sample", "begin", "size", "at")), names


def row_mark(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) & 0xFFFF


def rank_names(entries: Entries) -> tuple[Entries, Entries]:
    """Stretches whose name occurs in a smaller document, and the others, in order."""
    order = np.lexsort(tuple(entries[n] for n in ("begin", "row", "doc", "name", "sample")))
    own = taken(entries, order)
    sample, name, doc = own["sample"], own["name"], own["doc"]
    if not len(doc):
        return own, own
    new = np.concatenate(([True], (sample[1:] != sample[:-1]) | (name[1:] != name[:-1])))
    repeated = doc > doc[new][np.cumsum(new) - 1]
    return taken(own, repeated), taken(own, ~repeated)


def shares(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """Buckets by the first bits of sorted names: ``bucket, from, to``."""
    bucket = (keys >> np.uint64(NAME_BITS - bits)).astype(np.int64)
    edge = np.flatnonzero(np.diff(bucket)) + 1
    begin = np.concatenate(([0], edge)) if len(keys) else np.zeros(0, np.int64)
    end = np.append(edge, len(keys))
    return list(zip(bucket[begin].tolist(), begin.tolist(), end.tolist()))


def place_of(doc: np.ndarray, row: np.ndarray, places: int) -> np.ndarray:
    mixed = (doc.view(np.uint64) ^ (row.astype(np.uint64) << np.uint64(40))) * M1
    mixed ^= mixed >> np.uint64(31)
    return ((mixed * M2 >> np.uint64(20)) % np.uint64(places)).astype(np.int64)


def by_place(entries: Entries, names, places: int, kind: int) -> Iterator[tuple[int, int, bytes]]:
    to = place_of(entries["doc"], entries["row"], places)
    order = np.argsort(to, kind="stable")
    edge = np.flatnonzero(np.diff(to[order])) + 1
    for part in np.split(order, edge) if len(order) else []:
        yield int(to[part[0]]), kind, pack(taken(entries, part), names)


def as_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, kind, packed = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int64()), pa.array(kind, pa.int32()), pa.array(packed, pa.binary())],
        names=["bucket", "kind", "packed"],
    )


def sampler(bits: int, places: int) -> Callable:
    """Texts to packed entries by sample, and what repeats inside the task to ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def part() -> pa.RecordBatch:
            repeated, own = rank_names(join_entries(held, tuple(COLUMNS)))
            rows = [
                (b, ENTRIES, pack(taken(own, slice(i, j)), tuple(COLUMNS)))
                for b, i, j in shares(own["sample"], bits)
            ]
            return as_batch(rows + list(by_place(repeated, RANGE, places, RANGES)))

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc, data in zip(ids, batch.column("text").to_pylist()):
                own, names = stretches(data)
                count = len(names)
                if not count:
                    continue
                own["name"] = np.array(names, np.uint64) >> TO_NAME
                own["doc"] = np.full(count, LAST_ID if doc is None else doc, np.int64)
                own["row"] = np.full(count, row_mark(data), np.uint16)
                held.append(own)
                n += count
            if n > FLUSH:
                yield part()
                held, n = [], 0
        if held:
            yield part()

    return run


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, dict]]]]:
    """Rows in order of bucket, bucket by bucket."""
    rows = ((row["bucket"], row) for batch in batches for row in batch.to_pylist())
    for bucket, own in groupby(rows, key=lambda r: r[0]):
        yield bucket, (row for _, row in own)


class ByPlace:
    """Entries on their way to the places of their documents, packed once there are many."""

    def __init__(self, names: tuple[str, ...], places: int, kind: int):
        self.names, self.places, self.kind, self.held, self.n = names, places, kind, [], 0

    def add(self, entries: Entries) -> None:
        self.held.append({n: entries[n] for n in self.names})
        self.n += len(entries["doc"])

    def ready(self, least: int) -> Iterator[tuple[int, int, bytes]]:
        if self.n > least:
            entries = join_entries(self.held, self.names)
            self.held, self.n = [], 0
            yield from by_place(entries, self.names, self.places, self.kind)


def ranker(places: int) -> Callable:
    """Entries of all tasks to ranges that are removed, and stretches that need sorting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone, asked = ByPlace(RANGE, places, RANGES), ByPlace(ASKED, places, ENTRIES)
        for bucket, rows in grouped(batches):
            held, out = [], []
            for row in rows:
                if row["kind"] == RANGES:
                    out.append((bucket, RANGES, row["packed"]))
                else:
                    held.append(unpack(row["packed"], tuple(COLUMNS))[0])
            repeated, own = rank_names(join_entries(held, tuple(COLUMNS)))
            gone.add(repeated)
            sample, name, doc = own["sample"], own["name"], own["doc"]
            if len(sample):
                new = np.concatenate(([True], sample[1:] != sample[:-1]))
                group = np.cumsum(new) - 1
                first = np.flatnonzero(new)
                differ = np.logical_or.reduceat(name != name[first][group], first)
                several = np.logical_or.reduceat(doc != doc[first][group], first)
                asked.add(taken(own, (differ & several)[group]))
            yield as_batch([*out, *gone.ready(FLUSH), *asked.ready(FLUSH)])
        yield as_batch([*gone.ready(0), *asked.ready(0)])

    return run


def cut(data: bytes, own: Entries) -> Iterator[tuple[int, int, int, bytes]]:
    """A stretch in two: the suffixes that hold the 33 bytes from the sample on, and those that
    hold the 33 bytes up to its end. Yields ``bucket name, begin, size, bytes``."""
    for begin, size, at in zip(*(own[n].tolist() for n in ("begin", "size", "at"))):
        sample = begin + at
        # a suffix that begins up to 17 bytes before the sample holds 33 bytes from there
        split = min(max(begin, sample - (DEPTH - SIDE)), begin + size)
        for side, i, j in ((0, split, begin + size), (1, begin, split)):
            if i < j:
                key = sample if side == 0 else sample + GRAM - SIDE
                digest = xxhash.xxh3_64_intdigest(data[key : key + SIDE], side)
                yield digest >> int(TO_NAME), i, j - i, data[i : j + DEPTH - 1]


SORTED = ("sample", "doc", "row", "begin", "size")


def cutter(bits: int) -> Callable:
    """Documents with the stretches asked of them, to packed suffix buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tails, n = [], [], 0

        def part() -> pa.RecordBatch:
            own = join_entries(held, SORTED)
            order, out = np.argsort(own["sample"], kind="stable"), []
            own = taken(own, order)
            for b, i, j in shares(own["sample"], bits):
                tail = b"".join(tails[k] for k in order[i:j].tolist())
                out.append((b, ENTRIES, pack(taken(own, slice(i, j)), SORTED, tail)))
            return as_batch(out)

        for doc, data, own in with_documents(batches, ASKED, ENTRIES):
            if not len(own["doc"]):
                continue
            pieces = list(cut(data, own))
            count = len(pieces)
            held.append(
                {
                    "sample": np.array([p[0] for p in pieces], np.uint64),
                    "doc": np.full(count, own["doc"][0], np.int64),
                    "row": np.full(count, own["row"][0], np.uint16),
                    "begin": np.array([p[1] for p in pieces], np.uint32),
                    "size": np.array([p[2] for p in pieces], np.uint8),
                }
            )
            tails += [p[3] for p in pieces]
            n += count
            if n > FLUSH:
                yield part()
                held, tails, n = [], [], 0
        if held:
            yield part()

    return run


def with_documents(batches: Iterator[pa.RecordBatch], names, kind: int):
    """Each document of a place with its entries, which come before the documents."""
    place, held, own, order, doc = None, [], None, None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != place:
                place, held, own = row["bucket"], [], None
            if row["kind"] != TEXT:
                if row["kind"] == kind:
                    held.append(unpack(row["packed"], names)[0])
                continue
            if own is None:
                own = join_entries(held, names)
                order = np.lexsort((own["row"], own["doc"]))
                own, held = taken(own, order), []
            data = row["packed"]
            doc = LAST_ID if row["doc_id"] is None else row["doc_id"]
            i, j = np.searchsorted(own["doc"], doc), np.searchsorted(own["doc"], doc, "right")
            mine = taken(own, slice(i, j))
            if j > i:
                mine = taken(mine, mine["row"] == row_mark(data))
            yield row["doc_id"], data, mine


def sort_suffixes(own: Entries, text: bytes) -> Entries:
    """Ranges of one suffix each that are equal to one of the same bucket in a smaller document.
    ``own`` is in order of bucket and ``text`` holds the bytes of its stretches."""
    size = own["size"].astype(np.int64)
    source = np.cumsum(size + DEPTH - 1) - (size + DEPTH - 1)
    which = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    raw = np.frombuffer(text + b"\0" * 8, np.uint8)
    at = source[which] + within
    words = np.ndarray((len(raw) - 7,), np.dtype(">u8"), raw, 0, (1,))
    # 50 bytes as big-endian numbers, the last of which overlaps the one before
    key = [words[at + step].astype(np.uint64) for step in (0, 8, 16, 24, 32, 40, DEPTH - 8)]
    doc, bucket = own["doc"][which], own["sample"][which]
    order = np.lexsort((doc, *reversed(key), bucket))
    same = np.ones(len(order) - 1, bool)
    for k in (bucket, *key):
        same &= k[order][1:] == k[order][:-1]
    new = np.concatenate(([True], ~same))
    ranked = doc[order]
    hit = order[ranked > ranked[new][np.cumsum(new) - 1]]
    return {
        "doc": doc[hit],
        "row": own["row"][which][hit],
        "begin": (own["begin"][which][hit] + within[hit]).astype(np.uint32),
        "size": np.ones(len(hit), np.uint8),
    }


def sorter(places: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = ByPlace(RANGE, places, RANGES)
        for _, rows in grouped(batches):
            parts, texts = [], []
            for row in rows:
                own, tail = unpack(row["packed"], SORTED)
                parts.append(own)
                texts.append(tail)
            own, text = join_entries(parts, SORTED), np.frombuffer(b"".join(texts), np.uint8)
            length = own["size"].astype(np.int64) + DEPTH - 1
            source = np.cumsum(length) - length
            order = np.argsort(own["sample"], kind="stable")
            # a bucket matters if it has two documents; several are sorted together
            name, doc = own["sample"][order], own["doc"][order]
            first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
            group = np.cumsum(np.concatenate(([True], name[1:] != name[:-1]))) - 1
            several = np.logical_or.reduceat(doc != doc[first][group], first)
            order, group = order[several[group]], group[several[group]]
            load = np.cumsum(own["size"][order].astype(np.int64)) // SORTED_AT_ONCE
            last = np.append(group[1:] != group[:-1], True)
            # cut only where a bucket ends
            batch_of = np.concatenate(([0], np.cumsum(last)[:-1]))
            lead = load[np.flatnonzero(last)][batch_of] if len(order) else load
            for part in np.split(order, np.flatnonzero(np.diff(lead)) + 1) if len(order) else []:
                pieces = [text[source[i] : source[i] + length[i]] for i in part.tolist()]
                gone.add(sort_suffixes(taken(own, part), np.concatenate(pieces).tobytes()))
                yield as_batch(list(gone.ready(FLUSH)))
        yield as_batch(list(gone.ready(0)))

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their ranges, to what is left of them."""
    rows = []
    schema = pa.schema([(c.split()[0], pa.string() if "sha" in c else pa.int64())
                        for c in RESULT.split(", ")])
    for doc, data, own in with_documents(batches, RANGE, RANGES):
        kept, removed, spans = data, 0, 0
        if len(own["doc"]):
            change = np.zeros(len(data) + 1, np.int64)
            begin = own["begin"].astype(np.int64)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + own["size"] + DEPTH - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            removed = int(gone.sum())
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        rows.append((doc, len(data), removed, spans, hashlib.sha256(kept).hexdigest()))
        if len(rows) == 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
            rows = []
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (2 * parts - 1).bit_length())
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))

    def routed(rows: DataFrame, *order: str) -> DataFrame:
        return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", *order)

    @F.arrow_udf("long")
    def place(ids: pa.Array, texts: pa.Array) -> pa.Array:
        doc = ids.fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.array([row_mark(t) for t in texts.to_pylist()], np.uint16)
        return pa.array(place_of(doc, row, parts))

    none = F.lit(None)
    texts = own.select(
        place("doc_id", "text").alias("bucket"),
        F.lit(TEXT).alias("kind"),
        F.col("text").alias("packed"),
        "doc_id",
    )

    def beside(entries: DataFrame) -> DataFrame:
        return routed(entries.withColumn("doc_id", none.cast("long")).unionByName(texts), "kind")

    sampled = own.mapInArrow(sampler(bits, parts), SHUFFLED)
    ranked = written(routed(sampled).mapInArrow(ranker(parts), SHUFFLED), "repeat-ranks")
    asked = beside(ranked.filter(F.col("kind") == ENTRIES)).mapInArrow(cutter(bits), SHUFFLED)
    found = routed(asked).mapInArrow(sorter(parts), SHUFFLED)
    ranges = ranked.filter(F.col("kind") == RANGES).unionByName(found)
    return beside(ranges).mapInArrow(remover, RESULT)
