"""SimHash near-dedup over an inverted index of byte positions.

A fingerprint has eight bytes. Two that differ in at most three bits share at least five bytes
in place: each differing bit spoils one. The index posts every fingerprint under the bytes it
has at five positions, for all 56 choices of five; so a pair whose tally of shared positional
bytes reaches the guaranteed minimum meets in a posting list, and one below it never does. Each
list's pairs are verified by their differing bits.

A list of a single byte would hold a 256th of all fingerprints. One of five holds those that
agree in 40 bits, at most 2^24 whatever the corpus, and mostly one. Lists of up to
``PAIRWISE`` are compared pair by pair. In longer ones each fingerprint looks up its neighbours,
the 2,324 values at up to three bits from its free 24, so the work stays linear in the list.
Only a star per group of linked fingerprints leaves a list, never its pairs.

Equal fingerprints are one posting, however many documents have them. Components come from
star contractions (``components``).

Defined results: a text without words has fingerprint zero and links like any other; null is
such a text. Rows that share a doc_id are judged one by one; a null doc_id is never the smallest
unless its component has no other. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterance_guard.llm.common import LOWER, small_batches, text_bytes, written
from utterance_guard.llm.components import components

WIDTH = 3
SEED = 42
MOST_BITS = 3
SHARED_BYTES = 8 - MOST_BITS
PAIRWISE = 512
CHUNK = 1 << 16
CHOICES = tuple(combinations(range(8), SHARED_BYTES))
FREE_BITS = 8 * MOST_BITS
#: What up to three bits can change among the free 24.
NEIGHBOURS = np.array(
    [sum(1 << b for b in bits) for k in (1, 2, 3) for bits in combinations(range(FREE_BITS), k)],
    np.int64,
)


def shingle_hashes(data: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 of each shingle of lower-cased words, repeats included."""
    words = data.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[: len(words) - width + 1].tolist()
    end = end[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(begin, end)], np.uint64)


def fingerprint(data: bytes, width: int = WIDTH) -> int:
    """Bits set in over half the hashes, as a signed 64-bit number."""
    hashes = shingle_hashes(data, width)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def print_column(text: str, width: int) -> Column:
    @F.arrow_udf(T.LongType())
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, width) for t in texts.to_pylist()], pa.int64())

    return prints(text_bytes(text))


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether signed 64-bit numbers differ in few bits."""
    return np.bitwise_count((a ^ b).view(np.uint64)) <= MOST_BITS


def spread(links: np.ndarray) -> np.ndarray:
    """The smallest index each one reaches, from a symmetric matrix of links."""
    label = np.arange(len(links))
    while True:
        new = np.where(links, label[None, :], len(links)).min(1)
        new = np.minimum(new, label)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def groups_by_pairs(values: np.ndarray) -> np.ndarray:
    return spread(near(values[:, None], values[None, :]))


def free_part(values: np.ndarray, choice: tuple[int, ...]) -> np.ndarray:
    """The bytes at the positions that are not chosen, side by side."""
    out = np.zeros(len(values), np.int64)
    for place, byte in enumerate(sorted(set(range(8)) - set(choice))):
        out |= (values >> np.int64(8 * byte) & np.int64(255)) << np.int64(8 * place)
    return out


def groups_by_neighbours(values: np.ndarray, choice: tuple[int, ...]) -> np.ndarray:
    """The same for a long list: values are looked up in a bitmap of the free bits."""
    free = free_part(values, choice)
    order = np.argsort(free)
    ranked = free[order]
    there = np.zeros(1 << FREE_BITS, bool)
    there[ranked] = True
    label, changed = np.arange(len(values)), True  # by rank
    while changed:
        old = label.copy()
        for mask in NEIGHBOURS:
            other = ranked ^ mask
            hit = np.flatnonzero(there[other])
            if hit.size:
                at = np.searchsorted(ranked, other[hit])
                label[hit] = np.minimum(label[hit], label[at])
        label = np.minimum(label, label[label])
        changed = (label != old).any()
    out = np.empty(len(values), np.int64)
    out[order] = order[label]
    return out


def link_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read posting lists in order of ``choice, bytes``; yield links ``u, v``, a star for each
    group in a list."""
    rest: tuple[np.ndarray, ...] | None = None

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        names = ("choice", "bytes", "fp")
        return tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in names)

    def links(choice: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1
        begin = np.concatenate(([0], new))
        size = np.diff(np.concatenate((begin, [len(fp)])))
        two = begin[size == 2]
        a, b = fp[two], fp[two + 1]
        close = near(a, b)
        us, vs = [a[close]], [b[close]]
        for at, n in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
            own = fp[at : at + n]
            if n <= PAIRWISE:
                label = groups_by_pairs(own)
            else:
                label = groups_by_neighbours(own, CHOICES[int(choice[at])])
            us.append(own)
            vs.append(own[label])
        u, v = np.concatenate(us), np.concatenate(vs)
        linked = u != v
        return pa.RecordBatch.from_arrays(
            [pa.array(u[linked]), pa.array(v[linked])], names=["u", "v"]
        )

    for batch in batches:
        now = arrays(batch)
        if rest is not None:
            now = tuple(np.concatenate(pair) for pair in zip(rest, now))
        choice, key, fp = now
        if not len(fp):
            continue
        # the last list may go on in the next batch
        last = np.flatnonzero((choice != choice[-1]) | (key != key[-1]))
        cut = int(last[-1]) + 1 if last.size else 0
        rest = tuple(x[cut:] for x in now)
        if cut:
            yield links(*(x[:cut] for x in now))
    if rest is not None and len(rest[0]):
        yield links(*rest)


def posted(fps: DataFrame, parts: int) -> DataFrame:
    """Posting lists: every fingerprint under its bytes at each choice of positions."""

    def masked(choice: tuple[int, ...]):
        mask = sum(255 << (8 * b) for b in choice)
        return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))

    keys = F.array(
        *[
            F.struct(F.lit(i).alias("choice"), masked(c).alias("bytes"))
            for i, c in enumerate(CHOICES)
        ]
    )
    return (
        fps.select("fp", F.inline(keys))
        .repartition(parts, "choice", "bytes")
        .sortWithinPartitions("choice", "bytes")
    )


def near_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH
) -> DataFrame:
    """``doc_id, fp, component_id`` for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prints = written(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"), print_column(text, width).alias("fp")
        ),
        "fingerprints",
    )
    firsts = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-prints")
    links = posted(firsts.select("fp"), parts).mapInArrow(link_lists, "u long, v long")
    stars = components(links)
    rooted = written(
        firsts.join(stars, firsts["fp"] == stars["u"], "left").select(
            "fp", "first", F.coalesce("v", "fp").alias("root")
        ),
        "rooted-prints",
    )
    named = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "near-roots")
    of_print = written(rooted.join(named, "root").select("fp", "component_id"), "near-groups")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def hex_print(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_smallest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, the smallest id, with all its columns. Rows that share a
    doc_id stay or go together; those without one stay where no row of their group has one."""
    kept = written(
        near_groups(docs, doc_id, text).filter(F.expr("doc_id <=> component_id")), "near-kept"
    )
    number = docs[doc_id].cast("long")
    ids = kept.select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.join(ids, number == ids["_kept"], "left_semi")
    lone = kept.filter("doc_id IS NULL").select(F.col("fp").alias("_kept")).distinct()
    name = "_fp"
    while name in {c.lower() for c in docs.columns}:
        name = "_" + name
    nameless = docs.filter(number.isNull()).withColumn(name, print_column(text, WIDTH))
    nameless = nameless.join(lone, nameless[name] == lone["_kept"], "left_semi").drop(name)
    return named.unionByName(nameless)
