"""Ranked lexical search by Block-Max MaxScore over document shards.

Index. Each task cuts its documents into shards of at most ``SHARD_DOCS`` documents and about
``SHARD_TOKENS`` terms. A shard has a posting list for every term in it: document numbers as
differences and frequencies, packed as variable-length bytes in blocks of ``BLOCK`` postings.
Each block's head has its last document, its end in the data and the highest value a posting in
it adds for a weight of one. The index is one table with a row per shard and term; nothing is
shuffled to make it. Corpus counts come from a pass in the JVM before it.

Search. The lists of the queries' terms are dealt by shard. For each query a task keeps a heap of
its best documents over all its shards. In a shard, lists are ranked by their bounds, weight
times the highest value in the list. From the strongest list down, lists are read whole until
the bounds of those left add up to less than the score of the k-th best document so far: these
are non-essential. Documents that no essential list holds are out. The others are bounded by
what they have plus the block maxima at their place in each non-essential list, and rejected
below the threshold before a block is unpacked; the rest are completed list by list under the
same test. The shards' heaps are merged by a window that Spark limits to k rows per task first.

The threshold lets ties through, so equal scores are ordered by doc_id over all shards.

Queries come in blocks of at most ``QUERY_BYTES`` of text, measured first; each is one pass over
the index. The index holds all terms of all documents; a pass reads the lists it needs.

Defined results: a null or empty text has no term, and such a document is not ranked. Rows that
share an item_id are one item, with the terms of its distinct texts; null item_ids share one. Rows of
``docs`` that share a doc_id are ranked one by one; a null doc_id comes after others of equal
score. A very long text is a shard of its own. Empty tables give an empty result. Columns beside
those named are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from utterance_guard.llm.common import small_batches, text_bytes, written

#: Fixed value: everything but the 62 letters and digits of ASCII separates terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
K = 10
BLOCK = 128
SHARD_DOCS = 1 << 16
SHARD_TOKENS = 1 << 22
QUERY_BYTES = 8 << 20
HEAD = np.dtype([("last", "<u2"), ("top", "<u4"), ("end", "<u4")])
ROWS = "shard long, term binary, n long, head binary, data binary"
FOUND = "item_id long, doc_id long, score long"
#: The row of a shard that has its documents instead of a list.
DOCUMENTS = b""


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


def dampening(n, n_docs: int, n_terms: int):
    """What a document of n terms sets against the frequency of a term."""
    return 100 - 75 + (75 * n * n_docs) // n_terms


def value(tf, damp):
    """What a posting adds for a weight of one."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * damp)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low ones first, the high bit set on all but the last; and the bytes'
    end for each value."""
    width = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        longer = values >= 1 << bits
        if not longer.any():
            break
        width += longer
    ends = np.cumsum(width)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    first = ends - width
    for j in range(int(width.max(initial=0))):
        own = width > j
        more = width[own] > j + 1
        out[first[own] + j] = ((values[own] >> (7 * j)) & 127) | (more.astype(np.int64) << 7)
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    stops = np.flatnonzero(data < 128)
    if len(stops) == len(data):
        return data.astype(np.int64)
    first = np.append(0, stops[:-1] + 1)
    width = stops - first
    out = (data[first] & 127).astype(np.int64)
    for j in range(1, int(width.max()) + 1):
        own = np.flatnonzero(width >= j)
        out[own] |= (data[first[own] + j] & 127).astype(np.int64) << (7 * j)
    return out


# index


def cells(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.append(0, ends).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.binary(), len(ends), buffers)


class Shard:
    """Documents of a task on their way to rows of the index."""

    def __init__(self):
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.doc_ids, self.lengths, self.held, self.tokens = [], [], [], 0

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(terms))
        own = map(self.vocabulary.__getitem__, terms)
        self.held.append(np.fromiter(own, np.int32, len(terms)))
        self.tokens += len(terms)

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Term, document and frequency, by term and document."""
        n = len(self.doc_ids)
        place = np.repeat(np.arange(n), self.lengths)
        both = np.concatenate(self.held).astype(np.int64) * n + place
        self.held = []
        both.sort()
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        tf = np.diff(np.append(first, len(both)))
        return both[first] // n, both[first] % n, tf

    def rows(self, number: int, n_docs: int, n_terms: int, block: int) -> Iterator[pa.RecordBatch]:
        term, doc, tf = self.postings()
        lengths = np.array(self.lengths, np.int64)
        lists = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        size = np.diff(np.append(lists, len(term)))
        rank = np.arange(len(term)) - np.repeat(lists, size)
        before = np.append(-1, doc[:-1])
        before[rank == 0] = -1
        values = np.empty(2 * len(term), np.int64)
        values[0::2], values[1::2] = doc - before, tf
        data, ends = pack(values)
        ends = ends[1::2]  # after each posting
        begins = np.append(0, ends)[lists]
        blocks = np.flatnonzero(rank % block == 0)
        last = np.append(blocks[1:], len(term)) - 1
        head = np.empty(len(blocks), HEAD)
        head["last"] = doc[last]
        worth = value(tf, dampening(lengths[doc], n_docs, n_terms))
        head["top"] = np.maximum.reduceat(worth, blocks)
        per_list = -(-size // block)
        head["end"] = ends[last] - np.repeat(begins, per_list)
        ids = np.array([-1 if i is None else i for i in self.doc_ids], np.int64)
        none = np.array([i is None for i in self.doc_ids], np.uint8)
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "shard": number,
                    "term": DOCUMENTS,
                    "n": len(ids),
                    "head": ids.tobytes(),
                    "data": lengths.astype("<i8").tobytes() + none.tobytes(),
                }
            ],
            pa.schema([
                ("shard", pa.int64()), ("term", pa.binary()), ("n", pa.int64()),
                ("head", pa.binary()), ("data", pa.binary()),
            ]),
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(size), number), pa.int64()),
                pa.array(list(self.vocabulary), pa.binary()),
                pa.array(size, pa.int64()),
                cells(head.view(np.uint8), np.cumsum(per_list) * HEAD.itemsize),
                cells(data, ends[np.append(lists[1:], len(term)) - 1]),
            ],
            names=["shard", "term", "n", "head", "data"],
        )


@dataclass
class Index:
    table: DataFrame
    n_docs: int
    n_terms: int


def build_index(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shard_docs: int = SHARD_DOCS,
    shard_tokens: int = SHARD_TOKENS,
    block: int = BLOCK,
) -> Index:
    """Index every row, and write the index to the shared folder."""
    if not 0 < shard_docs <= SHARD_DOCS:
        raise ValueError("a shard numbers its documents in 16 bits")
    spark = docs.sparkSession
    small_batches(spark)
    n = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(TERM))
    total = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, n_terms = total[0], total[1] or 0

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        shard, made = Shard(), 0
        for batch in batches:
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                terms = terms_of(batch.column("text")[i].as_py())
                if not terms:
                    continue
                full = shard.tokens + len(terms) > shard_tokens or len(shard.doc_ids) == shard_docs
                if shard.tokens and full:
                    yield from shard.rows(first + made, n_docs, n_terms, block)
                    shard, made = Shard(), made + 1
                shard.add(doc, terms)
        if shard.tokens:
            yield from shard.rows(first + made, n_docs, n_terms, block)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    return Index(written(rows.mapInArrow(index, ROWS), "lexical-index"), n_docs, n_terms)


# search


class Postings:
    """A list of a shard; blocks are unpacked when they are asked for, and then kept."""

    def __init__(self, head: bytes, data: bytes, damp: np.ndarray):
        self.head = np.frombuffer(head, HEAD)
        self.tops = np.append(self.head["top"].astype(np.int64), 0)
        self.top = int(self.tops.max())
        self.data, self.damp = data, damp
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.all: tuple[np.ndarray, np.ndarray] | None = None

    def _open(self, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        lo = int(self.head["end"][first - 1]) if first else 0
        base = int(self.head["last"][first - 1]) if first else -1
        raw = np.frombuffer(self.data, np.uint8)[lo : int(self.head["end"][end - 1])]
        numbers = unpack(raw)
        docs = base + np.cumsum(numbers[0::2])
        return docs, value(numbers[1::2], self.damp[docs])

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if self.all is None:
            self.all, self.held = self._open(0, len(self.head)), {}
        return self.all

    def blocks(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.all is not None:
            yield self.all
            return
        for b in np.unique(wanted).tolist():
            if b < len(self.head):
                if b not in self.held:
                    self.held[b] = self._open(b, b + 1)
                yield self.held[b]


@dataclass
class Heap:
    """The best documents of a query so far."""

    scores: np.ndarray
    doc_ids: np.ndarray
    none: np.ndarray

    @classmethod
    def empty(cls) -> Heap:
        return cls(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))

    def threshold(self, k: int) -> int:
        """What a document must reach to enter."""
        return int(self.scores[-1]) if len(self.scores) == k else 1

    def merge(self, k: int, scores: np.ndarray, doc_ids: np.ndarray, none: np.ndarray) -> None:
        both = [np.concatenate(x) for x in (
            (self.scores, scores), (self.doc_ids, doc_ids), (self.none, none),
        )]
        best = np.lexsort((both[1], both[2], -both[0]))[:k]
        self.scores, self.doc_ids, self.none = (x[best] for x in both)


def best_in_shard(
    lists: list[tuple[int, Postings]], n: int, k: int, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """Documents that reach ``least`` and can be among the k best of the shard, with their
    scores. ``lists`` has the weight of each; lists of weight zero add nothing."""
    lists = sorted(((w * p.top, w, p) for w, p in lists if w > 0), key=lambda x: x[0])
    reach = np.cumsum([bound for bound, _, _ in lists])
    scores = np.zeros(n, np.int64)
    weak = len(lists)
    # essential lists, until those left cannot lift a document over the threshold by themselves
    while weak and reach[weak - 1] >= least:
        weak -= 1
        _, w, postings = lists[weak]
        docs, worth = postings.whole()
        scores[docs] += w * worth
        if (len(lists) - weak) % 4 == 0 and n > k:
            # partial scores only rise: the k-th of them is a bound for the k-th at the end
            least = max(least, int(np.partition(scores, n - k)[n - k]))
    if weak and n > k:
        least = max(least, int(np.partition(scores, n - k)[n - k]))
    held = np.flatnonzero((scores > 0) & (scores + (reach[weak - 1] if weak else 0) >= least))
    places, tops = [], []
    for _, w, postings in lists[:weak]:
        places.append(np.searchsorted(postings.head["last"], held))
        tops.append(w * postings.tops[places[-1]])
    rest = np.sum(tops, axis=0) if tops else np.zeros(len(held), np.int64)
    alive = scores[held] + rest >= least
    for j in range(weak - 1, -1, -1):
        held, rest = held[alive], rest[alive]
        places, tops = [x[alive] for x in places], [x[alive] for x in tops]
        if not len(held):
            break
        _, w, postings = lists[j]
        for docs, worth in postings.blocks(places[j]):
            scores[docs] += w * worth
        rest = rest - tops[j]
        alive = scores[held] + rest >= least
    held = held[alive] if len(alive) == len(held) else held
    return held, scores[held]


def searcher(queries, weights, k: int, n_docs: int, n_terms: int):
    """``queries``: item_id and counted terms; ``weights``: by term. Both broadcast."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, by_term = queries.value, weights.value
        heaps = [Heap.empty() for _ in asked]

        def answer(lists: dict[bytes, tuple[bytes, bytes]]) -> None:
            head, data = lists.pop(DOCUMENTS)
            ids = np.frombuffer(head, np.int64)
            lengths = np.frombuffer(data, "<i8", len(ids))
            none = np.frombuffer(data, np.uint8, len(ids), 8 * len(ids))
            damp = dampening(lengths, n_docs, n_terms)
            opened = {t: Postings(h, d, damp) for t, (h, d) in lists.items()}
            for (_, terms), heap in zip(asked, heaps):
                own = [(c * by_term[t], opened[t]) for t, c in terms.items() if t in opened]
                if own:
                    held, scores = best_in_shard(own, len(ids), k, heap.threshold(k))
                    heap.merge(k, scores, ids[held], none[held])

        shard, lists = None, {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "term", "head", "data")]
            for number, term, head, data in zip(*columns):
                if number != shard and lists:
                    answer(lists)
                    lists = {}
                shard = number
                lists[term] = (head, data)
        if lists:
            answer(lists)
        for (item, _), heap in zip(asked, heaps):
            if len(heap.scores):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item] * len(heap.scores), pa.int64()),
                        pa.array(heap.doc_ids, pa.int64(), mask=heap.none.astype(bool)),
                        pa.array(heap.scores, pa.int64()),
                    ],
                    names=["item_id", "doc_id", "score"],
                )

    return search


def query_blocks(
    items: DataFrame, item_id: str, text: str, block_bytes: int
) -> Iterator[list[tuple[int | None, dict[bytes, int]]]]:
    """Queries in parts that each hold few enough bytes to be collected."""
    rows = items.select(
        F.col(item_id).cast("long").alias("item_id"), text_bytes(text).alias("text")
    ).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    part = F.pmod(F.xxhash64("item_id"), F.lit(n))
    for i in range(n):
        found: dict[int | None, Counter] = {}
        for row in rows.filter(part == i).collect():
            found.setdefault(row["item_id"], Counter()).update(terms_of(bytes(row["text"])))
        yield [(item, dict(terms)) for item, terms in found.items() if terms]


def search(
    index: Index,
    items: DataFrame,
    k: int = K,
    item_id: str = "item_id",
    text: str = "text",
    block_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item."""
    spark = items.sparkSession
    small_batches(spark)
    found = spark.createDataFrame([], FOUND)
    if index.n_terms:
        for asked in query_blocks(items, item_id, text, block_bytes):
            if asked:
                found = found.unionByName(_search(spark, index, asked, k))
    best = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _search(spark: SparkSession, index: Index, asked: list, k: int) -> DataFrame:
    own = sorted({t for _, terms in asked for t in terms})
    wanted = spark.createDataFrame([(t,) for t in [DOCUMENTS, *own]], "term binary")
    lists = index.table.join(F.broadcast(wanted), "term", "left_semi")
    counted = lists.groupBy("term").agg(F.sum("n").alias("df")).collect()  # a row per query term
    weights = {bytes(r["term"]): weight(r["df"], index.n_docs) for r in counted}
    context = spark.sparkContext
    task = searcher(
        context.broadcast(asked), context.broadcast(weights), k, index.n_docs, index.n_terms
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lists.select("shard", "term", "head", "data").repartition(parts, "shard")
    return dealt.sortWithinPartitions("shard", "term").mapInArrow(task, FOUND)
