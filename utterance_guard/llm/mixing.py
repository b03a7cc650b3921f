"""Mixing sources to target weights.

The words of a source, document after document, form one stream that is cut into blocks of
fixed length. Every output shard draws its numbers of slots per source from a multinomial whose
weights are what each source still has to give, so all shards together give each source exactly
its number of slots. Slot j of a source stands for block ``p(j mod n)``, p being a pseudorandom
permutation of its n block numbers: no block comes twice before all have come once. Slots and
blocks are joined by source and block number. The last slot of a source takes the first words
of its block only, so that the source gives its target to the word.

The stream's offsets come from one range sort of narrow rows and sums per partition. A hot
source is spread over many partitions by the sort and over its block numbers by the join. The
driver holds a few numbers per source and one per shard and source.

Defined results: a null text has no words. Sources are in order of code points, null last.
Repeated rows are separate rows in the stream, next to each other. Documents without words and
sources without words take none. An empty table gives an empty result. Of other columns none is
read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from utterance_guard.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 512
SHARD_SLOTS = 1 << 14
SEED = 20240229
ROUNDS = 4


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(
    sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE
) -> list[float]:
    """What each source gives: by weight, at most ``MOST_REPEATS`` times its size. The excess
    of a source that reaches its limit goes to the others by weight until none is above."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    limit = [float(MOST_REPEATS * s) for s in sizes]
    given, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    rest = share * sum(sizes)
    while open_:
        total = sum(weight[i] for i in open_)
        full = {i for i in open_ if rest * weight[i] / total > limit[i]}
        if not full:
            for i in open_:
                given[i] = rest * weight[i] / total
            break
        for i in full:
            given[i] = limit[i]
        rest -= sum(limit[i] for i in sorted(full))
        open_ -= full
    return given


def _mix(value: np.ndarray, key: np.ndarray) -> np.ndarray:
    z = value + key * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n) for each key, applied to ``index``: a Feistel
    network over the next even number of bits, walked until it lands inside the range."""
    index, n, key = (np.asarray(x).astype(np.uint64) for x in (index, n, key))
    if not index.size:
        return index.astype(np.int64)
    bits = np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2).astype(np.uint64)
    bits += (np.uint64(1) << (np.uint64(2) * bits)) < n  # where the logarithm was rounded down
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = index.copy(), np.arange(index.size)
    rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    with np.errstate(over="ignore"):
        while todo.size:
            b, m, k = bits[todo], mask[todo], key[todo]
            left, right = out[todo] >> b, out[todo] & m
            for r in rounds:
                if back:
                    left, right = right ^ (_mix(left + np.uint64(r << 58), k) & m), left
                else:
                    left, right = right, left ^ (_mix(right + np.uint64(r << 58), k) & m)
            out[todo] = (left << b) | right
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


@dataclass
class Source:
    """One source's numbers."""

    index: int
    name: str | None
    size: int
    target: float
    blocks: int = 0
    slots: int = 0
    last: int = 0  # words that the last slot takes

    def plan(self, block_words: int, seed: int) -> None:
        words = round(self.target)
        self.blocks = -(-self.size // block_words)
        if not words:
            return
        short = self.blocks * block_words - self.size
        at = int(permute([self.blocks - 1], [self.blocks], [seed + self.index], back=True)[0])

        def given(slots: int) -> int:
            whole, part = divmod(slots, self.blocks)
            return slots * block_words - short * (whole + (part > at))

        self.slots = words // block_words
        while given(self.slots) < words:
            self.slots += 1
        self.last = words - given(self.slots - 1)


def draw(sources: list[Source], shard_slots: int, seed: int) -> list[tuple[int, int, int, int]]:
    """Rows ``shard, source, first, n``: the slots each shard draws of each source."""
    rest = np.array([s.slots for s in sources], np.int64)
    first, rows, shard = np.zeros_like(rest), [], 0
    while rest.any():
        random, wanted = np.random.default_rng([seed, shard]), min(shard_slots, int(rest.sum()))
        drawn = np.zeros_like(rest)
        while wanted:
            open_ = rest - drawn
            more = np.minimum(random.multinomial(wanted, open_ / open_.sum()), open_)
            drawn += more
            wanted -= int(more.sum())
        rows += [(shard, i, int(first[i]), int(drawn[i])) for i in np.flatnonzero(drawn).tolist()]
        first += drawn
        rest -= drawn
        shard += 1
    return rows


def offsets(docs: DataFrame, parts: int) -> DataFrame:
    """``doc_id, source, size, offset``: where a document begins in its source's stream."""
    narrow = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count().alias("size"),
            F.xxhash64("text").alias("check"),
        ),
        "mix-sizes",
    )

    def local(batches):
        seen: dict[str | None, int] = {}
        for batch in batches:
            sources = batch.column("source").to_pylist()
            starts = []
            for source, size in zip(sources, batch.column("size").to_pylist()):
                starts.append(seen.get(source, 0))
                seen[source] = starts[-1] + size
            columns = [batch.column(c) for c in ("part", "doc_id", "source", "size")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(starts, pa.int64())],
                names=["part", "doc_id", "source", "size", "start"],
            )

    ordered = written(
        narrow.repartitionByRange(parts, "source", "doc_id")
        .sortWithinPartitions("source", "doc_id", "size", "check")
        .select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "source", "size")
        .mapInArrow(local, "part long, doc_id long, source string, size long, start long"),
        "mix-offsets",
    )
    # a partition and a source: at most as many rows as there are partitions plus sources
    sums = ordered.groupBy("part", "source").agg(F.sum("size").alias("n"))
    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = F.sum("n").over(earlier)
    sums = sums.select(
        F.col("part").alias("_part"),
        F.col("source").alias("_source"),
        F.coalesce(before, F.lit(0)).alias("before"),
    )
    same = (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source"))
    return ordered.join(sums, same).select(
        "doc_id", "source", "size", (F.col("start") + F.col("before")).alias("offset")
    )


def plan_sources(sized: DataFrame, block_words: int, seed: int) -> list[Source]:
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    wanted = targets([r["n"] for r in rows])
    sources = [Source(i, r["source"], r["n"], t) for i, (r, t) in enumerate(zip(rows, wanted))]
    for source in sources:
        source.plan(block_words, seed)
    return sources


def slot_table(spark, sources: list[Source], shard_slots: int, seed: int, parts: int) -> DataFrame:
    """``shard, slot, index, block, words``: which block a slot stands for, and how many of its
    words it takes."""
    rows = draw(sources, shard_slots, seed)
    drawn = [(*r, sources[r[1]].blocks, sources[r[1]].slots, sources[r[1]].last) for r in rows]
    schema = "shard long, index long, first long, n long, blocks long, slots long, last long"

    @F.arrow_udf("long")
    def block(index: pa.Array, slot: pa.Array, blocks: pa.Array) -> pa.Array:
        i, j, n = (x.to_numpy(zero_copy_only=False) for x in (index, slot, blocks))
        return pa.array(permute(j % n, n, i + seed), pa.int64())

    end = F.col("first") + F.col("n") - 1
    whole = F.lit(2**62)  # a whole block
    return (
        spark.createDataFrame(drawn, schema)
        .repartition(parts, "shard", "index")
        .withColumn("slot", F.explode(F.sequence("first", end)))
        .select(
            "shard",
            "slot",
            "index",
            block("index", "slot", "blocks").alias("block"),
            F.when(F.col("slot") == F.col("slots") - 1, F.col("last"))
            .otherwise(whole)
            .alias("words"),
        )
    )


@dataclass
class Mix:
    """The documents with their numbers, and the pieces of them that the mix takes."""

    documents: DataFrame  # doc_id, source, size, offset, index, source_size, target
    pieces: DataFrame  # shard, slot, index, offset, begin, end: words of a document


def mix_sources(
    docs: DataFrame,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
) -> Mix:
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = written(offsets(docs, parts), "mix-sized")
    sources = plan_sources(sized, block_words, seed)
    known = spark.createDataFrame(
        [(s.name, s.index, s.size, s.target) for s in sources],
        "_source string, index long, source_size long, target double",
    )
    documents = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    b = F.lit(block_words)
    first = F.expr(f"offset div {block_words}")
    last = F.expr(f"(offset + size - 1) div {block_words}")
    blocks = (
        documents.filter("size > 0")
        .select("index", "offset", "size", F.explode(F.sequence(first, last)).alias("block"))
        .select(
            "index",
            "offset",
            "block",
            F.greatest(F.col("offset") - F.col("block") * b, F.lit(0)).alias("left"),
            F.least(F.col("offset") + F.col("size") - F.col("block") * b, b).alias("right"),
        )
    )
    slots = slot_table(spark, sources, shard_slots, seed, parts)
    # the drawn rows are few, the slots they unfold to grow with the corpus: no broadcast
    shift = F.col("block") * b - F.col("offset")
    pieces = (
        blocks.join(slots.hint("merge"), ["index", "block"])
        .withColumn("right", F.least("right", "words"))
        .filter("right > left")
        .select(
            "shard",
            "slot",
            "index",
            "offset",
            (F.col("left") + shift).alias("begin"),
            (F.col("right") + shift).alias("end"),
        )
    )
    return Mix(documents, pieces)


def taken_words(mix: Mix) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document."""
    taken = mix.pieces.groupBy("index", "offset").agg(F.sum(F.expr("end - begin")).alias("taken"))
    # a document without words begins where the next one does
    key = (F.col("d.index") == F.col("t.index")) & (F.col("d.offset") == F.col("t.offset"))
    return (
        mix.documents.alias("d")
        .join(taken.alias("t"), key & (F.col("d.size") > 0), "left")
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )
