"""Exact dedup: a tree-merge of sorted digest runs.

Every partition turns its texts into a run: entries (digest, smallest doc_id, count) in digest
order. Partitions then exchange runs in binomial rounds. A partition is a place with base-8
digits; in round r the partitions that differ in digit r only swap parts of their runs, each
keeps the entries whose digest has its digit there, and merges the eight sorted parts it gets.
After ceil(log8 P) rounds a place holds one range of the digest space, and all entries of it.
Equal entries collapse at every level, before the next exchange: of a text that makes up a
third of all rows, a place sends one entry.

An entry's key is SHA-256, length and XXH64 of the normalised text, so the smallest id of an
entry is verified by three independent values before it is retained.

Defined results: a null text counts as empty. Rows that share doc_id and text are one
document: they stay or go together, and each counts in ``group_size``. A null doc_id is larger
than any other; a group of such rows only has a null ``keep_id`` and keeps them. Empty tables
give empty results. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterance_guard.llm.common import written

FAN = 8
DIGIT_BITS = 3
KEY = ["digest", "n_bytes", "check"]
RUN = ["place", *KEY]
RUN_SCHEMA = "place long, digest string, n_bytes long, check long, keep_id long, n long"


def normal_text(text: Column) -> Column:
    """Each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the key of the normalised text."""
    normal = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normal_text(F.col(text)).alias("t"))
    return normal.select("doc_id", *text_key("t"))


def text_key(normal: str) -> list[Column]:
    return [
        F.sha2(F.col(normal).cast("binary"), 256).alias("digest"),
        F.octet_length(normal).cast("long").alias("n_bytes"),
        F.xxhash64(normal).alias("check"),
    ]


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge entries of equal key that follow each other, holding one batch and one entry."""
    last: pa.Table | None = None
    for batch in batches:
        run = pa.table(batch.columns, names=batch.schema.names)  # all columns nullable
        if last is not None:
            run = pa.concat_tables([last, run])
        if not run.num_rows:
            continue
        # keys come in order and groups appear in that order, so the result is a run again
        run = run.group_by(RUN, use_threads=False).aggregate([("keep_id", "min"), ("n", "sum")])
        run = run.select([*RUN, "keep_id_min", "n_sum"]).rename_columns([*RUN, "keep_id", "n"])
        last = run.slice(run.num_rows - 1)
        yield from run.slice(0, run.num_rows - 1).combine_chunks().to_batches()
    if last is not None:
        yield from last.combine_chunks().to_batches()


def tree_merge(keyed: DataFrame, places: int) -> DataFrame:
    """Groups of equal keys, ``digest, n_bytes, check, keep_id, n``, merged over ``places``
    rounded up to a power of eight."""
    levels = max(1, -(-(max(places, 2) - 1).bit_length() // DIGIT_BITS))
    place = F.pmod(F.spark_partition_id(), F.lit(FAN**levels)).cast("long")
    run = keyed.select(
        place.alias("place"),
        *KEY,
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("n"),
    )
    run = run.sortWithinPartitions(*RUN).mapInArrow(merge_runs, RUN_SCHEMA)
    home = F.conv(F.substring("digest", 1, 12), 16, 10).cast("long")
    for level in range(levels):
        # the digits up to this level come from the digest, the higher ones from the sender
        own = F.lit(FAN ** (level + 1))
        to = F.col("place") - F.pmod("place", own) + F.pmod(home, own)
        run = (
            run.withColumn("place", to)
            .repartition(FAN**levels, "place")
            .sortWithinPartitions(*RUN)
            .mapInArrow(merge_runs, RUN_SCHEMA)
        )
    return run.select(*KEY, "keep_id", "n")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256, n_bytes, check``.

    The join that brings groups back to documents has one row per key on one side; Spark
    splits the other side where a key is hot.
    """
    spark = docs.sparkSession
    keyed = written(digests(docs, doc_id, text), "digests")
    groups = written(tree_merge(keyed, int(spark.conf.get("spark.sql.shuffle.partitions"))), "runs")
    return keyed.join(groups, KEY).select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "n_bytes",
        "check",
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = exact_dedup(docs, doc_id, text).filter("kept")
    kept = kept.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(("doc_id", "text_sha256"))])
    own = (docs[doc_id].cast("long"), F.sha2(normal_text(docs[text]).cast("binary"), 256))
    return docs.join(
        kept, own[0].eqNullSafe(kept["_0"]) & (own[1] == kept["_1"]), "left_semi"
    )
