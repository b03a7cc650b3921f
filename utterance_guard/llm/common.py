"""What the operators share: scratch tables, byte tokens, streams of Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterance_guard.session import shared_folder

#: A-Z to a-z, every other byte as it is. ``bytes.split()`` then cuts at \x20 and \x09-\x0D.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WHITE = b" \t\n\x0b\x0c\r"
#: Rows of an Arrow batch; a batch of whole texts stays within a worker's memory.
BATCH_ROWS = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text, empty for null."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, unless the session already does."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: ``df`` as a Parquet table in the shared folder, read again. Whoever owns
    the folder that ``spark.checkpoint.dir`` names empties it after the job."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of bytes and the n + 1 offsets of the values in it."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def concat_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Join batches of few bytes a row into tables of about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)
