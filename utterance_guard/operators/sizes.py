"""Size checks that decide whether a table may be broadcast or written into an expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# A broadcast table lives on every executor: keep it well under a gigabyte.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def rows_if_few(df: DataFrame, limit: int) -> list[Row] | None:
    """All rows of ``df`` when there are at most ``limit``, else None. The driver never
    holds more than ``limit + 1`` rows."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


# What a number, or the header of a string, takes in a row.
CELL_BYTES = 8


def _row_bytes(df: DataFrame) -> Column:
    widths = [
        F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(0)
        for c, t in df.dtypes
    ]
    return sum(widths, F.lit(CELL_BYTES * len(df.columns))).cast("long")


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure all columns of ``df``, as it would be broadcast: an aggregation with one row
    per task."""
    size = df.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("b")
    ).first()
    return size["n"] <= max_rows and size["b"] <= max_bytes


def uses_that_fit(
    df: DataFrame, uses: str, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> int:
    """From which number of uses on, a power of two, the rows of ``df`` may be broadcast. The
    driver sees a row for each power."""
    sizes = (
        df.groupBy((F.length(F.bin(uses)) - 1).alias("power"))
        .agg(F.count("*").alias("n"), F.sum(_row_bytes(df)).alias("b"))
        .orderBy(F.desc("power"))
        .collect()
    )
    least, rows, size = 2**62, 0, 0
    for s in sizes:
        rows, size = rows + s["n"], size + s["b"]
        if rows > max_rows or size > max_bytes:
            break
        least = 2 ** s["power"]
    return least
