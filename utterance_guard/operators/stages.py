"""A border between costly columns and whatever is asked of them later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A filter on a derived column is pushed below the projection that makes it, and takes a
    copy of the whole expression along; over a chain of projections the copies multiply. No
    filter is pushed below the generator that gives these columns, one row for each row.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
