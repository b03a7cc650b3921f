"""Connected components of a table of links, by alternating star contractions.

A large star links the larger neighbours of every node to the smallest one it knows; a small
star does so for the node and its smaller neighbours. Repeated, each component becomes a star
around its smallest node. Every step is an aggregation (with partial results before the
shuffle) and a join with one row per node on one side; no list of neighbours is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterance_guard.llm.common import written


def _signature(links: DataFrame) -> tuple:
    mixed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(links.agg(F.count("*"), mixed).first())


def _with_least(links: DataFrame, least) -> DataFrame:
    """``links`` with the column ``m`` of their ``u``. Written first, so that Spark can split
    the links of a hot node in the join."""
    mins = written(links.groupBy("u").agg(least.alias("m")), "star-least")
    return links.join(mins.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u")).drop("_u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = _with_least(both, F.least(F.min("v"), F.first("u")))
    return both.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    own = _with_least(links, F.min("v"))
    moved = own.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(own.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``u, v``: each node with the smallest node of its component, that one itself left out.
    Links may come in any direction, repeated, or from a node to itself."""
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = written(links.filter("u > v").distinct(), "stars")
    before = None
    while (now := _signature(links)) != before and now[0]:
        before = now
        links = written(_large_star(links), "stars")
        links = written(_small_star(links), "stars")
    return links
