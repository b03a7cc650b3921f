"""Joins on keys of which a few hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "_salt"
TRACKED_PER_KEY = 10


def hot_keys(df: DataFrame, key: str, tasks: int) -> list:
    """Keys that hold more than half of what a task would get if rows were dealt evenly. There
    are fewer than two a task. A sketch of bounded size counts them, in one aggregation."""
    most = 2 * tasks
    tracked = min(1_000_000, TRACKED_PER_KEY * most)
    found = df.filter(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {most}, {tracked})").alias("top"), F.count("*").alias("n")
    ).first()
    return sorted(t["item"] for t in found["top"] or [] if t["count"] * most > found["n"])


def salted(keys: list, key: str, salts: int, salt_by: str) -> tuple[Column, Column]:
    """The salt of a row on the side with many rows a key, and the salts under which a row of
    the other side is copied. A key that is not listed has one salt and no copies."""
    hot = F.col(key).isin(keys) if keys else F.lit(False)
    own = F.when(hot, F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return own, copies


def skewed_join(many: DataFrame, few: DataFrame, key: str, salt_by: str) -> DataFrame:
    """Inner join on ``key``, of which ``many`` may have any number of rows. Rows of a hot key
    are spread over the session's tasks by ``salt_by``, and only such a key's rows of ``few``
    are copied."""
    tasks = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own, copies = salted(hot_keys(many, key, tasks), key, tasks, salt_by)
    spread = few.withColumn(SALT, F.explode(copies))
    return many.withColumn(SALT, own).join(spread, [key, SALT]).drop(SALT)
