"""A stored set of texts that grows by merging: laid out by the first digits of a digest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterance_guard.functions.text import text_key
from utterance_guard.operators.curate import dedupe_first
from utterance_guard.session import cut_lineage

PREFIX = "prefix"
DIGITS = 2


def read_store(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored rows; none where nothing was stored yet."""
    laid_out = T.StructType([*schema.fields, T.StructField(PREFIX, T.StringType())])
    try:
        return spark.read.schema(laid_out).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], laid_out)


def merge_texts(
    rows: DataFrame, path: str, digits: int = DIGITS, text: str = "text", row_id: str = "row_id"
) -> int:
    """Add the rows whose text the stored set lacks, the first of equal ones, and return how
    many there were. Rows without a text are left out.

    Only digests are compared. Prefixes that gain no row are not touched; the others are
    rewritten whole by a dynamic overwrite, so a merge that is repeated changes nothing, and one
    that was killed half-way is completed by the next. One merge at a time may run on a path.
    ``digits`` is fixed when a set is begun: 16 to that power is the number of prefixes.
    """
    spark = rows.sparkSession
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    stored = read_store(spark, path, schema)
    new = dedupe_first(rows.filter(F.col(text).isNotNull()), row_id, text)
    known = stored.select(text_key(text).alias("_known"))
    key = text_key(text)
    gained = cut_lineage(
        new.withColumn("_key", key)
        .join(known, F.col("_key") == F.col("_known"), "left_anti")
        .withColumn(PREFIX, F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, digits))
        .select(*rows.columns, PREFIX)
    )
    n = gained.count()
    if n:
        touched = F.broadcast(gained.select(PREFIX).distinct())  # 16 ** digits rows at most
        whole = stored.join(touched, PREFIX, "left_semi").select(*rows.columns, PREFIX)
        whole = cut_lineage(whole.unionByName(gained))  # what is read is overwritten
        whole.hint("rebalance", PREFIX).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(PREFIX).parquet(path)
    return n
