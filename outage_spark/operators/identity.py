"""Identity numbers that go on over appends.

Every append is a batch with its own folder of rows and one mark, the numbers it took. The mark is one small file
written last, so a batch counts once it is whole: a batch that stopped half-way is made again with the same
numbers, and one that has its mark is left as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outage_spark.operators.spread import assign_ids

MARK = "first_id bigint, n bigint"


def _marks(spark: SparkSession, home: str) -> DataFrame:
    return spark.read.schema(f"{MARK}, batch_id bigint").parquet(f"{home}/marks")


def create_numbered(spark: SparkSession, home: str) -> None:
    """Prepare an empty table of numbered rows; an existing one is left as it is."""
    spark.createDataFrame([], MARK).write.mode("ignore").parquet(f"{home}/marks/batch_id=-1")


def append_numbered(df: DataFrame, order: Sequence[str], home: str, batch_id: int, name: str = "id", start: int = 1) -> None:
    """Append ``df`` as a batch, numbered in ``order`` after all numbers taken so far.

    Numbers are dense over all batches, begin at ``start``, and never change. One writer at a time.
    """
    spark = df.sparkSession
    marks = _marks(spark, home)
    done, taken = marks.agg(F.max((F.col("batch_id") == batch_id).cast("int")), F.max(F.col("first_id") + F.col("n"))).first()
    if done:
        return
    first = start if taken is None else taken
    assign_ids(df, order, first, name).write.mode("overwrite").parquet(f"{home}/rows/batch_id={batch_id}")
    written = spark.read.schema(f"`{name}` bigint").parquet(f"{home}/rows/batch_id={batch_id}")
    mark = written.agg(F.lit(first).cast("bigint").alias("first_id"), F.count(F.lit(1)).alias("n"))
    mark.coalesce(1).write.mode("overwrite").parquet(f"{home}/marks/batch_id={batch_id}")


def read_numbered(spark: SparkSession, home: str, schema: str) -> DataFrame:
    """Rows of the batches that are whole; ``schema`` of the rows with their number."""
    rows = spark.read.schema(f"{schema}, batch_id bigint").parquet(f"{home}/rows")
    # One row per batch.
    return rows.join(F.broadcast(_marks(spark, home).select("batch_id")), "batch_id", "left_semi").drop("batch_id")
