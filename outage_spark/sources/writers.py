"""Sinks and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from outage_spark import schemas


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet", partition_by=()) -> None:
    """Write files; CSV gets a header. Facts are best partitioned by a date for pruning."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def ensure_tables(spark: SparkSession, database: str = "default") -> None:
    """Create the chunk and tracker tables where they are absent."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.docs_text ({schemas.CHUNKS}) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.docs_track ({schemas.TRACK}) USING parquet")


def append(df: DataFrame, table: str) -> None:
    """Append rows; columns go by name."""
    columns = df.sparkSession.table(table).columns
    df.select(*columns).write.insertInto(table)
