"""Readers: CSV tables, text and binary document folders. Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outage_spark import schemas
from outage_spark.functions.scalars import basename, normalise_postcode, parse_ts

CORRUPT = "_corrupt_record"


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(f"{schema}, {CORRUPT} STRING")
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )


def _problem(text: str, parsed: Column, what: str) -> Column:
    """Message where text is present but could not be read."""
    return F.when(F.col(text).isNotNull() & parsed.isNull(), F.lit(f"{text}: not a {what}"))


def _number(text: str, kind: str) -> Column:
    return F.expr(f"try_cast(`{text}` AS {kind})")


def _errors(*problems: Column) -> Column:
    return F.nullif(F.concat_ws("; ", F.when(F.col(CORRUPT).isNotNull(), "malformed line"), *problems), F.lit(""))


def planned_with_errors(spark: SparkSession, path: str) -> DataFrame:
    """Planned outages with an ``error`` column that is null for good rows."""
    start, end = parse_ts("outage_start_date_time"), parse_ts("outage_end_date_time")
    return _csv(spark, path, schemas.PLANNED_CSV).select(
        normalise_postcode("Postcode").alias("postcode"),
        start.alias("start_ts"),
        end.alias("end_ts"),
        F.col("reason_for_outage").alias("reason"),
        F.col("Suburb").alias("suburb"),
        _errors(
            _problem("outage_start_date_time", start, "time"), _problem("outage_end_date_time", end, "time")
        ).alias("error"),
    )


def history_with_errors(spark: SparkSession, path: str) -> DataFrame:
    """Unplanned outage history with an ``error`` column that is null for good rows."""
    start, end = parse_ts("Outage_StartTime"), parse_ts("Outage_EndTime")
    staff, hours, day = _number("Field_Staff", "INT"), _number("Outage_Hours", "DOUBLE"), _number("Day", "INT")
    return _csv(spark, path, schemas.HISTORY_CSV).select(
        normalise_postcode("Postcode").alias("postcode"),
        F.col("Suburb").alias("suburb"),
        F.col("Weather_Conditions").alias("condition"),
        staff.alias("staff"),
        start.alias("start_ts"),
        end.alias("end_ts"),
        hours.alias("hours"),
        day.alias("day"),
        F.col("DOW").alias("dow"),
        F.col("Month").alias("month"),
        _errors(
            _problem("Outage_StartTime", start, "time"),
            _problem("Outage_EndTime", end, "time"),
            _problem("Outage_Hours", hours, "number"),
            _problem("Field_Staff", staff, "number"),
        ).alias("error"),
    )


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows without the error column, bad rows with it)."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def read_planned(spark: SparkSession, path: str) -> DataFrame:
    return split_errors(planned_with_errors(spark, path))[0]


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return split_errors(history_with_errors(spark, path))[0]


def postcodes_with_errors(spark: SparkSession, path: str) -> DataFrame:
    """The postcode file, of any form of postcode; a row without its postcode or suburb says so in ``error``."""
    rows = _csv(spark, path, schemas.POSTCODES_CSV)
    postcode = normalise_postcode("Postcode")
    missing = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", f"{name}: missing") for name, c in (("Postcode", postcode), ("Suburb", F.col("Suburb")))]
    return rows.select(postcode.alias("postcode"), F.col("Suburb").alias("suburb"), _errors(*missing).alias("error"))


def read_postcodes(spark: SparkSession, path: str) -> DataFrame:
    return split_errors(postcodes_with_errors(spark, path))[0]


def read_text_docs(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Text files: one row per file, or per line."""
    rows = spark.read.text(path, wholetext=whole)
    return rows.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with their base name; the contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(basename("path").alias("file_name"), "path", "length", "modificationTime")


def read_binary_docs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Content of the files of a folder, or of the given files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(basename("path").alias("file_name"), "content")


def extract_text(files: DataFrame, fn: Callable[[bytes], str]) -> DataFrame:
    """Text of every file through ``fn(bytes) -> str``, on the executors.

    A file ``fn`` fails on becomes a row with an ``error`` instead of failing the job.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for content in batch["content"]:
                try:
                    texts.append(fn(bytes(content)))
                    errors.append(None)
                except Exception as problem:
                    texts.append(None)
                    errors.append(f"{type(problem).__name__}: {problem}")
            yield pd.DataFrame({"file_name": batch["file_name"], "text": texts, "error": errors})

    return files.select("file_name", "content").mapInPandas(extract, "file_name string, text string, error string")
