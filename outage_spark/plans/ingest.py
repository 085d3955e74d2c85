"""Folder to chunk table: list, skip what is done, extract, chunk, append, track."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outage_spark.operators.ingest import append_new, chunk_ids, chunk_separators, unprocessed
from outage_spark.operators.spread import settle
from outage_spark.sources.readers import extract_text, list_files, read_binary_docs, split_errors
from outage_spark.sources.writers import append, ensure_tables


FILES_AT_ONCE = 10_000


def ingest_batch(spark: SparkSession, folder: str, fn: Callable[[bytes], str], database: str = "default") -> DataFrame:
    """Ingest the files of ``folder`` that the tracker does not know yet; returns those that failed.

    The folder is listed first, and only new files are opened, ``FILES_AT_ONCE`` in one job. Files are
    read, extracted and chunked on the executors. Failed files are not tracked, so the next run tries
    them again. Chunks go in before the tracker and by id, so a run that stopped half-way can simply
    be repeated.
    """
    ensure_tables(spark, database)
    text_table, track_table = f"{database}.docs_text", f"{database}.docs_track"
    fresh = settle(unprocessed(list_files(spark, folder), spark.table(track_table)).select("path"))
    failed = [spark.createDataFrame([], "file_name string, error string")]
    names = (row.path for row in fresh.toLocalIterator())
    while paths := list(islice(names, FILES_AT_ONCE)):
        good, bad = split_errors(settle(extract_text(read_binary_docs(spark, paths), fn)))
        docs = good.select(F.xxhash64("file_name").alias("doc_id"), "text")
        append(append_new(chunk_ids(chunk_separators(docs)), spark.table(text_table), ["chunk_id"]), text_table)
        append(append_new(good.select("file_name"), spark.table(track_table), ["file_name"]), track_table)
        failed.append(bad.select("file_name", "error"))
    return reduce(DataFrame.unionByName, failed)
