"""Incremental document ingest on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outage_spark.functions.text import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS, fixed_chunks, separator_chunks


def unprocessed(files: DataFrame, track: DataFrame, on: Sequence[str] = ("file_name",)) -> DataFrame:
    """Files whose key is not in the tracker."""
    return files.join(track.select(*on).distinct(), list(on), "left_anti")


def append_new(src: DataFrame, target: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``src`` to append so that ``target`` holds every key once.

    Copies within ``src`` are dropped first (before the shuffle, by partial aggregation), so the
    anti join sees each key once however often it was sent.
    """
    return src.dropDuplicates(list(on)).join(target.select(*on), list(on), "left_anti")


def table_diff(old: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """Changes that turn ``old`` into ``new``: one row per changed key with ``op`` and the new values.

    Keys are unique in each table. A delete carries the old values.
    """
    keys, rest = list(on), [c for c in new.columns if c not in on]
    before = old.select(*keys, F.struct(*rest).alias("_old"))
    after = new.select(*keys, F.struct(*rest).alias("_new"))
    op = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), "delete")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    )
    joined = before.join(after, keys, "full_outer").withColumn("op", op).where(F.col("op").isNotNull())
    return joined.select("op", *keys, F.coalesce("_new", "_old").alias("_row")).select("op", *keys, "_row.*")


def explode_chunks(df: DataFrame, chunks: Column, keys: Sequence[str]) -> DataFrame:
    """Array of chunks to rows (chunk_no, text)."""
    return df.select(*keys, F.posexplode(chunks).alias("chunk_no", "text"))


def chunk_fixed(
    df: DataFrame, keys: Sequence[str] = ("doc_id",), size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Fixed windows per document. No shuffle."""
    return explode_chunks(df, fixed_chunks("text", size, overlap), keys)


def chunk_separators(
    df: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators=SEPARATORS,
) -> DataFrame:
    """Chunks cut at paragraph, line or word ends per document. No shuffle."""
    return explode_chunks(df, separator_chunks("text", size, overlap, separators), keys)


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """Add ``chunk_id``, a hash of document and chunk number: the same on every run, no ordering needed."""
    return chunks.withColumn("chunk_id", F.xxhash64("doc_id", "chunk_no"))


def ingest_delta(docs: DataFrame, track: DataFrame, on: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Chunks of the documents that are not in the tracker yet."""
    return chunk_separators(unprocessed(docs, track, on), on)
