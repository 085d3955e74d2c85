"""A stored vector index that follows a change feed.

Folders under the index's home:

* ``centres``: list_id, centre. Written once; every later row goes to the nearest of them.
* ``lists/version=V/list_id=L``: the rows of a list as of a version.
* ``changes/batch_id=B``: changed ids with their new vector and list; without a vector, the id is deleted.
* ``manifest/version=V``: per list the version that holds its rows, its reach and size, and the last batch
  folded into it. One file, so a version appears whole or not at all; the highest one counts.

A search merges the changes that are not folded in yet with the lists on reading. ``compact`` folds them in and
rewrites the lists they touch, as a new version; all other lists stay where they are.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outage_spark.operators.retrieval import ListMap, VectorIndex, _matrix, _vectors, centres_of, place_in_lists
from outage_spark.operators.spread import lookup_join, settle

ROWS = "vec_id bigint, v array<float>, angle double, norm double"
MANIFEST = "list_id int, rows_version int, radius double, longest double, n bigint, upto bigint"


def create_index(corpus: DataFrame, home: str, n_lists: int | None = None, vec_id: str = "vec_id", vec: str = "embedding") -> None:
    """Store the index of ``corpus`` (ids unique), which may not be empty, as version 0."""
    spark, stored = corpus.sparkSession, _vectors(corpus, vec_id, vec)
    n_lists = n_lists or max(1, math.isqrt(stored.count()))
    centres = centres_of(stored.where(F.exists("v", lambda x: x != 0)), n_lists)
    if not len(centres):
        raise ValueError("an index needs a vector that is not zero")
    rows = [(i, c) for i, c in enumerate(centres.tolist())]
    spark.createDataFrame(rows, "list_id int, centre array<double>").write.mode("overwrite").parquet(f"{home}/centres")
    _write_lists(place_in_lists(stored, centres), home, 0)
    spark.createDataFrame([], f"{ROWS}, list_id int").write.mode("overwrite").parquet(f"{home}/changes/batch_id=-1")
    _write_manifest(spark, home, 0, _reach(_lists(spark, home).where("version = 0")).withColumn("rows_version", F.lit(0)), -1)


def apply_changes(home: str, feed: DataFrame, batch_id: int, vec_id: str = "vec_id", vec: str = "embedding") -> None:
    """Add a batch of changes: ``op`` (insert, update, delete), id and vector, as ``table_diff`` gives them.

    An id changes at most once in a batch; of several batches the highest counts. A batch owns its folder, so a
    replay replaces it. A batch that was folded in already is left out. A change without a vector deletes.
    """
    spark = feed.sparkSession
    if batch_id <= _manifest(spark, home).agg(F.max("upto")).first()[0]:
        return
    gone = (F.col("op") == "delete") | F.col(vec).isNull()
    placed = place_in_lists(_vectors(feed.where(~gone), vec_id, vec), _centres(spark, home))
    deleted = feed.where(gone).select(F.col(vec_id).cast("bigint").alias("vec_id"))
    placed.unionByName(deleted, allowMissingColumns=True).write.mode("overwrite").parquet(f"{home}/changes/batch_id={batch_id}")


def read_index(spark: SparkSession, home: str, block_rows: int | None = None) -> VectorIndex:
    """The index with all changes so far."""
    manifest = settle(_manifest(spark, home))
    changed = _pending(spark, home, manifest)
    reach = manifest.select("list_id", "radius", "longest", "n").unionByName(_reach(changed.where("v IS NOT NULL")))
    # A list's reach may stay too wide after deletes; that costs time, never hits.
    reach = reach.groupBy("list_id").agg(F.max("radius").alias("radius"), F.max("longest").alias("longest"), F.sum("n").alias("n"))
    centres = _centres(spark, home)
    radii, longest, sizes = np.zeros(len(centres)), np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for row in reach.collect():  # one row per list
        radii[row["list_id"]], longest[row["list_id"]], sizes[row["list_id"]] = row["radius"], row["longest"], row["n"]
    return VectorIndex(_merged(spark, home, manifest, changed), ListMap(centres, radii, longest, sizes, block_rows))


def compact(spark: SparkSession, home: str) -> list[int]:
    """Fold all changes into the lists they touch; returns the numbers of those lists.

    A run that stops before the manifest is written leaves the index as it was.
    """
    manifest = settle(_manifest(spark, home))
    changed = _pending(spark, home, manifest)
    last = changed.agg(F.max("batch_id")).first()[0]
    if last is None:
        return []
    ids = changed.select("vec_id")
    left = lookup_join(_current(spark, home, manifest), ids, ["vec_id"], "inner").select("list_id")
    entered = changed.where("v IS NOT NULL").select("list_id")
    touched = left.unionByName(entered).distinct()
    numbers = sorted(row.list_id for row in touched.collect())  # at most one per list
    version = manifest.agg(F.max("version")).first()[0] + 1
    _write_lists(_merged(spark, home, manifest, changed).where(F.col("list_id").isin(numbers)), home, version)
    # A list that lost all its rows has no folder; its row says that it is empty.
    fresh = _reach(_lists(spark, home).where(F.col("version") == version))
    empty = spark.createDataFrame([(n, 0.0, 0.0, 0) for n in numbers], "list_id int, radius double, longest double, n bigint")
    fresh = fresh.unionByName(empty.join(fresh, "list_id", "left_anti")).withColumn("rows_version", F.lit(version))
    kept = manifest.where(~F.col("list_id").isin(numbers)).select(*fresh.columns)
    _write_manifest(spark, home, version, kept.unionByName(fresh), last)
    return numbers


def _centres(spark: SparkSession, home: str) -> np.ndarray:
    rows = spark.read.parquet(f"{home}/centres").orderBy("list_id").toArrow()
    return _matrix(rows.column("centre"))


def _lists(spark: SparkSession, home: str) -> DataFrame:
    return spark.read.schema(f"{ROWS}, version int, list_id int").parquet(f"{home}/lists")


def _write_lists(rows: DataFrame, home: str, version: int) -> None:
    # Each list is written by one task per block of rows, so a list is a few files.
    rows = rows.select("vec_id", "v", "angle", "norm", "list_id").repartition("list_id", F.pmod(F.xxhash64("vec_id"), F.lit(4)))
    rows.write.mode("overwrite").partitionBy("list_id").parquet(f"{home}/lists/version={version}")


def _reach(placed: DataFrame) -> DataFrame:
    return placed.groupBy("list_id").agg(F.max("angle").alias("radius"), F.max("norm").alias("longest"), F.count(F.lit(1)).alias("n"))


def _manifest(spark: SparkSession, home: str) -> DataFrame:
    stored = spark.read.schema(f"{MANIFEST}, version int").parquet(f"{home}/manifest")
    version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def _write_manifest(spark: SparkSession, home: str, version: int, reach: DataFrame, upto: int) -> None:
    rows = reach.withColumn("upto", F.lit(upto).cast("bigint")).select("list_id", "rows_version", "radius", "longest", "n", "upto")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{home}/manifest/version={version}")


def _pending(spark: SparkSession, home: str, manifest: DataFrame) -> DataFrame:
    """The last change of every id in batches that are not folded in yet, settled."""
    upto = manifest.agg(F.max("upto")).first()[0]
    stored = spark.read.schema(f"{ROWS}, list_id int, batch_id bigint").parquet(f"{home}/changes")
    latest = stored.where(F.col("batch_id") > upto).groupBy("vec_id").agg(F.max_by(F.struct("v", "angle", "norm", "list_id", "batch_id"), "batch_id").alias("c"))
    return settle(latest.select("vec_id", "c.*"))


def _current(spark: SparkSession, home: str, manifest: DataFrame) -> DataFrame:
    """Rows of the versions that the manifest names, without pending changes."""
    # One row per list, so this side is bounded; as both columns are partitions, other folders are not read.
    named = manifest.where("n > 0").select(F.col("list_id").alias("_list"), "rows_version")
    rows = _lists(spark, home)
    return rows.join(F.broadcast(named), (F.col("list_id") == F.col("_list")) & (F.col("version") == F.col("rows_version"))).select(
        "vec_id", "v", "angle", "norm", "list_id"
    )


def _merged(spark: SparkSession, home: str, manifest: DataFrame, changed: DataFrame) -> DataFrame:
    marks = changed.select("vec_id", F.lit(True).alias("_changed"))
    kept = lookup_join(_current(spark, home, manifest), marks, ["vec_id"], settled=True).where("_changed IS NULL").drop("_changed")
    return kept.unionByName(changed.where("v IS NOT NULL").select(*kept.columns))
