"""Vector join of two large sides by hash tables.

A table's bucket is the side of several random planes on which a vector lies. Corpus rows lie in one bucket per
table; a question looks into its own bucket and into those that differ only at planes close to it: every
bucket whose crossed planes are together no farther than a limit. Buckets with the same first planes form a block;
rows and questions are joined by block, a question with the marks of its buckets, and within a block bucket by bucket
scored exactly, so scores are right and only hits can be missed. The limit is fitted: it is the distance within
which the share ``target`` of the true hits of ``SAMPLE`` questions is found. The exact way is ``similar``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outage_spark.operators.retrieval import BLOCK_BYTES, GRID, HITS, QUESTION_SLICE, _matrix, _ranked, _TopK, _unit, _vectors, similar
from outage_spark.operators.spread import lookup_join, settle, size_in_blocks

TABLES = 6
SAMPLE = 256
ROWS_PER_BUCKET = 1024


class PlaneTables:
    """``tables`` tables of ``bits`` random planes each."""

    def __init__(self, width: int, tables: int, bits: int, seed: int):
        self.planes = np.random.default_rng(seed).normal(size=(tables, bits, width))
        self.planes /= np.linalg.norm(self.planes, axis=2, keepdims=True)
        self.values = 1 << np.arange(bits, dtype=np.int64)

    def sides(self, unit: np.ndarray, one: int) -> np.ndarray:
        """Signed distance of each vector from each plane of a table."""
        return unit @ self.planes[one].T

    def buckets(self, unit: np.ndarray, one: int) -> np.ndarray:
        return ((self.sides(unit, one) >= 0) * self.values).sum(axis=1)

    def distances(self, questions: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Per pair the least distance, over the tables, of the planes between question and row."""
        least = np.full(len(questions), np.inf)
        for one in range(len(self.planes)):
            ours, theirs = self.sides(questions, one), self.sides(rows, one)
            least = np.minimum(least, (np.abs(ours) * ((ours >= 0) != (theirs >= 0))).sum(axis=1))
        return least

    def near(self, question: np.ndarray, limit: float) -> Iterator[tuple[int, np.ndarray]]:
        """(table, buckets within the limit) of one question."""
        for one in range(len(self.planes)):
            sides = self.sides(question[None, :], one)[0]
            buckets, spent = np.array([((sides >= 0) * self.values).sum()]), np.zeros(1)
            for bit in np.argsort(np.abs(sides)):
                crossed = spent + abs(sides[bit])
                within = crossed <= limit
                buckets = np.concatenate([buckets, buckets[within] ^ self.values[bit]])
                spent = np.concatenate([spent, crossed[within]])
            yield one, buckets


def similar_hashed(
    questions: DataFrame,
    corpus: DataFrame,
    k: int = 4,
    tables: int = TABLES,
    target: float = 0.95,
    vec_id: str = "vec_id",
    vec: str = "embedding",
    seed: int = 5,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    block_rows: int | None = None,
) -> DataFrame:
    """About the ``k`` most similar corpus vectors per question: (question_id, vec_id, score, rank).

    Buckets are planned for ``rows_per_bucket`` rows. A table has ``GRID`` blocks of buckets, or as many as are needed
    for ``BLOCK_BYTES`` of rows; larger ones are cut into parts of ``block_rows`` rows (by default of those bytes), as are
    their questions, so a bucket of copies is many bounded groups, no pair is a row, and a question is sent to a block
    once, however many of its buckets it asks.
    """
    asked, stored = settle(_vectors(questions, vec_id, vec)), settle(_vectors(corpus, vec_id, vec))
    count, width = stored.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not count or asked.isEmpty():
        return _ranked(stored.sparkSession.createDataFrame([], HITS), k)
    bits = max(1, math.ceil(math.log2(max(count / rows_per_bucket, 1))))
    hashes = PlaneTables(width, tables, bits, seed)
    limit = fit_limit(hashes, asked, stored, k, target)

    kinds = [f"vec_id bigint, v {side.schema['v'].dataType.simpleString()}, tbl int, block bigint" for side in (asked, stored)]
    low = max(bits - math.ceil(math.log2(max(GRID, size_in_blocks(stored, BLOCK_BYTES)))), 0)
    block_rows = block_rows or max(BLOCK_BYTES // (8 * max(width, 1)), 1)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUESTION_SLICE):
                part, found = batch.slice(at, QUESTION_SLICE), []
                for row, unit in enumerate(_unit(_matrix(part.column(1)))):
                    for one, buckets in hashes.near(unit, limit):
                        marks = np.zeros((1 << (bits - low), 1 << low), bool)
                        marks[buckets >> low, buckets & ((1 << low) - 1)] = True
                        for block in np.flatnonzero(marks.any(axis=1)):
                            found.append((row, one, block, np.packbits(marks[block]).tobytes()))
                rows, tables_of, blocks, marks = zip(*found)
                yield _placed(part.take(pa.array(rows)), tables_of, blocks, pa.array(marks, pa.binary()), "marks")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column(1)))
                for one in range(tables):
                    buckets = hashes.buckets(unit, one)
                    yield _placed(batch, np.full(len(buckets), one), buckets >> low, pa.array(buckets & ((1 << low) - 1)), "bucket")

    probes = settle(asked.mapInArrow(probe, f"{kinds[0]}, marks binary"))
    rows = stored.mapInArrow(place, f"{kinds[1]}, bucket bigint")
    sizes = probes.groupBy("tbl", "block").agg(F.count(F.lit(1)).alias("_asked"))
    sizes = settle(sizes.join(rows.groupBy("tbl", "block").agg(F.count(F.lit(1)).alias("_rows")), ["tbl", "block"]))

    def cut(side: DataFrame, place: str, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        sized = lookup_join(side, sizes, ["tbl", "block"], "inner", settled=True)
        part = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col(n_own) / F.lit(block_rows))).cast("int").alias(own)
        others = F.sequence(F.lit(0), F.ceil(F.col(n_other) / F.lit(block_rows)).cast("int") - 1)
        return sized.select("vec_id", "v", place, "tbl", "block", part, F.explode(others).alias(other))

    group = ["tbl", "block", "ask_part", "row_part"]
    left = cut(probes, "marks", "ask_part", "_asked", "row_part", "_rows").groupBy(*group)
    right = cut(rows, "bucket", "row_part", "_rows", "ask_part", "_asked").groupBy(*group)

    def meet(questions: pa.Table, vectors: pa.Table) -> pa.Table:
        ids = questions.column("vec_id").to_numpy().astype(np.int64)
        best = _TopK(ids, _matrix(questions.column("v")) if len(ids) else np.empty((0, 0)), k)
        if not len(ids) or not vectors.num_rows:
            return best.table()
        packed = np.frombuffer(b"".join(questions.column("marks").to_pylist()), np.uint8).reshape(len(ids), -1)
        marks = np.unpackbits(packed, axis=1)
        row_ids, matrix = vectors.column("vec_id").to_numpy().astype(np.int64), _matrix(vectors.column("v"))
        buckets, of_row = np.unique(vectors.column("bucket").to_numpy(), return_inverse=True)
        for place, bucket in enumerate(buckets):
            own = np.flatnonzero(of_row == place)
            best.add(row_ids[own], matrix[own], np.flatnonzero(marks[:, bucket]))
        return best.table()

    # A row is met in several tables.
    hits = left.cogroup(right).applyInArrow(meet, HITS).groupBy("question_id", "vec_id").agg(F.max("score").alias("score"))
    return _ranked(hits, k)


def fit_limit(hashes: PlaneTables, asked: DataFrame, stored: DataFrame, k: int, target: float) -> float:
    """Distance within which ``target`` of the true hits of a sample of questions is found."""
    # Bounded: SAMPLE questions, with k hits each.
    sample = settle(asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE))
    hits = settle(similar(sample, stored, k, vec="v").select("question_id", "vec_id"))
    ours = sample.select(F.col("vec_id").alias("question_id"), F.col("v").alias("q"))
    pairs = hits.join(F.broadcast(ours), "question_id").join(lookup_join(stored, hits.select("vec_id").distinct(), ["vec_id"], "inner"), "vec_id")
    found = pairs.select(F.col("q").cast("array<double>"), F.col("v").cast("array<double>")).toArrow()
    if not found.num_rows:
        return 0.0
    distances = hashes.distances(_unit(_matrix(found.column("q"))), _unit(_matrix(found.column("v"))))
    return float(np.quantile(distances, target, method="higher")) + 1e-9


def _placed(rows: pa.RecordBatch, tables: Sequence[int], blocks: Sequence[int], last: pa.Array, name: str) -> pa.RecordBatch:
    places = pa.array(np.asarray(tables, np.int32)), pa.array(np.asarray(blocks, np.int64))
    return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *places, last], names=["vec_id", "v", "tbl", "block", name])
