"""Approximate nearest neighbours by cosine: cross-polytope hashing with multiprobe tables.

A hash function turns a unit vector by a fast Hadamard pseudo-rotation and takes the nearest signed axis. A
table joins as many functions as the corpus needs for buckets of about ``ROWS_PER_BUCKET`` rows. Every row
lies in one bucket of each table. A query's penalty for a bucket is how far its chosen axes fall short of the
query's best ones, summed over the functions; the query looks into every bucket within a penalty limit, and
all rows found are scored exactly.

The limit is fitted: for ``SAMPLE`` queries the true neighbours are looked up among all rows, and the limit
is the penalty within which the share ``TARGET`` of them is found. The sample bounds the fitting only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outage_spark.llm.text import table
from outage_spark.llm.vectors import Rotation, finite, lists, matrix, meet, numbered
from outage_spark.operators.spread import first_per_key, top_per_key

TABLES = 4
ROWS_PER_BUCKET = 4096
SAMPLE = 256
TARGET = 0.97
HITS = "query_id bigint, vec_id bigint, score double"


class CrossPolytope:
    """``tables`` hash tables of ``functions`` functions each."""

    def __init__(self, width: int, tables: int = TABLES, functions: int = 1, seed: int = 12):
        self.tables, self.functions = tables, functions
        self.turns = [[Rotation(width, seed + 1000 * t + f) for f in range(functions)] for t in range(tables)]
        self.axes = 2 * self.turns[0][0].width

    def _sides(self, unit: np.ndarray, table_no: int, function: int) -> np.ndarray:
        """Closeness to every signed axis: column 2 i is axis i, column 2 i + 1 its opposite."""
        turned = self.turns[table_no][function](unit)
        return np.stack([turned, -turned], axis=2).reshape(len(unit), self.axes)

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """Bucket number of every row (first axis) in every table (second)."""
        out = np.zeros((len(unit), self.tables), np.int64)
        for t in range(self.tables):
            for f in range(self.functions):
                out[:, t] = out[:, t] * self.axes + self._sides(unit, t, f).argmax(axis=1)
        return out

    def penalties(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Per pair (query, row) the least penalty over the tables at which the query finds the row."""
        least = np.full(len(queries), np.inf)
        for t in range(self.tables):
            total = np.zeros(len(queries))
            for f in range(self.functions):
                asked = self._sides(queries, t, f)
                axis = self._sides(rows, t, f).argmax(axis=1)
                total += asked.max(axis=1) - asked[np.arange(len(asked)), axis]
            least = np.minimum(least, total)
        return least

    def probes(self, query: np.ndarray, limit: float) -> Iterator[tuple[int, np.ndarray]]:
        """(table, numbers of the buckets within the limit) of one query."""
        for t in range(self.tables):
            numbers, spent = np.zeros(1, np.int64), np.zeros(1)
            for f in range(self.functions):
                side = self._sides(query[None, :], t, f)[0]
                short = side.max() - side
                near = np.flatnonzero(short <= limit)
                total = spent[:, None] + short[near]
                kept = total <= limit
                numbers = (numbers[:, None] * self.axes + near)[kept]
                spent = total[kept]
            yield t, numbers


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, which changes no cosine, so that no square overflows or vanishes."""
    largest = np.abs(vectors).max(axis=1, keepdims=True, initial=0.0)
    return np.ldexp(vectors, -np.frexp(largest)[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = _scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, summed in the same order wherever the pair is met."""
    queries, rows = _scaled(queries), _scaled(rows)
    dot = (queries * rows).sum(axis=1)
    return dot / (np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((rows * rows).sum(axis=1)))


def _nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query places, row places, scores) of the k nearest rows per query, other than rows with its own id.

    Equal rows are looked at once. Different rows under one id are taken in turns of distinct ids, so that k
    ids come out wherever there are k.
    """
    if len(np.unique(ids)) < len(ids):
        first = np.unique(np.column_stack([ids.view(np.float64), rows]).view(np.int64), axis=0, return_index=True)[1]
        first = first[np.argsort(ids[first], kind="stable")]
        sorted_ids = ids[first]
        turn = np.arange(len(first)) - np.searchsorted(sorted_ids, sorted_ids)
        if len(first) < len(ids) or turn.any():
            parts = []
            for t in range(turn.max() + 1):
                own = first[turn == t]
                asked, found, scores = _nearest(query_ids, queries, ids[own], rows[own], k)
                parts.append((asked, own[found], scores))
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    rough = _unit(queries) @ _unit(rows).T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    if rough.shape[1] > k:
        # The matrix product sums in an order of its own, so a little more than the k best is scored again.
        floor = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
        near = rough >= floor[:, None] - 1e-9
    else:
        near = np.ones(rough.shape, bool)
    asked, found = np.nonzero(near & np.isfinite(rough))
    scores = cosines(queries[asked], rows[found])
    order = np.lexsort((ids[found], -scores, asked))
    asked, found, scores = asked[order], found[order], scores[order]
    begins = np.searchsorted(asked, np.arange(len(queries)))
    kept = np.arange(len(asked)) - begins[asked] < k
    return asked[kept], found[kept], scores[kept]


def _hits(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> dict:
    return {"query_id": query_ids, "vec_id": ids, "score": scores}


class Index:
    """Stored rows (``vec_id, v, _at``), their hash tables and the fitted penalty limit."""

    def __init__(self, rows: DataFrame, width: int, hashes: CrossPolytope, limit: float):
        self.rows, self.width, self.hashes, self.limit = rows, width, hashes, limit


def usable(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows with an id and a vector that is finite and not zero, as ``vec_id, v``."""
    rows = embeddings.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & finite("v") & F.exists("v", lambda x: x != 0))


def build(rows: DataFrame, queries: DataFrame, k: int, tables: int = TABLES, seed: int = 12, target: float = TARGET) -> Index:
    """Index all ``rows`` (``vec_id, v``); ``queries`` (same columns) fit the penalty limit."""
    stored = numbered(rows)
    count, width = stored.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    axes = 2 * Rotation(width, 0).width
    functions = max(1, math.ceil(math.log(max(count / ROWS_PER_BUCKET, 1)) / math.log(max(axes, 2))))
    hashes = CrossPolytope(width, tables, functions, seed)
    return Index(stored, width, hashes, _fit(stored, width, hashes, queries, k, target))


def _fit(rows: DataFrame, width: int, hashes: CrossPolytope, queries: DataFrame, k: int, target: float) -> float:
    # Bounded: SAMPLE queries, and k neighbours of each.
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    query_ids, asked = sample.column("vec_id").to_numpy(), matrix(sample.column("v"), width)
    if not len(query_ids):
        return 0.0

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, block = batch.column(0).to_numpy(), matrix(batch.column(1), width)
                at, found, scores = _nearest(query_ids, asked, ids, block, k)
                columns = _hits(query_ids[at], ids[found], scores) | {"v": lists(block[found])}
                yield pa.RecordBatch.from_pydict(columns)

    found = rows.select("vec_id", "v").mapInArrow(scan, f"{HITS}, v array<double>")
    best = top_per_key(found, ["query_id"], [F.desc("score"), F.asc("vec_id")], k).toArrow()
    if not best.num_rows:
        return 0.0
    places = {q: at for at, q in enumerate(query_ids.tolist())}
    own = asked[[places[q] for q in best.column("query_id").to_pylist()]]
    short = hashes.penalties(_unit(own), _unit(matrix(best.column("v"), width)))
    return float(np.quantile(short, target, method="higher")) + 1e-9


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest rows found per query (``vec_id, v``): ``query_id, rank, vec_id, score``.

    Rows with a query's own id are not its neighbours; a query id that occurs repeatedly is asked once, by
    its least vector; a row id that occurs repeatedly counts once, with its best score.
    """
    hashes, width, limit = index.hashes, index.width, index.limit
    once = first_per_key(queries.select("vec_id", "v"), ["vec_id"], ["v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _unit(matrix(batch.column(1), width)) if batch.num_rows else ()
            for row, unit in enumerate(units):
                for table_no, numbers in hashes.probes(unit, limit):
                    own = batch.slice(row, 1).take(pa.array(np.zeros(len(numbers), np.int64)))
                    places = [pa.array(np.full(len(numbers), table_no, np.int32)), pa.array(numbers)]
                    yield pa.RecordBatch.from_arrays([*own.columns, *places], names=["vec_id", "v", "_table", "_bucket"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                buckets = hashes.buckets(_unit(matrix(batch.column(1), width)))
                for table_no in range(hashes.tables):
                    own = [pa.array(np.full(len(buckets), table_no, np.int32)), pa.array(buckets[:, table_no])]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=["vec_id", "v", "_at", "_table", "_bucket"])

    schema = "vec_id bigint, v array<double>, _table int, _bucket bigint"
    asked = numbered(once.mapInArrow(probe, schema))
    rows = index.rows.select("vec_id", "v", "_at").mapInArrow(place, "vec_id bigint, v array<double>, _at bigint, _table int, _bucket bigint")

    def compare(asked: pa.Table, rows: pa.Table) -> pa.Table:
        query_ids, ids = asked.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
        at, found, scores = _nearest(query_ids, matrix(asked.column("v"), width), ids, matrix(rows.column("v"), width), k)
        return pa.table(_hits(query_ids[at], ids[found], scores))

    hits = meet(asked, rows, ["_table", "_bucket"], compare, HITS, ask_block=1024)
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return top_per_key(hits, ["query_id"], [F.desc("score"), F.asc("vec_id")], k).select("query_id", "rank", "vec_id", "score")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    queries = rows.where(F.col("vec_id") % 50 == 0)
    return search(build(rows, queries, 5), queries, 5)
