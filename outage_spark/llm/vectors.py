"""Vectors as blocks inside tasks, shared by the vector operators.

Queries meet rows per key in blocks: keys are counted first, a key with many queries or rows is cut into
several blocks of either, and each pair of blocks is one bounded group. No pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outage_spark.llm.text import groups, store
from outage_spark.operators.spread import lookup_join

BLOCK = 4096


def finite(vector: str | Column) -> Column:
    """Is the vector there, without null, NaN or infinite components?"""
    vector = F.col(vector) if isinstance(vector, str) else vector
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def width_of(rows: DataFrame, vector: str) -> int:
    """Length of the longest vector; shorter ones count as filled up with zeros."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(column: pa.Array | pa.ChunkedArray, width: int, kind: type = np.float64) -> np.ndarray:
    """A list column as rows of ``width`` numbers, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):  # a column without rows has no chunks
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    if len(lengths) * width == len(flat) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), kind)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def lists(values: np.ndarray) -> pa.Array:
    """Rows of equally many numbers as a list column."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))


class Rotation:
    """An orthogonal pseudo-rotation: random signs and a fast Hadamard transform, three times over."""

    ROUNDS = 3

    def __init__(self, width: int, seed: int, least: int = 1):
        self.width = 1 << max(width - 1, least - 1, 0).bit_length()
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (self.ROUNDS, self.width))

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros((len(vectors), self.width))
        out[:, : vectors.shape[1]] = vectors
        for signs in self.signs:
            out *= signs
            half = 1
            while half < self.width:
                pairs = out.reshape(len(out), -1, 2, half)
                out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(out), -1)
                half *= 2
            out /= np.sqrt(self.width)
        return out


def numbered(df: DataFrame) -> DataFrame:
    """Rows stored with a number ``_at``, by which blocks are cut; it varies between equal rows too."""
    return store(df.withColumn("_at", F.monotonically_increasing_id()))


def meet(
    asked: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    compare: Callable[[pa.Table, pa.Table], pa.Table | None],
    schema: str,
    ask_block: int = BLOCK,
    row_block: int = BLOCK,
) -> DataFrame:
    """``compare(asked block, rows block)`` for every two blocks of a key that has both.

    Both sides carry the integer ``keys`` and ``_at`` from ``numbered``. Blocks have about the given rows.
    """
    keys = list(keys)
    n_ask = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_ask"))
    n_rows = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_rows"))
    sizes = store(n_ask.join(n_rows, keys))

    def cut(side: DataFrame, mark: int, own: str, n_own: str, own_block: int, other: str, n_other: str, other_block: int) -> DataFrame:
        sized = lookup_join(side, sizes, keys, "inner", settled=True)
        own_blocks = F.ceil(F.col(n_own) / F.lit(own_block))
        block = F.pmod(F.xxhash64("_at"), own_blocks).cast("int")
        others = F.sequence(F.lit(0), F.ceil(F.col(n_other) / F.lit(other_block)).cast("int") - 1)
        return sized.select(*side.columns, F.lit(mark).alias("_side"), block.alias(own), F.explode(others).alias(other))

    left = cut(asked, 0, "_ask", "_n_ask", ask_block, "_row", "_n_rows", row_block)
    right = cut(rows, 1, "_row", "_n_rows", row_block, "_ask", "_n_ask", ask_block)
    group = [*keys, "_ask", "_row"]
    both = left.unionByName(right, allowMissingColumns=True).repartition(*group).sortWithinPartitions(*group, "_side")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, begins in groups(batches, group):
            sides = whole.column("_side").to_numpy()
            for start, end in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                cut_at = start + int(np.searchsorted(sides[start:end], 1))
                if start < cut_at < end:
                    found = compare(whole.slice(start, cut_at - start), whole.slice(cut_at, end - cut_at))
                    if found is not None and found.num_rows:
                        yield from found.combine_chunks().to_batches()

    return both.mapInArrow(work, schema)
