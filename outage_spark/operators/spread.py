"""Skew-safe building blocks shared by the operators.

Two problems keep coming back in this library:

* *A running value per key* (row number, running sum, last known value, next row). A window over the
  key puts a hot key into one task. ``OrderedRows`` counts rows per key first. Rows of hot keys are
  sorted by (key, order) into range partitions, so a hot key is spread over as many tasks as it
  needs; the work is done inside each partition and the state is carried over the borders.
  Partitions are contiguous, so at most one key per partition needs a carried value: the carried
  table is never longer than the number of partitions, which is why broadcasting it is safe.
* *A lookup in a table with one row per key* where the asking side may be hot. ``lookup_join``
  broadcasts the table only after measuring it; past the limit only the hot keys' rows are broadcast.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = "_run"
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16
HOT_ROWS = 1_000_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only in local mode where none is set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="outage_spark_")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and cut its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class _Part:
    """Rows with the window that sees a whole key, or, when spread over runs, a key's rows of one run."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], spread: bool):
        self.rows = self.base = rows
        self.keys, self.spread = keys, spread
        self.window = Window.partitionBy(*([RUN] if spread else []), *keys).orderBy(*order)
        self.runs = Window.partitionBy(*keys).orderBy(RUN)
        self.earlier_runs = self.runs.rowsBetween(Window.unboundedPreceding, -1)

    def carry(self, value: Column, carried: Column) -> None:
        """Add ``_carried``: ``value`` is summed up per (run, key), ``carried`` taken from other runs of the key."""
        if not self.spread:
            self.rows = self.rows.withColumn("_carried", F.lit(None))
            return
        names = {c: f"_carry_{c}" for c in (RUN, *self.keys)}
        summary = self.base.groupBy(RUN, *self.keys).agg(value.alias("_value"))
        carry = summary.select(RUN, *self.keys, carried.alias("_carried"))
        carry = carry.where(F.col("_carried").isNotNull()).withColumnsRenamed(names)
        match = F.col(RUN) == F.col(names[RUN])
        for key in self.keys:
            match = match & F.col(key).eqNullSafe(F.col(names[key]))
        # Bounded: at most one key per run continues over a border.
        self.rows = self.rows.join(F.broadcast(carry), match, "left").drop(*names.values())

    def add(self, name: str, value: Column) -> None:
        self.rows = self.rows.withColumn(name, value).drop("_carried")


class OrderedRows:
    """Running values within ``keys`` in ``order``, which must be unique within a key.

    Keys of up to ``hot_rows`` rows take a plain window. Larger ones are cut into range partitions;
    those rows are settled, because partition borders are sampled and must stay the same for both
    passes. Without keys, with ``hot_rows=0`` or a given number of ``runs``, all rows go the second way.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        runs: int | None = None,
        hot_rows: int = HOT_ROWS,
    ):
        keys, order = list(keys), list(order)
        self._order = order
        everything = runs or not keys or not hot_rows
        plain, hot = (None, df) if everything else _split_hot(df, keys, _weigh(df, keys, F.count(F.lit(1))), hot_rows)
        self._parts = [] if plain is None else [_Part(plain, keys, order, spread=False)]
        if hot is not None:
            columns = [F.col(c) for c in (*keys, *order)]
            spread = hot.repartitionByRange(runs, *columns) if runs else hot.repartitionByRange(*columns)
            settled = settle(spread.withColumn(RUN, F.spark_partition_id()))
            self._parts.append(_Part(settled, keys, order, spread=True))

    def with_number(self, name: str, start: int = 1) -> OrderedRows:
        """Row number within the key."""
        for part in self._parts:
            part.carry(F.count(F.lit(1)), F.sum("_value").over(part.earlier_runs))
            number = F.row_number().over(part.window) + F.coalesce(F.col("_carried"), F.lit(0)) + (start - 1)
            part.add(name, number.cast("bigint"))
        return self

    def with_sum_before(self, value: str, name: str) -> OrderedRows:
        """Sum of ``value`` over the earlier rows of the key, 0 for the first."""
        for part in self._parts:
            part.carry(F.sum(value), F.sum("_value").over(part.earlier_runs))
            local = F.sum(value).over(part.window.rowsBetween(Window.unboundedPreceding, -1))
            part.add(name, F.coalesce(local, F.lit(0)) + F.coalesce(F.col("_carried"), F.lit(0)))
        return self

    def with_xor(self, value: str, name: str) -> OrderedRows:
        """Bitwise exclusive or of the whole numbers ``value`` over the rows of the key up to this one."""
        for part in self._parts:
            part.carry(F.bit_xor(value), F.bit_xor("_value").over(part.earlier_runs))
            local = F.bit_xor(value).over(part.window.rowsBetween(Window.unboundedPreceding, 0))
            part.add(name, local.bitwiseXOR(F.coalesce(F.col("_carried"), F.lit(0)).cast("bigint")))
        return self

    def with_last_known(self, value: str, name: str) -> OrderedRows:
        """Latest non-null ``value`` at or before the row, within the key."""
        position = F.when(F.col(value).isNotNull(), F.struct(*self._order))
        for part in self._parts:
            last = F.last("_value", ignorenulls=True).over(part.earlier_runs)
            part.carry(F.max_by(F.col(value), position), last)
            local = F.last(value, ignorenulls=True).over(part.window.rowsBetween(Window.unboundedPreceding, 0))
            part.add(name, F.coalesce(local, F.col("_carried")))
        return self

    def with_next(self, columns: Sequence[str], name: str) -> OrderedRows:
        """Struct of ``columns`` from the next row of the key, null for the last row."""
        for part in self._parts:
            first = F.min_by(F.struct(*columns), F.struct(*self._order))
            part.carry(first, F.lead("_value").over(part.runs))
            local = F.lead(F.struct(*columns)).over(part.window)
            part.add(name, F.coalesce(local, F.col("_carried")))
        return self

    @property
    def rows(self) -> DataFrame:
        frames = [part.rows.drop(RUN) for part in self._parts]
        return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def _weigh(df: DataFrame, keys: Sequence[str], weight: Column) -> DataFrame:
    return df.groupBy(*keys).agg(weight.alias("_weight"))


def _hot_keys(keys: Sequence[str], weights: DataFrame, limit: int) -> DataFrame | None:
    """Keys whose ``_weight`` is over the limit, as ``_hot_`` columns, or None; few, by the limit."""
    hot = settle(weights.where(F.col("_weight") > limit).select(*[F.col(k).alias(f"_hot_{k}") for k in keys]))
    if hot.isEmpty():
        return None
    return F.broadcast(hot) if is_small(hot) else hot


def _with_keys(df: DataFrame, keys: Sequence[str], hot: DataFrame, how: str) -> DataFrame:
    match = F.lit(True)
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_hot_{key}"))
    return df.join(hot, match, how)


def _split_hot(
    df: DataFrame, keys: Sequence[str], weights: DataFrame, limit: int
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of keys whose ``_weight`` is over the limit or None)."""
    hot = _hot_keys(keys, weights, limit)
    if hot is None:
        return df, None
    return _with_keys(df, keys, hot, "left_anti"), _with_keys(df, keys, hot, "left_semi")


def _row_bytes(table: DataFrame) -> Column:
    """Size of a row: 16 bytes per fixed-width column, the real length of text and of nested values."""
    width = F.lit(16 * len(table.columns)).cast("bigint")
    for field in table.schema.fields:
        name, kind = f"`{field.name}`", field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            width = width + F.coalesce(F.size(name), F.lit(0)) * 8
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            width = width + F.coalesce(F.octet_length(F.to_json(name)), F.lit(0))
    return width


def is_small(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a settled table against the broadcast limit."""
    size = table.agg(F.sum(_row_bytes(table))).first()[0]
    return (size or 0) <= max_bytes


def size_in_blocks(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> int:
    """How many parts of ``max_bytes`` a settled table has; at least one."""
    size = table.agg(F.sum(_row_bytes(table))).first()[0] or 0
    return max(1, -(-size // max_bytes))


def lookup_join(
    left: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    salt_by: str | None = None,
    max_bytes: int = BROADCAST_BYTES,
    settled: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``left`` to a table that has one row per key.

    The table is settled (unless it comes from a settled one) and measured. Small: broadcast, so
    ``left`` is not shuffled at all. Large: rows of hot keys are joined to the few table rows of
    those keys, the other rows by an ordinary shuffle join. A stream cannot be counted first; it is
    salted on ``salt_by`` (a column that varies within a hot key) with the table repeated per salt.
    """
    on = list(on)
    table = table if settled else settle(table)
    if is_small(table, max_bytes):
        return left.join(F.broadcast(table), on, how)
    if left.isStreaming:
        return _salted_join(left, table, on, how, salt_by)
    hot = _hot_keys(on, _weigh(left, on, F.count(F.lit(1))), hot_rows)
    if hot is None:
        return left.join(table, on, how)
    # One table row per hot key, and at most one hot key per hot_rows rows of left.
    rows_of_hot = settle(_with_keys(table, on, hot, "left_semi"))
    rows_of_hot = F.broadcast(rows_of_hot) if is_small(rows_of_hot) else rows_of_hot
    plain = _with_keys(left, on, hot, "left_anti").join(table, on, how)
    return plain.unionByName(_with_keys(left, on, hot, "left_semi").join(rows_of_hot, on, how))


def _salted_join(left: DataFrame, table: DataFrame, on: list[str], how: str, salt_by: str | None) -> DataFrame:
    if salt_by is None:
        return left.join(table, on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark plans a WindowGroupLimit: each map task keeps k rows per key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order; each map task sends one row per key."""
    return top_per_key(df, keys, [F.col(c) for c in order], 1, "_rank").drop("_rank")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of the whole table (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(*order).limit(k)


def assign_ids(
    df: DataFrame, order: Sequence[str], start: int = 1, name: str = "id", runs: int | None = None
) -> DataFrame:
    """Dense identity numbers in ``order`` without a single-task window.

    Rows are sorted into range partitions and numbered inside each while they are written; the numbers
    before a partition are one row per partition, so no second shuffle follows.
    """
    columns = [F.col(c) for c in order]
    spread = df.repartitionByRange(runs, *columns) if runs else df.repartitionByRange(*columns)
    # The lower 33 bits of the built-in id are the row's place in its partition.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = spread.sortWithinPartitions(*columns).withColumns({RUN: F.spark_partition_id(), "_place": place})
    placed = settle(placed)
    sizes = placed.groupBy(F.col(RUN).alias("_run_of")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_run_of").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_run_of", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # Bounded: one row per partition.
    joined = placed.join(F.broadcast(before), F.col(RUN) == F.col("_run_of"))
    return joined.select(*df.columns, (F.col("_before") + F.col("_place") + start).cast("bigint").alias(name))


def concat_text(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str = "text",
    sep: str = "\n",
    part_chars: int = 1_000_000,
    runs: int | None = None,
    weights: DataFrame | None = None,
) -> DataFrame:
    """Join the text pieces of a key in order, as numbered parts.

    A new part starts once ``part_chars`` characters are full, so an ordinary key is one part (0)
    and a huge key is many parts that no single task has to hold; in part order they hold every piece.
    ``weights`` (keys, ``_weight``) gives the characters per key where they are known more cheaply.
    """
    pieces = df.where(F.col(text).isNotNull()).withColumn("_chars", F.length(text) + max(len(sep), 1))
    ordering = ", ".join(f"`{c}`" for c in order)
    quoted = sep.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    joined = F.expr(f"listagg(`{text}`, '{quoted}') WITHIN GROUP (ORDER BY {ordering})").alias(text)

    def join_parts(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, "part").agg(joined, F.count(F.lit(1)).alias("pieces"))

    weights = weights if weights is not None else _weigh(pieces, keys, F.sum("_chars"))
    plain, hot = (None, pieces) if runs else _split_hot(pieces, keys, weights, part_chars)
    # Joining text does not shrink it, so rows are shuffled as they are and joined once, after it.
    frames = [] if plain is None else [join_parts(plain.repartition(*keys).withColumn("part", F.lit(0)))]
    if hot is not None:
        rows = OrderedRows(hot, keys, order, runs, hot_rows=0).with_sum_before("_chars", "_before").rows
        frames.append(join_parts(rows.withColumn("part", F.floor(F.col("_before") / part_chars).cast("int"))))
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
