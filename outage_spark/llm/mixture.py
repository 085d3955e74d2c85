"""Mixing sources to target weights by pivotal dependent rounding.

A source's target in words, divided by its size, is the number of copies each of its documents should
get on average: a whole part and a fraction. Fractions are rounded dependently. Two documents meet, and
word mass moves from one to the other, in a random direction that keeps each one's expectation, until
one of them has a whole number of copies; the other meets the next document. The words of a source are
thus kept exactly while documents meet, and only the last one is rounded alone. Order, directions and last
rounding are drawn from separate hashes of the row, anew at each level: a direction that went with the
order would favour the sizes that come early or late.

Documents are dealt to blocks by hash and meet inside a block, in hash order, while rows stream through
the task. Each block leaves at most one unfinished document; those of ``block_rows`` blocks form a block
of the next level, until a source has one block. A hot source just has more blocks. Nothing depends on
partitioning, so reruns agree.

Defined results: a null source is a source of its own, ordered last; a null or wordless text has size 0
and takes no words; repeated rows are documents of their own; empty tables give empty results; other
columns pass through untouched, whatever their names (internal names begin with ``_mix_``).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outage_spark.llm.text import nullable, store, table, word_count
from outage_spark.operators.spread import assign_ids, lookup_join

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_ROWS = 4096
COIN, LAST = 1, 2
MOVED = ("source", "block", "size", "p", "key")


def source_targets(
    docs: DataFrame, size: str, source: str, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """One stored row per source: ``source, n_rows, source_size, weight, target`` (words).

    Targets share ``share`` times all words by weight and stop at ``most`` times the source's size; what
    is over goes to the other sources by weight until none is above. Only sums reach the driver.
    """
    sums = docs.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("source_size")
    )
    numbered = assign_ids(sums.withColumn("_last", F.col("source").isNull()), ["_last", "source"], start=0, name="_id")
    choices = F.array(*map(F.lit, weights))
    rows = store(
        numbered.withColumn("weight", F.element_at(choices, (F.col("_id") % len(weights) + 1).cast("int"))).drop("_last", "_id")
    )
    limit = None
    cap = F.col("source_size") * most
    full = F.lit(False)
    while True:
        total, capped, free = rows.agg(
            F.sum("source_size"), F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))
        ).first()
        left = share * (total or 0) - (capped or 0)
        again = None if not free else (left, free)
        if again is None or again == limit:
            break
        limit = again
        # Who is full stays full, because the level only rises.
        full = F.lit(left) * F.col("weight") / F.lit(free) >= cap
    target = cap.cast("double") if limit is None else F.when(full, cap.cast("double")).otherwise(
        F.lit(limit[0]) * F.col("weight") / F.lit(limit[1])
    )
    return rows.withColumn("target", target)


def _draw(salt: int, key: int, nth: int) -> float:
    """A number in [0, 1) from a hash, for the ``nth`` row of a key."""
    return (xxhash.xxh3_64_intdigest(struct.pack("<qq", key, nth), seed=salt) >> 11) / (1 << 53)


def _meet(batches: Iterator[pa.RecordBatch], last_level: bool) -> Iterator[pa.RecordBatch]:
    """Rows come by (source, block); settled rows get ``copies``, a block's unfinished one keeps it null."""
    group = None
    held: dict | None = None  # the unfinished document: p, size and where its row is
    before, nth = None, 0

    def emitted(row: pa.RecordBatch, p: float, copies: int | None) -> pa.RecordBatch:
        schema = row.schema
        row = row.set_column(schema.get_field_index("_mix_p"), schema.field("_mix_p"), pa.array([p], pa.float64()))
        return row.set_column(
            schema.get_field_index("_mix_copies"), schema.field("_mix_copies"), pa.array([copies], pa.int64())
        )

    def finish(unit: dict) -> pa.RecordBatch:
        if last_level:
            return emitted(unit["row"], 0.0, int(_draw(LAST, *unit["key"]) < unit["p"]))
        return emitted(unit["row"], unit["p"], None)

    for batch in batches:
        columns = {name: batch.column(f"_mix_{name}").to_pylist() for name in MOVED}
        copies: list[int | None] = [None] * batch.num_rows
        out = list(columns["p"])
        skip = []
        for i in range(batch.num_rows):
            key = (columns["source"][i], columns["block"][i])
            if key != group:
                if held is not None:
                    if held["at"] is None:
                        yield finish(held)
                    elif last_level:
                        copies[held["at"]] = int(_draw(LAST, *held["key"]) < held["p"])
                    else:
                        out[held["at"]] = held["p"]
                group, held, before = key, None, None
            size, p = columns["size"][i], columns["p"][i]
            nth = nth + 1 if columns["key"][i] == before else 0
            before = columns["key"][i]
            row_key = before, nth
            if not size or p <= 0.0 or p >= 1.0:
                copies[i] = int(_draw(LAST, *row_key) < p)
                continue
            if held is None:
                held = {"p": p, "size": size, "key": row_key, "at": i}
                continue
            up = min(held["size"] * (1.0 - held["p"]), size * p)
            down = min(held["size"] * held["p"], size * (1.0 - p))
            if _draw(COIN, *row_key) * (up + down) < down:
                held_full, new_empty = held["size"] * (1.0 - held["p"]) <= up, size * p <= up
                a, b = held["p"] + up / held["size"], p - up / size
                a, b = (1.0 if held_full else a), (0.0 if new_empty else b)
            else:
                held_empty, new_full = held["size"] * held["p"] <= down, size * (1.0 - p) <= down
                a, b = held["p"] - down / held["size"], p + down / size
                a, b = (0.0 if held_empty else a), (1.0 if new_full else b)
            whole = {0.0: 0, 1.0: 1}
            new = {"p": b, "size": size, "key": row_key, "at": i}
            if a in whole:
                if held["at"] is None:
                    yield emitted(held["row"], a, whole[a])
                else:
                    copies[held["at"]] = whole[a]
                if b in whole:
                    copies[i] = whole[b]
                    held = None
                else:
                    held = new
            else:
                copies[i] = whole.get(b, round(b))
                held["p"] = a
        if held is not None and held["at"] is not None:
            held["row"] = batch.slice(held["at"], 1)
            skip.append(held["at"])
            held["at"] = None
        names = batch.schema
        batch = batch.set_column(names.get_field_index("_mix_p"), names.field("_mix_p"), pa.array(out, pa.float64()))
        batch = batch.set_column(
            names.get_field_index("_mix_copies"), names.field("_mix_copies"), pa.array(copies, pa.int64())
        )
        cuts = [-1, *skip, batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                yield batch.slice(a + 1, b - a - 1)
    if held is not None:
        yield finish(held)


def _even(*columns: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def mix(
    docs: DataFrame,
    targets: DataFrame,
    size: str,
    source: str,
    key: list[str],
    seed: int = 7,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All rows of ``docs`` with ``copies`` and their source's ``source_size`` and ``target`` (columns of these names are replaced).

    ``key`` are the columns whose hash deals rows to blocks; rows equal in them share one block, which
    is read as a stream and may be of any length.
    """
    about = targets.select(
        F.col("source").alias("_mix_source"), "n_rows", "source_size", "target", F.lit(True).alias("_mix_known")
    )
    largest = about.agg(F.max("n_rows")).first()[0] or 0
    known = F.coalesce(F.col(source), F.lit("")), F.col(source).isNull()
    left = docs.withColumns({"_mix_name": known[0], "_mix_null": known[1]})
    right = about.select(
        F.coalesce("_mix_source", F.lit("")).alias("_mix_name"), F.col("_mix_source").isNull().alias("_mix_null"),
        F.col("n_rows").alias("_mix_n"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"),
    )
    rows = lookup_join(left, right, ["_mix_name", "_mix_null"], "inner").drop("_mix_name", "_mix_null")
    each = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(0.0)
    rows = rows.withColumn("_mix_each", each)
    blocks = F.ceil(F.col("_mix_n") / block_rows)
    rows = rows.select(
        "*",
        F.floor("_mix_each").alias("_mix_base"),
        F.col(source).alias("_mix_source"),
        F.pmod(F.xxhash64(F.lit(seed), *key), blocks).alias("_mix_block"),
        F.lit(0).alias("_mix_level"),
        F.col(size).cast("bigint").alias("_mix_size"),
        (F.col("_mix_each") - F.floor("_mix_each")).alias("_mix_p"),
        _even(F.lit(seed + 1), *key).alias("_mix_u"),
        F.xxhash64(F.lit("draw"), F.lit(seed), F.lit(0), *key).alias("_mix_key"),
        F.lit(None).cast("bigint").alias("_mix_copies"),
    )
    schema = nullable(rows.schema)
    done: list[DataFrame] = []
    blocks_now, level = -(-largest // block_rows), 0
    while True:
        last = blocks_now <= 1
        ordered = rows.repartition("_mix_source", "_mix_block").sortWithinPartitions(
            "_mix_source", "_mix_block", "_mix_u", *key
        )
        met = ordered.mapInArrow(lambda batches, last=last: _meet(batches, last), schema)
        if last:
            done.append(met)
            break
        done.append(met.where(F.col("_mix_copies").isNotNull()))
        blocks_now, level = -(-blocks_now // block_rows), level + 1
        rows = met.where(F.col("_mix_copies").isNull()).withColumns(
            {
                "_mix_block": F.floor(F.col("_mix_block") / block_rows),
                "_mix_level": F.lit(level),
                "_mix_u": _even(F.lit(seed + 1 + level), *key),
                "_mix_key": F.xxhash64(F.lit("draw"), F.lit(seed), F.lit(level), *key),
            }
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        *[c for c in docs.columns if c not in ("copies", "source_size", "target")],
        (F.col("_mix_base") + F.col("_mix_copies")).cast("bigint").alias("copies"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
    )


def op7_mixture(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = store(
        docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), word_count("text").alias("size"))
    )
    targets = source_targets(sized, "size", "source")
    mixed = mix(sized, targets, "size", "source", ["doc_id", "text_key"])
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )
