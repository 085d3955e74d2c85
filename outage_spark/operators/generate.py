"""Repeatable sample tables: unplanned history and planned outages.

Each row is a function of its id, so rows are made in parallel, any engine can redo them, and a
table can be extended without changing the rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outage_spark.functions.scalars import (
    clamp,
    end_from_hours,
    hash_choice,
    hash_int,
    hash_uniform,
    staff_adjusted,
    time_features,
)
from outage_spark.operators.lookup import postcode_dimension
from outage_spark.operators.spread import assign_ids, lookup_join, settle
from outage_spark.schemas import ADVERSE_CONDITIONS, CONDITIONS, REASONS

# Hours before the staff adjustment, (adverse weather, fine weather), per variant. Fixed values.
BASE_HOURS = {1: ((3.0, 12.0), (0.0, 6.0)), 2: ((2.5, 5.5), (1.0, 4.0))}
# Staff numbers per postcode and the bounds of an outage in hours. Fixed values.
STAFF_LOW, STAFF_HIGH = 3, 15
HOURS_LOW, HOURS_HIGH = 0.0, 24.0
HISTORY_END = "2024-09-30"


def row_ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("row_id"))


def numbered_postcodes(postcodes: DataFrame) -> DataFrame:
    """Postcodes numbered 0..n-1 in their order, with their staff."""
    staff = (F.lit(STAFF_LOW) + _staff_draw("postcode")).cast("int")
    numbered = assign_ids(postcode_dimension(postcodes), ["postcode"], start=0, name="place")
    return settle(numbered.select("place", "postcode", "suburb", staff.alias("staff")))


def _staff_draw(postcode: str) -> Column:
    return hash_int(postcode, 0, STAFF_HIGH - STAFF_LOW + 1)


def _with_postcode(ids: DataFrame, postcodes: DataFrame, stream: int) -> DataFrame:
    numbered = numbered_postcodes(postcodes)
    n = numbered.count()
    placed = ids.withColumn("place", hash_int("row_id", stream, n))
    return lookup_join(placed, numbered, ["place"], "inner", settled=True).drop("place")


def _minutes(days: Column, hours: Column, minutes: Column) -> Column:
    return (days * 24 + hours) * 60 + minutes


def gen_history(ids: DataFrame, postcodes: DataFrame, variant: int = 2) -> DataFrame:
    """Unplanned outage history, one row per ``row_id``.

    Variant 1: calendar year 2024, days 1 to 28. Variant 2: the 365 days up to 2024-09-30, with
    shorter base durations. Adverse weather lasts longer, more staff makes it shorter.
    """
    adverse_range, fine_range = BASE_HOURS[variant]
    rows = _with_postcode(ids, postcodes, 1).withColumn("condition", hash_choice("row_id", 2, CONDITIONS))
    clock = (hash_int("row_id", 4, 24), hash_int("row_id", 5, 60))
    if variant == 1:
        month, day = hash_int("row_id", 3, 12) + 1, hash_int("row_id", 6, 28) + 1
        midnight = F.make_timestamp_ntz(
            F.lit(2024), month.cast("int"), day.cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")
        )
        start = F.timestamp_add("MINUTE", _minutes(F.lit(0), *clock), midnight)
    else:
        first = F.date_sub(F.lit(HISTORY_END).cast("date"), 365).cast("timestamp_ntz")
        start = F.timestamp_add("MINUTE", _minutes(hash_int("row_id", 3, 366), *clock), first)
    adverse = F.col("condition").isin(*ADVERSE_CONDITIONS)
    base = F.when(adverse, hash_uniform("row_id", 7, *adverse_range)).otherwise(
        hash_uniform("row_id", 7, *fine_range)
    )
    hours = clamp(staff_adjusted(base, "staff", STAFF_HIGH), HOURS_LOW, HOURS_HIGH)
    rows = rows.withColumn("start_ts", start).withColumn("hours", hours)
    rows = time_features(rows.withColumn("end_ts", end_from_hours("start_ts", "hours")), "start_ts")
    return rows.select(
        "row_id", "postcode", "suburb", "condition", "staff", "start_ts", "end_ts", "hours", "day", "dow", "month"
    )


def gen_planned(ids: DataFrame, postcodes: DataFrame, as_of: str, until: str) -> DataFrame:
    """Planned outages that start between ``as_of`` and ``until`` and last 1 to 12 hours."""
    rows = _with_postcode(ids, postcodes, 1)
    first = F.lit(as_of).cast("timestamp_ntz")
    span = F.greatest(F.datediff(F.lit(until).cast("date"), F.lit(as_of).cast("date")), F.lit(0)) + 1
    day = F.pmod(hash_int("row_id", 2, 1_000_000_000), span)
    start = F.timestamp_add("HOUR", day * 24 + hash_int("row_id", 3, 24), first)
    end = F.timestamp_add("HOUR", hash_int("row_id", 4, 12) + 1, F.col("start_ts"))
    rows = rows.withColumn("start_ts", start).withColumn("end_ts", end)
    return rows.select(
        "row_id", "postcode", "start_ts", "end_ts", hash_choice("row_id", 5, REASONS).alias("reason"), "suburb"
    )
