"""Unplanned outage history: mean hours and the duration estimate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outage_spark.functions.scalars import exact_mean, round2
from outage_spark.operators.spread import lookup_join, settle

LEVEL = ["postcode", "condition"]


def overall_hours(history: DataFrame) -> DataFrame:
    """One row: mean hours of all outages."""
    return history.agg(exact_mean("hours").alias("overall_hours"))


def hours_sums(history: DataFrame, keys=tuple(LEVEL)) -> DataFrame:
    """Rows ``n``, exact sum of hours and number of rows with hours per group."""
    hours = F.col("hours").cast("decimal(18,6)")
    return history.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hours).alias("hours_sum"), F.count(hours).alias("hours_n")
    )


def _mean(total: Column, n: Column) -> Column:
    return F.try_divide(total.cast("double"), n)


def hours_by(history: DataFrame, keys=tuple(LEVEL)) -> DataFrame:
    """Rows and mean hours per group. ``n`` counts rows, also those without hours."""
    mean = _mean(F.col("hours_sum"), F.col("hours_n"))
    return hours_sums(history, keys).select(*keys, "n", mean.alias("mean_hours"))


def hours_levels(history: DataFrame) -> DataFrame:
    """Group level and overall level in one pass; ``level`` is 0 for groups and 3 for the overall row."""
    return history.groupingSets([LEVEL, []], *LEVEL).agg(
        F.count(F.lit(1)).alias("n"),
        exact_mean("hours").alias("mean_hours"),
        F.grouping_id().cast("bigint").alias("level"),
    )


def estimate_duration(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Estimated hours per request: mean of its postcode and condition, else the overall mean.

    The overall mean stands in only where the group has no rows. A group whose hours are all null
    keeps its null estimate.
    """
    sums = settle(hours_sums(history))
    # The overall mean comes from the group sums: the history is read once.
    overall = sums.agg(_mean(F.sum("hours_sum"), F.sum("hours_n")).alias("overall")).scalar()
    joined = lookup_join(requests, sums, LEVEL, salt_by="request_id", settled=True)
    group = _mean(F.col("hours_sum"), F.col("hours_n"))
    estimate = F.when(F.col("n").isNull(), overall).otherwise(group)
    return joined.withColumn("est_hours", round2(estimate)).drop("n", "hours_sum", "hours_n")
