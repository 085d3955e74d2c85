"""Postcode dimension: suburb lookups and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outage_spark.operators.spread import lookup_join
from outage_spark.schemas import NOT_SUPPORTED


def postcode_dimension(postcodes: DataFrame) -> DataFrame:
    """One row per postcode, whatever its form; of several suburbs the first in the alphabet.

    A table has no first row, so the order of a file cannot decide.
    """
    known = postcodes.where(F.col("postcode").isNotNull()).select("postcode", "suburb")
    return known.groupBy("postcode").agg(F.min("suburb").alias("suburb"))


def with_suburb(df: DataFrame, postcodes: DataFrame) -> DataFrame:
    """Left join the suburb on; rows with an unknown postcode keep a null suburb."""
    return lookup_join(df, postcode_dimension(postcodes), ["postcode"], "left")


def suburb_for(requests: DataFrame, postcodes: DataFrame, default: str = NOT_SUPPORTED) -> DataFrame:
    """Answer the suburb for every request, or ``default`` where the postcode is not in the table."""
    answered = with_suburb(requests, postcodes)
    return answered.withColumn("suburb", F.coalesce("suburb", F.lit(default)))


def staff_lookup(df: DataFrame, staff: DataFrame, default: int | None = None) -> DataFrame:
    """Attach the field staff of the row's postcode."""
    known = staff.where(F.col("postcode").isNotNull())
    table = known.groupBy("postcode").agg(F.min("staff").alias("staff"))
    joined = lookup_join(df, table, ["postcode"], "left")
    return joined if default is None else joined.fillna(default, ["staff"])


def in_conditions(df: DataFrame, conditions, column: str = "condition") -> DataFrame:
    return df.where(F.col(column).isin(*conditions))


