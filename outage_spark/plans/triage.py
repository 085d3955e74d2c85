"""The decision a caller wants: is this outage planned, and if not, how long will it last?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outage_spark.functions.scalars import valid_postcode
from outage_spark.functions.weather import classify_weather
from outage_spark.operators.estimate import estimate_duration
from outage_spark.operators.lookup import with_suburb
from outage_spark.operators.planned import outages_per_day
from outage_spark.operators.spread import lookup_join
from outage_spark.operators.weather import weather_asof

TODAY = ["postcode", "day"]


def _today(requests: DataFrame) -> DataFrame:
    return requests.withColumn("day", F.col("start_date"))


def _busy_days(planned: DataFrame) -> DataFrame:
    return outages_per_day(planned).select(*TODAY)


def triage_planned(requests: DataFrame, planned: DataFrame) -> DataFrame:
    """Requests whose postcode has a planned outage on the asked day."""
    return lookup_join(_today(requests), _busy_days(planned), TODAY, "left_semi", "request_id").drop("day")


def triage_unplanned(requests: DataFrame, planned: DataFrame) -> DataFrame:
    """Requests whose postcode has none: treated as unplanned."""
    return lookup_join(_today(requests), _busy_days(planned), TODAY, "left_anti", "request_id").drop("day")


def outage_status(
    requests: DataFrame,
    postcodes: DataFrame,
    planned: DataFrame,
    history: DataFrame,
    observations: DataFrame | None = None,
) -> DataFrame:
    """One row per request with its status, the planned outages of the asked day, and an estimate.

    Status is ``invalid`` (no four digits), ``unsupported`` (postcode not in the table), ``planned``
    or ``unplanned``. Only unplanned requests get an estimate. With ``observations`` the condition is
    read from the weather at the time of asking, else from the request.
    """
    if observations is not None:
        requests = weather_asof(requests.drop("condition"), observations).withColumn(
            "condition", classify_weather("condition_text", "temp_c")
        )
    known = with_suburb(requests, postcodes)
    counted = lookup_join(_today(known), outages_per_day(planned), TODAY, salt_by="request_id")
    estimated = estimate_duration(counted, history)
    status = (
        F.when(~valid_postcode("postcode"), "invalid")
        .when(F.col("suburb").isNull(), "unsupported")
        .when(F.col("planned_count") > 0, "planned")
        .otherwise("unplanned")
    )
    supported = F.col("status").isin("planned", "unplanned")
    return estimated.withColumn("status", status).select(
        "request_id",
        "postcode",
        "suburb",
        "status",
        F.when(supported, F.coalesce("planned_count", F.lit(0))).alias("planned_count"),
        F.when(F.col("status") == "unplanned", F.col("est_hours")).alias("est_hours"),
    )
