"""Weather observations joined to requests as of the time of asking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outage_spark.operators.spread import OrderedRows

OBSERVATION = ["observed_at", "condition_text", "temp_c"]


def weather_asof(
    requests: DataFrame, observations: DataFrame, tolerance: str | None = None, runs: int | None = None
) -> DataFrame:
    """Latest observation of the postcode at or before ``asked_at``; null where there is none.

    Both sides become one sorted table in which the last observation is carried forward, also over
    partition borders, so neither a busy postcode nor a busy hour ends up in one task.
    A request without a postcode has no weather; observations without one are not read.
    ``tolerance`` (an interval such as ``"2 hours"``) drops observations that are too old.
    """
    asked = requests.select(
        "postcode",
        F.col("asked_at").alias("_at"),
        F.lit(1).alias("_side"),
        F.struct(*requests.columns).alias("_request"),
        F.xxhash64(*requests.columns).alias("_tie"),
    )
    seen = observations.where(F.col("postcode").isNotNull()).select(
        "postcode",
        F.col("observed_at").alias("_at"),
        F.lit(0).alias("_side"),
        F.struct(*OBSERVATION).alias("_seen"),
        F.xxhash64(*OBSERVATION).alias("_tie"),
    )
    both = asked.unionByName(seen, allowMissingColumns=True)
    rows = OrderedRows(both, ["postcode"], ["_at", "_side", "_tie"], runs).with_last_known("_seen", "_last").rows
    answered = rows.where("_side = 1").select("_request.*", "_last.*")
    if tolerance is None:
        return answered
    fresh = F.col("observed_at") >= F.col("asked_at") - F.expr(f"INTERVAL {tolerance}")
    return answered.select(*requests.columns, *[F.when(fresh, F.col(c)).alias(c) for c in OBSERVATION])
