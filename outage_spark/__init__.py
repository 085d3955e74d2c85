"""Outage analytics and document retrieval as Spark DataFrame operators.

The six questions an outage assistant can ask, each for a whole table at once:
``retrieve``, ``suburb_for``, ``as_of``, ``planned_for``, ``weather_asof``, ``estimate_duration``;
and ``outage_status``, which decides between them.
"""

from outage_spark.functions.scalars import as_of
from outage_spark.operators.estimate import estimate_duration
from outage_spark.operators.lookup import suburb_for
from outage_spark.operators.planned import planned_for
from outage_spark.operators.retrieval import retrieve
from outage_spark.operators.weather import weather_asof
from outage_spark.plans.triage import outage_status
from outage_spark.session import build_session

__all__ = [
    "as_of",
    "build_session",
    "estimate_duration",
    "outage_status",
    "planned_for",
    "retrieve",
    "suburb_for",
    "weather_asof",
]
