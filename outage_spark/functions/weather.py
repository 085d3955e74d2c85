"""Free weather text to one of the condition names the history uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STORM_WORDS = "storm|thunder|lightning|cyclone|gale"
RAIN_WORDS = "rain|drizzle|shower"
HOT_FROM_C = 35.0


def classify_weather(text: Column | str, temp_c: Column | str) -> Column:
    """Storm words win over rain words, rain words over heat; anything else is fine weather."""
    said = F.lower(F.col(text) if isinstance(text, str) else text)
    temp = F.col(temp_c) if isinstance(temp_c, str) else temp_c
    return (
        F.when(said.rlike(STORM_WORDS), "Storms")
        .when(said.rlike(RAIN_WORDS), "Rain")
        .when(temp >= HOT_FROM_C, "High Temperature")
        .otherwise("Fine_Conditions")
    )
