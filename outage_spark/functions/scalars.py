"""Column functions for postcodes, numbers, times and repeatable pseudo-random values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# Postcodes and paths


def normalise_postcode(value: Column | str) -> Column:
    return F.trim(_col(value).cast("string"))


def valid_postcode(value: Column | str) -> Column:
    """Four digits; null is not valid."""
    return F.coalesce(_col(value).rlike("^[0-9]{4}$"), F.lit(False))


def place_query(suburb: Column | str, suffix: str = ", AU") -> Column:
    return F.concat(_col(suburb), F.lit(suffix))


def basename(path: Column | str) -> Column:
    """Last path segment, without a query string or fragment."""
    return F.substring_index(F.regexp_replace(_col(path), "[?#].*$", ""), "/", -1)


# Numbers


def clamp(value: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(_col(value), F.lit(low)), F.lit(high))


def round2(value: Column | str) -> Column:
    return F.round(_col(value), 2)


def exact_mean(value: Column | str) -> Column:
    """Mean that does not depend on how rows are partitioned: decimal sum, one double division."""
    number = _col(value).cast("decimal(18,6)")
    return F.try_divide(F.sum(number).cast("double"), F.count(number))


def staff_adjusted(base: Column | str, staff: Column | str, full_staff: int = 15) -> Column:
    """Fewer field staff lengthen an outage: up to twice the base duration."""
    return _col(base) * (F.lit(1) + (F.lit(full_staff) - _col(staff)) / F.lit(float(full_staff)))


# Times


def parse_ts(value: Column | str) -> Column:
    """Timestamp without zone, or null where the text is no timestamp."""
    return _col(value).try_cast("timestamp_ntz")


def as_of(ts: Column | str | None = None) -> Column:
    """A time as text; now, unless a time is given, which makes a job repeatable."""
    moment = F.current_timestamp() if ts is None else _col(ts)
    return F.date_format(moment, TIMESTAMP_FORMAT)


def day_diff(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(_col(later), _col(earlier))


def end_from_hours(start: Column | str, hours: Column | str) -> Column:
    """Start plus fractional hours, to the microsecond."""
    micros = F.floor(_col(hours) * F.lit(3.6e9) + F.lit(0.5)).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, _col(start))


def time_features(df, ts: str):
    """Add day of month, weekday name and month name."""
    return df.select(
        "*",
        F.dayofmonth(ts).alias("day"),
        F.date_format(ts, "EEEE").alias("dow"),
        F.date_format(ts, "MMMM").alias("month"),
    )


def relative_range(day: Column | str, phrase: Column | str) -> Column:
    """Struct (start_date, end_date) for a relative phrase; both null for an unknown phrase."""
    today, said = F.to_date(_col(day)), F.lower(F.trim(_col(phrase)))
    monday = F.to_date(F.date_trunc("week", today))
    first = F.to_date(F.date_trunc("month", today))
    ranges = {
        "today": (today, today),
        "tomorrow": (F.date_add(today, 1), F.date_add(today, 1)),
        "this week": (monday, F.date_add(monday, 6)),
        "next week": (F.date_add(monday, 7), F.date_add(monday, 13)),
        "this month": (first, F.last_day(first)),
        "next month": (F.to_date(F.add_months(first, 1)), F.last_day(F.add_months(first, 1))),
    }
    start = end = F.lit(None).cast("date")
    for name, (low, high) in ranges.items():
        start = F.when(said == name, low).otherwise(start)
        end = F.when(said == name, high).otherwise(end)
    return F.struct(start.alias("start_date"), end.alias("end_date"))


# Repeatable pseudo-random values: a digest of the row id, so any engine can redo them


def hash_int(row_id: Column | str, stream: int, n: int) -> Column:
    """Integer in 0..n-1, fixed by the row id and the stream number."""
    digest = F.md5(F.concat_ws(":", _col(row_id).cast("string"), F.lit(str(stream))).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(n))


def hash_uniform(row_id: Column | str, stream: int, low: float, high: float) -> Column:
    """Double in [low, high), fixed by the row id and the stream number."""
    return F.lit(low) + F.lit(high - low) * (hash_int(row_id, stream, 1_000_000) / F.lit(1e6))


def hash_choice(row_id: Column | str, stream: int, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (hash_int(row_id, stream, len(values)) + 1).cast("int"))
