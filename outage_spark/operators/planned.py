"""Planned outages: one range, or a whole table of asked ranges.

A request asks for (postcode, start_date, end_date). Two readings of "in the range" are kept:

* ``overlap``: the outage touches at least one asked day.
* ``reference``: start date >= asked start and (end date >= asked end or end date <= asked end). The
  second part holds for any two non-null dates, so every later outage is listed, and one that
  already runs at the asked start is missed.

Many requests ask the same range, so matches are listed once per *ask* (distinct postcode and
range) and requests join their ask. Counts never list matches at all: they come from running day
totals per postcode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outage_spark.functions.text import outage_line
from outage_spark.operators.spread import OrderedRows, concat_text, first_per_key, lookup_join, settle

ASK = ["postcode", "start_date", "end_date"]


def range_predicate(start: Column, end: Column, low: Column, high: Column, semantics: str) -> Column:
    """Does the outage (start, end dates) belong to the asked range (low, high)?"""
    if semantics == "overlap":
        return (start <= high) & (end >= low)
    if semantics == "reference":
        return (start >= low) & ((end >= high) | (end <= high))
    raise ValueError(f"unknown semantics: {semantics}")


def planned_in_range(
    planned: DataFrame, postcode: str, start_date, end_date, semantics: str = "overlap"
) -> DataFrame:
    """Outages of one postcode in one range, by start. Filters reach the scan."""
    inside = range_predicate(
        F.to_date("start_ts"),
        F.to_date("end_ts"),
        F.lit(start_date).cast("date"),
        F.lit(end_date).cast("date"),
        semantics,
    )
    return planned.where((F.col("postcode") == postcode) & inside).orderBy("start_ts")


def asks_of(requests: DataFrame) -> DataFrame:
    """Distinct asked ranges; ranges that run backwards match nothing."""
    return requests.where(F.col("start_date") <= F.col("end_date")).select(*ASK).distinct()


def _days(low: Column | str, high: Column | str) -> Column:
    return F.explode(F.sequence(F.to_date(low), F.to_date(high)))


def _well_formed(planned: DataFrame) -> DataFrame:
    """Outages without an end, or ending before their start, match nothing."""
    return planned.where(F.col("start_ts") <= F.col("end_ts"))


def outages_per_day(planned: DataFrame) -> DataFrame:
    """Outages that touch each (postcode, day); counted before the shuffle."""
    touched = _well_formed(planned).select("postcode", _days("start_ts", "end_ts").alias("day"))
    return touched.groupBy("postcode", "day").agg(F.count(F.lit(1)).alias("planned_count"))


def _length_levels(rows: DataFrame, low: Column, high: Column) -> int:
    """Levels that the longest range of day numbers needs: blocks of up to its length."""
    return max(rows.agg(F.max(high - low + 1)).first()[0] or 1, 1).bit_length()


LEVELS = 24  # blocks of up to 2^23 days: any two dates


def _blocks(low: Column, high: Column, levels: int = LEVELS, way: int = 0) -> Column:
    """The day numbers ``low`` to ``high`` as dyadic blocks: at most two per level, none for low > high."""

    def at(level: int) -> list[Column]:
        size = F.lit(1 << level)
        first = F.ceil(low / size).cast("bigint")
        last = F.floor((high + 1) / size).cast("bigint") - 1
        some = first <= last
        left, right = some & (F.pmod(first, F.lit(2)) == 1), some & (F.pmod(last, F.lit(2)) == 0)
        if level == levels - 1:  # no larger blocks: the range is at most two of these
            left, right = some, first < last
        return [F.when(left, _node(way, level, first)), F.when(right, _node(way, level, last))]

    return F.array_compact(F.array(*[block for level in range(levels) for block in at(level)]))


def _node(way: int, level: int, block: Column) -> Column:
    return F.struct(F.lit(2 * level + way).alias("node"), block.cast("bigint").alias("block"))


def _blocks_over(day: Column, levels: int, way: int) -> Column:
    """The block of every level that holds a day number."""
    return F.array(*[_node(way, level, F.floor(day / F.lit(1 << level))) for level in range(levels)])


def _placed(asks: DataFrame, outages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Asks and outage rows (with ``_first`` and ``_last`` dates) at the tree nodes where those that share a day meet once.

    Either the outage begins in the asked range (way 0), or it began before and still runs when the range
    begins (way 1). Both are a day in a range of days: the range takes its dyadic blocks, about 2 log n rows for
    n days, and the day the blocks that hold it.
    """
    asks, outages = settle(asks), settle(outages)
    first, last = F.unix_date("_first"), F.unix_date("_last")
    start, end = F.unix_date("start_date"), F.unix_date("end_date")
    asked, ran = _length_levels(asks, start, end), _length_levels(outages, first + 1, last)
    of_ask = F.concat(_blocks(start, end, asked, way=0), _blocks_over(start, ran, way=1))
    of_outage = F.concat(_blocks_over(first, asked, way=0), _blocks(first + 1, last, ran, way=1))
    return asks.select("*", F.inline(of_ask)), outages.select("*", F.inline(of_outage))


NODE = ["postcode", "node", "block"]


def _spans(planned: DataFrame, *totals: Column) -> DataFrame:
    """Totals per (postcode, first day, last day): whether an outage is in a range depends on these only."""
    first, last = F.to_date("start_ts").alias("_first"), F.to_date("end_ts").alias("_last")
    return _well_formed(planned).groupBy("postcode", first, last).agg(*totals)


def planned_matches(
    requests: DataFrame, planned: DataFrame, columns=("outage_id", "start_ts", "end_ts", "reason")
) -> DataFrame:
    """The outages of every ask. AQE splits a (postcode, day) with very many outages."""
    outages = _well_formed(planned).select(
        "postcode", *columns, F.to_date("start_ts").alias("_first"), F.to_date("end_ts").alias("_last")
    )
    asks, outages = _placed(asks_of(requests), outages)
    return asks.join(outages, NODE).select(*ASK, *columns)


def planned_for(requests: DataFrame, planned: DataFrame) -> DataFrame:
    """One row per request: number, first start, last end and mean hours of its planned outages.

    Outages are summed up per span, then per node of a tree of dyadic day blocks, before they meet the asks:
    an ask reads about 2 log n totals for n days, however many outages its postcode has.
    """
    hours = F.timestamp_diff("MICROSECOND", F.col("start_ts"), F.col("end_ts")) / F.lit(3.6e9)
    spans = _spans(
        planned,
        F.count(F.lit(1)).alias("n"),
        F.min("start_ts").alias("first_start"),
        F.max("end_ts").alias("last_end"),
        F.sum(hours.cast("decimal(18,6)")).alias("hours"),
    )

    def totals() -> list[Column]:
        ends = F.min("first_start").alias("first_start"), F.max("last_end").alias("last_end")
        return [F.sum("n").alias("n"), *ends, F.sum("hours").alias("hours")]

    asks, nodes = _placed(asks_of(requests), spans)
    met = asks.join(nodes.groupBy(*NODE).agg(*totals()), NODE).groupBy(*ASK).agg(*totals())
    per_ask = met.select(
        *ASK,
        F.col("n").alias("n_outages"),
        "first_start",
        "last_end",
        F.round(F.col("hours").cast("double") / F.col("n"), 4).alias("mean_hours"),
    )
    joined = lookup_join(requests, per_ask, ASK, salt_by="request_id")
    return joined.fillna(0, ["n_outages"])


def planned_counts(requests: DataFrame, planned: DataFrame, semantics: str = "overlap") -> DataFrame:
    """Number of planned outages per request (``n_outages``) without listing them.

    ``overlap``: outages begun by the asked end minus outages over before the asked start.
    ``reference``: outages that begin on or after the asked start and have an end.
    """
    if semantics not in ("overlap", "reference"):
        raise ValueError(f"unknown semantics: {semantics}")
    totals = settle(_day_totals(requests, planned))
    if semantics == "reference":
        at_start = totals.select("postcode", F.col("day").alias("start_date"), "later")
        joined = lookup_join(requests, at_start, ["postcode", "start_date"], salt_by="request_id", settled=True)
        count, asked = F.col("later"), F.col("end_date").isNotNull()
    else:
        at_end = totals.select("postcode", F.col("day").alias("end_date"), "begun")
        at_start = totals.select("postcode", F.col("day").alias("start_date"), "over")
        joined = lookup_join(requests, at_end, ["postcode", "end_date"], salt_by="request_id", settled=True)
        joined = lookup_join(joined, at_start, ["postcode", "start_date"], salt_by="request_id", settled=True)
        count, asked = F.col("begun") - F.col("over"), F.col("start_date") <= F.col("end_date")
    n = F.when(asked, F.coalesce(count, F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    return joined.select(*requests.columns, n.alias("n_outages"))


def planned_numbered(planned: DataFrame, runs: int | None = None) -> DataFrame:
    """Outages with an end, numbered per postcode from the last start back (``from_last`` = 1 for the last).

    The ``reference`` reply to an ask is every outage from its start on: those with ``from_last`` up
    to the ask's ``planned_counts(..., "reference")``. One numbered table answers all asks; listing
    the replies ask by ask would repeat the later outages in each of them.
    """
    ended = planned.where(F.col("end_ts").isNotNull() & F.col("start_ts").isNotNull())
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    back = ended.withColumn("_back", -F.timestamp_diff("MICROSECOND", epoch, F.col("start_ts")))
    numbered = OrderedRows(back, ["postcode"], ["_back", "outage_id"], runs).with_number("from_last").rows
    return numbered.select("postcode", "outage_id", "start_ts", "end_ts", "reason", "from_last")


def _day_totals(requests: DataFrame, planned: DataFrame) -> DataFrame:
    """Per postcode and asked day: outages ``begun`` by then, ``over`` before it, and starting then or ``later``."""

    names = ("begun", "over", "later", "asked")

    def mark(day: Column, **given: Column | int) -> Column:
        values = [F.lit(given.get(name, 0)).cast("bigint").alias(name) for name in names]
        return F.struct(day.alias("day"), *values)

    # One scan per table: each row marks the days it counts on.
    start, after = F.to_date("start_ts"), F.date_add(F.to_date("end_ts"), 1)
    well_formed = F.coalesce(F.col("start_ts") <= F.col("end_ts"), F.lit(False)).cast("int")
    ends = F.col("end_ts").isNotNull().cast("int")
    of_outage = F.array(mark(start, begun=well_formed, later=ends), mark(after, over=well_formed))
    of_request = F.array(mark(F.col("start_date"), asked=1), mark(F.col("end_date"), asked=1))
    marks = planned.select("postcode", F.inline(of_outage)).unionByName(
        requests.select("postcode", F.inline(of_request))
    )
    each_day = (
        marks.where(F.col("day").isNotNull()).groupBy("postcode", "day").agg(*[F.sum(name).alias(name) for name in names])
    )
    # One row per (postcode, day) by now, so a window holds at most the days of the calendar.
    past = Window.partitionBy("postcode").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("postcode").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    totals = each_day.select(
        "postcode",
        "day",
        F.sum("begun").over(past).alias("begun"),
        F.sum("over").over(past).alias("over"),
        F.sum("later").over(ahead).alias("later"),
        "asked",
    )
    return totals.where("asked > 0").drop("asked")


NO_OUTAGES = "No planned outages in this period."


def planned_summary(
    requests: DataFrame, planned: DataFrame, part_chars: int = 1_000_000, default: str = NO_OUTAGES
) -> DataFrame:
    """The reply text per ask: one line per outage in start order, in numbered parts.

    Every ask has a part 0; one without outages, also a range that runs backwards, has the default text.
    ``header`` is the line that goes before the reply: it names the postcode and the range, found or not.
    """
    lined = planned.withColumn("line", outage_line("start_ts", "end_ts", "reason"))
    lines = settle(planned_matches(requests, lined, ("outage_id", "start_ts", "end_ts", "line")))
    replies = concat_text(lines, ASK, ["start_ts", "outage_id"], "line", "\n", part_chars)
    asked = requests.select(*[F.col(c).alias(f"_ask_{c}") for c in ASK]).distinct()
    same = F.lit(True)
    for c in ASK:
        same = same & F.col(c).eqNullSafe(F.col(f"_ask_{c}"))
    return asked.join(replies, same, "left").select(
        *[F.col(f"_ask_{c}").alias(c) for c in ASK],
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("pieces", F.lit(0).cast("bigint")).alias("n_lines"),
        _header(F.col("pieces").isNotNull()).alias("header"),
        F.coalesce("line", F.lit(default)).alias("reply"),
    )


def _header(some: Column) -> Column:
    """"Outages planned for 2000, 2030-01-01 to 2030-01-07", or that there are none."""
    named = [F.coalesce(F.col(f"_ask_{c}").cast("string"), F.lit("unknown")) for c in ASK]
    kind = F.when(some, "Outages planned for ").otherwise("No outages planned for ")
    return F.concat(kind, named[0], F.lit(", "), named[1], F.lit(" to "), named[2])


def next_planned(planned: DataFrame, as_of) -> DataFrame:
    """First planned outage per postcode that starts at or after ``as_of``."""
    later = planned.where(F.col("start_ts") >= F.lit(as_of).cast("timestamp_ntz"))
    rows = later.select("postcode", "outage_id", "start_ts", "end_ts", "reason")
    return first_per_key(rows, ["postcode"], ["start_ts", "outage_id"])


def planned_rollup(planned: DataFrame) -> DataFrame:
    """Outages and planned hours by postcode and reason, with subtotals."""
    hours = F.timestamp_diff("MICROSECOND", F.col("start_ts"), F.col("end_ts")) / F.lit(3.6e9)
    return (
        planned.withColumn("_hours", hours.cast("decimal(18,6)"))
        .rollup("postcode", "reason")
        .agg(
            F.count(F.lit(1)).alias("n_outages"),
            F.sum("_hours").cast("double").alias("planned_hours"),
            F.grouping_id().cast("bigint").alias("level"),
        )
    )


def planned_conflicts(planned: DataFrame, runs: int | None = None) -> DataFrame:
    """Outages that overlap others of their postcode in time, with the number of others.

    Counted, not paired: the others that begin before this one ends, minus those that end by its
    start. One sorted sweep over the end points of all outages gives both numbers.
    """
    usable = planned.where(F.col("start_ts") < F.col("end_ts"))
    point = F.explode(
        F.array(
            # At equal times an end comes before a start: touching outages do not clash.
            F.struct(F.col("end_ts").alias("at"), F.lit(0).alias("side"), F.lit(1).alias("ends")),
            F.struct(F.col("start_ts").alias("at"), F.lit(1).alias("side"), F.lit(0).alias("ends")),
        )
    )
    points = usable.select("postcode", "outage_id", point.alias("p")).select("postcode", "outage_id", "p.*")
    points = points.withColumn("starts", F.lit(1) - F.col("ends"))
    swept = OrderedRows(points, ["postcode"], ["at", "side", "outage_id"], runs)
    swept = swept.with_sum_before("starts", "_begun").with_sum_before("ends", "_over").rows
    counted = swept.groupBy("postcode", "outage_id").agg(
        F.max(F.when(F.col("side") == 1, F.col("at"))).alias("start_ts"),
        F.max(F.when(F.col("side") == 0, F.col("at"))).alias("end_ts"),
        (
            F.max(F.when(F.col("side") == 0, F.col("_begun"))) - F.max(F.when(F.col("side") == 1, F.col("_over"))) - 1
        ).alias("n_conflicts"),
    )
    return counted.where("n_conflicts > 0")
