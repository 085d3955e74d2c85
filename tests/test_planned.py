import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from outage_spark import schemas
from outage_spark.operators.planned import (
    _blocks,
    next_planned,
    planned_conflicts,
    planned_counts,
    planned_for,
    planned_in_range,
    planned_matches,
    planned_numbered,
    planned_summary,
)
from tests.conftest import PLANNED, day, ts


def ids(df):
    return [r.outage_id for r in df.collect()]


def ask(spark, *rows):
    full = [(i, p, s and day(s), e and day(e), None, None) for i, (p, s, e) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.REQUESTS)


def test_one_range_overlap(planned):
    assert ids(planned_in_range(planned, "2001", "2030-03-10", "2030-03-12")) == [2, 3, 4, 5]


def test_one_range_reference_is_one_sided(planned):
    """Lists the outage after the range, misses the one already running, drops the one without an end."""
    assert ids(planned_in_range(planned, "2001", "2030-03-10", "2030-03-12", "reference")) == [3, 4, 5, 6]


def test_unknown_semantics(planned, spark):
    with pytest.raises(ValueError):
        planned_in_range(planned, "2001", "2030-03-10", "2030-03-12", "other")
    with pytest.raises(ValueError):
        planned_counts(ask(spark), planned, "other")


def test_filters_reach_the_scan(planned, spark, tmp_path):
    path = str(tmp_path / "planned")
    planned.write.parquet(path)
    plan = planned_in_range(spark.read.parquet(path), "2001", "2030-03-10", "2030-03-12")
    assert "EqualTo(postcode,2001)" in plan._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(5)
    base = dt.datetime(2030, 1, 1)
    outages, asks = [], []
    for i in range(300):
        start = base + dt.timedelta(hours=rng.randrange(24 * 40))
        end = None if i % 29 == 0 else start + dt.timedelta(hours=rng.choice([0, 1, 5, 30, 100]) - (i % 31 == 0) * 200)
        # Two thirds of all outages and asks are in one postcode.
        outages.append((i, "2001" if i % 3 else f"20{10 + i % 7}", start, end, f"r{i % 5}"))
    for i in range(200):
        low = base.date() + dt.timedelta(days=rng.randrange(-3, 45))
        asks.append(("2001" if i % 3 else f"20{10 + i % 9}", str(low), str(low + dt.timedelta(days=rng.randrange(-1, 9)))))
    return spark.createDataFrame(outages, PLANNED), outages, asks


def overlapping(outages, ask):
    postcode, low, high = ask[0], day(ask[1]), day(ask[2])
    return [
        o
        for o in outages
        if o[1] == postcode and o[3] and o[2] <= o[3] and low <= high and o[2].date() <= high and o[3].date() >= low
    ]


def test_matches_equal_brute_force(spark, many):
    frame, outages, asks = many
    got = sorted(
        (r.postcode, str(r.start_date), str(r.end_date), r.outage_id)
        for r in planned_matches(ask(spark, *asks), frame).collect()
    )
    assert got == sorted((*a, o[0]) for a in set(asks) for o in overlapping(outages, a))


def test_counts_equal_brute_force(spark, many):
    frame, outages, asks = many
    requests = ask(spark, *asks)
    expected = [len(overlapping(outages, a)) for a in asks]
    assert [r.n_outages for r in planned_counts(requests, frame).orderBy("request_id").collect()] == expected
    assert [r.n_outages for r in planned_for(requests, frame).orderBy("request_id").collect()] == expected
    literal = [sum(o[1] == a[0] and o[3] is not None and o[2].date() >= day(a[1]) for o in outages) for a in asks]
    got = planned_counts(requests, frame, "reference").orderBy("request_id").collect()
    assert [r.n_outages for r in got] == literal


@pytest.mark.parametrize("runs", [None, 6])
def test_numbered_outages_give_the_reference_reply(spark, many, runs):
    frame, _, asks = many
    numbered = planned_numbered(frame, runs).collect()
    for r in planned_counts(ask(spark, *asks[:25]), frame, "reference").collect():
        reply = {o.outage_id for o in numbered if o.postcode == r.postcode and o.from_last <= r.n_outages}
        assert reply == set(ids(planned_in_range(frame, r.postcode, r.start_date, r.end_date, "reference")))


def test_requests_without_dates_or_postcode_are_kept(spark, planned):
    requests = ask(spark, ("2001", None, None), (None, "2030-03-11", "2030-03-11"), ("2001", "2030-03-11", None))
    for semantics in ("overlap", "reference"):
        assert [r.n_outages for r in planned_counts(requests, planned, semantics).collect()] == [0, 0, 0]
    assert [r.n_outages for r in planned_for(requests, planned).collect()] == [0, 0, 0]


@pytest.mark.parametrize("runs", [None, 5])
def test_conflicts_equal_brute_force(spark, many, runs):
    frame, outages, _ = many
    good = [o for o in outages if o[3] and o[2] < o[3]]
    clash = {
        o[0]: sum(p[0] != o[0] and p[1] == o[1] and p[2] < o[3] and p[3] > o[2] for p in good) for o in good
    }
    got = {r.outage_id: r.n_conflicts for r in planned_conflicts(frame, runs).collect()}
    assert got == {k: n for k, n in clash.items() if n}


def test_touching_outages_do_not_clash(spark):
    rows = [(1, "2001", ts("2030-01-01 08:00"), ts("2030-01-01 10:00"), ""),
            (2, "2001", ts("2030-01-01 10:00"), ts("2030-01-01 12:00"), "")]
    assert planned_conflicts(spark.createDataFrame(rows, PLANNED)).count() == 0


def test_reply_in_start_order(spark, planned):
    rows = planned_summary(ask(spark, ("2001", "2030-03-10", "2030-03-12")), planned).collect()
    assert len(rows) == 1 and rows[0].n_lines == 4
    assert rows[0].reply.split("\n")[0] == "2030-03-09 20:00 to 2030-03-10 01:00: touches the start"


def test_long_ranges_need_few_rows_and_meet_once(spark):
    rng = random.Random(11)
    base = dt.date(2000, 1, 1)
    spans = [(base + dt.timedelta(rng.randrange(5000)), rng.choice([0, 1, 3, 40, 3650])) for _ in range(60)]
    rows = [(i, "2001", dt.datetime.combine(d, dt.time(8)), dt.datetime.combine(d + dt.timedelta(n), dt.time(9)), "x") for i, (d, n) in enumerate(spans)]
    outages = spark.createDataFrame(rows, PLANNED)
    asked = [(base + dt.timedelta(rng.randrange(5000)), rng.choice([0, 1, 7, 3650])) for _ in range(40)]
    asks = ask(spark, *[("2001", str(d), str(d + dt.timedelta(n))) for d, n in asked])
    got = sorted((r.start_date, r.end_date, r.outage_id) for r in planned_matches(asks, outages).collect())
    want = sorted(
        {(d, d + dt.timedelta(n), i) for d, n in asked for i, _, s, e, _ in rows if s.date() <= d + dt.timedelta(n) and e.date() >= d}
    )
    assert got == want
    blocks = spark.range(1).select(F.size(_blocks(F.lit(3), F.lit(3653))).alias("n")).first().n
    assert blocks <= 24


def test_every_ask_has_a_reply(spark, planned):
    asked = ask(spark, ("2001", "2030-05-01", "2030-05-02"), ("2001", "2030-03-12", "2030-03-10"), ("9999", "2030-03-10", "2030-03-12"))
    rows = planned_summary(asked, planned).collect()
    assert [(r.part, r.n_lines, r.reply) for r in rows] == [(0, 0, "No planned outages in this period.")] * 3


def test_next_planned(planned):
    got = {r.postcode: r.outage_id for r in next_planned(planned, "2030-03-11 09:00:00").collect()}
    assert got == {"2001": 4}


def test_the_header_names_postcode_and_range(spark, planned):
    asked = ask(spark, ("2001", "2030-03-10", "2030-03-12"), ("9999", "2030-03-10", "2030-03-12"))
    rows = {r.postcode: r.header for r in planned_summary(asked, planned).collect()}
    assert rows == {"2001": "Outages planned for 2001, 2030-03-10 to 2030-03-12", "9999": "No outages planned for 9999, 2030-03-10 to 2030-03-12"}


def test_ten_year_asks_and_a_hot_postcode_read_totals_only(spark):
    """However many outages a postcode has, an ask meets at most two totals per level and way."""
    from outage_spark.operators import planned as P

    rows = spark.range(20_000).select(
        F.col("id").alias("outage_id"), F.lit("2001").alias("postcode"),
        F.expr("timestamp_ntz'2020-01-01 08:00:00' + make_dt_interval(CAST(id % 3650 AS INT))").alias("start_ts"),
        F.expr("timestamp_ntz'2020-01-01 08:00:00' + make_dt_interval(CAST(id % 3650 + id % 3 AS INT), 2)").alias("end_ts"), F.lit("x").alias("reason"),
    )
    asks = ask(spark, ("2001", "2020-01-05", "2029-12-20"), ("2001", "2021-01-01", "2021-01-01"))
    placed, _ = P._placed(P.asks_of(asks), P._spans(rows, F.count(F.lit(1)).alias("n")))
    assert placed.count() <= 2 * (2 * 12 + 2)
    found = {r.start_date.isoformat(): r.n_outages for r in P.planned_for(asks, rows).collect()}
    days = [(i % 3650, i % 3650 + i % 3) for i in range(20_000)]
    assert found == {"2020-01-05": sum(a <= 3641 and b >= 4 for a, b in days), "2021-01-01": sum(a <= 366 <= b for a, b in days)}
