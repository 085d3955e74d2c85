from outage_spark import schemas
from outage_spark.operators.estimate import estimate_duration, hours_by, hours_levels, overall_hours
from outage_spark.operators.lookup import staff_lookup, suburb_for, with_suburb
from outage_spark.operators.weather import weather_asof
from outage_spark.plans.triage import outage_status, triage_planned, triage_unplanned
from outage_spark.schemas import NOT_SUPPORTED
from tests.conftest import day, ts


def requests(spark, *rows):
    """(postcode, day, condition)."""
    full = [(i, p, day(d), day(d), ts(f"{d} 12:00"), c) for i, (p, d, c) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.REQUESTS)


def test_overall_mean_skips_nulls(history):
    assert overall_hours(history).first()[0] == 12.25 / 4


def test_group_counts_rows_also_without_hours(history):
    got = {(r.postcode, r.condition): (r.n, r.mean_hours) for r in hours_by(history).collect()}
    assert got[("2001", "Storms")] == (1, None)
    assert got[("2002", "Rain")] == (1, 4.0)


def test_levels_in_one_pass(history):
    got = {(r.level, r.postcode, r.condition): r.mean_hours for r in hours_levels(history).collect()}
    assert got[(3, None, None)] == 12.25 / 4 and got[(0, "2002", "rain")] == 8.0


def test_estimate_fallback_only_without_rows(spark, history):
    asked = requests(
        spark,
        ("2001", "2030-01-01", "Rain"),  # tie at the third decimal: half up
        ("2001", "2030-01-01", "Storms"),  # rows, but no hours: stays null
        ("2001", "2030-01-01", "rain"),  # exact match on case: no rows
        ("9999", "2030-01-01", "Rain"),
    )
    got = [r.est_hours for r in estimate_duration(asked, history).orderBy("request_id").collect()]
    assert got == [0.13, None, 3.06, 3.06]


def test_empty_history(spark, history):
    got = estimate_duration(requests(spark, ("2001", "2030-01-01", "Rain")), history.where("false")).collect()
    assert [r.est_hours for r in got] == [None]


def test_suburbs(spark, postcodes):
    asked = requests(spark, ("2002", "2030-01-01", None), ("20x", "2030-01-01", None), ("2999", "2030-01-01", None))
    got = [r.suburb for r in suburb_for(asked, postcodes).orderBy("request_id").collect()]
    # Any value of the table is joined on; the form of a postcode is checked on requests only.
    assert got == ["Birch", "Broken", NOT_SUPPORTED]
    assert with_suburb(asked, postcodes).count() == 3


def test_postcodes_of_any_form_are_looked_up(spark):
    table = spark.createDataFrame([("800", "Harbour"), (None, "Nowhere")], "postcode string, suburb string")
    asked = spark.createDataFrame([("800",), (None,)], "postcode string")
    got = {r.postcode: r.suburb for r in with_suburb(asked, table).collect()}
    assert got == {"800": "Harbour", None: None}


def test_staff(spark):
    staff = spark.createDataFrame([("2001", 4)], "postcode string, staff int")
    df = spark.createDataFrame([("2001",), ("2002",)], "postcode string")
    assert sorted(r.staff for r in staff_lookup(df, staff, 9).collect()) == [4, 9]


def test_every_status(spark, postcodes, planned, history):
    asked = requests(
        spark,
        ("12a4", "2030-03-11", "Rain"),
        ("999", "2030-03-11", "Rain"),
        ("2999", "2030-03-11", "Rain"),
        ("2001", "2030-03-11", "Rain"),
        ("2001", "2030-03-15", "Rain"),  # only a later outage: not planned today
        ("2003", "2030-03-11", "Rain"),
    )
    got = outage_status(asked, postcodes, planned, history).orderBy("request_id").collect()
    assert [r.status for r in got] == ["invalid", "invalid", "unsupported", "planned", "unplanned", "unplanned"]
    assert [r.planned_count for r in got] == [None, None, None, 2, 0, 0]
    assert [r.est_hours for r in got] == [None, None, None, None, 0.13, 3.06]


def test_triage_splits_all_requests(spark, planned):
    asked = requests(spark, ("2001", "2030-03-11", None), ("2001", "2030-03-15", None), ("2002", "2030-03-11", None))
    assert sorted(r.request_id for r in triage_planned(asked, planned).collect()) == [0, 2]
    assert [r.request_id for r in triage_unplanned(asked, planned).collect()] == [1]


def weather(spark, *rows):
    return spark.createDataFrame([(p, ts(t), c, x) for p, t, c, x in rows], schemas.WEATHER)


def test_status_by_weather(spark, postcodes, planned, history):
    asked = requests(spark, ("2002", "2030-05-01", None), ("2001", "2030-05-01", None))
    seen = weather(spark, ("2002", "2030-05-01 11:00", "Light RAIN", 20.0), ("2001", "2030-05-01 13:00", "Rain", 20.0))
    got = outage_status(asked, postcodes, planned, history, seen).orderBy("request_id").collect()
    assert [r.est_hours for r in got] == [4.0, 3.06]


def test_asof_takes_latest_at_or_before(spark):
    asked = requests(spark, ("2001", "2030-05-01", None), ("2002", "2030-05-01", None)).select(
        "request_id", "postcode", "asked_at"
    )
    seen = weather(
        spark,
        ("2001", "2030-05-01 09:00", "old", 1.0),
        ("2001", "2030-05-01 12:00", "same time", 2.0),
        ("2001", "2030-05-01 12:01", "later", 3.0),
        ("2002", "2030-05-01 09:00", "old", 4.0),
    )
    for runs in (None, 3):
        got = weather_asof(asked, seen, runs=runs).orderBy("request_id").collect()
        assert [r.condition_text for r in got] == ["same time", "old"]
    fresh = weather_asof(asked, seen, tolerance="2 hours").orderBy("request_id").collect()
    assert [r.condition_text for r in fresh] == ["same time", None]
