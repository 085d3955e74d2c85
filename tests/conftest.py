import datetime as dt

import pytest

from outage_spark import schemas
from outage_spark.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions=4,
        spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def ts(text):
    return dt.datetime.fromisoformat(text) if text else None


def day(text):
    return dt.date.fromisoformat(text)


PLANNED = "outage_id BIGINT, postcode STRING, start_ts TIMESTAMP_NTZ, end_ts TIMESTAMP_NTZ, reason STRING"


@pytest.fixture(scope="session")
def planned(spark):
    """Asked range in the tests: 2030-03-10 to 2030-03-12, postcode 2001."""
    rows = [
        (1, "2001", ts("2030-03-01 08:00"), ts("2030-03-01 12:00"), "before"),
        (2, "2001", ts("2030-03-09 20:00"), ts("2030-03-10 01:00"), "touches the start"),
        (3, "2001", ts("2030-03-11 08:00"), ts("2030-03-11 12:00"), "inside"),
        (4, "2001", ts("2030-03-11 23:00"), ts("2030-03-12 03:00"), "across midnight"),
        (5, "2001", ts("2030-03-12 22:00"), ts("2030-03-13 02:00"), "touches the end"),
        (6, "2001", ts("2030-03-20 08:00"), ts("2030-03-20 12:00"), "after"),
        (7, "2001", ts("2030-03-11 08:00"), None, "no end"),
        (8, "2002", ts("2030-03-11 08:00"), ts("2030-03-11 12:00"), "other postcode"),
    ]
    return spark.createDataFrame(rows, PLANNED)


@pytest.fixture(scope="session")
def postcodes(spark):
    rows = [("2001", "Alder"), ("2002", "Birch"), ("2002", "Cedar"), ("20x", "Broken"), ("2003", "Alder")]
    return spark.createDataFrame(rows, schemas.POSTCODES)


@pytest.fixture(scope="session")
def history(spark):
    rows = [
        ("2001", "Rain", 0.125),
        ("2001", "Rain", 0.125),
        ("2001", "Storms", None),
        ("2002", "Rain", 4.0),
        ("2002", "rain", 8.0),
    ]
    return spark.createDataFrame(rows, "postcode STRING, condition STRING, hours DOUBLE")
