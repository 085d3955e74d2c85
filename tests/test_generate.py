import pytest
from pyspark.sql import functions as F

from outage_spark.operators.generate import gen_history, gen_planned, row_ids
from outage_spark.schemas import CONDITIONS, REASONS


@pytest.mark.parametrize("variant,low,high", [(1, "2024-01-01", "2024-12-28"), (2, "2023-10-01", "2024-09-30")])
def test_history(spark, postcodes, variant, low, high):
    rows = gen_history(row_ids(spark, 3000), postcodes, variant).cache()
    assert rows.count() == 3000
    facts = rows.agg(
        F.min("hours"), F.max("hours"), F.min("staff"), F.max("staff"), F.min("start_ts"), F.max("start_ts")
    ).first()
    assert 0 <= facts[0] <= facts[1] <= 24 and 3 <= facts[2] <= facts[3] <= 15
    assert low <= str(facts[4].date()) and str(facts[5].date()) <= high
    assert {r.condition for r in rows.select("condition").distinct().collect()} == set(CONDITIONS)
    assert {r.postcode for r in rows.select("postcode").distinct().collect()} == {"2001", "2002", "2003", "20x"}
    assert rows.groupBy("postcode").agg(F.countDistinct("staff").alias("n")).where("n > 1").count() == 0
    means = {r.condition: r.m for r in rows.groupBy("condition").agg(F.avg("hours").alias("m")).collect()}
    assert means["Fine_Conditions"] < min(means[c] for c in CONDITIONS[1:])
    late = rows.where(F.abs(F.timestamp_diff("SECOND", "start_ts", "end_ts") / 3600 - F.col("hours")) > 0.001)
    assert late.count() == 0
    assert rows.where("day <> day(start_ts) or dow <> date_format(start_ts, 'EEEE')").count() == 0


def test_rows_depend_on_their_id_only(spark, postcodes):
    small = gen_history(row_ids(spark, 50), postcodes)
    large = gen_history(row_ids(spark, 500).repartition(9), postcodes).where("row_id < 50")
    assert sorted(small.collect()) == sorted(large.collect())


def test_planned(spark, postcodes):
    rows = gen_planned(row_ids(spark, 1000), postcodes, "2030-01-01 06:30:00", "2030-02-28").cache()
    assert {r.reason for r in rows.select("reason").distinct().collect()} == set(REASONS)
    hours = [r.h for r in rows.select(F.timestamp_diff("HOUR", "start_ts", "end_ts").alias("h")).distinct().collect()]
    assert sorted(hours) == list(range(1, 13))
    first, last = rows.agg(F.min("start_ts"), F.max("start_ts")).first()
    assert str(first) >= "2030-01-01 06:30" and str(last) <= "2030-03-01 05:30:00"


def test_planned_after_its_end_still_works(spark, postcodes):
    assert gen_planned(row_ids(spark, 5), postcodes, "2031-01-01 00:00:00", "2030-12-31").count() == 5
