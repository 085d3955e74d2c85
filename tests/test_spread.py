"""Hot keys: spread results equal the plain window, whatever the partition borders."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from outage_spark.operators.spread import (
    OrderedRows,
    _salted_join,
    assign_ids,
    concat_text,
    first_per_key,
    is_small,
    lookup_join,
    settle,
    top_per_key,
)


@pytest.fixture(scope="module")
def rows(spark):
    """One key (also null) with most of the rows, values with gaps."""
    key = F.when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") % 10 == 7, F.lit(None)).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))
    )
    seen = F.when(F.col("id") % 13 == 0, F.struct((F.col("id") * 3).alias("v")))
    return spark.range(2000).select("id", key.alias("key"), (F.col("id") % 97).alias("n"), seen.alias("seen"))


def plain(rows):
    window = Window.partitionBy("key").orderBy("id")
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "id",
        F.row_number().over(window).cast("bigint").alias("no"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.last("seen", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)).alias("last"),
        F.lead(F.struct("id", "n")).over(window).alias("next"),
    )


@pytest.mark.parametrize("how", [{"runs": 1}, {"runs": 9}, {"runs": 40}, {"hot_rows": 300}, {"hot_rows": 10**9}])
def test_running_values(rows, how):
    ordered = OrderedRows(rows, ["key"], ["id"], **how)
    ordered.with_number("no").with_sum_before("n", "before").with_last_known("seen", "last")
    got = ordered.with_next(["id", "n"], "next").rows.select("id", "no", "before", "last", "next")
    assert sorted(got.collect()) == sorted(plain(rows).collect())


def test_hot_key_is_spread_over_runs(rows):
    parts = OrderedRows(rows, ["key"], ["id"], runs=8)._parts
    sizes = [r["count"] for r in parts[0].rows.groupBy("_run").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 700


def test_carried_table_has_at_most_one_row_per_run(rows):
    part = OrderedRows(rows, ["key"], ["id"], runs=8)._parts[0]
    summary = part.base.groupBy("_run", "key").agg(F.count(F.lit(1)).alias("_value"))
    carried = summary.withColumn("c", F.sum("_value").over(part.earlier_runs)).where("c is not null")
    assert carried.count() <= 8


def test_assign_ids_are_dense_and_in_order(spark):
    got = assign_ids(spark.range(500).withColumnRenamed("id", "x"), ["x"], start=10, runs=6).collect()
    assert sorted((r.x, r.id) for r in got) == [(x, x + 10) for x in range(500)]


def test_concat_text_parts_hold_every_piece(spark):
    words = [(k, i, f"{k}{i:03d}") for k in ("a", "b") for i in range(200 if k == "a" else 3)]
    df = spark.createDataFrame(words, "k string, i int, text string")
    parts = sorted(concat_text(df, ["k"], ["i"], sep="|", part_chars=100).collect(), key=lambda r: (r.k, r.part))
    for k in ("a", "b"):
        mine = [r for r in parts if r.k == k]
        assert [r.part for r in mine] == list(range(len(mine)))
        assert "|".join(r.text for r in mine) == "|".join(w for key, _, w in words if key == k)
        assert max(len(r.text) for r in mine) <= 105
    assert sum(r.pieces for r in parts) == len(words)


@pytest.fixture(scope="module")
def lookup(spark):
    """Key 0 and the null key are hot; keys 20 to 39 are not in the table."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id") % 40)
    left = spark.range(1000).select("id", key.alias("k"))
    return left, spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [100, 10**6])
def test_large_lookup_equals_broadcast(lookup, how, hot_rows):
    left, table = lookup
    small = lookup_join(left, table, ["k"], how)
    large = lookup_join(left, table, ["k"], how, max_bytes=0, hot_rows=hot_rows)
    assert sorted(map(str, large.collect())) == sorted(map(str, small.collect()))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast(lookup, how):
    left, table = lookup
    salted = _salted_join(left, table, ["k"], how, "id")
    assert sorted(map(str, salted.collect())) == sorted(map(str, lookup_join(left, table, ["k"], how).collect()))


def test_size_check(spark):
    table = settle(spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("t")))
    assert is_small(table, 200_000) and not is_small(table, 100_000)


def test_first_and_top(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, n int, t string")
    assert sorted(map(tuple, first_per_key(df, ["k"], ["n"]).collect())) == [("a", 1, "y"), ("b", 5, "z")]
    top = top_per_key(df, ["k"], [F.desc("n")], 1)
    assert sorted((r.k, r.n, r["rank"]) for r in top.collect()) == [("a", 2, 1), ("b", 5, 1)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
