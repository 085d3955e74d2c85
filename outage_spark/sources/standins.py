"""The library's tables derived from the given star-schema, document and chat tables.

Each function reads whole tables; nothing is filtered or sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outage_spark.schemas import EVENTS, TURNS

# The given tables. A fixed schema spares a job per read that would look into file footers.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": EVENTS,
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": TURNS,
}
TABLES = tuple(SCHEMAS)
FIRST_POSTCODE = 2440
FIRST_DAY = "1995-01-01"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _postcode(number: Column) -> Column:
    return number.cast("string")


def postcodes(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    return nation.select(
        _postcode(F.col("n_nationkey") + FIRST_POSTCODE).alias("postcode"), F.col("n_name").alias("suburb")
    )


def planned(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    start = F.timestamp_add("HOUR", (F.col("o_orderkey") % 24).cast("int"), F.col("o_orderdate"))
    end = F.timestamp_add("HOUR", (1 + F.col("o_orderkey") % 12).cast("int"), F.col("start_ts"))
    return joined.withColumn("start_ts", start).select(
        F.col("o_orderkey").alias("outage_id"),
        _postcode(F.col("c_nationkey") + FIRST_POSTCODE).alias("postcode"),
        "start_ts",
        end.alias("end_ts"),
        F.col("o_orderpriority").alias("reason"),
    )


def history(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        _postcode(F.col("user_id") % 25 + FIRST_POSTCODE).alias("postcode"),
        F.col("event_type").alias("condition"),
        F.col("value").cast("decimal(12,2)").alias("hours"),
        F.col("ts").alias("start_ts"),
    )


def requests_from_events(events: DataFrame) -> DataFrame:
    """Asked ranges of 1 to 7 days; 8 of 33 postcodes are not in the dimension."""
    start = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("event_id") % 2400).cast("int"))
    return events.select(
        F.col("event_id").alias("request_id"),
        _postcode(F.col("user_id") % 33 + FIRST_POSTCODE - 4).alias("postcode"),
        start.alias("start_date"),
        F.date_add(start, (F.col("event_id") % 7).cast("int")).alias("end_date"),
        F.col("ts").alias("asked_at"),
        F.when(F.col("event_id") % 7 == 0, "unknown").otherwise(F.col("event_type")).alias("condition"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return requests_from_events(table(spark, folder, "events"))


def observations(spark: SparkSession, folder: str) -> DataFrame:
    return observations_from_events(table(spark, folder, "events"))


def observations_from_events(events: DataFrame) -> DataFrame:
    """Weather seen at every event: text from the event type, temperature from its value."""
    text = F.element_at(
        F.create_map(
            *[
                F.lit(v)
                for pair in (
                    ("view", "Light rain"),
                    ("error", "Thunderstorm"),
                    ("click", "Clear sky"),
                    ("signup", "Few clouds"),
                    ("purchase", "Showers with thunder"),
                )
                for v in pair
            ]
        ),
        F.col("event_type"),
    )
    return events.select(
        _postcode(F.col("user_id") % 25 + FIRST_POSTCODE).alias("postcode"),
        F.col("ts").alias("observed_at"),
        text.alias("condition_text"),
        F.col("value").alias("temp_c"),
    )


def staff(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    return nation.select(
        _postcode(F.col("n_nationkey") + FIRST_POSTCODE).alias("postcode"),
        (3 + F.col("n_nationkey") % 13).cast("int").alias("staff"),
    )


def register_views(spark: SparkSession, folder: str) -> None:
    """Temp views for SQL use: the given tables and the derived ones."""
    for name in TABLES:
        table(spark, folder, name).createOrReplaceTempView(name)
    derived = {
        "postcodes": postcodes,
        "planned": planned,
        "history": history,
        "requests": requests,
        "weather": observations,
    }
    for name, make in derived.items():
        make(spark, folder).createOrReplaceTempView(name)
