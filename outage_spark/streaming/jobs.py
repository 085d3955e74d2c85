"""Structured Streaming jobs. Each result equals its batch operator on the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from outage_spark import schemas
from outage_spark.functions.scalars import basename
from outage_spark.functions.text import separator_chunks
from outage_spark.operators.conversation import clean_turns
from outage_spark.operators.ingest import chunk_ids, explode_chunks
from outage_spark.operators.spread import OrderedRows, checkpoint_folder, lookup_join, settle, top_per_key
from outage_spark.operators.weather import OBSERVATION, weather_asof
from outage_spark.plans.triage import outage_status

# Ingest


def new_files(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of files with their base name and content; the query checkpoint remembers those done."""
    files = spark.readStream.schema(schemas.BINARY_FILE).format("binaryFile").load(folder)
    return files.select(basename("path").alias("file_name"), "content")


def file_chunks(files: DataFrame) -> DataFrame:
    """Chunks of UTF-8 text files, with the same id on every run."""
    docs = files.select(F.xxhash64("file_name").alias("doc_id"), F.col("content").cast("string").alias("text"))
    return chunk_ids(explode_chunks(docs, separator_chunks("text"), ["doc_id"]))


def earlier_ids(spark: SparkSession, target: str, batch_id: int, buckets: Sequence[int]) -> DataFrame:
    """Chunk ids that batches before ``batch_id`` wrote, of the given buckets only; other folders are not opened."""
    stored = spark.read.schema("chunk_id bigint, batch_id bigint, bucket int").parquet(target)
    return stored.where((F.col("batch_id") < batch_id) & F.col("bucket").isin(list(buckets))).select("bucket", "chunk_id")


def upsert_chunks(target: str, buckets: int = 64):
    """``foreachBatch`` writer that adds each chunk id to the parquet table at ``target`` once.

    A batch owns the folder ``batch_id=N`` and overwrites it, so a replayed batch replaces its own
    rows; ids that earlier batches wrote are left out. Ids are hashes and lie in folders by ``bucket``, so a
    batch reads the ids of its own buckets only: one of a few files does not look at all that was ever written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.col("chunk_id"), F.lit(buckets)).cast("int")
        fresh = settle(batch.dropDuplicates(["chunk_id"]).withColumn("bucket", bucket))
        if batch_id > 0:
            own = [row.bucket for row in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            earlier = earlier_ids(batch.sparkSession, target, batch_id, own)
            fresh = fresh.join(earlier, ["bucket", "chunk_id"], "left_anti")
        # An empty batch still leaves its folder, with the schema.
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch_id={batch_id}")

    return write


def ingest_stream(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Chunk the files that came since the last run and append them once."""
    writer = file_chunks(new_files(spark, folder)).writeStream.foreachBatch(upsert_chunks(target))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_stream(stream: DataFrame, keys, event_time: str, delay: str) -> DataFrame:
    """Drop re-sent rows that arrive within ``delay`` of the first."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


# Aggregates


def running_hours(history: DataFrame) -> DataFrame:
    """Running rows, sum and count of hours per (postcode, condition), for update mode."""
    return history.groupBy("postcode", "condition").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("hours").alias("hours_sum"),
        F.count("hours").alias("hours_n"),
    )


def windowed_counts(
    stream: DataFrame, ts: str, size: str, slide: str | None = None, delay: str = "1 hour", keys=()
) -> DataFrame:
    """Counts per tumbling or sliding window; rows later than ``delay`` are dropped."""
    timed = stream.withColumn(ts, zoned(ts)).withWatermark(ts, delay)
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    counted = timed.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(_ntz("w.start").alias("window_start"), _ntz("w.end").alias("window_end"), *keys, "n")


def session_counts(stream: DataFrame, ts: str, gap: str, delay: str = "1 hour", keys=()) -> DataFrame:
    """Counts per session of rows that are less than ``gap`` apart."""
    timed = stream.withColumn(ts, zoned(ts)).withWatermark(ts, delay)
    counted = timed.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(_ntz("w.start").alias("window_start"), _ntz("w.end").alias("window_end"), *keys, "n")


# Watermarks need a zoned time column. Times are read as UTC whatever the session zone, so that
# window borders fall on the hours and days of the data.
EPOCH = "1970-01-01 00:00:00"


def zoned(name: str) -> Column:
    """A time without zone as one in UTC."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col(name)))


def _ntz(name: str) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(name), F.lit(EPOCH).cast("timestamp_ntz"))


# Joins


def triage_stream(requests: DataFrame, tables: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], home: str) -> StreamingQuery:
    """Status of each arriving request, written to ``home``/out.

    ``tables`` gives (postcodes, planned, history) and is called for every batch, so outages that were
    published after the start of the stream are seen.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        outage_status(settle(batch), *tables()).write.mode("overwrite").parquet(f"{home}/out/batch_id={batch_id}")

    return each_batch(requests, answer, home)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], home: str) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{home}/state")
    return writer.trigger(availableNow=True).start()


def _log(rows: DataFrame, home: str, name: str, batch_id: int) -> DataFrame:
    """Add a batch to a log, in a folder of its own that a replay overwrites, and read the log up to it."""
    rows.write.mode("overwrite").parquet(f"{home}/{name}/batch_id={batch_id}")
    stored = rows.sparkSession.read.schema(f"{_ddl(rows)}, batch_id bigint").parquet(f"{home}/{name}")
    return stored.where(F.col("batch_id") <= batch_id)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def weather_stream(requests: DataFrame, observations: DataFrame, home: str, tolerance: str | None = None) -> StreamingQuery:
    """Weather as of each request, written to ``home``/out; the latest answer to a request counts.

    Both streams advance in one query and are logged by batch. A batch answers its own requests from all
    observations so far, and answers earlier requests again where one of its observations lies before
    them, so the end result is that of ``weather_asof`` in whatever order rows arrive. A stream-stream
    join would pair every request with every observation in reach; here each row is sorted once per
    batch that concerns it. ``request_id`` identifies a request.
    """
    asked = requests.select("postcode", F.struct(*requests.columns).alias("asked"))
    seen = observations.select("postcode", F.struct("postcode", *OBSERVATION).alias("seen"))
    asked_columns = requests.columns

    def answer(batch: DataFrame, batch_id: int) -> None:
        arrived = settle(batch)
        now = arrived.where("asked IS NOT NULL").select("asked.*").select(*asked_columns)
        fresh = arrived.where("seen IS NOT NULL").select("seen.*")
        known = _log(fresh, home, "seen", batch_id)
        past = _log(now, home, "asked", batch_id)
        since = fresh.groupBy("postcode").agg(F.min("observed_at").alias("_since"))
        again = lookup_join(past.where(F.col("batch_id") < batch_id), since, ["postcode"], "inner")
        due = settle(now.unionByName(again.where(F.col("asked_at") >= F.col("_since")).select(*asked_columns)))
        places = due.select("postcode").distinct()
        reach = lookup_join(known.drop("batch_id"), places, ["postcode"], "inner")
        weather_asof(due, reach, tolerance).write.mode("overwrite").parquet(f"{home}/out/batch_id={batch_id}")

    return each_batch(asked.unionByName(seen, allowMissingColumns=True), answer, home)


# Conversation state


def conversation_context(stream: DataFrame, home: str, clear: str = "clear") -> StreamingQuery:
    """Context of every turn as turns arrive, written to ``home``/out; the latest row of a turn counts.

    The log keeps number, role and length of each turn, not its text. A batch writes the contexts of all
    turns of the chats it concerns, so the end result is that of ``context_turns`` in whatever order and
    batches turns arrive. A turn with role ``clear`` starts the context anew and has no row.
    """

    def update(batch: DataFrame, batch_id: int) -> None:
        turns = clean_turns(batch).select("conv_id", "turn", "role", F.coalesce(F.length("text") + 1, F.lit(0)).alias("_chars"))
        arrived = settle(turns)
        known = _log(arrived, home, "turns", batch_id).drop("batch_id")
        concerned = lookup_join(known, arrived.select("conv_id").distinct(), ["conv_id"], "inner")
        cleared = concerned.withColumn("_clear", (F.col("role") == clear).cast("int"))
        parts = OrderedRows(cleared, ["conv_id"], ["turn"]).with_sum_before("_clear", "_part").rows
        parts = parts.where(F.col("_clear") == 0)
        rows = OrderedRows(parts, ["conv_id", "_part"], ["turn"]).with_number("_no").with_sum_before("_chars", "_before").rows
        out = rows.select(
            "conv_id", "turn", (F.col("_no") - 1).alias("context_turns"), F.greatest(F.col("_before") - 1, F.lit(0)).alias("context_chars")
        )
        out.write.mode("overwrite").parquet(f"{home}/out/batch_id={batch_id}")

    return each_batch(stream, update, home)


def read_out(spark: SparkSession, home: str, schema: str) -> DataFrame:
    """What a query wrote to ``home``/out, with ``batch_id``."""
    return spark.read.schema(f"{schema}, batch_id bigint").parquet(f"{home}/out")


# Bounded runs


def scratch_home(spark: SparkSession) -> str:
    """A new folder for one run in the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


def write_batches(stream: DataFrame, home: str, mode: str = "append") -> StreamingQuery:
    """Write what a query gives to ``home``/out, one folder per batch, over all rows there are now."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/out/batch_id={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{home}/state")
    return writer.trigger(availableNow=True).start()


def run_to_end(stream: DataFrame, mode: str = "append", home: str | None = None) -> DataFrame:
    """Run a query over all rows there are now and read its output back, with ``batch_id``.

    Output goes to files in the shared checkpoint folder, one folder per batch that a replay
    overwrites. In update and complete mode a key can come out of several batches; the last one counts.
    """
    spark = stream.sparkSession
    home = home or scratch_home(spark)
    write_batches(stream, home, mode).awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(f"{home}/out")


def run_windows(stream: DataFrame, keys: Sequence[str] = (), sessions: bool = False) -> DataFrame:
    """Run windowed or session counts to the end and return every window, the open ones as they stand.

    Windows come out in update mode. Sessions can only be appended once they are over, or given whole
    after every batch; a run that ends takes the whole of its last batch.
    """
    if not sessions:
        return latest_rows(run_to_end(stream, "update"), ["window_start", "window_end", *keys])
    out = run_to_end(stream, "complete")
    last = out.agg(F.max("batch_id").alias("_last"))  # one row
    return out.join(F.broadcast(last), F.col("batch_id") == F.col("_last")).drop("batch_id", "_last")


def latest_rows(updates: DataFrame, keys) -> DataFrame:
    """Last output per key of an update-mode run."""
    rest = [c for c in updates.columns if c not in (*keys, "batch_id")]
    last = top_per_key(updates, keys, [F.desc("batch_id")], 1, "_rank")
    return last.select(*keys, *rest)
