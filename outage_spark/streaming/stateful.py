"""Streams that keep only the state they still need.

``weather_interval_stream`` matches two streams in event time and drops both sides once the watermark has passed
them. ``conversation_state`` keeps turns per chat in a keyed store, so a batch touches the chats it has rows of.
``session_stream`` carries open sessions as rows from batch to batch and writes each closed one once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from outage_spark.operators.conversation import clean_turns
from outage_spark.operators.spread import settle
from outage_spark.operators.weather import OBSERVATION
from outage_spark.streaming.jobs import EPOCH, each_batch, zoned

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLOT_ROWS = ["is_ask", "at", "tie", "text"]
CONTEXT = "conv_id bigint, turn bigint, context_turns bigint, context_chars bigint"


def _text_of(df: DataFrame, columns: Sequence[str]) -> Column:
    """The columns as one JSON text from which ``_from_text`` makes the same values again."""
    kinds = {f.name: f.dataType for f in df.schema}
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) if isinstance(kinds[c], T.AtomicType) else F.col(c) for c in columns]))


def _from_text(text: str, fields: Sequence[T.StructField], name: str) -> Column:
    written = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.AtomicType) else f.dataType) for f in fields])
    read = F.from_json(text, written)
    return F.when(F.col(text).isNotNull(), F.struct(*[read[f.name].cast(f.dataType).alias(f.name) for f in fields])).alias(name)


class _Slot(StatefulProcessor):
    """Requests and observations of one postcode and time slot, kept as packed blocks of rows until the slot is over.

    Both sides are sorted and each request takes the last observation before it, so no pair is a row. A batch
    answers the requests that its rows concern; those that never had an answer get one without weather at the end.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("blocks", "packed binary")

    def _held(self) -> list[pd.DataFrame]:
        return [pa.ipc.open_stream(packed).read_pandas() for (packed,) in self.blocks.get()] if self.blocks.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # A key's rows of a batch may come in several calls.
        for fresh in rows:
            held = self._held()
            if not held:
                self.handle.registerTimer((int(key[1]) + 2) * self.seconds * 1000)
            packed = pa.BufferOutputStream()
            table = pa.Table.from_pandas(fresh[SLOT_ROWS], preserve_index=False)
            with pa.ipc.new_stream(packed, table.schema) as writer:
                writer.write_table(table)
            self.blocks.appendValue((packed.getvalue().to_pybytes(),))
            yield _last_before(held, fresh, found=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        self.blocks.clear()
        return iter([_last_before([], pd.concat(held), found=False)] if held else ())

    def close(self) -> None:
        pass


def _last_before(held: list[pd.DataFrame], fresh: pd.DataFrame, found: bool) -> pd.DataFrame:
    """(request, observation) of the requests that ``fresh`` rows answer; with ``found=False`` of those without any."""
    rows = pd.concat([*held, fresh], ignore_index=True)
    new = np.arange(len(rows)) >= len(rows) - len(fresh)
    asks = rows["is_ask"].to_numpy(bool)
    seen = np.flatnonzero(~asks)
    seen = seen[np.lexsort((rows["tie"].to_numpy()[seen], rows["at"].to_numpy()[seen]))]
    asks = np.flatnonzero(asks)
    at = rows["at"].to_numpy()[seen]
    last = np.searchsorted(at, rows["at"].to_numpy()[asks], side="right") - 1
    answered = (last >= 0) & (at[last] >= rows["tie"].to_numpy()[asks]) if len(at) else np.zeros(len(asks), bool)
    which = seen[last[answered]] if len(at) else seen
    text = rows["text"].to_numpy(object)
    if not found:
        return pd.DataFrame({"ask": text[asks[~answered]], "seen": pd.Series([None] * int((~answered).sum()), dtype=object)})
    now = new[asks[answered]] | new[which]
    return pd.DataFrame({"ask": text[asks[answered][now]], "seen": text[which[now]]})


def weather_interval_stream(
    requests: DataFrame, observations: DataFrame, home: str, tolerance: str, delay: str
) -> StreamingQuery:
    """Weather as of each request from observations up to ``tolerance`` old, written to ``home``/out.

    Rows of either stream may come ``delay`` later than later ones. Requests and observations meet by postcode and a
    time slot as long as the tolerance (a request asks its own and the one before), and a slot goes from the state once
    the watermark has passed all its requests; so the state holds about ``delay`` and twice ``tolerance`` of both streams,
    whatever the length of the run. Within a slot both sides are sorted and each request takes the last
    observation before it: work grows with the rows, not with their pairs. A batch writes the best observation so far of
    the requests that it concerns; ``best_weather`` takes the best of all batches, which equals ``weather_asof(...,
    tolerance)``. A request without a fresh observation has its rows, with nulls, once its slots are over; one
    without a time has none. ``request_id`` identifies a request.
    """
    # A slot may not be shorter than the tolerance.
    spark = requests.sparkSession
    # A keyed store is needed; a running session may still have the default one.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    seconds = spark.range(1).select(F.timestamp_diff("SECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.lit(EPOCH).cast("timestamp_ntz") + F.expr(f"INTERVAL {tolerance}"))).first()[0]
    seconds = max(seconds + 1, 1)
    own = F.floor(F.unix_seconds("_at") / F.lit(seconds))
    fields = list(requests.schema)
    weather = [observations.schema[c] for c in OBSERVATION]

    # ``tie`` is the earliest time that still counts for a request, and the order of equal times for an observation.
    asked = requests.withColumn("_at", zoned("asked_at")).withWatermark("_at", delay)
    since = F.unix_micros(F.col("_at") - F.expr(f"INTERVAL {tolerance}"))
    asked = asked.where(F.col("_at").isNotNull()).select(
        "_at", "postcode", F.explode(F.array(own, own - 1)).alias("slot"), F.lit(True).alias("is_ask"),
        F.unix_micros("_at").alias("at"), since.alias("tie"), _text_of(requests, requests.columns).alias("text"),
    )
    seen = observations.withColumn("_at", zoned("observed_at")).withWatermark("_at", delay)
    seen = seen.where(F.col("postcode").isNotNull() & F.col("_at").isNotNull()).select(
        "_at", "postcode", own.alias("slot"), F.lit(False).alias("is_ask"), F.unix_micros("_at").alias("at"),
        F.xxhash64(*OBSERVATION).alias("tie"), _text_of(observations, OBSERVATION).alias("text"),
    )
    met = asked.unionByName(seen).groupBy("postcode", "slot").transformWithStateInPandas(
        statefulProcessor=_Slot(seconds), outputStructType="ask string, seen string", outputMode="Append", timeMode="EventTime"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        read = batch.select(_from_text("ask", fields, "_ask"), _from_text("seen", weather, "_seen"))
        rank = F.when(F.col("_seen").isNotNull(), F.struct(F.col("_seen.observed_at").alias("observed_at"), F.xxhash64(*[f"_seen.{c}" for c in OBSERVATION]).alias("_tie")))
        ranked = read.select("_ask.*", "_seen", rank.alias("_rank"))
        best = ranked.groupBy(*requests.columns).agg(F.max_by("_seen", "_rank").alias("_last"), F.max("_rank").alias("_rank"))
        best.select(*requests.columns, "_last.*", F.col("_rank._tie").alias("_tie")).write.mode("overwrite").parquet(f"{home}/out/batch_id={batch_id}")

    return each_batch(met, write, home)


def best_weather(spark: SparkSession, home: str, columns: Sequence[str]) -> DataFrame:
    """The answers of ``weather_interval_stream`` to requests with the given columns, one per request."""
    found = spark.read.parquet(f"{home}/out")
    best = F.max_by(F.struct(*OBSERVATION), F.struct("observed_at", "_tie")).alias("_last")
    return found.groupBy(*columns).agg(best).select(*columns, "_last.*")


class _Chat(StatefulProcessor):
    """Turns of one chat: what every turn adds, and the totals after the last one."""

    def __init__(self, idle_ms: int | None, forget_cleared: bool):
        self.idle_ms, self.forget_cleared = idle_ms, forget_cleared

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "turn bigint", "cleared boolean, chars bigint")
        self.ends = handle.getValueState("ends", "last bigint, n bigint, chars bigint, since bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values("turn")
        fresh = [(int(t), bool(c), int(n)) for t, c, n in zip(arrived["turn"], arrived["cleared"], arrived["chars"])]
        last, n, chars, since = self.ends.get() if self.ends.exists() else (None, 0, 0, None)
        if self.forget_cleared and since is not None:
            fresh = [row for row in fresh if row[0] >= since]
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if not fresh:
            return iter(())
        for turn, cleared, size in fresh:
            self.turns.updateValue((turn,), (cleared, size))
        if last is None or fresh[0][0] > last:
            walk = sorted({turn: (turn, cleared, size) for turn, cleared, size in fresh}.values())
        else:
            # A turn came late: the chat's own turns are read again, and contexts from it on are given anew.
            walk = sorted((k[0], v[0], v[1]) for k, v in self.turns.iterator())
            n, chars, since = 0, 0, since if self.forget_cleared else None
        out = []
        for turn, cleared, size in walk:
            if cleared:
                n, chars, since = 0, 0, turn
                continue
            if turn >= fresh[0][0]:
                out.append((key[0], turn, n, max(chars - 1, 0)))
            n, chars = n + 1, chars + size
        self.ends.update((walk[-1][0], n, chars, since))
        if self.forget_cleared and since is not None:
            for (turn,) in [k for k in self.turns.keys() if k[0] < since]:
                self.turns.removeKey((turn,))
        return iter([pd.DataFrame(out, columns=["conv_id", "turn", "context_turns", "context_chars"])])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turns.clear()
        self.ends.clear()
        return iter(())

    def close(self) -> None:
        pass


def conversation_state(stream: DataFrame, clear: str = "clear", idle_ms: int | None = None, forget_cleared: bool = False) -> DataFrame:
    """Context of every turn, for update mode; the latest row of a turn counts.

    State is kept per chat in RocksDB: number and length of its turns, not their texts. A turn after the last one
    costs one step; a late one reads its own chat's turns again and gives the contexts that it changes anew. So
    the end result is that of ``context_turns`` in any order. With ``forget_cleared`` a turn with role ``clear``
    deletes the state before it, and turns from before it that come later are left out; with ``idle_ms`` the
    state of a chat goes after so long without a turn.
    """
    # A keyed store is needed; a running session may still have the default one.
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    turns = clean_turns(stream).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        (F.col("role") == clear).alias("cleared"), F.coalesce(F.length("text") + 1, F.lit(0)).cast("bigint").alias("chars"),
    )
    return turns.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=_Chat(idle_ms, forget_cleared), outputStructType=CONTEXT, outputMode="Update",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )


def merge_sessions(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sessions (``start, end, n`` per key) from parts of sessions: parts that touch are one."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    marked = parts.withColumn("_begins", begins)
    # A hot key's rows were made into few parts before they come here.
    numbered = marked.withColumn("_no", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(*keys, "_no").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    return merged.drop("_no")


def session_stream(stream: DataFrame, ts: str, gap: str, home: str, delay: str = "1 hour", keys: Sequence[str] = ()) -> StreamingQuery:
    """Sessions of rows at most ``gap`` apart: closed ones in ``home``/out, each once, open ones in ``home``/open.

    A batch reads the sessions that were open before it and nothing older. The watermark is the latest time of
    the batches before, less ``delay``: rows that would lie in a session over by then are dropped, as windows
    do, and sessions over by then are closed. A batch owns its folders, so a replay replaces them.
    """
    keys = list(keys)
    span = F.expr(f"INTERVAL {gap}")
    state = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema if f.name in keys], "start timestamp_ntz, end timestamp_ntz, n bigint"])
    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = spark.read.schema("latest timestamp_ntz, batch_id bigint").parquet(f"{home}/marks")
        latest = marks.where(F.col("batch_id") < batch_id).agg(F.max("latest")).first()[0]
        rows = settle(batch.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("start"), (F.col(ts) + span).alias("end")))
        over = F.lit(latest).cast("timestamp_ntz") - F.expr(f"INTERVAL {delay}")
        timely = rows if latest is None else rows.where(F.col("end") > over)
        # Rows of a key within half a gap are one part before they are sorted, so a hot key shrinks first.
        half = F.greatest(F.timestamp_diff("MICROSECOND", "start", "end") / 2, F.lit(1))
        slot = F.floor(F.unix_micros(zoned("start")) / half)
        parts = timely.groupBy(*keys, slot.alias("_slot")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))
        open_before = spark.read.schema(f"{state}, batch_id bigint").parquet(f"{home}/open").where(F.col("batch_id") == batch_id - 1)
        merged = settle(merge_sessions(parts.drop("_slot").unionByName(open_before.drop("batch_id")), keys))
        closed = F.lit(False) if latest is None else F.col("end") <= over
        merged.where(closed).write.mode("overwrite").parquet(f"{home}/out/batch_id={batch_id}")
        merged.where(~closed).write.mode("overwrite").parquet(f"{home}/open/batch_id={batch_id}")
        rows.agg(F.max("start").alias("latest")).write.mode("overwrite").parquet(f"{home}/marks/batch_id={batch_id}")

    spark = stream.sparkSession
    spark.createDataFrame([], state).write.mode("overwrite").parquet(f"{home}/open/batch_id=-1")
    spark.createDataFrame([], "latest timestamp_ntz").write.mode("overwrite").parquet(f"{home}/marks/batch_id=-1")
    return each_batch(stream, update, home)


def read_sessions(spark: SparkSession, home: str, schema: str) -> DataFrame:
    """Closed sessions and those that are still open, as they stand; ``schema`` of the keys, if any."""
    fields = ", ".join(x for x in (schema, "start timestamp_ntz, end timestamp_ntz, n bigint, batch_id bigint") if x)
    closed, opened = (spark.read.schema(fields).parquet(f"{home}/{part}") for part in ("out", "open"))
    last = spark.read.schema("latest timestamp_ntz, batch_id bigint").parquet(f"{home}/marks").agg(F.max("batch_id").alias("_last"))
    now = opened.join(F.broadcast(last), F.col("batch_id") == F.col("_last")).drop("_last")  # one row
    return closed.unionByName(now).drop("batch_id").withColumnsRenamed({"start": "window_start", "end": "window_end"})
