"""Named queries: each runs one operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outage_spark import schemas
from outage_spark.functions import scalars, text
from outage_spark.functions.registry import register_functions
from outage_spark.functions.weather import classify_weather
from outage_spark.operators import (
    conversation,
    estimate,
    generate,
    hashed,
    identity,
    index_store,
    ingest,
    lookup,
    planned,
    retrieval,
    spread,
    weather,
)
from outage_spark.plans import triage
from outage_spark.sources import standins
from outage_spark.sources.readers import split_errors
from outage_spark.streaming import jobs, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NEXT_FROM = "1998-01-01 00:00:00"
GEN_FROM, GEN_UNTIL = "2024-10-25 00:00:00", "2024-12-31"
PHRASES = {
    "view": "today",
    "error": "tomorrow",
    "click": "next week",
    "signup": "this month",
    "purchase": "next month",
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _chat(spark: SparkSession, d: str) -> DataFrame:
    return standins.table(spark, d, "conversations")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return standins.table(spark, d, "documents").select("doc_id", "text")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return standins.table(spark, d, "events")


# Sources and sinks


@query
def url_basename(spark, d):
    return standins.table(spark, d, "pages").select("page_id", scalars.basename("url").alias("file_name"))


@query
def html_text(spark, d):
    return standins.table(spark, d, "pages").select("page_id", text.html_text("html").alias("text"))


@query
def table_diff(spark, d):
    docs, labels = standins.table(spark, d, "documents"), standins.table(spark, d, "labels")
    known = docs.join(labels, "doc_id")
    old = known.select("doc_id", "lang", (F.col("n_chars") + F.col("quality")).alias("n_chars"))
    gone = labels.where("toxic = 1").select("doc_id")
    new = docs.join(gone, "doc_id", "left_anti").select("doc_id", "lang", "n_chars")
    return ingest.table_diff(old, new, ["doc_id"])


# Filters and predicates


@query
def parse_ts(spark, d):
    orders = standins.table(spark, d, "orders")
    written = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(
        F.date_format("o_orderdate", scalars.TIMESTAMP_FORMAT)
    )
    return orders.select("o_orderkey", scalars.parse_ts(written).alias("parsed"))


@query
def planned_literal(spark, d):
    return planned.planned_counts(standins.requests(spark, d), standins.planned(spark, d), "reference").select(
        "request_id", "postcode", "start_date", "end_date", "n_outages"
    )


@query
def planned_numbered(spark, d):
    return planned.planned_numbered(standins.planned(spark, d))


@query
def planned_overlap(spark, d):
    return planned.planned_counts(standins.requests(spark, d), standins.planned(spark, d)).select(
        "request_id", "postcode", "start_date", "end_date", "n_outages"
    )


@query
def condition_isin(spark, d):
    rows = _events(spark, d).select("event_id", F.col("event_type").alias("condition"), "value")
    return lookup.in_conditions(rows, ["view", "error"])


@query
def postcode_valid(spark, d):
    # Order keys stand in for typed postcodes: those below 1000 or above 9999 have the wrong length.
    typed = standins.table(spark, d, "orders").select(
        "o_orderkey", scalars.normalise_postcode("o_orderkey").alias("postcode")
    )
    return typed.withColumn("valid", scalars.valid_postcode("postcode").cast("int"))


@query
def classify_events(spark, d):
    seen = standins.observations(spark, d)
    return seen.withColumn("condition", classify_weather("condition_text", "temp_c"))


@query
def quarantine(spark, d):
    pages = standins.table(spark, d, "pages")
    raw = pages.select("page_id", F.regexp_extract("url", "[?&]page=([^&#]*)", 1).alias("page_text"))
    page_no = F.expr("try_cast(page_text AS INT)")
    checked = raw.select("page_id", page_no.alias("page_no"), F.when(page_no.isNull(), "page: not a number").alias("error"))
    good, bad = split_errors(checked)
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad)


@query
def clean_turns(spark, d):
    damaged = _chat(spark, d).withColumn("role", F.nullif("role", F.lit("system")))
    return conversation.clean_turns(damaged).select("conv_id", "turn", "role")


# Joins


@query
def outages_with_suburb(spark, d):
    return lookup.with_suburb(standins.planned(spark, d), standins.postcodes(spark, d)).select(
        "outage_id", "postcode", "start_ts", "end_ts", "reason", "suburb"
    )


@query
def new_files(spark, d):
    names = standins.table(spark, d, "pages").select("page_id", scalars.basename("url").alias("file_name"))
    done = standins.table(spark, d, "labels").select(F.col("doc_id").alias("page_id"))
    track = names.join(done, "page_id", "left_semi").select("file_name").distinct()
    return ingest.append_new(names.select("file_name"), track, ["file_name"])


@query
def suburb_lookup(spark, d):
    return lookup.suburb_for(standins.requests(spark, d), standins.postcodes(spark, d)).select(
        "request_id", "postcode", "suburb"
    )


@query
def unprocessed_docs(spark, d):
    files = standins.table(spark, d, "documents").select("doc_id", "lang", "source")
    return ingest.unprocessed(files, standins.table(spark, d, "labels"), ["doc_id"])


@query
def planned_for_requests(spark, d):
    return planned.planned_for(standins.requests(spark, d), standins.planned(spark, d)).select(
        "request_id", "postcode", "start_date", "end_date", "n_outages", "first_start", "last_end", "mean_hours"
    )


@query
def planned_matches(spark, d):
    return planned.planned_matches(standins.requests(spark, d), standins.planned(spark, d))


@query
def triage_planned(spark, d):
    hit = triage.triage_planned(standins.requests(spark, d), standins.planned(spark, d))
    return hit.select("request_id", "postcode", "start_date")


@query
def triage_unplanned(spark, d):
    missed = triage.triage_unplanned(standins.requests(spark, d), standins.planned(spark, d))
    return missed.select("request_id", "postcode", "start_date")


@query
def weather_asof(spark, d):
    return weather.weather_asof(_asked(spark, d), standins.observations(spark, d))


def _asked(spark, d):
    return standins.requests(spark, d).select("request_id", "postcode", "asked_at")


@query
def vector_topk(spark, d):
    vectors = standins.table(spark, d, "embeddings")
    return retrieval.similar(vectors, vectors, 4)


@query
def vector_topk_index(spark, d):
    vectors = standins.table(spark, d, "embeddings")
    return retrieval.search_index(retrieval.build_index(vectors), vectors, 4)


@query
def index_after_changes(spark, d):
    """An index that lost a third of its ids, was compacted, and then got new and corrected vectors."""
    vectors = standins.table(spark, d, "embeddings").select("vec_id", "embedding")
    wrong = F.when(F.col("vec_id") % 7 == 0, F.reverse("embedding")).otherwise(F.col("embedding"))
    old = vectors.withColumn("embedding", wrong).where("vec_id % 5 <> 0")
    fewer, now = old.where("vec_id % 3 <> 0"), vectors.where("vec_id % 3 <> 0")
    home = jobs.scratch_home(spark)
    index_store.create_index(old, home)
    index_store.apply_changes(home, ingest.table_diff(old, fewer, ["vec_id"]), 0)
    index_store.compact(spark, home)
    index_store.apply_changes(home, ingest.table_diff(fewer, now, ["vec_id"]), 1)
    return retrieval.search_index(index_store.read_index(spark, home), now, 4)


@query
def vector_join_hashed(spark, d):
    vectors = standins.table(spark, d, "embeddings")
    return hashed.similar_hashed(vectors, vectors, 4)


@query
def retrieved_texts(spark, d):
    texts = _docs(spark, d).withColumnRenamed("doc_id", "vec_id")
    vectors = standins.table(spark, d, "embeddings").select("vec_id", "embedding")
    found = retrieval.retrieve(vectors, vectors, 4, texts)
    return found.select("question_id", "vec_id", "score", "rank", F.length("text").alias("text_chars"))


@query
def planned_conflicts(spark, d):
    return planned.planned_conflicts(standins.planned(spark, d))


# Aggregates


@query
def overall_avg_hours(spark, d):
    return estimate.overall_hours(standins.history(spark, d))


@query
def hours_by_area_condition(spark, d):
    return estimate.hours_by(standins.history(spark, d))


@query
def estimate_duration(spark, d):
    return estimate.estimate_duration(standins.requests(spark, d), standins.history(spark, d)).select(
        "request_id", "postcode", "condition", "est_hours"
    )


@query
def hours_grouping_sets(spark, d):
    return estimate.hours_levels(standins.history(spark, d))


@query
def distinct_sources(spark, d):
    return standins.table(spark, d, "documents").select("source").distinct()


@query
def concat_turns(spark, d):
    return conversation.transcript(_chat(spark, d))


@query
def planned_summary(spark, d):
    return planned.planned_summary(standins.requests(spark, d), standins.planned(spark, d))


@query
def pending_conversations(spark, d):
    return conversation.pending_turns(_chat(spark, d))


@query
def pending_context(spark, d):
    return conversation.pending_context(_chat(spark, d))


@query
def planned_rollup(spark, d):
    return planned.planned_rollup(standins.planned(spark, d))


# Windows, sort, set operations


@query
def first_per_key(spark, d):
    docs = standins.table(spark, d, "documents").select("source", "doc_id", "lang", "n_chars")
    return spread.first_per_key(docs, ["source"], ["doc_id"])


@query
def question_answer_pairs(spark, d):
    return conversation.question_answer_pairs(_chat(spark, d))


@query
def context_turns(spark, d):
    return conversation.context_turns(_chat(spark, d))


@query
def surrogate_id(spark, d):
    chunks = ingest.chunk_fixed(_docs(spark, d)).select("doc_id", "chunk_no")
    return spread.assign_ids(chunks, ["doc_id", "chunk_no"])


@query
def surrogate_id_appends(spark, d):
    """Chunk ids that go on over three appends, the second of them sent twice."""
    home = jobs.scratch_home(spark)
    identity.create_numbered(spark, home)
    for batch in (0, 1, 1, 2):
        docs = _docs(spark, d).where(F.col("doc_id") % 3 == batch)
        identity.append_numbered(ingest.chunk_fixed(docs).select("doc_id", "chunk_no"), ["doc_id", "chunk_no"], home, batch)
    return identity.read_numbered(spark, home, "doc_id bigint, chunk_no int, id bigint")


@query
def top_k_global(spark, d):
    return spread.top_k(_events(spark, d).select("event_id", "value"), [F.desc("value"), F.asc("event_id")], 10)


@query
def next_planned(spark, d):
    return planned.next_planned(standins.planned(spark, d), NEXT_FROM)


@query
def append_answers(spark, d):
    chat = _chat(spark, d)
    answers = conversation.pending_turns(chat).select("conv_id", F.concat(F.lit("Re: "), "text").alias("text"))
    return conversation.append_answers(chat, answers)


# Scalar functions


@query
def time_features(spark, d):
    return scalars.time_features(_events(spark, d).select("event_id", "ts"), "ts")


@query
def end_from_hours(spark, d):
    return _events(spark, d).select("event_id", scalars.end_from_hours("ts", "value").alias("end_ts"))


@query
def day_diff(spark, d):
    return _events(spark, d).select(
        "event_id", scalars.day_diff(F.to_date("ts"), F.lit(standins.FIRST_DAY).cast("date")).alias("days")
    )


@query
def clamp_hours(spark, d):
    return _events(spark, d).select("event_id", scalars.clamp("value", 0.0, 24.0).alias("hours"))


@query
def staff_adjusted(spark, d):
    hours = scalars.clamp(scalars.staff_adjusted("value", F.lit(3) + F.col("user_id") % 13), 0.0, 24.0)
    return _events(spark, d).select("event_id", F.round(hours, 6).alias("hours"))


@query
def staff_lookup(spark, d):
    asked = standins.requests(spark, d).select("request_id", "postcode")
    return lookup.staff_lookup(asked, standins.staff(spark, d))


@query
def relative_range(spark, d):
    phrase = F.element_at(
        F.create_map(*[F.lit(v) for pair in PHRASES.items() for v in pair]), F.col("event_type")
    )
    ranges = _events(spark, d).select("event_id", scalars.relative_range("ts", phrase).alias("r"))
    return ranges.select("event_id", "r.start_date", "r.end_date")


@query
def sql_chunk_rows(spark, d):
    register_functions(spark)
    _docs(spark, d).createOrReplaceTempView("chunked_docs")
    return spark.sql("SELECT doc_id, c.* FROM chunked_docs, LATERAL chunk_rows(text, 1000, 200) c")


@query
def events_as_of(spark, d):
    return _events(spark, d).select("event_id", scalars.as_of("ts").alias("as_of"))


@query
def chunk_fixed(spark, d):
    return ingest.chunk_fixed(_docs(spark, d))


@query
def chunk_separators(spark, d):
    return ingest.chunk_separators(_docs(spark, d))


# Retrieval


@query
def text_vectors(spark, d):
    """Of every document vector: slots in use, length (0 without a word that counts), and a sum over its components."""
    encoded = retrieval.embed_words(_docs(spark, d))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    placed = F.aggregate(F.arrays_zip("embedding", F.sequence(F.lit(1), F.size("embedding")).alias("at")), F.lit(0.0), lambda a, x: a + x["embedding"].cast("double") * x["at"])
    used = F.size(F.filter("embedding", lambda v: v != 0)).cast("bigint")
    return encoded.select("doc_id", used.alias("n_used"), F.round(squares, 4).alias("weight"), F.round(placed, 3).alias("checksum"))


@query
def ann_recall(spark, d):
    vectors = standins.table(spark, d, "embeddings")
    quick = retrieval.search_index(retrieval.build_index(vectors), vectors, 4, n_probe=4, exact=False)
    return retrieval.ann_recall(retrieval.similar(vectors, vectors, 4), quick)


@query
def rag_context(spark, d):
    vectors, docs = standins.table(spark, d, "embeddings"), _docs(spark, d)
    texts = docs.withColumnRenamed("doc_id", "vec_id")
    asked = vectors.select(F.col("vec_id").alias("question_id")).join(
        docs.select(F.col("doc_id").alias("question_id"), F.col("text").alias("question")), "question_id"
    )
    return retrieval.assemble_context(retrieval.similar(vectors, vectors, 4), texts, asked)


@query
def precision_at_k(spark, d):
    vectors = standins.table(spark, d, "embeddings")
    return retrieval.label_precision_at_k(retrieval.similar(vectors, vectors, 4), vectors)


@query
def in_scope(spark, d):
    vectors = standins.table(spark, d, "embeddings")
    hits = retrieval.similar(vectors, vectors, 4).where("question_id <> vec_id")
    scope = retrieval.in_scope(hits, 0.5)
    return scope.withColumn("in_scope", F.col("in_scope").cast("int"))


@query
def ingest_delta(spark, d):
    return ingest.ingest_delta(_docs(spark, d), standins.table(spark, d, "labels"))


# Decision flow and generators


@query
def outage_status(spark, d):
    return triage.outage_status(
        standins.requests(spark, d),
        standins.postcodes(spark, d),
        standins.planned(spark, d),
        standins.history(spark, d),
    )


@query
def outage_status_weather(spark, d):
    """The condition comes from the weather at the time of asking; the history is classified the same way."""
    seen = standins.observations(spark, d)
    history = seen.select(
        "postcode",
        classify_weather("condition_text", "temp_c").alias("condition"),
        F.col("temp_c").cast("decimal(12,2)").alias("hours"),
    )
    return triage.outage_status(
        standins.requests(spark, d), standins.postcodes(spark, d), standins.planned(spark, d), history, seen
    )


def _row_ids(spark, d):
    return _events(spark, d).select(F.col("event_id").alias("row_id"))


@query
def gen_history_rows(spark, d):
    rows = generate.gen_history(_row_ids(spark, d), standins.postcodes(spark, d), 2)
    return rows.withColumn("hours", F.round("hours", 6))


@query
def gen_history_rows_calendar(spark, d):
    rows = generate.gen_history(_row_ids(spark, d), standins.postcodes(spark, d), 1)
    return rows.withColumn("hours", F.round("hours", 6))


@query
def gen_planned_rows(spark, d):
    return generate.gen_planned(_row_ids(spark, d), standins.postcodes(spark, d), GEN_FROM, GEN_UNTIL)


# Streams, run to their end


def _stream(spark, d, name, schema):
    # A glob, because a file stream takes a folder or a pattern but not one file.
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parquet*")


def _event_stream(spark, d):
    return _stream(spark, d, "events", schemas.EVENTS)


@query
def stream_running_hours(spark, d):
    history = _event_stream(spark, d).select(
        (F.col("user_id") % 25 + standins.FIRST_POSTCODE).cast("string").alias("postcode"),
        F.col("event_type").alias("condition"),
        F.col("value").cast("decimal(12,2)").alias("hours"),
    )
    updates = jobs.run_to_end(jobs.running_hours(history), "update")
    last = jobs.latest_rows(updates, ["postcode", "condition"])
    mean = F.col("hours_sum").cast("double") / F.col("hours_n")
    return last.select("postcode", "condition", "n", mean.alias("mean_hours"))


@query
def stream_outage_status(spark, d):
    asked = standins.requests_from_events(_event_stream(spark, d))
    home = jobs.scratch_home(spark)
    tables = lambda: (standins.postcodes(spark, d), standins.planned(spark, d), standins.history(spark, d))
    jobs.triage_stream(asked, tables, home).awaitTermination()
    return spark.read.parquet(f"{home}/out").drop("batch_id")


@query
def stream_windowed_counts(spark, d):
    counted = jobs.windowed_counts(_event_stream(spark, d), "ts", "1 day", keys=["event_type"])
    return jobs.run_windows(counted, ["event_type"])


@query
def stream_sliding_counts(spark, d):
    counted = jobs.windowed_counts(_event_stream(spark, d), "ts", "6 hours", "3 hours")
    return jobs.run_windows(counted)


@query
def stream_session_counts(spark, d):
    home = jobs.scratch_home(spark)
    stateful.session_stream(_event_parts(spark, d), "ts", "30 minutes", home, keys=["user_id"]).awaitTermination()
    return stateful.read_sessions(spark, home, "user_id bigint")


def _event_parts(spark, d, parts: int = 4, end: bool = False):
    """All events as a stream of several batches in order of time.

    ``end`` adds two events far later, of no real user and without id: a watermark counts from the batch after the
    one that moved it, so the batch of the second completes all that came before the first.
    """
    folder, events = f"{jobs.scratch_home(spark)}/events", _events(spark, d)
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    borders = [first + (last - first) * i / parts for i in range(1, parts)] if first else []
    part = sum((F.coalesce(F.col("ts") >= F.lit(b).cast("timestamp_ntz"), F.lit(False)).cast("int") for b in borders), F.lit(0))
    for n in range(len(borders) + 1):
        events.where(part == n).coalesce(1).write.mode("append").parquet(folder)
    for days in (400, 800) if end else ():
        late = events.agg((F.max("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("ts"))
        given = {"ts": F.col("ts"), "user_id": F.lit(-1)}
        late.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]).write.mode("append").parquet(folder)
    return spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


@query
def stream_weather_interval(spark, d):
    """Weather up to two hours old, from two streams whose state goes with the watermark."""
    events = _event_parts(spark, d, end=True)
    asked = standins.requests_from_events(events).select("request_id", "postcode", "asked_at")
    seen = standins.observations_from_events(events)
    home = jobs.scratch_home(spark)
    stateful.weather_interval_stream(asked, seen, home, "2 hours", "1 hour").awaitTermination()
    return stateful.best_weather(spark, home, asked.columns).where("request_id IS NOT NULL")


@query
def stream_conversation_state(spark, d):
    turns = _stream(spark, d, "conversations", schemas.TURNS)
    updates = jobs.run_to_end(stateful.conversation_state(turns), "update")
    return jobs.latest_rows(updates, ["conv_id", "turn"])


@query
def stream_weather_asof(spark, d):
    asked = standins.requests_from_events(_event_stream(spark, d)).select("request_id", "postcode", "asked_at")
    seen = standins.observations_from_events(_event_stream(spark, d))
    home = jobs.scratch_home(spark)
    jobs.weather_stream(asked, seen, home).awaitTermination()
    return jobs.latest_rows(spark.read.parquet(f"{home}/out"), ["request_id"])


@query
def stream_conversation_context(spark, d):
    turns = _stream(spark, d, "conversations", schemas.TURNS)
    home = jobs.scratch_home(spark)
    jobs.conversation_context(turns, home).awaitTermination()
    return jobs.latest_rows(spark.read.parquet(f"{home}/out"), ["conv_id", "turn"])


@query
def stream_deduped_users(spark, d):
    """Each (user, event type) once per day. Pairs of a day lie less than a day apart, so that delay is enough."""
    stream = _event_parts(spark, d).select(
        "user_id", "event_type", F.to_date("ts").alias("day"), jobs.zoned("ts").alias("ts")
    )
    kept = jobs.dedupe_stream(stream, ["user_id", "event_type", "day"], "ts", "1 day")
    return jobs.run_to_end(kept).select("user_id", "event_type", "day")
