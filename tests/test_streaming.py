import random
"""Streams over files: each run takes what came since the last one."""

import pytest
from pyspark.sql import functions as F

from outage_spark import schemas
from outage_spark.functions.text import outage_line
from outage_spark.operators.conversation import context_turns
from outage_spark.operators.estimate import hours_by
from outage_spark.operators.weather import weather_asof
from outage_spark.streaming import jobs, stateful
from tests.conftest import day, ts


class Feed:
    """A folder that a stream reads; every ``add`` is one file and one batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema
        self.files = 0

    def add(self, *rows):
        df = self.spark.createDataFrame(list(rows), self.schema).coalesce(1)
        df.write.mode("append").parquet(self.folder)
        self.files += 1

    def stream(self):
        reader = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1)
        return reader.parquet(self.folder)

    def batch(self):
        return self.spark.read.schema(self.schema).parquet(self.folder)


@pytest.fixture
def feed(spark, tmp_path):
    return lambda name, schema: Feed(spark, tmp_path / name, schema)


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_only_new_files_are_ingested(spark, tmp_path):
    folder, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    folder.mkdir()

    def names():
        return sorted(r.text for r in spark.read.parquet(target).collect())

    (folder / "a.txt").write_text("first file")
    run(jobs.ingest_stream(spark, str(folder), target, checkpoint))
    assert names() == ["first file"]
    (folder / "b.txt").write_text("second file")
    run(jobs.ingest_stream(spark, str(folder), target, checkpoint))
    run(jobs.ingest_stream(spark, str(folder), target, checkpoint))
    assert names() == ["first file", "second file"]


def test_replayed_and_resent_chunks_are_added_once(spark, tmp_path):
    write = jobs.upsert_chunks(str(tmp_path / "chunks"))

    def chunks(*ids):
        return spark.createDataFrame([(i, i, 0, f"t{i}") for i in ids], schemas.CHUNKS)

    write(chunks(1, 2, 2), 0)
    write(chunks(2, 3), 1)
    write(chunks(2, 3), 1)  # replay of batch 1
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    assert sorted(r.chunk_id for r in stored.collect()) == [1, 2, 3]


def test_running_hours_equal_the_batch_mean(feed):
    source = feed("history", "postcode STRING, condition STRING, hours DECIMAL(12,2)")
    from decimal import Decimal as D

    source.add(("2001", "Rain", D("1.00")), ("2001", "Rain", D("2.00")), ("2002", "Rain", None))
    source.add(("2001", "Rain", D("6.00")), ("2002", "Storms", D("5.00")))
    updates = jobs.run_to_end(jobs.running_hours(source.stream()), "update")
    assert updates.select("batch_id").distinct().count() == 2
    got = jobs.latest_rows(updates, ["postcode", "condition"]).select(
        "postcode", "condition", "n", F.try_divide(F.col("hours_sum").cast("double"), F.col("hours_n")).alias("m")
    )
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, hours_by(source.batch()).collect())))


def test_triage_sees_outages_published_later(spark, feed, postcodes, planned, history, tmp_path):
    source = feed("requests", schemas.REQUESTS)
    for i, (p, d) in enumerate([("2001", "2030-03-11"), ("12a4", "2030-03-11"), ("2002", "2030-03-15")]):
        source.add((i, p, day(d), day(d), ts(f"{d} 12:00"), "Rain"))
    home, published = str(tmp_path / "home"), [planned.where("postcode <> '2001'")]

    def status():
        run(jobs.triage_stream(source.stream(), lambda: (postcodes, published[-1], history), home))
        return {r.request_id: r.status for r in spark.read.parquet(f"{home}/out").collect()}

    assert status() == {0: "unplanned", 1: "invalid", 2: "unplanned"}
    published.append(planned)
    source.add((3, "2001", day("2030-03-11"), day("2030-03-11"), ts("2030-03-11 12:00"), "Rain"))
    assert status()[3] == "planned"


def test_windows_drop_late_rows_and_keep_open_ones(feed):
    source = feed("events", "ts TIMESTAMP_NTZ, k STRING")
    source.add((ts("2030-01-01 10:10"), "a"), (ts("2030-01-01 10:50"), "a"))
    source.add((ts("2030-01-01 13:00"), "a"))
    source.add((ts("2030-01-01 13:10"), "a"))  # lateness is judged by the watermark of the batch before
    source.add((ts("2030-01-01 10:20"), "late"), (ts("2030-01-01 12:30"), "b"))
    source.add((ts("2030-01-01 15:00"), "a"))
    counts = jobs.run_windows(jobs.windowed_counts(source.stream(), "ts", "1 hour", delay="1 hour"))
    got = {(r.window_start.hour, r.n) for r in counts.collect()}
    assert got == {(10, 2), (12, 1), (13, 2), (15, 1)}


def test_sessions(feed):
    source = feed("events", "ts TIMESTAMP_NTZ, k STRING")
    source.add(*[(ts(f"2030-01-01 {t}"), "a") for t in ("10:00", "10:20", "11:30")])
    source.add((ts("2030-01-01 20:00"), "b"))
    got = jobs.run_windows(jobs.session_counts(source.stream(), "ts", "30 minutes", keys=["k"]), ["k"], sessions=True).collect()
    assert sorted((str(r.window_start), str(r.window_end), r.n) for r in got) == [
        ("2030-01-01 10:00:00", "2030-01-01 10:50:00", 2),
        ("2030-01-01 11:30:00", "2030-01-01 12:00:00", 1),
        ("2030-01-01 20:00:00", "2030-01-01 20:30:00", 1),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_weather_in_any_order_equals_the_batch(spark, feed, tmp_path, seed):
    rng = random.Random(seed)
    asked = feed("asked", "request_id BIGINT, postcode STRING, asked_at TIMESTAMP_NTZ")
    seen = feed("seen", schemas.WEATHER)
    places = ["2001", "2002", None]
    observed = [(rng.choice(places), ts(f"2030-01-01 {h:02d}:00"), f"w{h}", 20.0) for h in range(24)]
    requests = [(i, rng.choice(places), ts(f"2030-01-01 {rng.randrange(24):02d}:30")) for i in range(20)]
    rng.shuffle(observed)
    home = str(tmp_path / "home")
    for n in range(3):
        seen.add(*observed[n * 8 : n * 8 + 8])
        asked.add(*requests[n * 6 : n * 6 + 6])
        run(jobs.weather_stream(asked.stream(), seen.stream(), home))
    asked.add(*requests[18:])
    run(jobs.weather_stream(asked.stream(), seen.stream(), home))
    got = jobs.latest_rows(spark.read.parquet(f"{home}/out"), ["request_id"])
    want = weather_asof(asked.batch(), seen.batch()).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where("postcode IS NULL AND observed_at IS NOT NULL").count() == 0


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_context_in_any_order_and_batching_equals_the_batch(spark, feed, tmp_path, batches):
    rng = random.Random(batches)
    source = feed("turns", schemas.TURNS)
    turns = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "some text"])) for c in range(4) for t in range(10)]
    rng.shuffle(turns)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    home = str(tmp_path / "home")
    try:
        for n in range(batches):
            source.add(*turns[n::batches])
            run(jobs.conversation_context(source.stream(), home))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = jobs.latest_rows(spark.read.parquet(f"{home}/out"), ["conv_id", "turn"])
    want = context_turns(source.batch()).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_clear_turn_starts_the_context_anew(spark, feed, tmp_path):
    source, home = feed("turns", schemas.TURNS), str(tmp_path / "home")
    source.add((1, 4, "user", "four"), (1, 0, "user", "one"), (2, 0, "user", "other"))
    run(jobs.conversation_context(source.stream(), home))
    source.add((1, 3, "clear", None), (1, 1, "assistant", "two"), (1, 5, "user", "five"))
    run(jobs.conversation_context(source.stream(), home))
    got = jobs.latest_rows(spark.read.parquet(f"{home}/out"), ["conv_id", "turn"])
    rows = {(r.conv_id, r.turn): (r.context_turns, r.context_chars) for r in got.collect()}
    assert rows == {(1, 0): (0, 0), (1, 1): (1, 3), (1, 4): (0, 0), (1, 5): (1, 4), (2, 0): (0, 0)}


def test_resent_rows_are_dropped(feed):
    source = feed("files", "file_name STRING, ts TIMESTAMP")
    source.add(("a", ts("2030-01-01 10:00")), ("a", ts("2030-01-01 10:01")), ("b", ts("2030-01-01 10:00")))
    source.add(("a", ts("2030-01-01 10:02")), ("c", ts("2030-01-01 10:05")))
    kept = jobs.run_to_end(jobs.dedupe_stream(source.stream(), ["file_name"], "ts", "1 hour"))
    assert sorted(r.file_name for r in kept.collect()) == ["a", "b", "c"]


def test_windows_do_not_depend_on_the_session_zone(spark, feed):
    source = feed("events", "ts TIMESTAMP_NTZ, k STRING")
    # 02:30 does not exist on this day in the zone set here.
    source.add((ts("2030-03-10 00:30"), "a"), (ts("2030-03-10 02:30"), "a"), (ts("2030-03-12 00:00"), "a"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = jobs.run_windows(jobs.windowed_counts(source.stream(), "ts", "1 day")).orderBy("window_start").collect()
        start = F.lit("2030-03-10 02:30:00").cast("timestamp_ntz")
        said = spark.range(1).select(outage_line(start, F.lit(None), F.lit("x"))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [tuple(map(str, r)) for r in got] == [
        ("2030-03-10 00:00:00", "2030-03-11 00:00:00", "2"),
        ("2030-03-12 00:00:00", "2030-03-13 00:00:00", "1"),
    ]
    assert said == "2030-03-10 02:30 to further notice: x"


WEATHER_AT = "request_id BIGINT, postcode STRING, asked_at TIMESTAMP_NTZ"


def state_rows(query):
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in map(dict, query.recentProgress) if p["stateOperators"]]


@pytest.mark.parametrize("seed", [1, 2])
def test_weather_in_event_time_equals_the_batch_with_bounded_state(spark, feed, tmp_path, seed):
    import datetime as dt

    rng, base = random.Random(seed), ts("2030-01-01 00:00")
    asked, seen = feed("asked", WEATHER_AT), feed("seen", schemas.WEATHER)
    places = ["2001", "2002", None]
    observed = [(rng.choice(places), base + dt.timedelta(minutes=rng.randrange(60 * 48)), f"w{i}", float(i)) for i in range(200)]
    requests = [(i, rng.choice(places), base + dt.timedelta(minutes=rng.randrange(60 * 48))) for i in range(160)]

    def by_arrival(rows, at):
        """Rows up to an hour late, in sixteen files."""
        rows = sorted(rows, key=lambda r: r[at] + dt.timedelta(minutes=rng.randrange(59)))
        size = -(-len(rows) // 16)
        return [rows[i : i + size] for i in range(0, len(rows), size)]

    for o, q in zip(by_arrival(observed, 1), by_arrival(requests, 2)):
        seen.add(*o)
        asked.add(*q)
    for days in (400, 800):
        # Rows without a postcode are not read at all, so they move no watermark.
        seen.add(("none", base + dt.timedelta(days=days), None, None))
        asked.add((-1, None, base + dt.timedelta(days=days)))
    home = str(tmp_path / "home")
    query = stateful.weather_interval_stream(asked.stream(), seen.stream(), home, "2 hours", "8 hours")
    run(query)
    got = stateful.best_weather(spark, home, ["request_id", "postcode", "asked_at"]).where("request_id >= 0")
    want = weather_asof(asked.batch().where("request_id >= 0"), seen.batch(), "2 hours").select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # Requests are kept twice; of two days about ten to fourteen hours stay at a time.
    rows = state_rows(query)
    assert len(rows) > 10 and max(rows) < 0.6 * (200 + 2 * 160) and rows[-1] < 10


@pytest.mark.parametrize("batches", [1, 4])
def test_chat_state_in_any_order_equals_the_batch(spark, feed, tmp_path, batches):
    rng = random.Random(batches)
    source = feed("turns", schemas.TURNS)
    turns = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "some text"])) for c in range(4) for t in range(10)]
    rng.shuffle(turns)
    home = str(tmp_path / "home")
    for n in range(batches):
        source.add(*turns[n::batches])
        run(jobs.write_batches(stateful.conversation_state(source.stream()), home, "update"))
    got = jobs.latest_rows(jobs.read_out(spark, home, stateful.CONTEXT), ["conv_id", "turn"])
    want = context_turns(source.batch()).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_chat_state_clear_and_forget(spark, feed, tmp_path):
    for forget, late in ((False, (1, 3)), (True, None)):
        source, home = feed(f"turns{forget}", schemas.TURNS), str(tmp_path / f"home{forget}")

        def step(*rows):
            source.add(*rows)
            query = jobs.write_batches(stateful.conversation_state(source.stream(), forget_cleared=forget), home, "update")
            run(query)
            return query

        step((1, 0, "user", "one"), (1, 4, "user", "four"), (2, 0, "user", "other"))
        step((1, 3, "clear", None), (1, 5, "user", "five"))
        query = step((1, 1, "assistant", "two"))  # from before the clear
        got = jobs.latest_rows(jobs.read_out(spark, home, stateful.CONTEXT), ["conv_id", "turn"])
        rows = {(r.conv_id, r.turn): (r.context_turns, r.context_chars) for r in got.collect()}
        assert rows == {(1, 0): (0, 0), (1, 4): (0, 0), (1, 5): (1, 4), (2, 0): (0, 0)} | ({(1, 1): late} if late else {})
        # With forget_cleared the turns before the clear are gone: the clear, 4 and 5 of chat 1, 0 of chat 2.
        assert state_rows(query)[-1] <= (4 + 2 if forget else 6 + 2)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sessions_over_batch_borders(spark, feed, tmp_path, seed):
    import datetime as dt

    rng, base = random.Random(seed), ts("2030-01-01 00:00")
    source, home, gap, delay = feed("events", "ts TIMESTAMP_NTZ, k STRING"), str(tmp_path / "home"), dt.timedelta(minutes=30), dt.timedelta(hours=2)
    rows = [(base + dt.timedelta(minutes=rng.randrange(60 * 24)), rng.choice("ab")) for _ in range(60)]
    rows = sorted(rows, key=lambda r: r[0] + dt.timedelta(minutes=rng.randrange(180)))
    kept, latest = [], None
    for i in range(0, 60, 10):
        part = rows[i : i + 10]
        source.add(*part)
        kept += [r for r in part if latest is None or r[0] + gap > latest - delay]
        latest = max([latest or base, *(r[0] for r in part)])
    query = stateful.session_stream(source.stream(), "ts", "30 minutes", home, "2 hours", ["k"])
    run(query)
    want = []
    for k in "ab":
        for t in sorted(t for t, own in kept if own == k):
            if want and want[-1][0] == k and t <= want[-1][2]:
                want[-1][2:] = [t + gap, want[-1][3] + 1]
            else:
                want.append([k, t, t + gap, 1])
    got = stateful.read_sessions(spark, home, "k STRING").select("k", "window_start", "window_end", "n").collect()
    assert sorted(map(list, got)) == sorted(want)
    opened = {r.batch_id: r["count"] for r in spark.read.parquet(f"{home}/open").groupBy("batch_id").count().collect()}
    assert max(opened.values()) < len(want)  # closed sessions are not carried on


def test_a_batch_opens_only_the_ids_of_its_buckets(spark, tmp_path):
    target = str(tmp_path / "chunks")
    write = jobs.upsert_chunks(target, buckets=8)
    for batch_id in range(3):
        write(spark.createDataFrame([(i, i, 0, f"t{i}") for i in range(batch_id * 10, batch_id * 10 + 15)], schemas.CHUNKS), batch_id)
    stored = sorted(r.chunk_id for r in spark.read.parquet(target).collect())
    assert stored == list(range(35))
    plan = jobs.earlier_ids(spark, target, 2, [3])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "bucket" in text.split("PartitionFilters")[1]
    assert sorted(r.chunk_id for r in plan.collect()) == [3, 11, 19]


def test_rows_of_a_slot_are_sorted_not_paired():
    """Forty thousand rows of one slot in two batches: each request takes the last observation before it."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    n, at = 40_000, rng.integers(0, 5_000, 40_000)
    is_ask = rng.random(n) < 0.5
    rows = pd.DataFrame({"is_ask": is_ask, "at": at, "tie": np.where(is_ask, at - 3, rng.permutation(n)), "text": [str(i) for i in range(n)]})
    rows.loc[~is_ask & (at > 1_000) & (at < 1_100), "at"] = 1_000
    first, second = rows[::2], rows[1::2]
    given = pd.concat([stateful._last_before([], first, True), stateful._last_before([first], second, True)])
    none = stateful._last_before([], rows, False)
    seen = {t: i for t, _, i in sorted(rows.loc[~rows["is_ask"], ["at", "tie", "text"]].itertuples(index=False))}
    want = {}
    for ask in rows[rows["is_ask"]].itertuples():
        near = [t for t in range(ask.at, ask.at - 4, -1) if t in seen]
        want[ask.text] = seen[near[0]] if near else None
    got = dict(zip(given["ask"], given["seen"])) | dict.fromkeys(none["ask"])
    assert got == want and None in want.values()


def test_requests_without_a_time_have_no_row_and_without_a_postcode_no_weather(spark, feed, tmp_path):
    import datetime as dt

    base = ts("2030-01-01 00:00")
    asked, seen = feed("asked", WEATHER_AT), feed("seen", schemas.WEATHER)
    seen.add(("2001", base, "rain", 1.5), ("2001", None, "no time", 2.0), (None, base, "no place", 3.0), ("2001", base - dt.timedelta(microseconds=1), None, None))
    asked.add((1, "2001", base), (2, "2001", None), (3, None, base), (4, "2001", base - dt.timedelta(microseconds=1)), (5, "2001", base + dt.timedelta(hours=3)))
    for days in (400, 800):
        seen.add(("none", base + dt.timedelta(days=days), None, None))
        asked.add((-1, None, base + dt.timedelta(days=days)))
    home = str(tmp_path / "home")
    run(stateful.weather_interval_stream(asked.stream(), seen.stream(), home, "2 hours", "1 hour"))
    got = {r.request_id: r[1:] for r in stateful.best_weather(spark, home, ["request_id", "postcode", "asked_at"]).where("request_id > 0").collect()}
    assert got[1] == ("2001", base, base, "rain", 1.5) and got[3] == (None, base, None, None, None)
    assert got[4][2:] == (base - dt.timedelta(microseconds=1), None, None) and got[5][2:] == (None, None, None)
    assert len(got) == 4
