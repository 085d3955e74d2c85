from pyspark.sql import functions as F

from outage_spark.operators.ingest import append_new, chunk_ids, chunk_separators, ingest_delta, table_diff, unprocessed
from outage_spark.plans.ingest import ingest_batch
from outage_spark.sources import readers, standins
from outage_spark.sources.writers import append, ensure_tables, write_table


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


PLANNED = """Postcode,outage_start_date_time,outage_end_date_time,reason_for_outage,Suburb
2001,2030-01-02 03:04:05.678901,2030-01-02 05:04:05.678901,"Inspection, yearly",Alder
 2002 ,2030-01-03 00:00:00,,Upgrade,
2003,soon,2030-01-02 05:00:00,Upgrade,Birch
2004,2030-01-02 03:00:00
"""


def test_planned_csv(spark, tmp_path):
    path = write(tmp_path / "planned.csv", PLANNED)
    good = readers.read_planned(spark, path).orderBy("postcode").collect()
    assert [(r.postcode, r.reason) for r in good] == [("2001", "Inspection, yearly"), ("2002", "Upgrade")]
    assert good[0].start_ts.microsecond == 678901 and good[1].end_ts is None and good[1].suburb is None
    _, bad = readers.split_errors(readers.planned_with_errors(spark, path))
    errors = {r.postcode: r.error for r in bad.collect()}
    assert errors == {"2003": "outage_start_date_time: not a time", "2004": "malformed line"}


def test_postcodes_csv_stay_text(spark, tmp_path):
    path = write(tmp_path / "postcodes.csv", "Postcode,Suburb\n0801,Alder\n2001,Birch\n")
    assert [r.postcode for r in readers.read_postcodes(spark, path).orderBy("postcode").collect()] == ["0801", "2001"]


HISTORY = """Postcode,Suburb,Weather_Conditions,Field_Staff,Outage_StartTime,Outage_EndTime,Outage_Hours,Day,DOW,Month
2001,Alder,Rain,4,2030-01-02 03:04:00,2030-01-02 05:04:00,2.0,2,Wednesday,January
2001,Alder,Storms,4,2030-01-02 03:04:00,2030-01-02 05:04:00,many,2,Wednesday,January
"""


def test_history_csv(spark, tmp_path):
    path = write(tmp_path / "history.csv", HISTORY)
    assert [(r.staff, r.hours, r.day) for r in readers.read_history(spark, path).collect()] == [(4, 2.0, 2)]
    assert readers.history_with_errors(spark, path).where("error = 'Outage_Hours: not a number'").count() == 1


def test_write_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, t string")
    write_table(df, str(tmp_path / "csv"), fmt="csv")
    write_table(df.where("n = 1"), str(tmp_path / "csv"), fmt="csv")  # the second run replaces the first
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect() == [("1", "a")]
    write_table(df, str(tmp_path / "parquet"), partition_by=["t"])
    assert spark.read.parquet(str(tmp_path / "parquet")).where("t = 'b'").first().n == 2


def test_tables_and_append(spark):
    ensure_tables(spark, "outage_test")
    ensure_tables(spark, "outage_test")
    docs = spark.createDataFrame([(7, "one two")], "doc_id BIGINT, text STRING")
    append(chunk_ids(chunk_separators(docs)), "outage_test.docs_text")
    assert [(r.doc_id, r.chunk_no, r.text) for r in spark.table("outage_test.docs_text").collect()] == [(7, 0, "one two")]
    names = spark.createDataFrame([("a",), ("b",), ("a",)], "file_name string")
    for _ in range(2):
        fresh = append_new(names, spark.table("outage_test.docs_track"), ["file_name"])
        append(fresh, "outage_test.docs_track")
    assert sorted(r.file_name for r in spark.table("outage_test.docs_track").collect()) == ["a", "b"]


def test_text_and_binary_documents(spark, tmp_path):
    write(tmp_path / "docs" / "a.txt", "one\ntwo\n")
    write(tmp_path / "docs" / "b.txt", b"\xff\xfe broken")
    folder = str(tmp_path / "docs")
    whole = {r.file_name: r.text for r in readers.read_text_docs(spark, folder).collect()}
    assert whole["a.txt"] == "one\ntwo\n"
    lines = readers.read_text_docs(spark, str(tmp_path / "docs" / "a.txt"), whole=False)
    assert [r.text for r in lines.collect()] == ["one", "two"]
    assert sorted(r.file_name for r in readers.list_files(spark, folder).collect()) == ["a.txt", "b.txt"]
    texts = readers.extract_text(readers.read_binary_docs(spark, folder), lambda raw: raw.decode("utf-8"))
    good, bad = readers.split_errors(texts)
    assert [(r.file_name, r.text) for r in good.collect()] == [("a.txt", "one\ntwo\n")]
    assert [r.error.split(":")[0] for r in bad.collect()] == ["UnicodeDecodeError"]


def test_listing_does_not_read_contents(spark, tmp_path):
    write(tmp_path / "docs" / "a.txt", "x")
    plan = readers.list_files(spark, str(tmp_path / "docs"))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_views(spark):
    standins.register_views(spark, "/root/testdata/sf0.001")
    assert spark.sql("SELECT count(*) n FROM requests JOIN postcodes USING (postcode)").first().n > 0


def test_unprocessed_and_delta(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id BIGINT, text STRING")
    track = spark.createDataFrame([(1,), (1,)], "doc_id BIGINT")
    assert [r.doc_id for r in unprocessed(docs, track, ["doc_id"]).collect()] == [2]
    assert [r.text for r in ingest_delta(docs, track).collect()] == ["b"]


def test_append_new_with_hot_copies(spark):
    src = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("k"))
    target = spark.createDataFrame([(950,)], "k BIGINT")
    assert append_new(src, target, ["k"]).count() == 100


def test_table_diff(spark):
    schema = "k int, a string, b int"
    old = spark.createDataFrame([(1, "x", 1), (2, None, 2), (3, None, None), (4, "d", 4)], schema)
    new = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (3, None, None), (5, None, None)], schema)
    got = sorted(map(tuple, table_diff(old, new, ["k"]).collect()), key=lambda r: r[1])
    assert got == [("update", 2, "y", 2), ("delete", 4, "d", 4), ("insert", 5, None, None)]


def test_ingest_batch_takes_each_file_once(spark, tmp_path):
    folder = str(tmp_path / "docs")
    write(tmp_path / "docs" / "a.txt", "first " * 300)
    write(tmp_path / "docs" / "b.txt", b"\xff\xfe broken")

    def run():
        return [r.file_name for r in ingest_batch(spark, folder, lambda raw: raw.decode(), "outage_ingest").collect()]

    def stored():
        chunks = spark.table("outage_ingest.docs_text").select("chunk_id", "text").collect()
        return len(chunks), sorted(r.file_name for r in spark.table("outage_ingest.docs_track").collect())

    assert run() == ["b.txt"]
    assert stored() == (3, ["a.txt"])
    write(tmp_path / "docs" / "b.txt", "repaired")
    assert run() == []
    assert stored() == (4, ["a.txt", "b.txt"])
    spark.sql("TRUNCATE TABLE outage_ingest.docs_track")  # as if a run had stopped before tracking
    assert run() == []
    assert stored() == (4, ["a.txt", "b.txt"])


def test_ingest_opens_new_files_only(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    ingest_batch(spark, str(tmp_path), lambda raw: raw.decode(), "outage_ingest_new")
    (tmp_path / "a.txt").chmod(0)  # unreadable for most users, and changed for all
    (tmp_path / "b.txt").write_text("two")

    def extract(raw: bytes) -> str:
        assert raw == b"two", "an old file was opened"
        return raw.decode()

    assert ingest_batch(spark, str(tmp_path), extract, "outage_ingest_new").count() == 0
    assert {r.file_name for r in spark.table("outage_ingest_new.docs_track").collect()} == {"a.txt", "b.txt"}


def test_postcode_rows_without_a_key_or_suburb(spark, tmp_path):
    path = tmp_path / "postcodes.csv"
    path.write_text("Postcode,Suburb\n2001,Alder\n,Birch\n20x,Cedar\n2002,\n")
    rows = {(r.postcode, r.suburb): r.error for r in readers.postcodes_with_errors(spark, str(path)).collect()}
    assert rows[("2001", "Alder")] is None and rows[("20x", "Cedar")] is None
    assert [e for e in rows.values() if e] and sum(e is not None for e in rows.values()) == 2
    assert readers.read_postcodes(spark, str(path)).count() == 2
