from outage_spark.operators.identity import append_numbered, create_numbered, read_numbered


def test_numbers_go_on_over_appends_and_replays(spark, tmp_path):
    home = str(tmp_path / "ids")
    create_numbered(spark, home)
    create_numbered(spark, home)

    def append(batch_id, keys):
        append_numbered(spark.createDataFrame([(k,) for k in keys], "key STRING"), ["key"], home, batch_id)

    def rows():
        return {r.key: r.id for r in read_numbered(spark, home, "key STRING, id BIGINT").collect()}

    append(0, "cab")
    assert rows() == {"a": 1, "b": 2, "c": 3}
    append(1, "")
    append(2, "zy")
    append(2, "zy")
    append(0, "cab")
    append(3, "d")
    assert rows() == {"a": 1, "b": 2, "c": 3, "y": 4, "z": 5, "d": 6}


def test_a_batch_without_its_mark_does_not_count(spark, tmp_path):
    home = str(tmp_path / "ids")
    create_numbered(spark, home)
    append_numbered(spark.createDataFrame([("a",)], "key STRING"), ["key"], home, 0)
    # Rows of a batch that stopped before its mark.
    spark.createDataFrame([("half", 2)], "key STRING, id BIGINT").write.parquet(f"{home}/rows/batch_id=1")
    assert read_numbered(spark, home, "key STRING, id BIGINT").count() == 1
    append_numbered(spark.createDataFrame([("b",), ("c",)], "key STRING"), ["key"], home, 1)
    assert {r.key: r.id for r in read_numbered(spark, home, "key STRING, id BIGINT").collect()} == {"a": 1, "b": 2, "c": 3}
