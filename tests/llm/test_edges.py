"""Odd rows and empty tables through every operator and stage."""

from collections import Counter
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from outage_spark.llm import (
    decontamination, jaccard_join, license_scan, mixture, personal_data, quality_rules, repeated_passages, toxicity, url_filter,
)
from outage_spark.llm.text import word_count
from tests.llm.helpers import odd_rows, table, words

ITEMS = "item_id BIGINT, text STRING"
LABELS = "doc_id BIGINT, quality INT, toxic INT"


@pytest.fixture(scope="module", params=["odd", "empty"])
def docs(request, spark):
    return table(spark, odd_rows() if request.param == "odd" else [])


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_quality_rules(docs):
    rows = quality_rules.judge(quality_rules.ledger(docs), "strict-1")
    assert ids(rows) == ids(docs)
    assert all(not r.kept for r in rows.collect() if r.n_words < 50)
    # A filter above the projection must not change anything.
    assert rows.where("kept").count() == sum(r.kept for r in rows.collect())


def test_personal_data(docs):
    assert ids(personal_data.find_personal_data(docs)) == ids(docs)
    clean = personal_data.redact(docs)
    assert clean.columns == docs.columns
    assert sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))


def test_jaccard_join(docs):
    classes = jaccard_join.similar_classes(docs)
    assert classes.count() == docs.count()
    found = {(r.id_key, r.component_id) for r in classes.collect()}
    if found:
        assert {(7, 7), (8, 7), (9, 7), (1, 1), (2, 2), (3, 3), (12, 12), (13, 12)} <= found
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    if found:
        # Of the class of 7 only 7 stays, once; texts without words stay all.
        assert ids(kept) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 7: 1, 10: 1, 11: 1, 12: 1, None: 2})


def test_repeated_passages(docs):
    rows = repeated_passages.remove_repeats(docs)
    assert ids(rows) == ids(docs)
    kept = {(r.doc_id, r.n_words): r.n_removed for r in rows.collect()}
    if kept:
        assert kept[7, 60] == 0 and kept[8, 60] == 60 and kept[10, 100] == 60 and kept[11, 40] == 40
        assert kept[None, 60] == 60 and kept[12, 20_000] == 0 and kept[13, 20_001] == 20_000 and kept[None, 0] == 0


def test_decontamination(spark, docs):
    for items in ([], [(1, None), (2, ""), (3, "two words"), (3, "two words"), (None, "one")]):
        items = spark.createDataFrame(items, ITEMS)
        clean = decontamination.decontaminate(docs, items)
        assert clean.columns == docs.columns
        gone = ids(docs) - ids(clean)
        # The item without an id removes its documents too, but is in no list.
        assert gone == (Counter({None: 1, 4: 2}) if items.count() and docs.count() else Counter())
        found = {(r.doc_id, r.n_hit, tuple(r["items"])) for r in decontamination.find_contamination(docs, items).collect()}
        assert found == ({(None, 2, ("3",)), (4, 1, ())} if gone else set())


def test_mixture(docs):
    sized = docs.withColumns({"size": word_count("text"), "k": F.xxhash64("text")})
    targets = mixture.source_targets(sized, "size", "source")
    rows = mixture.mix(sized, targets, "size", "source", ["doc_id", "k"], block_rows=2)
    assert ids(rows) == ids(docs)
    assert all(0 <= r.copies <= 2 for r in rows.collect())


def test_toxicity(spark, docs):
    for labels in ([], [(1, 1, 1), (1, 1, 0), (2, 1, None), (None, 1, 1), (7, 0, 0), (8, 1, 1)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
        rows = toxicity.score(docs, model)
        assert ids(rows) == ids(docs)
        assert all(0 <= r.score <= 1 for r in rows.collect())


def test_license_scan(docs):
    assert license_scan.scan_licenses(docs).count() == 0


def test_url_filter(spark):
    schema = "page_id BIGINT, url STRING, html STRING, host STRING, rule STRING, verdict STRING"
    rows = [
        (1, None, None, "h", "r", "v"), (2, "no scheme", "", "h", "r", "v"), (3, "http://A.NET", "<a href='//b.org/x'>", "h", "r", "v"),
        (3, "http://A.NET", None, "h", "r", "v"), (None, "x://www.a.net/p?q", None, "h", "r", "v"), (5, "://", None, None, None, None),
    ]
    out = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_pages(spark.createDataFrame(rows, schema)).collect()}
    assert {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (None, "www.a.net", "/p", "net/", "block"), (5, "", "", None, "allow")} <= out
    assert ("a.net", "") in {(host, path) for _, host, path, _, _ in out}
    assert url_filter.judge_pages(spark.createDataFrame([], schema)).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    spark.createDataFrame([(4, 1, 1)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "two words")], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*corpus_pipeline.COLUMNS, "copy"]
    kept = {r.doc_id for r in out.collect()}
    assert not kept & {8, 9}
    assert all(words(r.text) for r in out.where("copy > 2").collect())
