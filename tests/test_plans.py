"""What the plans must look like: pruned scans, pushed filters, no pair-wise joins."""

import pytest

from outage_spark.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if not q.startswith("stream_")))
def test_no_pairwise_joins_and_no_row_python(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for bad in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython"):
        assert bad not in text


@pytest.mark.parametrize("name", ["outage_status", "suburb_lookup", "estimate_duration", "planned_overlap"])
def test_requests_are_not_shuffled_for_small_lookups(spark, name):
    """The scan of the requests reaches the result through broadcast joins only."""
    text = plan(QUERIES[name](spark, FOLDER))
    path = text[: text.index("FileScan parquet [event_id")].splitlines()
    depth, above = None, []
    for line in reversed(path):
        here = len(line) - len(line.lstrip(" :+-"))
        if depth is None or here < depth:
            depth = here
            above.append(line)
    assert not [line for line in above if "Exchange" in line]


def test_scans_read_needed_columns_only(spark):
    text = plan(QUERIES["triage_planned"](spark, FOLDER))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in text
    chunks = QUERIES["chunk_fixed"](spark, FOLDER)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(chunks)
    assert "Exchange" not in plan(chunks)


def test_filters_are_pushed(spark):
    assert "In(event_type, [error,view])" in plan(QUERIES["condition_isin"](spark, FOLDER))
    assert "IsNotNull(role)" in plan(QUERIES["question_answer_pairs"](spark, FOLDER))


def test_limits_stay_distributed(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_k_global"](spark, FOLDER))
    assert "WindowGroupLimit" in plan(QUERIES["vector_topk"](spark, FOLDER))


def test_grouped_means_are_partial(spark):
    text = plan(QUERIES["hours_by_area_condition"](spark, FOLDER))
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1
