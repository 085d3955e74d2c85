import pytest

from outage_spark import schemas
from outage_spark.operators.conversation import (
    append_answers,
    join_parts,
    pending_context,
    clean_turns,
    context_turns,
    pending_turns,
    question_answer_pairs,
    transcript,
)

TURNS = [
    (1, 0, "system", "rules"),
    (1, 1, "user", "power?"),
    (1, 2, None, "broken"),
    (1, 3, "assistant", "off"),
    (1, 4, "user", "until?"),
    (2, 0, "system", "rules"),
    (3, 0, "user", "a"),
    (3, 1, "user", "b"),
    (3, 2, "assistant", "c"),
]


@pytest.fixture(scope="module")
def conv(spark):
    return spark.createDataFrame(TURNS, schemas.TURNS)


def test_turns_without_role_are_dropped(conv):
    assert clean_turns(conv).count() == len(TURNS) - 1


def test_pending(conv):
    assert [tuple(r) for r in pending_turns(conv).collect()] == [(1, 4, "until?")]


def test_a_malformed_last_message_is_not_pending(spark):
    rows = [(1, 0, "user", "a"), (1, 1, None, "broken"), (2, 0, None, "x"), (2, 1, "user", "b")]
    assert [r.conv_id for r in pending_turns(spark.createDataFrame(rows, schemas.TURNS)).collect()] == [2]


@pytest.mark.parametrize("part_chars", [1_000_000, 4])
def test_whole_context_of_pending_chats(spark, conv, part_chars):
    more = spark.createDataFrame([(5, 0, "user", "first")], schemas.TURNS)
    parts = pending_context(conv.unionByName(more), part_chars)
    whole = {r.conv_id: r.context for r in join_parts(parts, ["conv_id", "turn"], "context").collect()}
    assert whole == {1: "rules\npower?\noff", 5: ""}
    assert part_chars > 4 or parts.where("part > 0").count() > 0


@pytest.mark.parametrize("runs", [None, 4])
def test_pairs(conv, runs):
    got = sorted(map(tuple, question_answer_pairs(conv, runs).collect()))
    assert got == [(1, 1, "power?", "off"), (3, 1, "b", "c")]


@pytest.mark.parametrize("runs", [None, 4])
def test_context_is_a_beginning_of_the_transcript(conv, runs):
    whole = {r.conv_id: r.text for r in transcript(conv).collect()}
    clean = [t for t in TURNS if t[2]]
    for r in context_turns(conv, max_turns=2, runs=runs).collect():
        earlier = [t[3] for t in clean if t[0] == r.conv_id and t[1] < r.turn]
        assert r.context_turns == len(earlier)
        assert whole[r.conv_id][: r.context_chars] == "\n".join(earlier)
        assert r.recent == "\n".join(earlier[-2:])


def test_context_without_texts(conv):
    assert context_turns(conv).columns == ["conv_id", "turn", "role", "context_turns", "context_chars"]


def test_answers_follow_the_last_turn(spark, conv):
    answers = spark.createDataFrame([(1, "soon"), (9, "hello")], "conv_id BIGINT, text STRING")
    added = append_answers(conv, answers).where("text in ('soon', 'hello')").collect()
    assert sorted(map(tuple, added)) == [(1, 5, "assistant", "soon"), (9, 0, "assistant", "hello")]


def test_two_answers_get_two_turns(spark, conv):
    answers = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "conv_id BIGINT, text STRING")
    added = append_answers(conv, answers).where("conv_id = 1 and turn > 4").collect()
    assert sorted((r.turn, r.text) for r in added) == [(5, "a"), (6, "a"), (7, "b")]
