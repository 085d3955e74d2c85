"""The conversation trie against a plain trie, with odd rows, long conversations and low bands."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from outage_spark.llm import conversation_trie as ct
from tests.llm.helpers import words

ROWS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, pos STRING, depth STRING, h1 STRING, k1 STRING, n_words STRING"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], ROWS)


def rebuilt_by_hand(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        base, head = c - (abs(c) % 20) * (1 if c >= 0 else -1), zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(base, [])[:head] + turns[head:]
    return out


def trie_by_hand(rows):
    convs = rebuilt_by_hand(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = sum(not any(m[:-1] == n and m for m in members) for n in below)
        saved = sum((len(members[n]) - 1) * len(words(n[-1][1])) for n in below if n)
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        children = sum(m[:-1] == node for m in members if m)
        out.append((min(who), len(node), parent, len(who), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def build(spark, rows, height=ct.HEIGHT):
    turns = ct.hashed(ct.ordered_turns(frame(spark, rows)))
    base = F.col("conv_id") - F.col("conv_id") % ct.SHARED_FROM
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    return ct.trie(ct.rebuild(turns, base, head), height)


def some_rows(seed=4):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-25, 60), 10**15, 140, 141, 142]:
        if c in (20, 43):
            continue  # 21 to 39 have no base
        for t in range(rng.choice([1, 1, 2, 3, 5])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["yes", "no no", "", None, "a\tb  c"])))
    # Null and equal turns, equal rows, rows of no conversation, a long conversation and copies of it.
    rows += [(5, None, "user", "z"), (5, None, "user", "y"), (5, 0, "user", "b"), (5, 0, "user", "a"), (5, 0, "user", "a"), (None, 1, "user", "x")]
    for c in (200, 201, 202):
        rows += [(c, 1000 + t, "user", f"word {t % 3}") for t in range(75 if c == 200 else 60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("height", [16, 2, 200])
def test_trie(spark, height):
    rows = some_rows()
    found = sorted((tuple(r) for r in build(spark, rows, height).collect()), key=repr)
    assert found == trie_by_hand(rows)
    assert max(r[1] for r in found) == 75


def test_hot_conversation_is_spread(spark, monkeypatch):
    """Conversations over the limit are numbered and chained over several tasks."""
    plain = ct.OrderedRows
    monkeypatch.setattr(ct, "OrderedRows", lambda df, keys, order: plain(df, keys, order, hot_rows=10))
    rows = some_rows(5)
    assert sorted((tuple(r) for r in build(spark, rows, 4).collect()), key=repr) == trie_by_hand(rows)


def test_small_and_empty_tables(spark):
    assert build(spark, []).count() == 0
    for rows in ([(None, 1, "user", "x")], [(1, 1, None, None)], [(0, 1, "user", "a"), (0, 2, "user", "b")], [(3, 1, "u", "a"), (4, 1, "u", "a")]):
        assert sorted((tuple(r) for r in build(spark, rows).collect()), key=repr) == (trie_by_hand(rows) if rows[0][0] is not None else [])


def test_ends_in_chunks(spark):
    ids = [-3, 5, 10, 9, 100, 2, 77] * 2
    df = spark.createDataFrame([(0, 1, 2, i) for i in ids] + [(1, 1, 2, 4)], "depth INT, k1 BIGINT, k2 BIGINT, conv_id BIGINT")
    found = {r.depth: r.ends_sha256 for r in ct.ends_hashes(df, ct.NODE, chunk=3).collect()}
    assert found[0] == hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    assert found[1] == hashlib.sha256(b"4").hexdigest()
