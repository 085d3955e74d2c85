"""The stored index after random changes equals one that is built anew."""

import os
import random

import numpy as np
import pytest

from outage_spark.operators import index_store as S
from outage_spark.operators import retrieval as R
from outage_spark.operators.ingest import table_diff
from tests.test_retrieval import rows

VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>"


def vector(rng, centres):
    v = centres[rng.randrange(len(centres))] + 0.2 * np.random.default_rng(rng.randrange(10**9)).normal(size=8)
    return [float(np.float32(x)) for x in v / np.linalg.norm(v)]


def frame(spark, table):
    return spark.createDataFrame(sorted(table.items()), VECTORS)


def searched(spark, home, table):
    asked = frame(spark, table)
    return rows(R.search_index(S.read_index(spark, home, block_rows=16), asked, 3, 1)), rows(R.similar(asked, asked, 3))


def test_changes_and_compaction(spark, tmp_path):
    rng, home = random.Random(1), str(tmp_path / "index")
    centres = np.random.default_rng(2).normal(size=(10, 8)) * 3
    table = {i: vector(rng, centres) for i in range(150)}
    S.create_index(frame(spark, table), home, n_lists=10)
    found, exact = searched(spark, home, table)
    assert found == exact and S.compact(spark, home) == []
    for batch in range(4):
        old = dict(table)
        for _ in range(12):
            what, one = rng.choice(["insert", "update", "delete"]), rng.choice(sorted(table))
            if what == "delete":
                del table[one]
            else:
                table[one if what == "update" else 1000 + rng.randrange(1000)] = vector(rng, centres)
        feed = table_diff(frame(spark, old), frame(spark, table), ["vec_id"])
        S.apply_changes(home, feed, batch)
        S.apply_changes(home, feed, batch)  # a replay
        found, exact = searched(spark, home, table)
        assert found == exact, batch
        if batch % 2:
            before = {f: os.listdir(f"{home}/lists/{f}") for f in os.listdir(f"{home}/lists") if f.startswith("version=")}
            touched = S.compact(spark, home)
            for folder, lists in before.items():
                assert os.listdir(f"{home}/lists/{folder}") == lists
            newest = max(int(f.split("=")[1]) for f in os.listdir(f"{home}/lists") if f.startswith("version="))
            written = {int(f.split("=")[1]) for f in os.listdir(f"{home}/lists/version={newest}") if f.startswith("list_id=")}
            assert written <= set(touched)
            S.apply_changes(home, feed, batch)  # folded in already
            found, exact = searched(spark, home, table)
            assert found == exact
            assert S.compact(spark, home) == []


def test_only_touched_lists_are_rewritten(spark, tmp_path):
    home = str(tmp_path / "index")
    axes = np.eye(6)
    table = {i: [float(x) for x in axes[i % 6]] for i in range(60)}
    S.create_index(frame(spark, table), home, n_lists=6)
    of = {r.vec_id: r.list_id for r in S.read_index(spark, home).table.collect()}
    # 3 moves from its list to that of 4; 5 goes; a new row comes to the list of 4.
    feed = spark.createDataFrame([("update", 3, table[4]), ("delete", 5, None), ("insert", 99, table[4])], f"op STRING, {VECTORS}")
    S.apply_changes(home, feed, 7)
    assert S.compact(spark, home) == sorted({of[3], of[4], of[5]})
    now = {r.vec_id: r.list_id for r in S.read_index(spark, home).table.collect()}
    assert now[3] == now[99] == of[4] and 5 not in now and len(now) == 60


def test_a_half_written_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    home, table = str(tmp_path / "index"), {i: [float(i), 1.0] for i in range(1, 30)}
    S.create_index(frame(spark, table), home, n_lists=4)
    del table[3]
    S.apply_changes(home, spark.createDataFrame([("delete", 3, None)], f"op STRING, {VECTORS}"), 0)

    def broken(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(S, "_write_manifest", broken)
        with pytest.raises(RuntimeError):
            S.compact(spark, home)
    found, exact = searched(spark, home, table)
    assert found == exact
    S.compact(spark, home)
    found, exact = searched(spark, home, table)
    assert found == exact


def test_a_list_that_loses_all_rows(spark, tmp_path):
    home, table = str(tmp_path / "index"), {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.1, 1.0]}
    S.create_index(frame(spark, table), home, n_lists=3)
    S.apply_changes(home, spark.createDataFrame([("delete", 1, None), ("update", 2, None), ("delete", 50, None)], f"op STRING, {VECTORS}"), 0)
    S.compact(spark, home)
    found, exact = searched(spark, home, {3: table[3]})
    assert found == exact == [(3, 3, 1.01, 1)]
