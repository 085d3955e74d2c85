"""Hard negatives and nearest neighbours against brute force, with odd rows and small blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from outage_spark.llm import cross_polytope, hard_negatives
from outage_spark.llm.queries import QUERIES
from outage_spark.llm.vectors import Rotation, lists, matrix

# Further columns carry names that the operators use themselves.
ROWS = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, v STRING, _at STRING, ints STRING, _table STRING, score STRING"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "a", "b", "c", "d", "e") for i, v, label in rows], ROWS)


def vectors(n, width=20, labels=4, seed=1):
    """A third of the rows share a label and many are near copies of one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, width))
    hot = rng.normal(size=width)
    rows = []
    for i in range(n):
        label = 0 if i % 3 == 0 else int(rng.integers(labels))
        base = hot + 0.01 * rng.normal(size=width) if i % 4 == 1 else 0.8 * centres[label] + rng.normal(size=width)
        rows.append((i, [float(np.float32(x)) for x in base / np.linalg.norm(base)], label))
    return rows


ODD = [
    (None, [0.5] * 20, 1), (1000, None, 1), (1050, [0.5, None], 1), (1100, [math.nan] * 20, 1), (1150, [math.inf] + [0.0] * 19, 2),
    (1200, [0.25] * 20, None), (1250, [], 1), (1300, [0.0] * 20, 2), (1350, [0.5, -0.5], 2), (51, [0.25] * 20, 0), (51, [0.25] * 20, 0),
    (-50, [0.1] * 20, 3), (52, [0.25] * 20, 1), (53, [0.25] * 20, 1), (1400, [3e30] * 20, 1),
]


def takes_part(vec_id, vector):
    return vec_id is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def hard_by_hand(rows):
    rows = [(i, [math.floor(256 * np.float32(x).item()) for x in v], label) for i, v, label in rows if takes_part(i, v) and label is not None]
    rows = [r for r in rows if dot(r[1], r[1]) <= 2**62]
    out = []
    for a, av, al in sorted({i: (i, v, label) for i, v, label in rows if i % 50 == 0}.values()):
        scored = sorted((-dot(av, v), i, label) for i, v, label in rows if i != a)
        for s, p, _ in [x for x in scored if x[2] == al][:5]:
            good = [(n, -t) for t, n, label in scored if label != al and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, rank + 1, n, -s, t) for rank, (n, t) in enumerate(good)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 4096), (2, 37)])
def test_hard_negatives(spark, blocks):
    rows = vectors(300) + ODD
    coded, width = hard_negatives.encode(frame(spark, rows))
    out = hard_negatives.mine(coded, width, coded.where(F.col("vec_id") % 50 == 0), ask_block=blocks[0], row_block=blocks[1])
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(tuple(r) for r in out.select(*columns).collect())
    assert found == hard_by_hand(rows) and len(found) > 30


def test_hard_negatives_without_rows(spark):
    for rows in ([], ODD[:6], [(50, [0.5], 1)], [(50, [0.5], 1), (51, [0.5], 2)]):
        coded, width = hard_negatives.encode(frame(spark, rows))
        assert hard_negatives.mine(coded, width, coded.where(F.col("vec_id") % 50 == 0)).count() == 0


def test_intervals_hold_every_score():
    rng = np.random.default_rng(3)
    import pyarrow as pa

    for width, scale in ((5, 10), (64, 300), (100, 1e6)):
        whole = np.floor(rng.normal(size=(200, width)) * scale)
        whole[7], whole[8] = 0, whole[9]
        codes = hard_negatives.OneBitCodes(width)
        packed, aligned, rest = codes.encode(whole)
        assert (np.diff(rest, axis=1) <= 1e-6).all()
        block = pa.table({
            "vec_id": np.arange(200), "label": np.zeros(200, np.int64), "ints": lists(whole.astype(np.int64)),
            "codes": lists(packed.view(np.int64)), "aligned": lists(aligned), "rest": lists(rest),
        })
        held = hard_negatives._Rows(codes, block, width)
        for anchor in (0, 7, 9):
            query = hard_negatives._Query(codes, codes.rotate(whole[anchor : anchor + 1])[0])
            at, estimate, truth = np.arange(200), np.zeros(200), whole @ whole[anchor]
            widths = []
            for level in range(codes.levels):
                estimate, least, most = held.interval(query, level, at, estimate)
                assert (least <= truth).all() and (truth <= most).all()
                widths.append((most - least).mean())
            assert widths[-1] < widths[0] or anchor == 7


@pytest.mark.parametrize("width, scale", [(5, 10), (64, 300), (64, 1e8)])
def test_codes_of_many_anchors_are_compared_at_once(monkeypatch, width, scale):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    whole = np.floor(rng.normal(size=(900, width)) * scale)
    whole[7], whole[8], whole[20:40] = 0, whole[9], whole[50]
    labels, codes = rng.integers(3, size=900), hard_negatives.OneBitCodes(width)
    packed, aligned, rest = codes.encode(whole)
    block = pa.table({
        "vec_id": np.arange(900) // 2 * 2, "label": labels, "ints": lists(whole.astype(np.int64)),
        "codes": lists(packed.view(np.int64)), "aligned": lists(aligned), "rest": lists(rest),
    })
    rows, truth = hard_negatives._Rows(codes, block, width), whole.astype(np.int64) @ whole[:90].astype(np.int64).T
    calls, interval = [], hard_negatives._Rows.interval
    monkeypatch.setattr(hard_negatives._Rows, "interval", lambda *a: calls.append(1) or interval(*a))
    out = np.arange(90)[:, None] // 2 == np.arange(900) // 2
    bands = [[hard_negatives.band_under(int(s)) for s in sorted(truth[:, a])[-6:-1]] for a in range(90)]
    low, least_high, high = (np.array([f(b[i] for b in own) for own in bands], float) for f, i in ((min, 0), (min, 1), (max, 1)))
    there = hard_negatives.may_rank(rows, rows.decoded(codes.levels - 1), codes.rotate(whole[:90]), out, low, least_high, high, 3)
    left = 0
    for a, at in enumerate(there):
        left += len(at)
        length = float(np.sqrt((whole[a] ** 2).sum()))
        got = [(b, list(zip(rows.ids[p].tolist(), x.tolist()))) for b, p, x in hard_negatives.best_in_bands(rows, whole[a].astype(np.int64), length, at, bands[a], 3)]
        inside = [[(int(truth[j, a]), int(rows.ids[j])) for j in range(900) if not out[a, j] and lo <= truth[j, a] <= hi] for lo, hi in bands[a]]
        want = [(b, [(i, x) for x, i in sorted(found, key=lambda f: (-f[0], f[1]))[:3]]) for b, found in enumerate(inside) if found]
        assert got == want
    # One comparison for all anchors, and most pairs are never scored in integers.
    assert len(calls) == 1 and left < 0.5 * 90 * 900


def near_by_hand(rows, k):
    rows = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if takes_part(i, v) and any(v)}
    width = max(len(v) for v in rows.values())
    rows = {i: np.pad(v, (0, width - len(v))) for i, v in rows.items()}
    out = {}
    for q in (i for i in rows if i % 50 == 0):
        scored = [(-(rows[q] @ v) / math.sqrt((rows[q] @ rows[q]) * (v @ v)), i) for i, v in rows.items() if i != q]
        out[q] = sorted(scored)[:k]
    return out


@pytest.mark.parametrize("functions", [1, 2])
def test_nearest_neighbours(spark, monkeypatch, functions):
    if functions == 2:
        monkeypatch.setattr(cross_polytope, "ROWS_PER_BUCKET", 1)
    rows = vectors(600) + ODD
    usable = cross_polytope.usable(frame(spark, rows))
    queries = usable.where(F.col("vec_id") % 50 == 0)
    index = cross_polytope.build(usable, queries, 5)
    assert index.hashes.functions == functions
    found = {}
    for r in cross_polytope.search(index, queries, 5).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    truth = near_by_hand(rows, 5)
    assert set(found) == set(truth)
    hits = 0
    for q, near in found.items():
        assert [x[0] for x in near] == [1, 2, 3, 4, 5] and q not in {x[1] for x in near}
        assert [(-s, i) for _, i, s in near] == sorted((-s, i) for _, i, s in near)
        best = {i: -s for s, i in truth[q]}
        hits += sum(i in best for _, i, _ in near)
        assert all(abs(best[i] - s) < 1e-12 for _, i, s in near if i in best)
    assert hits >= 0.9 * 5 * len(truth)
    # Equal vectors score alike, so the smaller id comes first.
    ties = [x[1] for x in found[-50] if x[1] in (51, 52, 53)]
    assert ties == sorted(ties) and len(ties) == 3


def test_nearest_neighbours_with_few_rows(spark):
    for rows, n in (([], 0), (ODD[:6], 0), ([(0, [1.0], 1)], 0), ([(0, [1.0, 0.0], 1), (1, [1.0], 2), (1, [1.0], 2)], 1)):
        usable = cross_polytope.usable(frame(spark, rows))
        out = cross_polytope.search(cross_polytope.build(usable, usable.where("vec_id = 0"), 5), usable.where("vec_id = 0"), 5)
        assert [(r.vec_id, r.score) for r in out.collect()] == [(1, 1.0)][:n]


def test_repeated_ids_do_not_push_others_out():
    ids = np.array([1] * 6 + [2, 3], np.int64)
    rows = np.array([[1.0, 0.0]] * 4 + [[1.0, 0.1], [1.0, 0.2]] + [[1.0, 1.0], [0.0, 1.0]])
    asked, found, _ = cross_polytope._nearest(np.array([9]), np.array([[1.0, 0.0]]), ids, rows, 3)
    assert set(ids[found]) == {1, 2, 3} and len(asked) <= 5


def test_recall_on_given_vectors(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    truth = {q: {i for _, i in near} for q, near in near_by_hand(rows, 5).items()}
    found = QUERIES["op12_nearest_neighbours"](spark, folder).collect()
    assert len(found) == 5 * len(truth)
    assert sum(r.vec_id in truth[r.query_id] for r in found) >= 0.9 * len(found)


def test_rotation_keeps_lengths_and_lists_come_back():
    rng = random.Random(2)
    rows = np.array([[rng.gauss(0, 1) for _ in range(5)] for _ in range(9)])
    turned = Rotation(5, 1)(rows)
    assert turned.shape == (9, 8) and np.allclose(turned @ turned.T, rows @ rows.T)
    assert (matrix(lists(rows), 5) == rows).all()
