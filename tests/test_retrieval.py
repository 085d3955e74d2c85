import numpy as np
import pytest
from pyspark.sql import functions as F

from outage_spark.operators import retrieval as R
from outage_spark.operators.spread import settle

K = 4


@pytest.fixture(scope="module")
def data(spark):
    """Clustered unit vectors; a third of them are copies of one vector."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    vectors = centres[rng.integers(0, 8, 600)] + 0.3 * rng.normal(size=(600, 16))
    vectors[::3] = vectors[0]
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 8)) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT").repartition(5)
    return df, vectors.astype(np.float64)


def best(questions, corpus):
    scores = np.round(questions @ corpus.T, 6)
    out = []
    for q, row in enumerate(scores):
        order = np.lexsort((np.arange(len(row)), -row))[:K]
        out += [(q, int(v), round(float(row[v]), 6) + 0.0, n + 1) for n, v in enumerate(order)]
    return out


def rows(hits):
    return sorted((r.question_id, r.vec_id, round(r.score, 6), r["rank"]) for r in hits.collect())


def same(got, expected):
    assert [(q, v, n) for q, v, _, n in got] == sorted((q, v, n) for q, v, _, n in expected)


def test_scan_equals_numpy(data):
    df, vectors = data
    got = rows(R.similar(df, df, K))
    same(got, best(vectors, vectors))
    assert len(got) == 600 * K


def test_blocks_equal_scan(data):
    df, _ = data
    asked = settle(R._vectors(df, "vec_id", "embedding"))
    blocks = R._ranked(R._grid(asked, R._vectors(df, "vec_id", "embedding"), K, block_rows=130), K)
    assert rows(blocks) == rows(R.similar(df, df, K))
    assert rows(R.similar(df, df, K, max_bytes=0)) == rows(R.similar(df, df, K))


@pytest.mark.parametrize("n_probe", [1, 3])
def test_index_search_is_exact(data, n_probe):
    df, _ = data
    index = R.build_index(df, n_lists=8)
    assert rows(R.search_index(index, df, K, n_probe)) == rows(R.similar(df, df, K))


def test_stored_index_prunes_lists(data, tmp_path):
    df, _ = data
    index = R.build_index(df, n_lists=8, path=str(tmp_path / "index"))
    one = df.where("vec_id = 1")
    assert rows(R.search_index(index, one, K, 1)) == rows(R.similar(one, df, K))
    assert index.table.count() == 600
    plan = index.table.where(F.col("list_id").isin([1]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list_id" in plan


def test_index_of_vectors_of_any_length(data):
    df, _ = data
    stretched = df.withColumn(
        "embedding", F.transform("embedding", lambda v: (v * (F.col("vec_id") % 7)).cast("float"))
    )
    index = R.build_index(stretched, n_lists=8)
    assert rows(R.search_index(index, stretched, K, 1)) == rows(R.similar(stretched, stretched, K))


def test_recall_of_a_quick_search(data):
    df, _ = data
    exact = R.similar(df, df, K)
    index = R.build_index(df, n_lists=8)
    recall = R.ann_recall(exact, R.search_index(index, df, K, 8, exact=False)).agg(F.avg("recall")).first()[0]
    assert recall == 1.0
    quick = R.ann_recall(exact, R.search_index(index, df, K, 1, exact=False))
    assert quick.count() == 600 and 0.5 < quick.agg(F.avg("recall")).first()[0] <= 1.0


def test_null_vectors_and_few_rows(spark):
    rows_ = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows_, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    got = [(r.question_id, r.vec_id) for r in R.similar(df, df, K).orderBy("question_id", "rank").collect()]
    assert got == [(1, 1), (1, 3), (3, 3), (3, 1)]


def test_context_in_rank_order(spark):
    schema = "question_id bigint, vec_id bigint, score double, rank int"
    hits = spark.createDataFrame([(1, 10, 0.5, 2), (1, 11, 0.9, 1)], schema)
    texts = spark.createDataFrame([(10, "second"), (11, "first")], "vec_id bigint, text string")
    asked = spark.createDataFrame([(1, "why {context}?"), (2, "who?")], "question_id bigint, question string")
    got = {r.question_id: r for r in R.assemble_context(hits, texts, asked, "{context}|{question}", "+").collect()}
    assert got[1].prompt == "first+second|why {context}?" and got[1].n_texts == 2
    assert got[2].prompt == "|who?" and got[2].n_texts == 0


def test_scope_and_precision(spark):
    hits = spark.createDataFrame(
        [(1, 1, 1.0, 1), (1, 2, 0.4, 2), (1, 3, 0.3, 3)], "question_id bigint, vec_id bigint, score double, rank int"
    )
    labels = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "vec_id bigint, label int")
    assert R.label_precision_at_k(hits, labels).collect() == [(1, 2, 0.5)]
    assert [r.in_scope for r in R.in_scope(hits.where("vec_id > 1"), 0.5).collect()] == [False]


def test_embedding_hook(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "doc_id bigint, text string")
    got = R.embed(df, lambda texts: [[float(len(t)), 1.0] for t in texts]).orderBy("doc_id").collect()
    assert [r.embedding for r in got] == [[2.0, 1.0], [4.0, 1.0]]


def test_word_vectors_find_the_same_topic(spark):
    texts = ["power outage in the storm", "storm power outage report", "recipe for apple cake", "apple cake with cream"]
    df = spark.createDataFrame(list(enumerate(texts)), "vec_id bigint, text string")
    encoded = R.embed_words(df).select("vec_id", "embedding")
    hits = R.similar(encoded, encoded, 2).where("question_id <> vec_id").collect()
    assert {(r.question_id, r.vec_id) for r in hits} >= {(0, 1), (1, 0), (2, 3), (3, 2)}
    lengths = encoded.select(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-5 for r in lengths)


def test_no_questions(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    none = df.where("false")
    assert R.similar(none, df, 2).count() == 0
    assert R.search_index(R.build_index(df, 2), none, 2).count() == 0


def test_arguments_hold_for_any_number_of_questions(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "vec_id bigint, embedding array<float>")
    index = R.build_index(df, 6)
    for exact in (True, False):
        small = R.search_index(index, df, 3, 1, exact)
        large = R.search_index(index, df, 3, 1, exact, max_bytes=1000)
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


@pytest.mark.parametrize("block_rows", [7, 60, 5000])
def test_lists_and_blocks(data, block_rows):
    """Copies make one list much longer than a block; others share blocks."""
    df, vectors = data
    index = R.build_index(df, n_lists=12, block_rows=block_rows)
    lists = index.lists
    spans = [(f, f + n) for f, n in zip(lists.first_block.tolist(), lists.n_blocks.tolist())]
    assert all(a[1] <= b[0] or a == b or (a[1] - a[0], b[1] - b[0]) == (1, 1) for a, b in zip(spans, spans[1:]))
    sizes = {r.block_id: r["count"] for r in index.rows().groupBy("block_id").count().collect()}
    assert sum(sizes.values()) == 600
    if block_rows == 60:
        assert len(sizes) > 8 and max(sizes.values()) < 3 * block_rows
    # More questions than a task may hold at once.
    for max_bytes in (1000, 10**7):
        same(rows(R.search_index(index, df, K, 1, max_bytes=max_bytes)), best(vectors, vectors))


def test_search_keeps_everything_off_the_driver():
    import inspect

    source = inspect.getsource(R.search_index) + inspect.getsource(R._probe)
    assert "toArrow" not in source and "collect(" not in source


def test_quick_search_scores_the_nearest_lists_only(data):
    df, vectors = data
    index = R.build_index(df, n_lists=12)
    of_row = {r.vec_id: r.list_id for r in index.table.collect()}
    probed = index.lists.nearest(vectors, 2)
    for r in R.search_index(index, df, K, 2, exact=False).collect():
        assert probed[r.question_id, of_row[r.vec_id]]


def test_hits_without_a_text_stay(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    texts = spark.createDataFrame([(1, "one"), (3, "three"), (4, "four")], "vec_id bigint, text string")
    found = {(r.question_id, r["rank"]): (r.vec_id, r.text) for r in R.retrieve(vectors, vectors, 2, texts).collect()}
    assert found[1, 1] == (1, "one") and found[1, 2] == (2, None) and found[2, 2] in {(1, "one"), (2, None)} and len(found) == 6
    own = vectors.join(texts, "vec_id", "left")
    assert {(r.question_id, r["rank"]): (r.vec_id, r.text) for r in R.retrieve(own, own, 2).collect()} == found


def test_hashed_join_finds_nearly_all(data):
    from outage_spark.operators.hashed import similar_hashed

    df, _ = data
    exact = R.similar(df, df, K)
    for rows_per_bucket, block_rows in ((20, 4096), (1024, 50)):
        found = settle(similar_hashed(df, df, K, rows_per_bucket=rows_per_bucket, block_rows=block_rows))
        assert R.ann_recall(exact, found).agg(F.avg("recall")).first()[0] >= 0.9
        scores = {(q, v): s for q, v, s, _ in rows(exact)}
        assert all(abs(scores[q, v] - s) < 1e-9 for q, v, s, _ in rows(found) if (q, v) in scores)
        assert found.count() == 600 * K and found.select("question_id", "vec_id").distinct().count() == 600 * K


def test_hashed_join_of_few_rows(spark):
    from outage_spark.operators.hashed import similar_hashed

    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert rows(similar_hashed(df, df, 1)) == rows(R.similar(df, df, 1))
    assert similar_hashed(df.where("false"), df, 2).count() == similar_hashed(df, df.where("false"), 2).count() == 0


def test_word_vectors_do_not_depend_on_what_is_broadcast(spark):
    """Without room for any word, all are rare; a row that comes twice and texts without words stay."""
    texts = ["storm in the storm", "the power outage", "the power of the storm", "", None, "the", "the power outage"]
    df = spark.createDataFrame([(min(i, 5), t) for i, t in enumerate(texts)] + [(1, texts[1])], "vec_id bigint, text string")
    want = sorted(map(str, R.embed_words(df, dims=16).collect()))
    assert len(want) == 8 and R.embed_words(df, dims=16).columns == ["vec_id", "text", "embedding"]
    for max_bytes in (0, 200):
        assert sorted(map(str, R.embed_words(df, dims=16, max_bytes=max_bytes).collect())) == want


def test_scores_are_held_by_tiles(monkeypatch):
    """No array of scores is larger than a tile; ties, copies and vectors that are not numbers are as before."""
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(300, 3)), 1)
    vectors[7] = np.nan
    ids = rng.permutation(np.repeat(np.arange(150), 2))
    seen = []
    merge = R._TopK._merge
    monkeypatch.setattr(R, "QUESTION_SLICE", 16)
    monkeypatch.setattr(R, "ROW_SLICE", 32)
    monkeypatch.setattr(R._TopK, "_merge", lambda self, part, some, scores: (seen.append(scores.shape), merge(self, part, some, scores)))
    best_of = R._TopK(np.arange(40), vectors[20:60], K)
    for at in range(0, 300, 100):
        best_of.add(ids[at : at + 100], vectors[at : at + 100])
    assert max(a * b for a, b in seen) <= 16 * 32
    scores = np.nan_to_num(np.round(vectors[20:60] @ vectors.T, 6), nan=-1e9)
    for question, row in enumerate(scores):
        order = np.lexsort((ids, -row))[:K]
        assert best_of.ids[question].tolist() == ids[order].tolist() and best_of.scores[question].tolist() == row[order].tolist()
    few = R._TopK(np.arange(2), vectors[:2], K)
    few.add(ids[:3], vectors[:3])
    assert few.batch().num_rows == 6


def test_a_question_meets_a_block_once(data, monkeypatch):
    """However many lists of a block a question asks, its vector is sent there once, and only its lists are scored."""
    df, vectors = data
    index = R.build_index(df, n_lists=12, block_rows=300)
    blocks, sent = index.lists.count_blocks(), []
    monkeypatch.setattr(R, "settle", lambda frame: (sent.append(frame) if "block_id" in frame.columns else None, settle(frame))[1])
    same(rows(R.search_index(index, df, K, 6)), best(vectors, vectors))
    assert blocks < 6 and len(sent) == 2
    for probes in sent:
        assert probes.count() == probes.select("vec_id", "block_id").distinct().count() and "near" in probes.columns
        assert dict(probes.dtypes)["v"] == "array<float>"


def test_hashed_questions_meet_a_block_once(data, monkeypatch):
    """A question is sent to a block of buckets once, as it was given, with the marks of its buckets."""
    from outage_spark.operators import hashed

    df, _ = data
    sent = []
    monkeypatch.setattr(hashed, "settle", lambda frame: (sent.append(frame) if "marks" in frame.columns else None, settle(frame))[1])
    hashed.similar_hashed(df, df, K, rows_per_bucket=5)
    assert len(sent) == 1 and dict(sent[0].dtypes)["v"] == "array<float>"
    assert sent[0].count() == sent[0].select("vec_id", "tbl", "block").distinct().count() <= 600 * hashed.TABLES * 8
