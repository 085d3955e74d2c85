"""Vector retrieval: exact top-k, an index that stays exact, context assembly and checks.

Scores are dot products of double vectors, rounded to six decimals; equal scores rank by id.
Questions meet the corpus as matrix blocks inside tasks and only the best k per question and task
leave a task, so pairs are never rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outage_spark.functions.text import fill_template
from outage_spark.operators.spread import BROADCAST_BYTES, is_small, lookup_join, settle, size_in_blocks, top_per_key

HITS = "question_id bigint, vec_id bigint, score double"
QUESTION_SLICE = 512
ROW_SLICE = 2048
# Of vectors as doubles: what is sent to every task, and what a task holds of either side.
QUESTION_BYTES = 8 * 1024 * 1024
BLOCK_BYTES = 32 * 1024 * 1024
GRID, GRID_ROWS = 8, 4096

PROMPT = (
    "Answer the question about power outages from the notes below, briefly and in English. "
    "If the notes do not hold the answer, say so.\nNotes:\n{context}\nQuestion: {question}\nAnswer:"
)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1) if len(array) else np.empty((0, 0))


class _TopK:
    """Best k per question over the blocks a task sees, by score descending then id ascending."""

    def __init__(self, question_ids: np.ndarray, questions: np.ndarray, k: int):
        self.question_ids, self.questions, self.k = question_ids, questions, k
        self.scores = np.full((len(question_ids), k), -np.inf)
        self.ids = np.full((len(question_ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Score a block against all questions, or against the given question rows.

        Scores exist for a tile of ``QUESTION_SLICE`` questions and ``ROW_SLICE`` vectors at a time, and only those
        that reach the k-th best so far are looked at further.
        """
        rows = np.arange(len(self.question_ids)) if rows is None else rows
        for at in range(0, len(rows), QUESTION_SLICE):
            part = rows[at : at + QUESTION_SLICE]
            questions = self.questions[part]
            for start in range(0, len(ids), ROW_SLICE):
                tile = slice(start, start + ROW_SLICE)
                self._merge(part, ids[tile], questions @ vectors[tile].T)

    def _merge(self, part: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        least = self.scores[part, -1]
        if scores.shape[1] > self.k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        # The slack covers the rounding.
        near, column = np.nonzero(scores >= (least - 1e-6 - 1e-12 * np.abs(least))[:, None])
        if not len(near):
            return
        touched, place = np.unique(near, return_inverse=True)
        held = part[touched]
        row = np.concatenate([np.repeat(np.arange(len(touched)), self.k), place])
        score = np.concatenate([self.scores[held].ravel(), np.round(scores[near, column], 6)])
        one = np.concatenate([self.ids[held].ravel(), ids[column]])
        order = np.lexsort((one, -score, row))
        starts = np.searchsorted(row[order], np.arange(len(touched)))
        best = order[starts[:, None] + np.arange(self.k)]
        self.scores[held], self.ids[held] = score[best], one[best]

    def table(self) -> pa.Table:
        return pa.Table.from_batches([self.batch()])

    def batch(self) -> pa.RecordBatch:
        found = np.isfinite(self.scores)
        question = np.broadcast_to(self.question_ids[:, None], self.scores.shape)[found]
        # Adding 0.0 turns a rounded -0.0 into 0.0.
        return pa.RecordBatch.from_arrays(
            [pa.array(question), pa.array(self.ids[found]), pa.array(self.scores[found] + 0.0)],
            names=["question_id", "vec_id", "score"],
        )


def _vectors(df: DataFrame, vec_id: str, vec: str) -> DataFrame:
    return df.where(F.col(vec).isNotNull()).select(F.col(vec_id).alias("vec_id"), F.col(vec).alias("v"))


def _local(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = table.toArrow()
    return rows.column("vec_id").to_numpy().astype(np.int64), _matrix(rows.column("v"))


def similar(
    questions: DataFrame,
    corpus: DataFrame,
    k: int = 4,
    vec_id: str = "vec_id",
    vec: str = "embedding",
    max_bytes: int = QUESTION_BYTES,
) -> DataFrame:
    """Exact k most similar corpus vectors per question: (question_id, vec_id, score, rank).

    A question table of up to ``max_bytes`` is sent to every task and the corpus is scanned in place. A larger
    one is cut into blocks, as is the corpus, and block pairs are shuffled together; a task holds at most
    ``BLOCK_BYTES`` of either side, however many rows there are.
    """
    asked, stored = settle(_vectors(questions, vec_id, vec)), _vectors(corpus, vec_id, vec)
    if asked.isEmpty():
        return _ranked(asked.sparkSession.createDataFrame([], HITS), k)
    hits = _scan(asked, stored, k) if is_small(asked, max_bytes) else _grid(asked, stored, k)
    return _ranked(hits, k)


def texts_of(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Hits with their texts (``vec_id, text``, one row per id); a hit whose text is missing stays, with null.

    Only texts that were hit are shuffled or kept, so the corpus of texts is read once and never copied.
    """
    hit = hits.select("vec_id").distinct()
    wanted = texts.select("vec_id", "text").join(hit, "vec_id", "left_semi")
    return lookup_join(hits, wanted, ["vec_id"])


def retrieve(questions: DataFrame, corpus: DataFrame, k: int = 4, texts: DataFrame | None = None) -> DataFrame:
    """The k nearest corpus vectors per question, with their texts.

    ``questions`` and ``corpus`` are (vec_id, embedding); ``texts`` is (vec_id, text), by default the corpus's
    own column. All corpus vectors are ranked, whether they have a text or not: a missing text leaves the
    hit with a null text and lets no further hit move up.
    """
    hits = settle(similar(questions, corpus, k))
    return texts_of(hits, corpus if texts is None else texts)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    return top_per_key(hits, ["question_id"], [F.desc("score"), F.asc("vec_id")], k)


def _scan(asked: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    question_ids, questions = _local(asked)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _TopK(question_ids, questions, k)
        for batch in batches:
            if batch.num_rows:
                best.add(batch.column(0).to_numpy(), _matrix(batch.column(1)))
        yield best.batch()

    return stored.mapInArrow(scan, HITS)


def _grid(asked: DataFrame, stored: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
    """Block join: each question block meets each corpus block in one bounded task group."""
    stored = settle(stored)

    def blocks(side: DataFrame) -> int:
        # As many as keep the machines busy, so rows are copied no more often as tables grow, until blocks are full.
        count = side.count()
        return max(1, math.ceil(count / (block_rows or count or 1)), min(GRID, math.ceil(count / GRID_ROWS)), size_in_blocks(side, BLOCK_BYTES))

    n_q, n_c = blocks(asked), blocks(stored)

    def cut(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int").alias(own)
        return df.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    left = cut(asked, "q_block", n_q, "c_block", n_c).groupBy("q_block", "c_block")
    right = cut(stored, "c_block", n_c, "q_block", n_q).groupBy("q_block", "c_block")

    def meet(questions: pa.Table, vectors: pa.Table) -> pa.Table:
        if not questions.num_rows:
            return _TopK(np.empty(0, np.int64), np.empty((0, 0)), k).table()
        best = _TopK(questions.column("vec_id").to_numpy().astype(np.int64), _matrix(questions.column("v")), k)
        if vectors.num_rows:
            best.add(vectors.column("vec_id").to_numpy(), _matrix(vectors.column("v")))
        return best.table()

    return left.cogroup(right).applyInArrow(meet, HITS)


# Index

ROUNDS = 1


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


class ListMap:
    """What tasks know of the lists: centre, widest angle and longest vector of each, and its blocks.

    Rows meet questions in blocks: a list of more than ``block_rows`` rows is cut into several blocks, and
    neighbouring smaller lists share one. By default there are ``GRID`` blocks of at least ``GRID_ROWS`` rows, or as
    many as are needed for blocks of up to ``BLOCK_BYTES``.
    """

    def __init__(
        self, centres: np.ndarray, radii: np.ndarray, longest: np.ndarray, sizes: np.ndarray, block_rows: int | None = None
    ):
        self.centres, self.radii, self.longest = centres, radii, longest
        most = max(BLOCK_BYTES // (8 * max(centres.shape[1], 1)), 1)
        block_rows = block_rows or min(most, max(GRID_ROWS, -(-int(sizes.sum()) // GRID)))
        self.n_blocks = np.maximum(-(-sizes // block_rows), 1).astype(np.int32)
        self.first_block, block, filled = np.zeros(len(sizes), np.int32), -1, block_rows
        for one, size in enumerate(sizes.tolist()):
            if filled + size > block_rows:
                block, filled = block + 1, 0
            self.first_block[one] = block
            block, filled = block + int(self.n_blocks[one]) - 1, filled + size

    def count_blocks(self) -> int:
        return int((self.first_block + self.n_blocks).max())

    def nearest(self, questions: np.ndarray, n_probe: int) -> np.ndarray:
        """(questions x lists) which lists are the ``n_probe`` nearest of a question."""
        closeness = questions @ self.centres.T
        n_probe = min(n_probe, len(self.centres))
        wanted = np.zeros(closeness.shape, bool)
        np.put_along_axis(wanted, np.argpartition(-closeness, n_probe - 1, axis=1)[:, :n_probe], True, axis=1)
        return wanted

    def best_possible(self, questions: np.ndarray) -> np.ndarray:
        """Upper bound of the score in each list: the angle to the centre less the list's widest angle."""
        lengths = np.linalg.norm(questions, axis=1, keepdims=True)
        cosines = (questions @ self.centres.T) / np.maximum(lengths, 1e-12)
        nearest = np.cos(np.maximum(np.arccos(np.clip(cosines, -1.0, 1.0)) - self.radii, 0.0))
        # The slack covers rounded scores and float noise in the angles.
        return lengths * self.longest * np.maximum(nearest, 0.0) + 1e-5

    def blocks_of(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question place, block, list) for every block of every wanted list, in that order."""
        question, one = np.nonzero(wanted)
        times = self.n_blocks[one]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        question, block, one = np.repeat(question, times), np.repeat(self.first_block[one], times) + within, np.repeat(one, times)
        order = np.lexsort((one, block, question))
        return question[order], block[order], one[order]


class VectorIndex:
    """Corpus rows ``vec_id, v, list_id`` and the map of their lists."""

    def __init__(self, table: DataFrame, lists: ListMap):
        self.table, self.lists = table, lists

    def rows(self) -> DataFrame:
        """``vec_id, v, list_id, block_id``."""
        blocks = zip(self.lists.first_block.tolist(), self.lists.n_blocks.tolist(), strict=True)
        layout = self.table.sparkSession.createDataFrame(
            [(i, first, n) for i, (first, n) in enumerate(blocks)], "list_id int, _first int, _n int"
        )
        # Bounded: one row per list, and lists are as many as the square root of the corpus.
        placed = self.table.join(F.broadcast(layout), "list_id")
        block = F.col("_first") + F.pmod(F.xxhash64("vec_id"), F.col("_n")).cast("int")
        return placed.select("vec_id", "v", "list_id", block.alias("block_id"))


def centres_of(stored: DataFrame, n_lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres: distinct rows to begin with, then ``rounds`` times the mean of the rows nearest to each.

    Only centres and their sums, ``n_lists`` rows, come to the driver. All rows take part in every mean.
    """
    # Copies of a vector would begin as the same centre, so some more rows are looked at.
    begin = stored.orderBy(F.xxhash64("vec_id"), "vec_id").limit(3 * n_lists).select("v").toArrow()
    centres = _unit(np.unique(_matrix(begin.column("v")), axis=0))
    centres = centres[np.random.default_rng(7).permutation(len(centres))[:n_lists]]
    for _ in range(rounds):

        def add_up(batches: Iterator[pa.RecordBatch], now: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            sums = np.zeros_like(now)
            for batch in batches:
                if batch.num_rows:
                    unit = _unit(_matrix(batch.column(0)))
                    np.add.at(sums, (unit @ now.T).argmax(axis=1), unit)
            yield pa.RecordBatch.from_pydict({"list_id": np.arange(len(now), dtype=np.int32), "s": list(sums)})

        parts = stored.select("v").mapInArrow(add_up, "list_id int, s array<double>")
        total = parts.select("list_id", F.posexplode("s").alias("at", "x")).groupBy("list_id", "at").agg(F.sum("x").alias("x")).toArrow()
        sums = np.zeros_like(centres)
        sums[total.column("list_id").to_numpy(), total.column("at").to_numpy()] = total.column("x").to_numpy()
        moved = np.linalg.norm(sums, axis=1) > 1e-9
        centres = np.where(moved[:, None], _unit(sums), centres)
    return centres


def place_in_lists(stored: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows (``vec_id``, ``v``, and any others) with the list of the nearest centre, the angle to it and the length."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema]
    at, names = stored.columns.index("v"), [*stored.columns, "angle", "norm", "list_id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column(at))
                norms = np.linalg.norm(vectors, axis=1)
                cosines = (vectors @ centres.T) / np.maximum(norms, 1e-12)[:, None]
                lists = cosines.argmax(axis=1)
                angles = np.arccos(np.clip(cosines[np.arange(len(lists)), lists], -1.0, 1.0))
                added = map(pa.array, (angles, norms, lists.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    return stored.mapInArrow(place, ", ".join([*fields, "angle double, norm double, list_id int"]))


def list_stats(placed: DataFrame, n_lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(widest angle, longest vector, rows) of every list."""
    reach = placed.groupBy("list_id").agg(F.max("angle").alias("radius"), F.max("norm").alias("longest"), F.count(F.lit(1)).alias("n"))
    radii, longest, sizes = np.zeros(n_lists), np.zeros(n_lists), np.zeros(n_lists, np.int64)
    for row in reach.collect():  # n_lists rows
        radii[row["list_id"]], longest[row["list_id"]], sizes[row["list_id"]] = row["radius"], row["longest"], row["n"]
    return radii, longest, sizes


def build_index(
    corpus: DataFrame, n_lists: int | None = None, vec_id: str = "vec_id", vec: str = "embedding",
    path: str | None = None, block_rows: int | None = None,
) -> VectorIndex:
    """Group vectors into ``n_lists`` lists around centres; with ``path``, store them one folder per list.

    Stored lists are partitions, so a search reads only the lists it probes. Without ``n_lists`` there
    are as many as the square root of the corpus, so lists grow no faster than their number does. All
    rows place the centres; exact searches do not depend on them.
    """
    stored = _vectors(corpus, vec_id, vec)
    n_lists = n_lists or max(1, math.isqrt(stored.count()))
    # A zero vector has no direction, so it places no centre.
    centres = centres_of(stored.where(F.exists("v", lambda x: x != 0)), n_lists)
    if not len(centres):
        centres = np.ones((1, stored.agg(F.max(F.size("v"))).first()[0] or 1))
    placed = place_in_lists(stored, centres)
    if path:
        placed.write.mode("overwrite").partitionBy("list_id").parquet(path)
        placed = corpus.sparkSession.read.schema(placed.schema).parquet(path)
    else:
        placed = settle(placed)
    return VectorIndex(placed, ListMap(centres, *list_stats(placed, len(centres)), block_rows))


def search_index(
    index: VectorIndex,
    questions: DataFrame,
    k: int = 4,
    n_probe: int = 4,
    exact: bool = True,
    vec_id: str = "vec_id",
    vec: str = "embedding",
    max_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Top k per question from the nearest ``n_probe`` lists, then from every list that could still hold a better one.

    Questions choose their lists inside tasks, and (question, block) rows are joined with the index by block,
    so neither side passes through the driver and no task holds more than one block and ``max_bytes`` of
    questions. A question is sent to a block once, however many of its lists it asks. The angle between question and
    centre, less the list's widest angle, bounds the best score in a list; the second pass joins each question's k-th
    score and asks the lists whose bound reaches it, so the answer equals a full scan. ``exact=False`` stops after the
    first pass and scores the nearest lists only.
    """
    asked, lists = _vectors(questions, vec_id, vec), index.lists
    kind = asked.schema["v"].dataType.simpleString()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUESTION_SLICE):
                part = batch.slice(at, QUESTION_SLICE)
                chosen = lists.nearest(_matrix(part.column(1)), n_probe)
                ends = np.r_[0, np.cumsum(chosen.sum(axis=1))].astype(np.int32)
                near = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(chosen)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, near], names=["vec_id", "v", "near"])

    asked = settle(asked.select(F.col("vec_id").cast("bigint").alias("vec_id"), "v").mapInArrow(near, f"vec_id bigint, v {kind}, near array<int>"))
    parts = max(size_in_blocks(asked, max_bytes), min(GRID, math.ceil(asked.count() / GRID_ROWS)))
    every = exact and lists.count_blocks() == 1

    def nearest(matrix: np.ndarray, kth: np.ndarray, met: np.ndarray) -> np.ndarray:
        return np.ones_like(met) if every else met

    def possible(matrix: np.ndarray, kth: np.ndarray, met: np.ndarray) -> np.ndarray:
        return (lists.best_possible(matrix) >= kth[:, None]) & ~met

    first = _probe(index, asked.withColumn("kth", F.lit(float("-inf"))), nearest, k, parts)
    if not exact or every:
        return _ranked(first, k)
    first = settle(_ranked(first, k).drop("rank"))
    worst = first.groupBy(F.col("question_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_kth"))
    kth = F.when(F.col("_n") >= k, F.col("_kth")).otherwise(F.lit(float("-inf")))
    left = asked.join(worst, "vec_id", "left").select("vec_id", "v", "near", kth.alias("kth"))
    return _ranked(first.unionByName(_probe(index, left, possible, k, parts)), k)


def _probe(index: VectorIndex, asked: DataFrame, choose: Callable, k: int, parts: int) -> DataFrame:
    """Hits of the questions (``vec_id, v, near, kth``) in the lists that ``choose`` gives them, and in no others."""
    lists = index.lists
    kind = asked.schema["v"].dataType.simpleString()

    def wanted_of(part: pa.Table | pa.RecordBatch) -> np.ndarray:
        near = part.column("near")
        near = near.combine_chunks() if isinstance(near, pa.ChunkedArray) else near
        met = np.zeros((part.num_rows, len(lists.centres)), bool)
        met[np.repeat(np.arange(len(met)), np.asarray(near.value_lengths())), near.flatten().to_numpy()] = True
        return choose(_matrix(part.column("v")), part.column("kth").to_numpy(), met)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUESTION_SLICE):
                part = batch.slice(at, QUESTION_SLICE)
                question, block, _ = lists.blocks_of(wanted_of(part))
                if len(question):
                    once = np.r_[True, (np.diff(question) != 0) | (np.diff(block) != 0)]
                    own = part.take(pa.array(question[once]))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(block[once].astype(np.int32))], names=[*own.schema.names, "block_id"])

    part_of = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    picked = asked.mapInArrow(pick, f"vec_id bigint, v {kind}, near array<int>, kth double, block_id int")
    probes = settle(picked.withColumn("part", part_of))
    needed = probes.select(F.col("block_id").alias("_block"), F.col("part").alias("_part")).distinct()
    rows = index.rows().join(needed, F.col("block_id") == F.col("_block")).drop("_block").withColumnRenamed("_part", "part")

    def meet(questions: pa.Table, vectors: pa.Table) -> pa.Table:
        ids = questions.column("vec_id").to_numpy().astype(np.int64)
        if not len(ids) or not vectors.num_rows:
            return _TopK(np.empty(0, np.int64), np.empty((0, 0)), k).table()
        best = _TopK(ids, _matrix(questions.column("v")), k)
        row_ids, matrix = vectors.column("vec_id").to_numpy().astype(np.int64), _matrix(vectors.column("v"))
        here, of_row = np.unique(vectors.column("list_id").to_numpy(), return_inverse=True)
        slices = range(0, len(ids), QUESTION_SLICE)
        wanted = np.concatenate([wanted_of(questions.slice(at, QUESTION_SLICE))[:, here] for at in slices])
        order = np.argsort(of_row, kind="stable")
        ends = np.searchsorted(of_row[order], np.arange(len(here) + 1))
        for one in range(len(here)):
            own = order[ends[one] : ends[one + 1]]
            best.add(row_ids[own], matrix[own], np.flatnonzero(wanted[:, one]))
        return best.table()

    return probes.groupBy("block_id", "part").cogroup(rows.groupBy("block_id", "part")).applyInArrow(meet, HITS)


def ann_recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Share of the exact hits that a search found, per question."""
    pair = ["question_id", "vec_id"]
    marked = exact.select(*pair).join(found.select(*pair, F.lit(1.0).alias("_found")), pair, "left")
    return marked.groupBy("question_id").agg(F.round(F.avg(F.coalesce("_found", F.lit(0.0))), 6).alias("recall"))


# Text to vector


def embed(df: DataFrame, fn: Callable, text: str = "text", name: str = "embedding") -> DataFrame:
    """Add vectors from ``fn(pandas.Series of text) -> sequence of float lists``, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(list(fn(texts)))

    return df.withColumn(name, encode(text))


WORD_BREAK = r"[^\p{L}\p{N}]+"


def _lower_words(text: str) -> Column:
    """Lower-case runs of letters and digits, in order; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), WORD_BREAK), lambda w: w != "")


def word_dictionary(df: DataFrame, text: str = "text", dims: int = 256) -> DataFrame:
    """``word, slot, rarity`` of every word of all texts.

    The slot is the number of the first eight hexadecimal digits of the word's MD5, modulo ``dims``; rarity is
    ln((texts + 1) / (texts with the word + 1)).
    """
    return _word_texts(df, text, dims).drop("_texts")


def _word_texts(df: DataFrame, text: str, dims: int) -> DataFrame:
    """The dictionary with ``_texts``, the number of texts that have the word."""
    once = df.select(F.explode(F.array_distinct(_lower_words(text))).alias("word"))
    known = once.groupBy("word").agg(F.count(F.lit(1)).alias("_texts"))
    slot = F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 8), 16, 10).cast("bigint") % dims
    rarity = F.log((F.lit(df.count()) + 1) / (F.col("_texts") + 1))
    return known.select("word", slot.cast("int").alias("slot"), rarity.alias("rarity"), "_texts")


def _common_from(dictionary: DataFrame, max_bytes: int) -> int:
    """Least power of two such that the words of at least so many texts stay within ``max_bytes``."""
    power = F.floor(F.log2("_texts")).cast("int").alias("power")
    sizes = dictionary.groupBy(power).agg(F.sum(F.octet_length("word") + 16 * len(dictionary.columns)).alias("bytes"))
    total, least = 0, 0
    for row in sizes.orderBy(F.desc("power")).collect():  # at most 64 rows
        total += row["bytes"]
        if total > max_bytes:
            least = row["power"] + 1
            break
    return 1 << least


def embed_words(
    df: DataFrame, text: str = "text", name: str = "embedding", dims: int = 256, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Built-in encoder without a model: hashed words, weighted by rarity, scaled to unit length.

    The dictionary may have any size: words that many texts have are broadcast, as many as ``max_bytes`` hold, and
    only the occurrences of the rest, which are few texts a word, are shuffled to meet their entries. Texts are
    brought to their key once and add up there. Rows are named by two hashes of all their columns, so equal rows
    share a vector. A text without words, or only with words that every text has, gets zeros.
    """
    key = {"_k1": F.xxhash64(*df.columns), "_k2": F.xxhash64(F.lit("second"), *df.columns)}
    keyed = df.withColumns(key)
    dictionary = settle(_word_texts(df, text, dims))
    common_from = _common_from(dictionary, max_bytes)
    common = F.broadcast(dictionary.where(F.col("_texts") >= common_from).select("word", "slot", "rarity"))

    def sums(weighted: DataFrame) -> DataFrame:
        slots = weighted.groupBy(*key, "slot").agg(F.sum("w").alias("w")).where("w > 0")
        return slots.groupBy(*key).agg(F.collect_list(F.struct("slot", "w")).alias("_w"))

    texts = keyed.select(*key, text).dropDuplicates(list(key))
    words = texts.select(*key, F.explode(_lower_words(text)).alias("word"))
    slots = sums(words.join(common, "word").select(*key, "slot", F.col("rarity").alias("w")))
    rows = keyed.join(slots, list(key), "left")
    entries = F.coalesce("_w", F.array())
    if common_from > 1:
        # Rows of a rare word are fewer than the texts that make a word common, so no word is hot here.
        rare = dictionary.where(F.col("_texts") < common_from).select("word", "slot", "rarity")
        counts = words.join(common, "word", "left_anti").groupBy(*key, "word").agg(F.count(F.lit(1)).alias("_tf"))
        further = sums(counts.join(rare, "word").select(*key, "slot", (F.col("_tf") * F.col("rarity")).alias("w")))
        rows = rows.join(further.withColumnRenamed("_w", "_rare"), list(key), "left")
        entries = F.concat(entries, F.coalesce("_rare", F.array()))

    @F.arrow_udf("array<float>")
    def scaled(given: pa.Array) -> pa.Array:
        found = given.flatten()
        lengths = np.asarray(given.value_lengths().fill_null(0))
        dense = np.zeros((len(given), dims))
        place = np.repeat(np.arange(len(given)), lengths), found.field("slot").to_numpy(zero_copy_only=False)
        np.add.at(dense, place, found.field("w").to_numpy(zero_copy_only=False))
        dense /= np.maximum(np.sqrt((dense * dense).sum(axis=1, keepdims=True)), np.finfo(np.float64).tiny)
        ends = pa.array(np.arange(len(given) + 1, dtype=np.int32) * dims)
        return pa.ListArray.from_arrays(ends, pa.array(dense.astype(np.float32).ravel()))

    return rows.select(*df.columns, scaled(entries).alias(name))


# Context and checks


def in_scope(hits: DataFrame, min_score: float) -> DataFrame:
    """Per question its best score and whether that is enough to answer at all."""
    best = hits.groupBy("question_id").agg(F.max("score").alias("best_score"))
    return best.withColumn("in_scope", F.col("best_score") >= min_score)


def assemble_context(
    hits: DataFrame, texts: DataFrame, questions: DataFrame, template: str = PROMPT, sep: str = "\n\n"
) -> DataFrame:
    """Prompt per question: the texts of its k hits in rank order, put into the template with the question.

    ``texts`` is (vec_id, text), ``questions`` is (question_id, question). A group holds k texts; hits whose
    text is missing add nothing.
    """
    found = texts_of(settle(hits), texts).where(F.col("text").isNotNull()).select("question_id", "rank", "text")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))["text"]
    contexts = found.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_texts"), ordered.alias("_texts"))
    joined = questions.join(contexts, "question_id", "left")
    prompt = fill_template(template, context=F.coalesce(F.array_join("_texts", sep), F.lit("")), question="question")
    return joined.select("question_id", F.coalesce("n_texts", F.lit(0)).alias("n_texts"), prompt.alias("prompt"))


def label_precision_at_k(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of a question's hits that carry its own label; a hit on itself does not count."""
    others = hits.where(F.col("question_id") != F.col("vec_id"))
    table = labels.select("vec_id", "label")
    marked = lookup_join(others, table, ["vec_id"], "inner", "question_id")
    own = table.select(F.col("vec_id").alias("question_id"), F.col("label").alias("_own"))
    marked = lookup_join(marked, own, ["question_id"], "inner", "vec_id")
    return marked.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.round(F.avg((F.col("label") == F.col("_own")).cast("double")), 6).alias("precision"),
    )
