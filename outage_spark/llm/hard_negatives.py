"""Hard negatives: the best rows of other labels whose score lies in a band under a positive's score.

Every vector is kept as integers ``floor(256 * x)`` and, besides, as rotated one-bit codes: the signs of the
rotated vector, the alignment of the vector with its code vector, and the length of what the code leaves
over; the rest is coded again, ``LEVELS`` times. Anchors are compared with codes first: products of matrices of a
block of anchors with the vectors that the codes stand for give estimates, and by Cauchy-Schwarz the part left over by
the codes is at most the product of the lengths at right angles to the code vector. So every score lies in a known
interval, without any probability. A pair is dropped only where its interval cannot reach the ranks asked for; the
scores of all others are computed in integers, so results are exact. Every anchor meets every row once, so the number of
pairs grows with the square of the rows; what is held at once does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outage_spark.llm.text import store, table
from outage_spark.llm.vectors import Rotation, finite, lists, matrix, meet, numbered, width_of
from outage_spark.operators.spread import first_per_key, top_per_key

SCALE = 256.0
LEVELS = 6
POSITIVES = 5
NEGATIVES = 3
# Pairs of an anchor and a row whose estimates are held at once.
PAIRS = 1 << 18
FOUND = "anchor_id bigint, slot int, other_id bigint, score bigint"
CODED = (
    "vec_id bigint, label bigint, ints array<bigint>, codes array<bigint>, aligned array<double>, rest array<double>"
)


class OneBitCodes:
    """Codes of integer vectors, and the intervals that they give for scores."""

    def __init__(self, width: int, seed: int = 11, levels: int = LEVELS):
        self.rotate = Rotation(width, seed, 64)
        self.levels, self.bits = levels, self.rotate.width
        self.words = self.bits // 64

    def _pack(self, marks: np.ndarray) -> np.ndarray:
        return np.packbits(marks, axis=1, bitorder="little").view(np.uint64)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, alignments, lengths of what is left) of every level."""
        left = self.rotate(vectors)
        codes, aligned, rest = [], [], []
        for _ in range(self.levels):
            signs = left >= 0
            codes.append(self._pack(signs))
            code_vector = np.where(signs, 1.0, -1.0) / np.sqrt(self.bits)
            along = (left * code_vector).sum(axis=1)
            left = left - along[:, None] * code_vector
            aligned.append(along)
            rest.append(np.sqrt((left * left).sum(axis=1)))
        return np.concatenate(codes, axis=1), np.stack(aligned, 1), np.stack(rest, 1)


class _Query:
    """A rotated anchor, or several as rows of a matrix."""

    def __init__(self, codes: OneBitCodes, rotated: np.ndarray):
        self.rotated = rotated
        self.length = np.sqrt((rotated * rotated).sum(axis=-1, keepdims=True))


class _Rows:
    """A block of coded rows."""

    def __init__(self, codes: OneBitCodes, block: pa.Table, width: int):
        self.codes = codes
        self.ids = block.column("vec_id").to_numpy()
        self.labels = block.column("label").to_numpy()
        self.ints = matrix(block.column("ints"), width, np.int64)
        packed = matrix(block.column("codes"), codes.levels * codes.words, np.int64).view(np.uint64)
        self.bits = packed.reshape(len(self.ids), codes.levels, codes.words)
        self.aligned = matrix(block.column("aligned"), codes.levels)
        self.rest = matrix(block.column("rest"), codes.levels)
        self.floats = self.ints.astype(np.float64)
        self.lengths = np.sqrt((self.floats * self.floats).sum(axis=1))

    def signs(self, level: int, at: np.ndarray | slice) -> np.ndarray:
        """The code vectors of a level."""
        marks = np.unpackbits(np.ascontiguousarray(self.bits[at, level]).view(np.uint8), axis=1, bitorder="little")
        return (2.0 * marks - 1.0) / np.sqrt(self.codes.bits)

    def decoded(self, levels: int) -> np.ndarray:
        """The vectors that the first levels stand for."""
        out = np.zeros((len(self.ids), self.codes.bits))
        for level in range(levels):
            out += self.aligned[:, level, None] * self.signs(level, slice(None))
        return out

    def interval(
        self, query: _Query, level: int, at: np.ndarray | slice, before: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(estimate, least, most) of the scores of rows ``at``; ``before`` is the estimate of the levels before."""
        along = query.rotated @ self.signs(level, at).T
        estimate = before + self.aligned[at, level] * along
        half = self.rest[at, level] * np.sqrt(np.maximum(query.length**2 - along**2, 0.0))
        half += 1e-9 * (1.0 + self.lengths[at] * query.length)
        return estimate, estimate - half, estimate + half

    def scores(self, anchor: np.ndarray, length: float, at: np.ndarray) -> np.ndarray:
        """Integer inner products; doubles are exact while every partial sum is below 2^53."""
        if not len(at):
            return np.empty(0, np.int64)
        if length * self.lengths[at].max() < 2.0**52:
            return np.rint(self.floats[at] @ anchor.astype(np.float64)).astype(np.int64)
        return (self.ints[at] * anchor).sum(axis=1)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _lengths(vectors: np.ndarray) -> list[float]:
    floats = vectors.astype(np.float64)
    return np.sqrt((floats * floats).sum(axis=1)).tolist()


def _reached(values: np.ndarray, k: int, groups: int = 64) -> np.ndarray:
    """A value that at least k of each row's reach, near the k-th largest: the k-th of the largest of groups."""
    if values.shape[1] > 4 * max(groups, k):
        groups = max(groups, k)
        part = values.shape[1] // groups
        values = values[:, : part * groups].reshape(len(values), part, groups).max(axis=1)
    n = values.shape[1]
    return np.partition(values, n - k, axis=1)[:, n - k] if n >= k else np.full(len(values), -np.inf)


def may_rank(
    rows: _Rows,
    decoded: np.ndarray,
    rotated: np.ndarray,
    out: np.ndarray,
    low: np.ndarray,
    least_high: np.ndarray,
    high: np.ndarray,
    k: int,
) -> Iterator[np.ndarray]:
    """For each anchor the places of the rows that may be among the k best of a band, by their codes.

    ``decoded`` holds what all levels of the rows but the last stand for. ``out`` marks pairs that take no part. The bands of an anchor begin at ``low`` or above and end between
    ``least_high`` and ``high``. k rows at most ``least_high`` lie in each band that begins under them, so no row
    under all of them can be among the k best of any band.
    """
    last = rows.codes.levels - 1
    _, least, most = rows.interval(_Query(rows.codes, rotated), last, slice(None), rotated @ decoded.T)
    np.copyto(most, -np.inf, where=out)
    np.copyto(least, -np.inf, where=out)
    floor = np.maximum(low, _reached(np.where(most <= least_high[:, None], least, -np.inf), k))
    keep = (most >= floor[:, None]) & (least <= high[:, None])
    for row in keep:
        yield np.flatnonzero(row)


def best(rows: _Rows, anchor: np.ndarray, length: float, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row places, scores) of the k best of rows ``at``, exactly."""
    scores = rows.scores(anchor, length, at)
    order = _first(scores, rows.ids[at], k)
    return at[order], scores[order]


def best_in_bands(
    rows: _Rows, anchor: np.ndarray, length: float, at: np.ndarray, bands: list[tuple[int, int]], k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(band, row places, scores) of the k best of rows ``at`` with scores in each band (low, high), exactly."""
    scores = rows.scores(anchor, length, at)
    order = np.lexsort((rows.ids[at], -scores))
    at, scores = at[order], scores[order]
    for band, (low, high) in enumerate(bands):
        begin, end = np.searchsorted(-scores, [-high, -low + 1]).tolist()
        end = min(end, begin + k)
        if begin < end:
            yield band, at[begin:end], scores[begin:end]


def band_under(score: int) -> tuple[int, int]:
    """Integers n with 50 * score <= 100 * n <= 95 * score; none (low > high) under a negative score."""
    return -(-score // 2), score + (-score // 20)


def encode(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", seed: int = 11) -> tuple[DataFrame, int]:
    """(stored codes, vector width) of the rows that take part.

    Left out are rows with a null id, label or vector, or a null or non-finite component, and those whose
    sum of squares passes 2^62, because their scores would not fit a long.
    """
    rows = embeddings.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("v")
    )
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("v"))
    width = width_of(rows, "v")
    codes = OneBitCodes(width, seed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = np.floor(SCALE * matrix(batch.column(2), width))
            fits = (whole * whole).sum(axis=1) <= 2.0**62
            whole, batch = whole[fits], batch.filter(pa.array(fits))
            packed, aligned, rest = codes.encode(whole)
            ints, packed = lists(whole.astype(np.int64)), lists(packed.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), ints, packed, lists(aligned), lists(rest)],
                names=["vec_id", "label", "ints", "codes", "aligned", "rest"],
            )

    return numbered(rows.mapInArrow(work, CODED)), width


def _found(anchors: list, slots: list, ids: list, scores: list) -> pa.Table | None:
    if not ids:
        return None
    sizes = [len(x) for x in ids]
    return pa.table(
        {
            "anchor_id": np.repeat(np.array(anchors, np.int64), sizes),
            "slot": np.repeat(np.array(slots, np.int32), sizes),
            "other_id": np.concatenate(ids),
            "score": np.concatenate(scores),
        }
    )


def mine(coded: DataFrame, width: int, anchors: DataFrame, seed: int = 11, ask_block: int = 4096, row_block: int = 4096) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``coded`` comes from ``encode`` and ``anchors`` are some of its rows. Rows with an anchor's own id are
    neither its positives nor its negatives; an anchor id that occurs repeatedly is taken once, by its least
    (label, vector). Other rows that share an id count one by one.
    """
    codes = OneBitCodes(width, seed)
    anchors = first_per_key(anchors, ["vec_id"], ["label", "ints", "_at"]).select("vec_id", "label", "ints", "_at")
    anchors = store(anchors)

    def pieces(asked: pa.Table, rows: _Rows) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(places, vectors, rotated vectors, which rows are their own) of some anchors at a time."""
        ids, ints = asked.column("vec_id").to_numpy(), matrix(asked.column("ints"), width, np.int64)
        step = max(1, PAIRS // max(1, len(rows.ids)))
        for start in range(0, len(ids), step):
            some = slice(start, start + step)
            yield some, ints[some], codes.rotate(ints[some].astype(np.float64)), ids[some, None] == rows.ids

    def positives_of(asked: pa.Table, block: pa.Table) -> pa.Table | None:
        rows = _Rows(codes, block, width)
        decoded, ids = rows.decoded(codes.levels - 1), asked.column("vec_id").to_numpy()
        owners, found_ids, scores = [], [], []
        for some, ints, rotated, own in pieces(asked, rows):
            ends = np.full(len(ints), np.inf)
            there = may_rank(rows, decoded, rotated, own, np.full(len(ints), np.finfo(np.float64).min), ends, ends, POSITIVES)
            for owner, anchor, length, at in zip(ids[some].tolist(), ints, _lengths(ints), there, strict=True):
                at, score = best(rows, anchor, length, at, POSITIVES)
                owners.append(owner)
                found_ids.append(rows.ids[at])
                scores.append(score)
        return _found(owners, [0] * len(owners), found_ids, scores)

    near = meet(anchors, coded, ["label"], positives_of, FOUND, ask_block, row_block)
    near = top_per_key(near.drop("slot"), ["anchor_id"], [F.desc("score"), F.asc("other_id")], POSITIVES, "slot")
    near = store(near.select("anchor_id", "slot", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # At most POSITIVES scores of an anchor.
    bands = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("_p"))
    asked = anchors.join(bands, "vec_id").withColumn("positives", F.col("_p.positive_score")).drop("_p")

    def negatives_of(asked: pa.Table, block: pa.Table) -> pa.Table | None:
        rows = _Rows(codes, block, width)
        decoded, ids, labels = rows.decoded(codes.levels - 1), asked.column("vec_id").to_numpy(), asked.column("label").to_numpy()
        bands = [[band_under(p) for p in positives] for positives in asked.column("positives").to_pylist()]
        # Bands without any score do not count; an anchor that has no other band asks for nothing.
        ends = [[b for b in own if b[0] <= b[1]] or [(np.inf, -np.inf)] for own in bands]
        low, least_high, high = (np.array([f(b[i] for b in own) for own in ends], np.float64) for f, i in ((min, 0), (min, 1), (max, 1)))
        owners, slots, found_ids, scores = [], [], [], []
        for some, ints, rotated, own in pieces(asked, rows):
            out = own | (labels[some, None] == rows.labels)
            there = may_rank(rows, decoded, rotated, out, low[some], least_high[some], high[some], NEGATIVES)
            for owner, anchor, length, asks, at in zip(ids[some].tolist(), ints, _lengths(ints), bands[some], there, strict=True):
                for band, places, score in best_in_bands(rows, anchor, length, at, asks, NEGATIVES):
                    owners.append(owner)
                    slots.append(band + 1)
                    found_ids.append(rows.ids[places])
                    scores.append(score)
        return _found(owners, slots, found_ids, scores)

    one = F.lit(0).alias("_all")
    far = meet(asked.select("*", one), coded.select("*", one), ["_all"], negatives_of, FOUND, ask_block, row_block)
    far = top_per_key(far, ["anchor_id", "slot"], [F.desc("score"), F.asc("other_id")], NEGATIVES)
    return far.join(near, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    coded, width = encode(rows.withColumn("label", moved))
    return mine(coded, width, coded.where(F.col("vec_id") % 50 == 0))


OP11_SQL = """
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS ints
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS alike,
           CAST(list_dot_product(a.ints, c.ints) AS BIGINT) AS score
    FROM whole a JOIN whole c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), found AS (
    SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS place
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM found WHERE place <= 3
"""
