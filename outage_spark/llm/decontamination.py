"""Benchmark decontamination by a distributed positional inverted index.

The index is stored, split by documents: a row holds the terms of one document that the benchmark uses
and, for each, the list of its places. A window of an item is looked up from its rarest term (fewest
places in all training texts): the term's places less its offset in the window are possible starts, and
the lists of the next terms, adjusted by their offsets, are intersected with them until the starts left
are the exact occurrences, or none is.

Only places that can matter are stored: a place inside a run of benchmark words shorter than the
shortest window that any of them begins in cannot belong to an occurrence. This loses nothing, and the
index is about as large as what benchmark and corpus share. As lists of one document lie together, a
frequent term or a passage that a third of all documents contain is as spread as the documents are;
nothing is shuffled but counts and matches.

The benchmark is the query set. Its items go to the tasks in blocks of about ``block_words`` words, with
one pass over the documents for each, so what is broadcast has a bound whatever the benchmark's size.

Words are runs of digits, letters and characters outside ASCII, with A-Z lower-cased.

Defined results: a null text has no words and is never hit; an item without words matches nothing; a
null ``doc_id`` is matched null-safely, with the hash of the text; repeated rows get equal results;
items count by their distinct ids, and one without an id hits words and marks texts as contaminated like
any other but is in no count or list of ids; empty tables give empty results or no hits; other columns pass
through ``decontaminate`` and are ignored elsewhere.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outage_spark.llm.text import NOT_ALNUM, nullable, split_alnum_words, store, table, word_count

WINDOW = 10
BLOCK_WORDS = 1_000_000
KEY = ("doc_id", "row_key")


@dataclass
class Block:
    """A bounded part of the benchmark: its terms by number, and its distinct windows with their items."""

    terms: dict[bytes, int]
    least: np.ndarray  # per term, the fewest words of a window that has it
    windows: dict[tuple, set[str]]

    @classmethod
    def of(cls, items: list[tuple[str, list[bytes]]], size: int) -> Block:
        terms: dict[bytes, int] = {}
        windows: dict[tuple, set[str]] = defaultdict(set)
        for item, words in items:
            ids = [terms.setdefault(w, len(terms)) for w in words]
            for start in range(max(1, len(ids) - size + 1) if ids else 0):
                windows[tuple(ids[start : start + size])].add(item)
        least = np.full(max(1, len(terms)), size, np.int64)
        for window in windows:
            if len(window) < size:
                least[list(window)] = np.minimum(least[list(window)], len(window))
        return cls(terms, least, dict(windows))


def benchmark_blocks(
    items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW, block_words: int = BLOCK_WORDS
) -> Iterator[Block]:
    """The items in blocks; each is read alone, so the driver holds one at a time."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("body"))
    rows = store(rows.where(F.col("body").isNotNull()))
    total = rows.agg(F.sum(word_count("body", NOT_ALNUM))).first()[0] or 0
    n_blocks = max(1, -(-total // block_words))
    block = F.pmod(F.xxhash64("item"), F.lit(n_blocks))
    for number in range(n_blocks):
        part = rows.where(block == number)
        yield Block.of([(r.item, split_alnum_words(r.body)) for r in part.toLocalIterator()], size)


def _in_runs(ids: np.ndarray, least: np.ndarray, gap: int, missing: int) -> np.ndarray:
    """Places of terms in runs that are long enough for some window; up to ``gap`` other words may lie between."""
    places = np.flatnonzero(ids >= 0)
    if not len(places):
        return places
    breaks = np.flatnonzero(np.diff(places) > gap + 1) + 1
    starts, ends = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(places)]))
    shortest = np.minimum.reduceat(least[ids[places]], starts) - missing
    return places[np.repeat(ends - starts >= shortest, ends - starts)]


def build_index(
    docs: DataFrame, block: Block, doc_id: str = "doc_id", text: str = "text", gap: int = 0, missing: int = 0
) -> DataFrame:
    """The stored index: ``doc_id, row_key`` (hash of the text), ``terms`` and for each its ``places``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row_key"), F.col(text).alias("_text"))
    lists = F.array().cast("array<array<int>>").alias("places")
    schema = nullable(rows.select(*KEY, F.array().cast("array<int>").alias("terms"), lists).schema)
    shared = docs.sparkSession.sparkContext.broadcast((block.terms, block.least))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, least = shared.value
        look = known.get
        for batch in batches:
            at, terms, places = [], [], []
            for r, body in enumerate(batch.column(2)):
                words = split_alnum_words(body.as_py())
                ids = np.fromiter((look(w, -1) for w in words), np.int64, len(words))
                kept = _in_runs(ids, least, gap, missing)
                if len(kept):
                    order = kept[np.argsort(ids[kept], kind="stable")]
                    cuts = np.flatnonzero(np.diff(ids[order])) + 1
                    lists = np.split(order.astype(np.int32), cuts)
                    at.append(r)
                    places.append(lists)
                    terms.append([ids[part[0]] for part in lists])
            take = pa.array(at, pa.int64())
            columns = [batch.column(0).take(take), batch.column(1).take(take)]
            columns += [pa.array(terms, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, [*KEY, "terms", "places"])

    return store(rows.mapInArrow(read, schema))


def _plans(index: DataFrame, block: Block, first: int = 1) -> dict[int, list[tuple]]:
    """Windows by each of their ``first`` rarest terms: (terms from rarest on as (offset, term), window)."""
    # One number per term of the block.
    counts = index.select(F.explode(F.arrays_zip("terms", "places")).alias("t")).groupBy("t.terms")
    frequency = dict(counts.agg(F.sum(F.size("t.places"))).collect())
    plans: dict[int, list[tuple]] = defaultdict(list)
    for window in block.windows:
        order = sorted(range(len(window)), key=lambda o: (frequency.get(window[o], 0), o))
        plan = tuple((o, window[o]) for o in order)
        for _, term in dict.fromkeys((0, term) for _, term in plan[:first]):
            plans[term].append((plan, window))
    return dict(plans)


def _matches(index: DataFrame, block: Block, plans: dict, look_up) -> DataFrame:
    """``doc_id, row_key, item, start, n_terms``: what ``look_up(lists, plan)`` finds in each document."""
    schema = nullable(
        index.select(*KEY, F.lit("").alias("item"), F.lit(0).alias("start"), F.lit(0).alias("n_terms")).schema
    )
    shared = index.sparkSession.sparkContext.broadcast((plans, block.windows))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, windows = shared.value
        for batch in batches:
            at, found = [], []
            for r in range(batch.num_rows):
                lists = dict(zip(batch.column(2)[r].as_py(), map(np.array, batch.column(3)[r].as_py())))
                seen = set()
                for term in lists:
                    for plan, window in plans.get(term, ()):
                        if window in seen:
                            continue
                        starts = look_up(lists, plan)
                        if len(starts):
                            seen.add(window)
                        for start in starts:
                            for item in windows[window]:
                                at.append(r)
                                found.append((item, int(start), len(window)))
            take = pa.array(at, pa.int64())
            items, starts, sizes = zip(*found) if found else ((), (), ())
            columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(items, pa.string())]
            columns += [pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*KEY, "item", "start", "n_terms"])

    return index.mapInArrow(read, schema)


def _exact(lists: dict, plan: tuple) -> np.ndarray:
    """Starts of the window: lists adjusted by their offsets, intersected from the rarest term on."""
    starts = None
    for offset, term in plan:
        places = lists.get(term)
        if places is None:
            return np.empty(0, np.int64)
        adjusted = places - offset
        starts = adjusted[adjusted >= 0] if starts is None else np.intersect1d(starts, adjusted, assume_unique=True)
        if not len(starts):
            break
    return starts


def phrase_matches(index: DataFrame, block: Block) -> DataFrame:
    """Every exact occurrence of every window of the block."""
    return _matches(index, block, _plans(index, block), _exact)


def proximity_matches(index: DataFrame, block: Block, slop: int = 3, missing: int = 2) -> DataFrame:
    """Starts where all but ``missing`` terms of a window lie within its span, widened by ``slop`` on both sides.

    ``index`` must have been built with ``gap`` of at least ``2 * slop + missing`` and the same ``missing``.
    Starts are taken from the ``missing + 1`` rarest terms, one of which every such match has.
    """

    def near(lists: dict, plan: tuple) -> list[int]:
        n, found = len(plan), []
        for offset, term in plan[: missing + 1]:
            for start in lists.get(term, np.empty(0, np.int64)) - offset:
                low, high = start - slop, start + n + slop
                held = sum(np.searchsorted(p, high) > np.searchsorted(p, low) for p in (lists.get(t, ()) for _, t in plan) if len(p))
                if held >= max(1, n - missing):
                    found.append(max(0, int(start)))
        return sorted(set(found))

    return _matches(index, block, _plans(index, block, missing + 1), near)


def find_contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``doc_id, row_key, n_hit, items`` (sorted) for the texts that hold a window; one row per distinct pair."""
    hits = None
    for block in benchmark_blocks(items, size=size, block_words=block_words):
        found = phrase_matches(build_index(docs, block, doc_id, text), block)
        hits = found if hits is None else hits.unionByName(found)
    # Distinct windows first: a text has at most as many as it has words, whatever the number of copies.
    spans = hits.groupBy(*KEY, "start").agg(F.max("n_terms").alias("n"), F.collect_set("item").alias("items"))
    grouped = spans.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("start", "n"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))
    covered = F.aggregate(
        "spans",
        state,
        lambda a, s: F.struct(
            F.greatest(a.end, s.start + s.n).alias("end"),
            (a.hit + F.greatest(s.start + s.n - F.greatest(a.end, s.start), F.lit(0))).alias("hit"),
        ),
    )
    return grouped.select(*KEY, covered.hit.cast("bigint").alias("n_hit"), "items")


def _with_hits(docs: DataFrame, hits: DataFrame, doc_id: str) -> DataFrame:
    """``docs`` (with ``_row_key``) joined null-safely to the hits of their texts."""
    hits = hits.select(*[F.col(c).alias(f"_hit_{c}") for c in hits.columns])
    match = F.col(doc_id).eqNullSafe(F.col("_hit_doc_id")) & (F.col("_row_key") == F.col("_hit_row_key"))
    return docs.join(hits, match, "left")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those that hold a window of a benchmark item."""
    hits = store(find_contamination(docs, items, doc_id, text, **options))
    # The row as one value, so that its names cannot clash with those of the hits.
    rows = docs.select(F.struct("*").alias("doc"), F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_row_key"))
    return _with_hits(rows, hits, "_id").where(F.col("_hit_n_hit").isNull()).select("doc.*")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("_row_key"), word_count("text", NOT_ALNUM).alias("n_words"))
    items = F.coalesce(F.col("_hit_items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("_hit_n_hit"), F.lit(0).cast("bigint"))
    return _with_hits(rows, hits, "doc_id").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP6_SQL = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS k, least(len(w), 10) AS n FROM starts),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, windows.n FROM places JOIN windows USING (k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
