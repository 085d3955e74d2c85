"""Substring dedup by repeated-phrase automata.

A phrase is a window of 13 consecutive words. A word goes if a phrase over it also starts in a document
with a smaller id.

1. Equal texts are one from the start; only the first document's text is read on.
2. Every phrase has an *anchor*, the least hash of the short word runs inside it, so equal phrases have
   equal anchors and most neighbouring phrases share one. Anchors that occur in two documents mark the
   phrases that can recur.
3. The marked passages travel to the shard of their anchor; equal passages are merged on the way, so a
   passage that a third of all documents share arrives once per task. An anchor with very many passages
   is split by whole phrase.
4. In a shard, phrases that recur are confirmed word for word, compiled into an Aho-Corasick automaton
   over words, and all passages of the shard stream through it. Automata are compiled per
   ``AUTOMATON_PHRASES`` phrases, so their memory has a bound.
5. Occurrences go back to their documents as word spans.

Defined results: null and empty texts have no words; a null ``doc_id`` counts as larger than any other
and never removes words elsewhere but from nothing; rows with equal id and text do not remove each
other's words; empty tables give empty results; other columns pass through ``remove_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outage_spark.llm.text import groups, hash_windows, hash_words, nullable, split_words, store, table
from outage_spark.operators.spread import lookup_join

PHRASE = 13
ANCHOR = 6
AUTOMATON_PHRASES = 50_000
PIECE = 4096
LAST = (1 << 63) - 1


def _anchor_runs(words: np.ndarray, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of phrases with one anchor: the anchors' hashes, the first phrase of each run and the one after its last."""
    n = len(words) - phrase + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    short = hash_windows(words, ANCHOR)
    wide = phrase - ANCHOR + 1
    at = np.lib.stride_tricks.sliding_window_view(short, wide).argmin(axis=1) + np.arange(n)
    first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    return short[at[first]].view(np.int64), first, np.concatenate((first[1:], [n]))


def _anchors(texts: DataFrame, phrase: int) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    schema = nullable(texts.select("id_key", "row_key", F.array(zero).alias("anchors")).schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_anchor_runs(hash_words(split_words(t.as_py())), phrase)[0] for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], schema.names)

    return texts.select("id_key", "row_key", "_text").mapInArrow(read, schema)


def _passages(texts: DataFrame, phrase: int) -> DataFrame:
    """``anchor, piece, row_key, id_key, start, passage`` for the marked runs of ``texts``.

    ``runs`` has the number of each run and, above 32 bits, how many pieces beyond one its anchor has.
    """
    schema = "anchor bigint, piece int, row_key bigint, id_key bigint, start int, passage string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3))
            for id_key, row_key, body, runs in rows:
                words = split_words(body.as_py())
                hashes = hash_words(words)
                anchors, firsts, ends = _anchor_runs(hashes, phrase)
                whole = None
                for mark in runs.as_py():
                    run, pieces = mark & 0xFFFFFFFF, (mark >> 32) + 1
                    first, end, anchor = int(firsts[run]), int(ends[run]), int(anchors[run])
                    if pieces == 1:
                        text = b" ".join(words[first : end + phrase - 1]).decode("utf-8", "surrogatepass")
                        out.append((anchor, 0, row_key, id_key, first, text))
                        continue
                    whole = hash_windows(hashes, phrase) if whole is None else whole
                    for i in range(first, end):
                        text = b" ".join(words[i : i + phrase]).decode("utf-8", "surrogatepass")
                        out.append((anchor, int(whole[i] % np.uint64(pieces)), row_key, id_key, i, text))
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            names = ["anchor", "piece", "row_key", "id_key", "start", "passage"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return texts.select("id_key", "row_key", "_text", "runs").mapInArrow(read, schema)


class _Shard:
    """Passages of some anchors as strings over an alphabet of words: one character per word."""

    def __init__(self, phrase: int):
        self.phrase, self.letters, self.passages, self.phrases = phrase, {}, [], {}

    def _letter(self, word: str) -> str:
        n = self.letters.setdefault(word, len(self.letters) + 1)
        return chr(n if n < 0xD800 else n + 0x800)

    def add(self, key: int, passage: str, least: int, most: int) -> None:
        text = "".join(map(self._letter, passage.split(" ")))
        self.passages.append((key, text))
        for i in range(len(text) - self.phrase + 1):
            window = text[i : i + self.phrase]
            known = self.phrases.get(window)
            self.phrases[window] = (least, most) if known is None else (min(least, known[0]), max(most, known[1]))

    def full(self) -> bool:
        return len(self.phrases) >= AUTOMATON_PHRASES

    def occurrences(self) -> Iterator[tuple[int, list[list[int]]]]:
        """(passage, [first offset, last offset, first document]) for the confirmed phrases in every passage."""
        automaton = ahocorasick.Automaton()
        for window, (least, most) in self.phrases.items():
            if least < most:
                automaton.add_word(window, least)
        if not len(automaton):
            return
        automaton.make_automaton()
        for key, text in self.passages:
            found: list[list[int]] = []
            for end, least in automaton.iter(text):
                at = end - self.phrase + 1
                if found and found[-1][1] == at - 1 and found[-1][2] == least:
                    found[-1][1] = at
                else:
                    found.append([at, at, least])
            if found:
                yield key, found


def _located(passages: DataFrame, phrase: int) -> DataFrame:
    """``passage_key, found`` (low, high: offsets; first: document) of the distinct passages with recurring phrases."""
    distinct = passages.groupBy("anchor", "piece", "passage").agg(F.min("id_key").alias("least"), F.max("id_key").alias("most"))
    distinct = distinct.withColumn("passage_key", F.xxhash64("anchor", "piece", "passage"))
    shards = distinct.repartition("anchor", "piece").sortWithinPartitions("anchor", "piece")

    kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("first", pa.int64())]))

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        found = [[{"low": low, "high": high, "first": first} for low, high, first in spots] for _, spots in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(found, kind)], ["passage_key", "found"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(phrase)
        for part, cuts in groups(batches, ["anchor", "piece"]):
            least, most = part.column("least").to_numpy(), part.column("most").to_numpy()
            keys, passages = part.column("passage_key").to_pylist(), part.column("passage")
            for low, high in zip(cuts.tolist(), cuts.tolist()[1:]):
                if high - low == 1 and least[low] == most[low]:
                    continue
                for k in range(low, high):
                    shard.add(keys[k], passages[k].as_py(), int(least[k]), int(most[k]))
                if shard.full():
                    yield packed(list(shard.occurrences()))
                    shard = _Shard(phrase)
        yield packed(list(shard.occurrences()))

    return shards.mapInArrow(read, "passage_key bigint, found array<struct<low:int,high:int,first:bigint>>")


def _spans(starts: DataFrame, phrase: int) -> DataFrame:
    """``row_key, spans``: flat array of first word, word after the last, and so on, from runs of phrases that start at low to high."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                spans: list[int] = []
                for low, high in sorted((r["low"], r["high"] + phrase) for r in value.as_py()):
                    if spans and low <= spans[-1]:
                        spans[-1] = max(spans[-1], high)
                    else:
                        spans += [low, high]
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["row_key", "spans"])

    return starts.mapInArrow(read, "row_key bigint, spans array<int>")


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrase: int = PHRASE) -> DataFrame:
    """One row per distinct text: ``row_key`` (its hash), ``first_id`` and the ``spans`` to remove from that document."""
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST)).alias("id_key"), F.xxhash64(text).alias("row_key"), F.col(text).alias("_text")
    ).where(F.col("_text").isNotNull())
    first = store(rows.groupBy("row_key").agg(F.min("id_key").alias("id_key")))
    texts = lookup_join(rows, first, ["id_key", "row_key"], "inner", settled=True)
    anchors = store(_anchors(texts, phrase))
    seen = anchors.select("id_key", F.explode("anchors").alias("anchor"))
    recurring = seen.groupBy("anchor").agg(
        F.min("id_key").alias("least"), F.max("id_key").alias("most"), F.count(F.lit(1)).alias("n")
    )
    recurring = recurring.where(F.col("least") < F.col("most")).select(
        "anchor", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces")
    )
    places = anchors.select("row_key", F.posexplode("anchors").alias("run", "anchor"))
    marked = lookup_join(places, recurring, ["anchor"], "inner").groupBy("row_key").agg(
        F.collect_list(F.col("run") + F.shiftleft((F.col("pieces") - 1).cast("bigint"), 32)).alias("runs")
    )
    passages = store(_passages(lookup_join(texts, marked, ["row_key"], "inner"), phrase))
    thin = passages.select("row_key", "id_key", "start", F.xxhash64("anchor", "piece", "passage").alias("passage_key"))
    # Both sides are shuffled by passage; a passage that very many documents share is a skewed key of one side only.
    found = thin.join(_located(passages, phrase), "passage_key")
    later = F.filter("found", lambda f: f.first < F.col("id_key"))
    starts = found.select("row_key", F.explode(F.transform(later, lambda f: F.struct((f.low + F.col("start")).alias("low"), (f.high + F.col("start")).alias("high")))).alias("at"))
    spans = _spans(starts.groupBy("row_key").agg(F.collect_set("at").alias("starts")), phrase)
    return first.withColumnRenamed("id_key", "first_id").join(spans, "row_key", "left")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrase: int = PHRASE) -> DataFrame:
    """``docs`` with ``kept_text`` (kept words joined by one blank, null for null), ``n_words`` and ``n_removed``."""
    by_text = find_repeats(docs, doc_id, text, phrase)
    docs = docs.drop("kept_text", "n_words", "n_removed")
    by_text = by_text.select(F.col("row_key").alias("_row_key"), "first_id", F.col("spans").alias("_spans"))
    rows = docs.withColumn("_row_key", F.xxhash64(text))
    copy = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST)) > F.col("first_id")
    rows = lookup_join(rows, by_text, ["_row_key"], "left").withColumn("_copy", F.coalesce(copy, F.lit(False))).drop("_row_key", "first_id")
    empty = F.lit(0).cast("bigint")
    out = nullable(docs.select("*", F.lit("").alias("kept_text"), empty.alias("n_words"), empty.alias("n_removed")).schema)
    at = docs.columns.index(text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, removed = [], [], []
            spans, copies = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            for body, span, is_copy in zip(batch.column(at), spans, copies.to_pylist()):
                words = split_words(body.as_py())
                n = len(words)
                cuts = [0, n] if is_copy and n >= phrase else [] if is_copy else span.as_py() or []
                parts, end = [], 0
                for low, high in zip(cuts[::2], cuts[1::2]):
                    parts += words[end:low]
                    end = high
                parts += words[end:]
                kept.append(None if body.as_py() is None else b" ".join(parts).decode("utf-8", "surrogatepass"))
                total.append(n)
                removed.append(n - len(parts))
            columns = batch.columns[:-2] + [pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, out.names)

    return rows.select(*docs.columns, "_spans", "_copy").mapInArrow(read, out)


def op5_repeated_passages(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce(F.col("kept_text"), F.lit("")), 256)
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM docs WHERE len(w) >= 13),
phrases AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS k FROM starts),
later AS (SELECT doc_id, i FROM phrases QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM later, range(0, 13) AS t(o)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM docs),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""
