"""Prefix trie of conversations: sizes, children, leaves and saved tokens of every node.

A node is a distinct sequence of first turns; it is named by its depth and two 64-bit keys, the exclusive ors
of hashes of (place, role, text) over its turns, so a parent's key is the node's without its last turn.

Subtree sums go up in bands of ``HEIGHT`` depths. A node's own numbers are exploded only to its ancestors in
its own band. The nodes at the tops of bands, with the sums of their bands, are a trie of their own, whose
depth is smaller by ``HEIGHT``; its sums are made in the same way. Then every completed top of a band is
exploded to the ancestors in the band above. So a node meets at most ``HEIGHT`` ancestors in a round, and
there are as many rounds as the logarithm of the depth to the base ``HEIGHT``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outage_spark.llm.text import groups, store, table, word_count
from outage_spark.operators.spread import OrderedRows, lookup_join

HEIGHT = 16
SHARED_FROM = 20
HEAD_TURNS = 3
IDS_PER_CHUNK = 10_000
NODE = ["depth", "k1", "k2"]


def ordered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, pos, role, text``: the turns of each conversation, numbered from 1 by turn, null first.

    Null role and text become empty. Turns of equal number follow their role and text; rows without
    ``conv_id`` belong to no conversation.
    """
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    numbered = OrderedRows(rows, ["conv_id"], ["turn", "role", "text"]).with_number("pos").rows
    return numbered.select("conv_id", F.col("pos").cast("int").alias("pos"), "role", "text")


def rebuild(turns: DataFrame, base: Column, head: Column) -> DataFrame:
    """Conversations whose first turns come from another one: ``conv_id, depth, h1, h2, n_words, n_turns`` of every turn.

    Conversation c begins with the first ``head`` (0 to HEAD_TURNS) turns of conversation ``base``, all of
    them if there are fewer, none if it is absent; then follow c's own turns after its first ``head``.
    ``turns`` is (conv_id, pos, h1, h2, n_words), with one row per turn. Each row of the result carries the
    length ``n_turns`` of its conversation; a row of depth 0 stands for the start of every conversation.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("_own"))
    convs = sizes.withColumns({"_base": base, "_head": head.cast("int")})
    # A base is shared by few conversations, and HEAD_TURNS rows of it count.
    heads = turns.where(F.col("pos") <= HEAD_TURNS)
    starts = sizes.select(F.col("conv_id").alias("_base"), F.least("_own", F.lit(HEAD_TURNS)).alias("_there"))
    convs = convs.join(starts, "_base", "left")
    taken = F.least("_head", F.coalesce("_there", F.lit(0)))
    convs = convs.select(
        "conv_id", "_base", "_head", taken.alias("_taken"),
        (taken + F.greatest(F.col("_own") - F.col("_head"), F.lit(0))).alias("n_turns"),
    )
    convs = store(convs)
    columns = ["conv_id", "depth", "h1", "h2", "n_words", "n_turns"]
    borrowed = convs.join(heads.withColumnRenamed("conv_id", "_base"), "_base").where(F.col("pos") <= F.col("_taken"))
    borrowed = borrowed.select("conv_id", F.col("pos").alias("depth"), "h1", "h2", "n_words", "n_turns")
    own = lookup_join(turns, convs, ["conv_id"], "inner", settled=True).where(F.col("pos") > F.col("_head"))
    own = own.withColumn("depth", F.col("pos") - F.col("_head") + F.col("_taken")).select(*columns)
    zero = F.lit(0).cast("bigint")
    start = convs.select("conv_id", F.lit(0).alias("depth"), zero.alias("h1"), zero.alias("h2"), zero.alias("n_words"), "n_turns")
    return borrowed.unionByName(own).unionByName(start)


def hashed(turns: DataFrame) -> DataFrame:
    """Turns with the number of words instead of role and text, which are hashed later with their depth."""
    return turns.select(
        "conv_id", "pos", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("second"), "role", "text").alias("h2"),
        word_count("text").alias("n_words"),
    )


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """Every first part of every conversation: its key, the key of the part without the last turn, its words."""
    placed = {h: F.when(F.col("depth") > 0, F.xxhash64("depth", h, F.lit(h))).otherwise(F.lit(0)).cast("bigint") for h in ("h1", "h2")}
    rows = OrderedRows(rebuilt.withColumns(placed), ["conv_id"], ["depth"]).with_xor("h1", "k1").with_xor("h2", "k2").rows
    return rows.select("conv_id", *NODE, F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "n_words", "n_turns")


def subtree_sums(nodes: DataFrame, paths: DataFrame, sums: list[str], depth: int, height: int = HEIGHT) -> DataFrame:
    """``depth, k1, k2`` and the totals of ``sums`` over each node's subtree, its top included.

    ``nodes`` has one row per node with ``conv_id``, a conversation that begins with it; ``paths`` (conv_id,
    depth, k1, k2) has at least the prefixes of those conversations. ``depth`` is the largest depth.
    """
    band = F.floor(F.col("depth") / F.lit(height)).cast("int")
    steps = paths.select("conv_id", band.alias("_band"), *[F.col(c).alias(f"_{c}") for c in NODE])

    def up(rows: DataFrame) -> DataFrame:
        """Numbers of ``rows`` added up at the steps of their ``_band`` at or above them: at most ``height`` each."""
        met = rows.select("conv_id", "_band", "depth", *sums).join(steps, ["conv_id", "_band"]).where(F.col("_depth") <= F.col("depth"))
        return met.groupBy(*[F.col(f"_{c}").alias(c) for c in NODE]).agg(*[F.sum(c).alias(c) for c in sums])

    own = up(nodes.withColumn("_band", band))
    if depth < height:
        return own
    own = store(own)
    tops = nodes.drop(*sums).join(own, NODE).where(F.col("depth") % height == 0)
    shorter = (F.col("depth") / F.lit(height)).cast("int")
    above = paths.where(F.col("depth") % height == 0).withColumn("depth", shorter)
    tops = store(tops.select("conv_id", *NODE, *sums))
    whole = subtree_sums(tops.withColumn("depth", shorter), above, sums, depth // height, height)
    whole = whole.withColumn("depth", F.col("depth") * height).join(tops.select("conv_id", *NODE), NODE)
    below = up(whole.where(F.col("depth") > 0).withColumn("_band", band - 1))
    return own.unionByName(below).groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in sums])


def ends_hashes(ends: DataFrame, keys: list[str], conv_id: str = "conv_id", chunk: int = IDS_PER_CHUNK) -> DataFrame:
    """SHA-256 per key over its ids, ascending, joined by commas.

    Ids are sorted over all tasks and written as chunks of text first; the last step then reads a key's
    chunks one after another, because SHA-256 has no parallel form, and holds one of them at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, begins in groups(batches, keys):
            ids = whole.column(conv_id).to_numpy()
            at = [a for b, e in zip(begins[:-1], begins[1:], strict=True) for a in range(b, e, chunk)]
            to = [min(a + chunk, e) for b, e in zip(begins[:-1], begins[1:], strict=True) for a in range(b, e, chunk)]
            text = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(at, to, strict=True)]
            columns = [whole.column(k).take(pa.array(at)).combine_chunks() for k in (*keys, conv_id)]
            yield from pa.table([*columns, pa.array(text)], names=[*keys, "_first", "_ids"]).to_batches()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for row in zip(*[batch.column(k).to_pylist() for k in (*keys, "_ids")], strict=True):
                if row[:-1] != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = row[:-1], hashlib.sha256(row[-1].encode())
                else:
                    state.update(b"," + row[-1].encode())
            if done:
                yield _rows_of(done, keys)
        if key is not None:
            yield _rows_of([(*key, state.hexdigest())], keys)

    kinds = dict(ends.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    order = [F.col(c) for c in (*keys, conv_id)]
    # Borders of the range partitions are sampled, so what is sorted by them is stored.
    chunks = store(ends.select(*keys, conv_id).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, f"{schema}, _first bigint, _ids string"))
    whole = chunks.repartition(*keys).sortWithinPartitions(*keys, "_first")
    return whole.mapInArrow(digest, f"{schema}, ends_sha256 string")


def _rows_of(rows: list[tuple], keys: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int32() if k == "depth" else pa.int64() for k in keys] + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*keys, "ends_sha256"])


def trie(rebuilt: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row per node of the trie over ``rebuilt`` (see ``rebuild``); none without conversations.

    ``conv_id`` is the smallest member; ``saved_tokens`` adds up (members - 1) x words of the last turn.
    """
    paths = store(prefixes(rebuilt))
    depth = paths.agg(F.max("depth")).first()[0]
    members = paths.groupBy(*NODE, "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_words").alias("n_words")
    )
    members = store(members)
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = members.where("depth > 0").groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = members.join(children, NODE, "left").fillna(0, ["n_children"])
    nodes = store(
        nodes.withColumns(
            {
                "n_leaves": (F.col("n_children") == 0).cast("bigint"),
                "saved_tokens": (F.col("n_convs") - 1) * F.when(F.col("depth") > 0, F.col("n_words")).otherwise(F.lit(0)),
            }
        )
    )
    totals = subtree_sums(nodes, paths, ["n_leaves", "saved_tokens"], depth or 0, height)
    ends = ends_hashes(paths.where(F.col("depth") == F.col("n_turns")), NODE)
    # Many children of one parent: the parents' table is looked up, so they need not meet in one task.
    named = members.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.drop("n_leaves", "saved_tokens").join(totals, NODE).join(ends, NODE, "left")
    nodes = lookup_join(nodes, named, ["depth", "p1", "p2"], "left")
    return nodes.select(
        "conv_id",
        F.col("depth").cast("bigint").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = store(hashed(ordered_turns(table(spark, sf_dir, "conversations"))))
    base = F.col("conv_id") - F.col("conv_id") % SHARED_FROM
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD_TURNS + 1)
    return trie(rebuild(turns, base, head))


OP13_SQL = """
WITH RECURSIVE numbered AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), bits AS (
    SELECT conv_id, CAST(conv_id AS VARCHAR) AS digits, 0 AS done, CAST(4294967295 AS BIGINT) AS crc
    FROM (SELECT DISTINCT conv_id FROM numbered)
    UNION ALL
    SELECT conv_id, digits, done + 1,
           CASE WHEN mixed & 1 = 1 THEN xor(mixed >> 1, 3988292384) ELSE mixed >> 1 END
    FROM (SELECT *, CASE WHEN done % 8 = 0 THEN xor(crc, CAST(ascii(substr(digits, done // 8 + 1, 1)) AS BIGINT)) ELSE crc END AS mixed
          FROM bits WHERE done < 8 * length(digits))
), convs AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base, xor(crc, 4294967295) % 4 AS head FROM bits WHERE done = 8 * length(digits)
), rebuilt AS (
    SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY part, pos) AS depth, role, text
    FROM (SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN numbered n ON n.conv_id = c.base AND n.pos <= c.head
          UNION ALL
          SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND n.pos > c.head) c
), paths AS (
    SELECT conv_id, depth, len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS n_words,
           string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS node
    FROM rebuilt
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
    SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n_words) AS saved,
           left(node, CAST(length(node) - 128 AS BIGINT)) AS parent
    FROM paths GROUP BY node, depth
), children AS (
    SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent
), totals AS (
    SELECT p.node, CAST(sum(n.saved) AS BIGINT) AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
    FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN children k ON k.node = n.node
    GROUP BY p.node
), ends AS (
    SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
    FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS n_turns FROM paths)
    WHERE depth = n_turns GROUP BY node
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, t.n_leaves,
       t.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN totals t USING (node) LEFT JOIN children k USING (node) LEFT JOIN ends e USING (node)
LEFT JOIN nodes u ON n.depth > 0 AND u.node = n.parent
"""
