"""N-gram Jaccard join by token-combination prefixes.

The tokens of a document are its distinct word shingles. Documents with equal token sets are one from
the start. For the others, tokens have a global order (rare before frequent, then by hash), and two sets
that are similar enough share k tokens of their first ``n - ceil(t * n) + k``. So rare tokens of the
extended prefix are indexed alone; of the frequent ones, pairs (k = 2) are indexed where sets are small
enough for all pairs, and single ones (k = 1) where they are not. Candidates are then verified on the
whole sets.

What is frequent comes from counts over all documents in a fixed number of hash cells. The classes only
decide the order; the result is exact whatever they are.

Large families of near copies would make nearly every pair a candidate. Therefore classes are formed
first: documents with the same two least hashes are compared in blocks, by ORDERS hash orders with
different blocks, with whole sets. From then on only index entries that still hold two classes matter, and only
pairs across classes are compared. A bound on the overlap (token counts in hash bins, as many as the set
needs) removes pairs that only share a passage. A pair leaves an entry only if the two sets do not share one
of the entries just before it too, so a pair is not made once per shared key. Entries of any size are cut into
block pairs, so no task holds a whole one.

Defined results: empty and null texts have no tokens, size 0, and form a class alone; fewer words than a
shingle are one token; a null ``doc_id`` takes part and names no class unless it is alone; repeated rows
are equal sets; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outage_spark.llm.components import components
from outage_spark.llm.text import groups, hash_windows, hash_words, mix, nullable, split_lower_words, store, table
from outage_spark.operators.spread import lookup_join

PERCENT = 85
SHINGLE = 4
CELLS = 1 << 20
FREQUENT = 64
PAIRS_BELOW = 128
BINS = 128
BIN_TOKENS = 12
BEFORE = 2
BLOCK = 512
ORDERS = 2
NO_ID = -(1 << 63)


def tokens_of(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    words = hash_words(split_lower_words(text))
    return np.unique(hash_windows(words, min(shingle, len(words)))) if len(words) else words


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _set_key(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64)) if len(tokens) else 0


def _least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _bins(tokens: np.ndarray) -> bytes:
    """Tokens per hash bin modulo 16, two bins a byte; at most BIN_TOKENS tokens per bin on average."""
    bins = BINS
    while bins * BIN_TOKENS < len(tokens):
        bins *= 2
    counts = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % bins, minlength=bins).astype(np.uint8) & 15
    return (counts[: bins // 2] | counts[bins // 2 :] << 4).tobytes()


class _Bins:
    """The bins of many sets, and how far two sets differ by them at least."""

    def __init__(self, packed: list[bytes]):
        self.packed = np.array([np.frombuffer(p, np.uint8) for p in packed] + [None], object)[:-1]
        self.width = np.array([2 * len(p) for p in packed])
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _at(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a set's row is, and the rows of all sets of at least ``width`` bins, folded to that many."""
        if width not in self.folded:
            place, rows = np.zeros(len(self.width), np.int64), []
            for own in np.unique(self.width[self.width >= width]).tolist():
                at = np.flatnonzero(self.width == own)
                place[at] = sum(map(len, rows)) + np.arange(len(at))
                packed = np.stack(self.packed[at])
                row = np.concatenate([packed & 15, packed >> 4], axis=1)
                rows.append(row.reshape(len(at), -1, width).sum(axis=1, dtype=np.uint8) & 15)
            self.folded[width] = place, np.concatenate(rows)
        return self.folded[width]

    def differ(self, i: np.ndarray, j: np.ndarray, cells: int = 1 << 22) -> np.ndarray:
        """At most the number of tokens that only one of two sets has: differences modulo 16, the shorter way round."""
        least, widths = np.zeros(len(i), np.int64), np.minimum(self.width[i], self.width[j])
        for width in np.unique(widths).tolist():
            place, rows = self._at(width)
            some = np.flatnonzero(widths == width)
            for at in np.split(some, range(cells // width, len(some), cells // width)):
                apart = (rows[place[i[at]]] - rows[place[j[at]]]) & 15
                least[at] = np.minimum(apart, 16 - apart).sum(axis=1, dtype=np.int64)
        return least


def _least(tokens: np.ndarray) -> list[int]:
    """One value per hash order for its two smallest hashes; sets that only share a common token rarely agree in it."""
    values = []
    for order in range(ORDERS):
        ranks = mix(tokens ^ np.uint64(order * 0x9E3779B97F4A7C15 % (1 << 64)))
        both = mix(np.partition(ranks, 1)[:2] if len(ranks) > 2 else np.sort(ranks))
        values.append(int(_signed(both[:1] ^ (both[-1:] * np.uint64(3)))[0]))
    return values


def _index_keys(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Index keys of a set, in one order for all sets: rare tokens, frequent ones, pairs; see the module's text."""
    n = len(tokens)
    prefix = n - _least_overlap(n, percent) + 1
    rank = mix(tokens)
    common = frequent[(tokens >> np.uint64(44)).astype(np.int64)]
    ordered = np.lexsort((rank, common))[: prefix + 1]
    is_common = common[ordered]
    keys = [tokens[ordered[~is_common]]]
    # Partners of a set below the limit may lie above it, by the ratio that sizes can have.
    if 100 * n >= percent * PAIRS_BELOW:
        keys.append(mix(tokens[ordered[:prefix][is_common[:prefix]]] + np.uint64(1)))
    if n < PAIRS_BELOW:
        frequent_ones = tokens[ordered[is_common]]
        i, j = np.triu_indices(len(frequent_ones), 1)
        keys.append(mix(frequent_ones[i] * np.uint64(0x9E3779B97F4A7C15) + frequent_ones[j] + np.uint64(2)))
    return np.concatenate(keys)


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Columns ``id_key, row_key, _text``; the first two find a text again."""
    return docs.select(
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("id_key"), F.xxhash64(text).alias("row_key"), F.col(text).alias("_text")
    )


def _first_pass(rows: DataFrame, shingle: int) -> DataFrame:
    """Per document its set (``set_key, n``), and per task the cells with more tokens than usual (``cell, excess``)."""
    none = F.lit(None).cast("bigint")
    schema = nullable(
        rows.select("id_key", "row_key", none.alias("set_key"), none.alias("n"), none.alias("cell"), none.alias("excess")).schema
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = np.zeros(CELLS, np.int64), set()
        for batch in batches:
            keys, sizes, fresh, waiting = [], [], [], 0
            for body in batch.column(2):
                tokens = tokens_of(body.as_py(), shingle)
                key = _set_key(tokens)
                keys.append(key)
                sizes.append(len(tokens))
                if len(tokens) and key not in seen:
                    seen.add(key)
                    fresh.append((tokens >> np.uint64(44)).astype(np.int64))
                    waiting += len(tokens)
                if waiting > 1_000_000:
                    cells += np.bincount(np.concatenate(fresh), minlength=CELLS)
                    fresh, waiting = [], 0
            if fresh:
                cells += np.bincount(np.concatenate(fresh), minlength=CELLS)
            empty = pa.nulls(len(keys), pa.int64())
            columns = [batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), empty, empty]
            yield pa.RecordBatch.from_arrays(columns, schema.names)
        usual = int(2 * cells.sum() / CELLS) + 2
        over = np.flatnonzero(cells > usual)
        empty = pa.nulls(len(over), pa.int64())
        columns = [empty, empty, empty, empty, pa.array(over), pa.array(cells[over] - usual)]
        yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(read, schema)


def _second_pass(rows: DataFrame, frequent: np.ndarray, percent: int, shingle: int) -> DataFrame:
    """One row per distinct set of a task: ``set_key, n, least, bins, keys``."""
    zero = F.lit(0).cast("bigint")
    schema = nullable(
        rows.select(
            zero.alias("set_key"), zero.alias("n"), F.array(zero).alias("least"), F.lit(b"").alias("bins"), F.array(zero).alias("keys"),
        ).schema
    )
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(frequent))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = np.unpackbits(shared.value).astype(bool), set()
        for batch in batches:
            out: list[tuple] = []
            for body in batch.column(0):
                tokens = tokens_of(body.as_py(), shingle)
                key = _set_key(tokens)
                if not len(tokens) or key in seen:
                    continue
                seen.add(key)
                out.append((key, len(tokens), _least(tokens), _bins(tokens), _signed(_index_keys(tokens, common, percent))))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _arrow(schema))], schema.names)

    return rows.select("_text").mapInArrow(read, schema)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class _Classes:
    """Union-find over names."""

    def __init__(self, names: Iterable[int] = ()):
        self.parent = {name: name for name in names}

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[self.find(i)] = self.find(j)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """The rule itself: 100 * intersection >= percent * union."""
    if not len(a) or not len(b):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _may_link(columns: dict, bins: _Bins, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs are of two classes (and two blocks, in a pair of blocks) and can be linked by size and tokens per bin."""
    n, m = columns["n"][i], columns["n"][j]
    good = (columns["class"][i] != columns["class"][j]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    good &= (columns["low"][i] == columns["high"][i]) | (columns["own"][i] != columns["own"][j])
    at = np.flatnonzero(good)
    both = n[at] + m[at]
    return at[(both - bins.differ(i[at], j[at])) * (100 + percent) >= 2 * percent * both]


def _first_shared(before: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs share none of the keys just before this one. The first key that two sets share is always such a one."""
    shared = np.zeros(len(i), bool)
    for mine in before:
        for theirs in before:
            shared |= (mine[i] == theirs[j]) & (mine[i] != 0)
    return np.flatnonzero(~shared)


def _pairs_within(cuts: np.ndarray, most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within groups, in bounded portions: all groups of one small size together, large ones row by row."""
    sizes = np.diff(cuts)
    for size in np.unique(sizes[sizes > 1]).tolist():
        starts = cuts[:-1][sizes == size]
        if size <= 64:
            a, b = np.triu_indices(size, 1)
            step = max(1, most // len(a))
            for at in range(0, len(starts), step):
                some = starts[at : at + step, None]
                yield (some + a).ravel(), (some + b).ravel()
            continue
        for start in starts.tolist():
            for k in range(1, size):
                yield np.full(k, start + k), np.arange(start, start + k)


def _link_block(names: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(name, name) edges that span the classes within one block."""
    sizes = np.array([len(s) for s in sets])
    bins = _Bins([_bins(s) for s in sets])
    columns = {"n": sizes, "class": np.arange(len(sets)), "low": np.zeros(len(sets)), "high": np.zeros(len(sets))}
    classes, edges = _Classes(range(len(sets))), []
    for i, j in _pairs_within(np.array([0, len(sets)])):
        good = _may_link(columns | {"own": columns["class"]}, bins, i, j, percent)
        for a, b in zip(i[good].tolist(), j[good].tolist()):
            if classes.find(a) != classes.find(b) and linked(sets[a], sets[b], percent):
                classes.join(a, b)
                edges.append((int(names[a]), int(names[b])))
    return edges


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (``id_key, row_key`` and more) with the text of each."""
    return lookup_join(rows, wanted, ["id_key", "row_key"], "inner")


def _class_blocks(rows: DataFrame, sets: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Edges found by comparing sets with the same two least hashes, in blocks."""
    members = sets.select("set_key", "id_key", "row_key", F.posexplode("least").alias("j", "least"))
    crowded = members.groupBy("j", "least").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    block = F.pmod(F.xxhash64("set_key", "j"), F.ceil(F.col("size") / BLOCK))
    placed = members.join(crowded, ["j", "least"]).select("set_key", "id_key", "row_key", F.struct("j", "least", block.alias("block")).alias("s"))
    wanted = placed.groupBy("id_key", "row_key", "set_key").agg(F.collect_list("s").alias("s"))
    near = _texts(rows, wanted).select("set_key", "_text", F.explode("s").alias("s")).select("set_key", "_text", "s.*")
    near = near.repartition("j", "least", "block").sortWithinPartitions("j", "least", "block", "set_key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cuts in groups(batches, ["j", "least", "block"]):
            keys, bodies, found = part.column("set_key").to_numpy(), part.column("_text"), []
            for low, high in zip(cuts, cuts[1:]):
                names, at = np.unique(keys[low:high], return_index=True)
                if len(names) > 1:
                    sets = [tokens_of(bodies[int(low + k)].as_py(), shingle) for k in at]
                    found += _link_block(names, sets, percent)
            yield _edges(found)

    return near.mapInArrow(compare, "a bigint, b bigint")


def _candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs across classes from the index entries that hold more than one class."""
    entries = sets.select(F.explode("keys").alias("key"), "set_key", "n", "class")
    mixed = entries.groupBy("key").agg(
        F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).cast("int").alias("size"),
        F.min("n").cast("int").alias("least"), F.max("n").cast("int").alias("most"),
    )
    # Two sets of sizes too far apart cannot be linked; most entries that two sets share are of this kind.
    apart = (F.col("size") == 2) & (100 * F.col("least").cast("bigint") < percent * F.col("most").cast("bigint"))
    mixed = mixed.where((F.col("low") < F.col("high")) & ~apart).select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    # Sets have their keys in the same order; 0 stands for none before.
    none = [F.array(*[F.lit(0).cast("bigint")] * k) for k in range(1, BEFORE + 1)]
    runs = F.arrays_zip(F.col("keys").alias("key"), *[F.concat(z, "keys").alias(f"before{k}") for k, z in enumerate(none, 1)])
    placed = sets.select(F.explode(runs).alias("k"), "set_key", "n", "class", "bins").where(F.col("k.key").isNotNull())
    held = lookup_join(placed.select("k.*", "set_key", "n", "class", "bins"), mixed, ["key"], "inner")
    own = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    held = held.withColumn("own", own).select("*", other.alias("other"))
    held = held.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("blocks", "other")
    held = held.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, cuts in groups(batches, ["key", "low", "high"]):
            columns = {c: part.column(c).to_numpy() for c in ("n", "class", "set_key", "own", "low", "high")}
            before = [part.column(f"before{k}").to_numpy() for k in range(1, BEFORE + 1)]
            bins = _Bins(part.column("bins").to_pylist())
            for i, j in _pairs_within(cuts):
                first = _first_shared(before, i, j)
                i, j = i[first], j[first]
                good = _may_link(columns, bins, i, j, percent)
                a, b = columns["set_key"][i[good]], columns["set_key"][j[good]]
                a, b = np.minimum(a, b), np.maximum(a, b)
                # The same pair may still come from several keys; most repeats go before the shuffle.
                mixed = (mix(a.view(np.uint64)) ^ b.view(np.uint64)).tolist()
                fresh = [k for k, m in enumerate(mixed) if m not in seen and not seen.add(m)]
                if len(seen) > 500_000:
                    seen.clear()
                yield _edges(list(zip(a[fresh].tolist(), b[fresh].tolist())))

    return held.mapInArrow(compare, "a bigint, b bigint").distinct()


def _verified(rows: DataFrame, sets: DataFrame, pairs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Of the pairs whose whole sets are linked, enough to span their classes.

    Pairs are checked by connected group, or by pairs of blocks of a large one, so a text travels once
    per group and not once per pair. Links that close a ring within such a spot are left out.
    """
    roots = components(pairs)
    group = F.coalesce("root", "a")
    grouped = pairs.join(roots, pairs["a"] == roots["node"], "left").select("a", "b", group.alias("g"))
    sizes = roots.groupBy(F.col("root").alias("g")).agg(F.ceil((F.count(F.lit(1)) + 1) / BLOCK).alias("blocks"))
    own = [F.pmod(F.xxhash64(c), F.col("blocks")).cast("int") for c in ("a", "b")]
    spot = F.struct("g", F.least(*own).alias("low"), F.greatest(*own).alias("high"))
    placed = store(grouped.join(sizes, "g").select("a", "b", spot.alias("s")))
    members = placed.select(F.explode(F.array("a", "b")).alias("set_key"), "s").groupBy("set_key").agg(F.collect_set("s").alias("s"))
    wanted = members.join(sets.select("set_key", "id_key", "row_key"), "set_key")
    texts = _texts(rows, wanted).select(F.explode("s").alias("s"), F.lit(0).alias("pair"), F.col("set_key").alias("a"), F.lit(None).cast("bigint").alias("b"), "_text")
    both = texts.unionByName(placed.select("s", F.lit(1).alias("pair"), "a", "b", F.lit(None).cast("string").alias("_text")))
    both = both.select("s.*", "pair", "a", "b", "_text")
    both = both.repartition("g", "low", "high").sortWithinPartitions("g", "low", "high", "pair")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, classes, now = {}, _Classes(), None
        for batch in batches:
            spots = zip(*(batch.column(c).to_pylist() for c in ("g", "low", "high")))
            rest = zip(batch.column("pair").to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("_text"))
            good = []
            for spot, (is_pair, a, b, body) in zip(spots, rest):
                if spot != now:
                    sets, classes, now = {}, _Classes(), spot
                if not is_pair:
                    if a not in sets:
                        sets[a] = tokens_of(body.as_py(), shingle)
                        classes.parent[a] = a
                elif classes.find(a) != classes.find(b) and linked(sets[a], sets[b], percent):
                    classes.join(a, b)
                    good.append((a, b))
            yield _edges(good)

    return both.mapInArrow(compare, "a bigint, b bigint")


def similar_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE
) -> DataFrame:
    """``id_key, row_key, n_shingles, component_id`` for every row; a null id has the key NO_ID."""
    rows = _identified(docs, doc_id, text)
    first = store(_first_pass(rows, shingle))
    over = first.where(F.col("cell").isNotNull()).groupBy("cell").agg(F.sum("excess").alias("excess"))
    frequent = np.zeros(CELLS, bool)
    # At most CELLS numbers, whatever the data.
    frequent[[r.cell for r in over.where(F.col("excess") >= FREQUENT).select("cell").toLocalIterator()]] = True
    members = first.where(F.col("cell").isNull()).select("id_key", "row_key", "set_key", "n")
    known = F.when(F.col("id_key") != NO_ID, F.col("id_key"))
    reps = members.where(F.col("n") > 0).groupBy("set_key").agg(
        F.min(F.struct(known.isNull(), "id_key", "row_key")).alias("r"), F.min(known).alias("least_id")
    )
    reps = reps.select("set_key", "r.id_key", "r.row_key", "least_id")
    second = _second_pass(rows, frequent, percent, shingle).groupBy("set_key").agg(
        F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("least", "bins", "keys")]
    )
    sets = store(second.join(reps, "set_key"))
    spanning = store(_class_blocks(rows, sets, percent, shingle))
    roots = components(spanning)
    with_class = store(_with_class(sets, roots))
    pairs = store(_candidates(with_class, percent))
    more = _verified(rows, sets, pairs, percent, shingle)
    final = components(spanning.unionByName(more))
    named = _with_class(sets.select("set_key", "least_id"), final)
    least = named.groupBy("class").agg(F.min("least_id").alias("component_id"))
    by_set = named.join(least, "class").select("set_key", "component_id")
    out = lookup_join(members, by_set, ["set_key"], "left")
    own = F.when(F.col("id_key") != NO_ID, F.col("id_key"))
    return out.select("id_key", "row_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", own).alias("component_id"))


def _with_class(sets: DataFrame, roots: DataFrame) -> DataFrame:
    roots = roots.select(F.col("node").alias("set_key"), F.col("root").alias("_root"))
    return sets.join(roots, "set_key", "left").withColumn("class", F.coalesce("_root", "set_key")).drop("_root")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, of each class only the one with the smallest ``doc_id`` (and then text hash).

    Rows with a null id stay only if their class has no other; repeated rows of the kept document are one.
    """
    classes = similar_classes(docs, doc_id, text, **options)
    best = classes.groupBy(F.coalesce("component_id", F.lit(NO_ID)).alias("c"), (F.col("n_shingles") > 0).alias("f"), F.when(
        (F.col("n_shingles") == 0) | F.col("component_id").isNull(), F.struct("id_key", "row_key")).alias("alone")
    ).agg(F.min(F.struct(F.col("id_key") == NO_ID, "id_key", "row_key")).alias("r"))
    kept = best.select("r.id_key", "r.row_key").distinct()
    # The row as one value, so that its names cannot clash with the keys.
    keyed = docs.select(
        F.struct("*").alias("doc"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("id_key"), F.xxhash64(text).alias("row_key")
    )
    return lookup_join(keyed, kept, ["id_key", "row_key"], "inner").dropDuplicates(["id_key", "row_key"]).select("doc.*")


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    classes = similar_classes(table(spark, sf_dir, "documents"))
    own: Column = F.when(F.col("id_key") != NO_ID, F.col("id_key"))
    return classes.select(own.alias("doc_id"), "n_shingles", "component_id")
