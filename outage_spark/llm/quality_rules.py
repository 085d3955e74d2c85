"""Quality rules as a bitmask ledger (native).

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per
rule; a policy is a versioned mask of bits, so judging by another policy, or asking what a rule is
worth, reads the ledger and never the texts. One projection, no shuffle; ablations group by the mask
value, of which there are at most two to the number of rules.

Defined results: a null text counts as empty and fails ``few_words``; empty tables give empty results;
repeated rows are judged one by one; further columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outage_spark.llm.text import BLANKS, bound, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")

# Bit n belongs to the n-th rule; rules are only ever appended.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 25 * n_words",
    "repeated_lines": "100 * n_dup_lines > 40 * n_lines",
    "capitals": "100 * n_capitals > 50 * word_chars",
    "short_or_long_words": "word_chars < 2 * n_words OR word_chars > 25 * n_words",
}

# Policies are never changed once published; a new one gets a new version.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "strict-1": tuple(RULES),
}


def mask_of(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def _tail(array: Column) -> Column:
    return F.slice(array, F.lit(2), F.greatest(F.size(array), F.lit(1)))


def _windows(words: Column) -> Column:
    """Hashes of the three-word windows, in order; null if there are none."""
    places = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3))
    return F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))


def _covered(windows: Column) -> Column:
    """Number of words in windows that are found twice; null if none is."""
    # Only a text with such a window is sorted: windows by (hash, place), so equal ones are neighbours.
    twice = F.size(F.array_distinct(windows)) < F.size(windows)
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(rows: Column) -> Column:
        pairs = F.zip_with(rows, _tail(rows), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

    def words(at: Column) -> Column:
        # A window covers three words, fewer of them its own if the next one begins before it ends.
        own = F.zip_with(at, _tail(at), lambda a, b: F.coalesce(F.least(F.lit(3), b - a), F.lit(3)))
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda total, x: total + x)

    return F.when(twice, bound(bound(placed, places), words))


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the measurements of every whole text."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, body.alias("_text"), words_of(body).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    text_length = F.length("_text")
    rows = rows.select(
        *keep,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\f\r", "")).cast("bigint").alias("word_chars"),
        (text_length - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        (text_length - F.length(F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("bigint").alias("n_capitals"),
        lines.alias("_lines"),
        bound(bound(F.col("_words"), _windows), _covered).alias("_covered"),
    )
    return rows.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce("_covered", F.lit(0)).cast("bigint").alias("n_repeat_words"),
        "n_capitals",
    )


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements plus ``failed``: the bits of all rules that a document fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    return measure(docs, text, keep).withColumn("failed", reduce(Column.bitwiseOR, bits).cast("bigint"))


def judge(rows: DataFrame, policy: str) -> DataFrame:
    """Add ``kept`` and ``policy`` to a ledger: kept if no rule of the policy failed."""
    kept = F.col("failed").bitwiseAND(F.lit(mask_of(policy))) == 0
    return rows.withColumn("policy", F.lit(policy)).withColumn("kept", kept)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that would be kept without it."""
    mask = mask_of(policy)
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = list(RULES)
    values = [(rule, 1 << names.index(rule)) for rule in POLICIES[policy]]
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(b).cast("bigint").alias("bit")) for r, b in values]))
    each = counts.select("bits", "n", rules.alias("_r")).select("bits", "n", "_r.rule", "_r.bit")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.bit_or(F.when(fails, F.col("bits")).otherwise(F.lit(0).cast("bigint"))).alias("failed_together"),
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    from outage_spark.llm.text import table

    rows = judge(ledger(table(spark, sf_dir, "documents")), "strict-1")
    base_failed = F.col("failed").bitwiseAND(F.lit(mask_of("base-1"))) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), "kept", "failed", "n_lines", "n_capitals",
    )


OP10_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT doc_id, text, list_filter(string_split_regex(text, '{BLANKS}'), lambda w: w <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM docs),
grams AS (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM parts),
keyed AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM grams),
twice AS (SELECT doc_id, i FROM keyed QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) AS t(o) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
  FROM parts LEFT JOIN covered USING (doc_id)),
f AS (
  SELECT *, ({" + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values()))})::BIGINT AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed,
       failed = 0 AS kept, failed, n_lines, n_capitals
FROM f
"""
