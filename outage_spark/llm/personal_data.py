"""Personal data by bootstrapped contextual extraction (native).

Fixed patterns give the base spans (email, ip, card, phone). They are also the seeds: every token that
carries a digit or ``@``, and every run of two to eight neighbouring tokens made of digits and separators
(``030 555 99 99``), is an *instance*, seen in a *pattern*, its lexical context (the word before it
and the word after it). Pattern and instance form a weighted graph. A pattern that holds many seed
instances of a kind, and little else, is trusted; an instance that trusted patterns hold becomes a seed
of the next round. Instances reached at the end add spans of the pattern's kind; base spans stay.

Counts are aggregated before every join, so a hot pattern or instance is one row per partner, and the
graph shrinks to distinct pairs. Only spans travel, never texts; texts are read in projections.
Positions are code points, ends exclusive.

Defined results: a null text is empty; a null ``doc_id`` is matched null-safely; repeated rows get equal
results; empty tables give empty results; other columns are ignored. A match that fails its check
(octet over 255, digits, Luhn) is dropped and not retried at another place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outage_spark.llm.text import bound, store, table
from outage_spark.operators.spread import lookup_join

KINDS = ("email", "ip", "card", "phone")

# A search may only begin where the character before cannot belong to the match, or where the last
# match ended; possessive repeats never go back. Matches are the same, and time is linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "%@%", "ip": "%.%.%.%", "card": "%", "phone": "%+%"}
GROUP = r"[+(]?[0-9][0-9()./+-]*+(?![^\x20\x09-\x0D,;:!?])"
TOKEN = (
    rf"(?<![^\x20\x09-\x0D])(?:{GROUP}(?:\x20{GROUP}){{1,7}}+"
    r"|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
)
STEPS = 128
TEXT_KEY = ("_text_key", "_text_check")
SPAN = "array<struct<start:int,end:int,value:string>>"


def spans_of(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches, from the matches and the pieces between them."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    steps = F.zip_with(pieces, values, lambda p, v: F.struct(F.length(p).alias("gap"), v.alias("value")))
    return bound(F.filter(steps, lambda s: s.value.isNotNull()), _placed)


def _placed(steps: Column) -> Column:
    """Spans of (gap, value) steps. A fold copies what it has gathered at every step, so it runs within blocks of steps."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def walk(a: Column, s: Column) -> Column:
        end = a.at + s.gap + F.length(s.value)
        span = F.struct((a.at + s.gap).alias("start"), end.alias("end"), s.value.alias("value"))
        return F.struct(end.alias("at"), F.concat(a.spans, F.array(span)).alias("spans"))

    firsts = F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1)), F.lit(STEPS))
    return bound(F.transform(firsts, lambda first: F.aggregate(F.slice(steps, first, F.lit(STEPS)), start, walk)), _moved)


def _moved(blocks: Column) -> Column:
    """Spans of all blocks, each block moved to where the one before it ended."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))
    begins = F.aggregate(
        blocks, start, lambda a, b: F.struct((a.at + b.at).alias("at"), F.concat(a.begins, F.array(a.at)).alias("begins"))
    ).begins

    def shift(by: Column) -> Callable[[Column], Column]:
        return lambda s: F.struct((s.start + by).alias("start"), (s.end + by).alias("end"), s.value.alias("value"))

    return F.flatten(F.zip_with(blocks, begins, lambda b, by: F.transform(b.spans, shift(by))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    reverse = F.split(F.reverse(digits), "")
    values = F.transform(
        F.filter(reverse, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))
        ),
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _is_valid(kind: str) -> Callable[[Column], Column]:
    return lambda span: _valid(kind, span.value)


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?$"))
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(F.substring(digits, 1, 19))
    return F.length(digits).between(8, 15)


def base_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the text, one array of valid (start, end, value) per kind, and ``tokens`` (see TOKEN)."""
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = F.col("_text").rlike("[0-9@]")
    empty = F.array().cast(SPAN)
    for kind in KINDS:
        spans = F.when(found & F.col("_text").like(NEEDS[kind]), spans_of(F.col("_text"), PATTERNS[kind]))
        rows = rows.withColumn(f"_{kind}", F.coalesce(spans, empty))
    rows = rows.withColumn("_tokens", F.coalesce(F.when(found, spans_of(F.col("_text"), TOKEN)), empty))
    valid = [F.filter(f"_{kind}", _is_valid(kind)).alias(kind) for kind in KINDS]
    return rows.select(*keep, "_text", *valid, F.col("_tokens").alias("tokens"))


def _all(kinds: tuple[str, ...] = KINDS) -> Column:
    """All base spans as (kind, start, end, value), in order."""

    def numbered(n: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(F.lit(n).alias("kind"), s.start.alias("start"), s.end.alias("end"), s.value.alias("value"))

    return F.concat(*[F.transform(kind, numbered(n)) for n, kind in enumerate(kinds)])


def _word(text: Column) -> Column:
    """A context word without case and outer punctuation."""
    return F.regexp_replace(F.lower(text), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}=:]+$", "")


def occurrences(found: DataFrame, row_key: list[str]) -> DataFrame:
    """Each identifier-like token: place, value, context and, where a base span meets it, its kind.

    A base span stands as it is. Any other token counts without its outer punctuation, and only if no
    base span overlaps it.
    """

    def both(base: Column) -> Column:
        spans = F.transform(base, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.value.alias("value"), s.kind.alias("kind")))
        free = F.filter(
            F.transform(
                "tokens",
                lambda t: F.struct(
                    (t.start + F.length(F.regexp_extract(t.value, r"^[^\p{L}\p{N}+@]*+", 0))).alias("start"),
                    (t.end - F.length(F.regexp_extract(t.value, r"[^\p{L}\p{N}]*$", 0))).alias("end"),
                    F.regexp_replace(t.value, r"^[^\p{L}\p{N}+@]++|[^\p{L}\p{N}]+$", "").alias("value"),
                    F.lit(None).cast("int").alias("kind"),
                ),
            ),
            lambda t: (t.end > t.start) & ~F.exists(base, lambda s: (s.start < t.end) & (s.end > t.start)),
        )
        return F.concat(spans, free)

    rows = found.select(*row_key, "_text", F.explode(bound(_all(), both)).alias("s"))
    # The context is looked for near the span only: a word of more than 40 characters is cut there.
    before = F.substring(F.col("_text"), F.greatest(F.col("s.start") - 41, F.lit(0)) + 1, F.least(F.col("s.start"), F.lit(41)))
    after = F.substring(F.col("_text"), F.col("s.end") + 1, F.lit(41))
    return rows.select(
        *row_key,
        F.col("s.start").alias("start"),
        F.col("s.end").alias("end"),
        F.col("s.value").alias("instance"),
        F.col("s.kind").alias("kind"),
        _word(F.regexp_extract(before, r"([^\x20\x09-\x0D]*)[\x20\x09-\x0D]*$", 1)).alias("left_word"),
        _word(F.regexp_extract(after, r"^[^\x20\x09-\x0D]*[\x20\x09-\x0D]+([^\x20\x09-\x0D]*)", 1)).alias("right_word"),
    )


def bootstrap(
    seen: DataFrame, rounds: int = 3, min_support: int = 5, min_confidence: float = 0.8
) -> DataFrame:
    """Instances discovered from seeds: ``instance, kind``.

    Each round scores patterns by the share of their distinct instances that belong to a kind, counts
    those with at least ``min_support`` of them, and scores an instance by the best such pattern. Both
    sides of the pattern are used, alone and together. Scores are ratios of counts, thus exact.
    """
    left, right = F.concat(F.lit("L:"), "left_word"), F.concat(F.lit("R:"), "right_word")
    both = F.concat(F.lit("B:"), "left_word", F.lit(" _ "), "right_word")
    patterns = F.array(
        F.when(F.col("left_word") != "", left), F.when(F.col("right_word") != "", right),
        F.when((F.col("left_word") != "") & (F.col("right_word") != ""), both),
    )
    # Short numbers (years, versions, counts) identify nobody; they count against a pattern all the same.
    telling = F.col("instance").contains("@") | (F.length(_digits(F.col("instance"))) >= 4)
    edges = store(
        seen.select("instance", telling.alias("telling"), "kind", F.explode(patterns).alias("pattern"))
        .where(F.col("pattern").isNotNull())
        .groupBy("pattern", "instance", "telling")
        .agg(F.max("kind").alias("seed"))
    )
    known = edges.where(F.col("seed").isNotNull()).groupBy("instance").agg(F.min("seed").alias("kind"))
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    for _ in range(rounds):
        known = store(known)
        held = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n_kind"))
        trusted = (
            held.where(F.col("n_kind") >= min_support)
            .join(totals, "pattern")
            .withColumn("confidence", F.col("n_kind") / F.col("n"))
            .where(F.col("confidence") >= min_confidence)
        )
        fresh = (
            edges.where(F.col("seed").isNull() & F.col("telling"))
            .join(trusted.select("pattern", "kind", "confidence"), "pattern")
            .groupBy("instance")
            .agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
        )
        known = known.unionByName(fresh.join(known, "instance", "left_anti"))
    seeds = edges.where(F.col("seed").isNotNull()).select("instance").distinct()
    return known.join(seeds, "instance", "left_anti")


def find_personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """``keep``, ``base`` and ``added``: arrays of (kind, start, end, value), kind as a number of KINDS."""
    keyed = docs.select(*keep, *([] if text in keep else [text]), F.xxhash64(text).alias("_row"))
    found = base_spans(keyed, text, (*keep, "_row"))
    key = [keep[0], "_row"]
    seen = store(occurrences(found, key))
    discovered = store(bootstrap(seen, **options))
    added = _added(seen, discovered).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
        F.struct("kind", "start", "end", F.col("instance").alias("value")).alias("span"),
    )
    added = added.groupBy("_k0", "_k1").agg(F.sort_array(F.collect_set("span")).alias("added"))
    match = F.col(keep[0]).eqNullSafe(F.col("_k0")) & (F.col("_row") == F.col("_k1"))
    rows = found.select(*keep, "_row", _all().alias("base"))
    empty = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
    joined = rows.join(added, match, "left")
    return joined.select(*keep, "base", F.coalesce("added", empty).alias("added"))


def _added(seen: DataFrame, discovered: DataFrame) -> DataFrame:
    """Occurrences outside base spans whose instance was discovered; an instance may be everywhere, its kind is one row."""
    return lookup_join(seen.where(F.col("kind").isNull()).drop("kind"), discovered, ["instance"], "inner")


def redact(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with every span, base and added, replaced by its kind in brackets.

    Overlapping spans are merged and named after the first. A null text stays null. Spans follow from the
    text alone, so texts find theirs by two hashes; patterns run once over the texts, and texts are only
    shuffled where the spans of all of them are too many to broadcast.
    """
    # The row as one value, so that its names cannot clash with those of the spans.
    body = F.col("_doc").getField(text)
    rows = docs.select(F.struct("*").alias("_doc"))
    rows = rows.select("_doc", F.xxhash64(body).alias(TEXT_KEY[0]), F.xxhash64(F.lit("check"), body).alias(TEXT_KEY[1]))
    seen = store(occurrences(base_spans(rows.select(*TEXT_KEY, body.alias("_body")), "_body", TEXT_KEY), list(TEXT_KEY)))
    added = _added(seen, store(bootstrap(seen, **options)))
    span = F.struct("start", "end", "kind").alias("span")
    both = seen.where(F.col("kind").isNotNull()).select(*TEXT_KEY, span).unionByName(added.select(*TEXT_KEY, span))
    per_text = both.groupBy(*TEXT_KEY).agg(F.sort_array(F.collect_set("span")).alias("_spans"))
    found = lookup_join(rows, per_text, list(TEXT_KEY), "left")
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    cut = F.aggregate(
        "_spans",
        start,
        lambda a, s: F.struct(
            F.greatest(a.at, s.end).alias("at"),
            F.when(s.start < a.at, a.parts)
            .otherwise(F.concat(a.parts, F.array(F.substring(body, a.at + 1, s.start - a.at), F.element_at(names, s.kind + 1))))
            .alias("parts"),
        ),
    )
    rows = found.withColumn("_cut", F.when(F.col("_spans").isNotNull(), cut))
    rest = F.substring(body, F.col("_cut.at") + 1, F.length(body))
    clean = F.when(F.col("_cut").isNull(), body).otherwise(F.concat(F.array_join("_cut.parts", ""), rest))
    return rows.select(F.col("_doc").withField(f"`{text}`", clean).alias("_doc")).select("_doc.*")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s.kind, s.start, s.end)))
    return F.array_join(
        F.transform(
            ordered,
            lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string")),
        ),
        ",",
    )


def op9_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s.kind)
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("bigint").alias(f"n_{kind}") for n, kind in enumerate(KINDS)
    ]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("bigint").alias("n_added"),
    )
