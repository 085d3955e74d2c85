"""License scan by MinHash bands over overlapping windows (native).

Texts and templates are sequences of five-word shingles. Templates are whole license texts, notices and
one-line mentions. For each template length a text is cut into overlapping windows of one and a half times
that length, an eighth of it apart. A window's MinHash values are grouped into bands of ``ROWS``; windows
that share a band with a template are retrieved, and only that.

What decides is the text around a retrieved place: from each beginning of a run of the template's shingles,
the share of them that the next one and a half template lengths hold. It does not depend on where windows
were cut. Of several licenses at one place, the one that holds most shingles is returned.

Band settings: a window that holds at least 80% of a template has a Jaccard similarity of at least
0.8 / 1.7 = 0.47 with it, and one of 40 bands of 2 agrees with probability 1 - (1 - 0.47^2)^40 > 0.9999.

Windows with fewer known shingles than a template of their length needs are not hashed: the verification
could not accept them. The templates are a fixed small table (tens of texts), broadcast; only retrieved
places are shuffled.

Defined results: null, empty and very short texts (under five words) match nothing; a template of under
five words is refused; the same license found in several windows is one row; repeated rows of a document
are one; a null ``doc_id`` is a group of its own; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outage_spark.llm.text import NOT_ALNUM, ascii_lower, bound, table

SHINGLE = 5
BANDS = 40
ROWS = 2
CONTAINMENT = 0.8

def _gnu(kind: str, version: str, library: bool = False) -> tuple[str, str]:
    """The notice of a GNU licence for source files, "or later" and "only"."""
    start = f"This {'library' if library else 'program'} is free software: you can redistribute it and/or modify it under the terms of the {kind} as published by the Free Software Foundation, "
    return start + f"either version {version} of the License, or (at your option) any later version.", start + f"version {version} of the License."


def _whole(name: str) -> str:
    return (Path(__file__).parent / "licenses" / f"{name}.txt").read_text(encoding="utf-8")


_CC = "This work is licensed under a Creative Commons {} 4.0 International License"
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        _whole("Apache-2.0"),
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        _whole("MIT"),
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        *_gnu("GNU General Public License", "3"),
        _whole("GPL-3.0"),
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        *_gnu("GNU General Public License", "2"),
        _whole("GPL-2.0"),
    ),
    "LGPL-2.1": (*_gnu("GNU Lesser General Public License", "2.1", True), _whole("LGPL-2.1")),
    "LGPL-3.0": (*_gnu("GNU Lesser General Public License", "3"), *_gnu("GNU Lesser General Public License", "3", True), _whole("LGPL-3.0")),
    "AGPL-3.0": _gnu("GNU Affero General Public License", "3"),
    "BSD-2-Clause": (_whole("BSD-2-Clause"),),
    "BSD-3-Clause": (_whole("BSD-3-Clause"),),
    "BSD-4-Clause": (_whole("BSD-4-Clause"),),
    "ISC": (_whole("ISC"),),
    "Zlib": (_whole("Zlib"),),
    "Unlicense": (_whole("Unlicense"),),
    "CC0-1.0": (_whole("CC0-1.0"),),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", _CC.format("Attribution NonCommercial")),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", _CC.format("Attribution")),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", _CC.format("Attribution ShareAlike")),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", _whole("MPL-2.0")),
}


def shingled(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep`` and ``all``: 64-bit hashes of the five-word shingles of a text, in order; empty under five words."""
    lower = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    words = F.filter(F.split(lower, NOT_ALNUM), lambda w: w != "")
    return rows.select(*keep, bound(words, _hashes).alias("all"))


def _hashes(words: Column) -> Column:
    n = F.size(words)
    places = F.when(n >= SHINGLE, F.sequence(F.lit(0), n - SHINGLE))
    hashed = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    return F.coalesce(hashed, F.array().cast("array<bigint>"))


def _bands(window: Column) -> Column:
    """Array of one hash per band of MinHash values."""

    def least(seed: int) -> Column:
        return F.array_min(F.transform(window, lambda h: F.xxhash64(h, F.lit(seed))))

    return F.array(*[F.xxhash64(F.lit(b), *[least(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)])


def template_table(spark: SparkSession, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """``license, part, set, size``: the distinct shingles of every template text."""
    texts = [
        F.struct(F.lit(name).alias("license"), F.lit(part).alias("part"), F.lit(text).alias("text"))
        for name, parts in templates.items()
        for part, text in enumerate(parts)
    ]
    rows = spark.range(1).select(F.explode(F.array(*texts)).alias("t")).select("t.*")
    rows = shingled(rows, "text", "license", "part")
    return rows.select("license", "part", F.array_distinct("all").alias("set"), F.size("all").alias("size"))


def _constants(spark: SparkSession, templates: dict[str, tuple[str, ...]]) -> tuple[dict[int, int], list[int]]:
    """The fewest distinct shingles by template length, and all shingles: both fixed by the template table."""
    rows = template_table(spark, templates).collect()
    if any(not r["size"] for r in rows):
        raise ValueError(f"a template needs at least {SHINGLE} words")
    lengths: dict[int, int] = {}
    for r in rows:
        lengths[r["size"]] = min(len(r["set"]), lengths.get(r["size"], len(r["set"])))
    return lengths, sorted({h for r in rows for h in r["set"]})


def _span(length: int | Column) -> int | Column:
    """Shingles that an occurrence may reach over: half as many again as the template's."""
    return length + (F.floor(length / 2).cast("int") if isinstance(length, Column) else length // 2)


def license_windows(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified places: ``doc_id, row_key, license, part, first_shingle, last_shingle, held, containment``."""
    spark = docs.sparkSession
    lengths, known = _constants(spark, templates)
    # Literals, so that a set of them is made once.
    among = f"IN ({', '.join(f'{h}L' if h > -(1 << 63) else 'NULL' for h in known)})"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row_key"), F.col(text).alias("_text"))
    rows = shingled(rows, "_text", "doc_id", "row_key").where(F.expr(f"exists(all, h -> h {among})"))
    cuts = []
    for length, fewest in lengths.items():
        last = F.greatest(F.size("all") - _span(length), F.lit(0))
        starts = F.array_union(F.sequence(F.lit(0), last, F.lit(max(1, length // 8))), F.array(last))
        need = math.ceil(CONTAINMENT * fewest)
        cuts.append(F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(length).alias("length"), F.lit(need).alias("need"))))
    windows = rows.select("doc_id", "row_key", "all", F.explode(F.concat(*cuts)).alias("w")).select("doc_id", "row_key", "all", "w.*")
    windows = windows.withColumn("window", F.slice("all", F.col("start") + 1, _span(F.col("length"))))
    windows = windows.where(F.expr(f"size(filter(window, h -> h {among})) >= need")).withColumn("bands", bound(F.col("window"), _bands))
    wanted = template_table(spark, templates)
    sizes = wanted.select("license", "part", F.col("size").alias("length"), F.size("set").alias("n"))
    bands = wanted.select("license", "part", F.col("size").alias("length"), F.explode(F.array_distinct(bound(F.col("set"), _bands))).alias("band"))
    found = windows.select("doc_id", "row_key", "all", "start", "length", F.explode(F.array_distinct("bands")).alias("band"))
    # Bounded: BANDS rows per template text.
    near = found.join(F.broadcast(bands), ["length", "band"]).groupBy("doc_id", "row_key", "license", "part", "length", "start").agg(F.first("all").alias("all"))
    # The text around a retrieved place: a whole span before and after the window.
    low = F.greatest(F.col("start") - _span(F.col("length")), F.lit(0))
    around = F.slice("all", low + 1, F.col("start") + 2 * _span(F.col("length")) - low)
    each = near.select("doc_id", "row_key", "license", "part", low.alias("low"), F.posexplode(around).alias("i", "h"))
    shingles = wanted.select("license", "part", F.explode("set").alias("h"))
    each = each.join(F.broadcast(shingles), ["license", "part", "h"]).join(F.broadcast(sizes), ["license", "part"])
    hits = each.groupBy("doc_id", "row_key", "license", "part", "length", "n").agg(
        F.sort_array(F.collect_set(F.struct((F.col("low") + F.col("i")).alias("at"), "h"))).alias("hits")
    )
    begins = F.filter("hits", lambda x, i: (i == 0) | (F.get(F.col("hits"), i - 1)["at"] != x["at"] - 1))
    places = hits.select("*", F.explode(F.transform(begins, lambda x: x["at"])).alias("first_shingle"))
    inside = F.filter("hits", lambda x: (x["at"] >= F.col("first_shingle")) & (x["at"] < F.col("first_shingle") + _span(F.col("length"))))
    places = places.withColumn("inside", inside)
    places = places.withColumn("held", F.size(F.array_distinct(F.col("inside.h")))).withColumn("containment", F.col("held") / F.col("n"))
    return places.where(F.col("containment") >= CONTAINMENT).select(
        "doc_id", "row_key", "license", "part", "first_shingle", F.array_max("inside.at").alias("last_shingle"), "held", "containment"
    )


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, license, containment, first_shingle``: each license found in a document, at its best place.

    Of two licenses at one place, the one that holds more shingles of the text is returned.
    """
    place = F.struct("license", "first_shingle", "last_shingle", "held", "containment")
    grouped = license_windows(docs, templates, doc_id, text).groupBy("doc_id", "row_key").agg(F.collect_set(place).alias("all"))

    def beaten(x: Column) -> Column:
        def better(y: Column) -> Column:
            common = F.least(x["last_shingle"], y["last_shingle"]) - F.greatest(x["first_shingle"], y["first_shingle"]) + 1
            more = (y["held"] > x["held"]) | ((y["held"] == x["held"]) & (y["containment"] > x["containment"]))
            return (y["license"] != x["license"]) & more & (2 * common > x["last_shingle"] - x["first_shingle"] + 1)

        return F.exists("all", better)

    left = grouped.select("doc_id", F.explode(F.filter("all", lambda x: ~beaten(x))).alias("p")).select("doc_id", "p.*")
    best = left.groupBy("doc_id", "license").agg(F.max(F.struct("containment", -F.col("first_shingle"))).alias("b"))
    return best.select("doc_id", "license", F.col("b.containment").alias("containment"), (-F.col("b.col2")).alias("first_shingle"))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _op3_sql() -> str:
    texts = ", ".join(f"('{name}', {part}, '{text.replace(chr(39), chr(39) * 2)}')" for name, parts in TEMPLATES.items() for part, text in enumerate(parts))
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

    def pieces(source: str, keys: str) -> str:
        return f"""SELECT {keys}, i, array_to_string(w[i + 1:i + {SHINGLE}], ' ') AS s
  FROM (SELECT {keys}, w, unnest(range(0, len(w) - {SHINGLE - 1})) AS i
        FROM (SELECT {keys}, regexp_extract_all(translate(coalesce(text, ''), {upper}), '{word}') AS w FROM {source}))"""

    return f"""
WITH t(license, part, text) AS (VALUES {texts}),
ts AS ({pieces("t", "license, part")}),
sizes AS (SELECT license, part, count(*) AS length, count(DISTINCT s) AS n FROM ts GROUP BY 1, 2),
ds AS ({pieces("documents", "doc_id")}),
hits AS (SELECT doc_id, license, part, i, ds.s FROM ds JOIN (SELECT DISTINCT license, part, s FROM ts) ts ON ds.s = ts.s),
begins AS (
  SELECT doc_id, license, part, i FROM (
    SELECT *, lag(i) OVER (PARTITION BY doc_id, license, part ORDER BY i) AS before FROM hits)
  WHERE before IS NULL OR before <> i - 1),
places AS (
  SELECT b.doc_id, b.license, b.part, b.i AS first_shingle, max(h.i) AS last_shingle, count(DISTINCT h.s) AS held,
         count(DISTINCT h.s) / any_value(z.n) AS containment
  FROM begins b JOIN sizes z ON z.license = b.license AND z.part = b.part
  JOIN hits h ON h.doc_id = b.doc_id AND h.license = b.license AND h.part = b.part AND h.i >= b.i AND h.i < b.i + z.length + z.length // 2
  GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT h.s) / any_value(z.n) >= {CONTAINMENT})
SELECT doc_id, license, max(containment) AS containment, (min_by(first_shingle, (-containment, first_shingle)))::INT AS first_shingle
FROM places x
WHERE NOT EXISTS (
  FROM places y WHERE y.doc_id = x.doc_id AND y.license <> x.license
    AND (y.held > x.held OR (y.held = x.held AND y.containment > x.containment))
    AND 2 * (least(x.last_shingle, y.last_shingle) - greatest(x.first_shingle, y.first_shingle) + 1) > x.last_shingle - x.first_shingle + 1)
GROUP BY doc_id, license
"""


OP3_SQL = _op3_sql()
