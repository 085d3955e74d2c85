"""The same functions for SQL users, as SQL functions that Catalyst inlines (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from outage_spark.functions.text import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS


def register_functions(spark: SparkSession) -> None:
    """Define ``valid_postcode``, ``cosine``, ``chunk_text`` (array) and ``chunk_rows`` (table) for SQL.

    The chunk functions take the size of a chunk and the overlap as further arguments.
    """
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION valid_postcode(p STRING) RETURNS BOOLEAN "
        "RETURN coalesce(p RLIKE '^[0-9]{4}$', false)"
    )
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
        RETURN try_divide(
            aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v),
            sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v)))
        """
    )
    # The pattern of separator_pattern(), with the sizes as arguments.
    step = "CAST(size - overlap AS STRING)"
    ends = [f"'.{{0,', CAST(size - overlap - {len(sep)} AS STRING), '}}\\\\Q{_quoted(sep)}\\\\E|'" for sep in SEPARATORS]
    pattern = f"concat('(?s).{{1,', {step}, '}}\\\\z|', {', '.join(ends)}, '.{{1,', {step}, '}}')"
    tail = (
        "CASE WHEN i = 0 THEN '' WHEN length(get(g, i - 1)) <= overlap THEN get(g, i - 1) "
        "ELSE regexp_replace(right(get(g, i - 1), overlap), '^[^ \\n]*[ \\n]+', '') END"
    )
    sizes = f"size INT DEFAULT {CHUNK_SIZE}, overlap INT DEFAULT {CHUNK_OVERLAP}"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION chunk_text(t STRING, {sizes}) RETURNS ARRAY<STRING> "
        f"RETURN transform(array(regexp_extract_all(t, {pattern}, 0)), g -> transform(g, (s, i) -> concat({tail}, s)))[0]"
    )
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION chunk_rows(t STRING, {sizes}) RETURNS TABLE(chunk_no INT, text STRING) "
        "RETURN SELECT r.pos, r.col FROM (SELECT chunk_text(t, size, overlap) AS chunks) q, LATERAL posexplode(q.chunks) r"
    )


def _quoted(separator: str) -> str:
    return separator.replace("\n", "\\n")
