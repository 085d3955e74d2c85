import random
import re

import pytest
from pyspark.sql import functions as F

from outage_spark.functions import scalars, text
from outage_spark.functions.registry import register_functions
from outage_spark.functions.weather import classify_weather
from outage_spark.operators.ingest import chunk_fixed, chunk_ids, chunk_separators


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def chunks(df):
    out = {}
    for row in df.orderBy("doc_id", "chunk_no").collect():
        out.setdefault(row.doc_id, []).append(row.text)
    return out


def random_text(rng, n):
    pieces = ["word", "längeres", "𝔘nicode", " ", " ", "\n", "\n\n", "x" * 300, "."]
    return "".join(rng.choice(pieces) for _ in range(n))


TEXTS = ["a" * 1000, "a" * 1001, "b" * 3000, "short", " ", *[random_text(random.Random(i), 40 * i) for i in range(1, 12)]]


def fixed(text):
    n = 1 + max(0, -(-(len(text) - 200) // 800) - 1)
    return [text[i * 800 : i * 800 + 1000] for i in range(n)]


def test_fixed_chunks(spark):
    got = chunks(chunk_fixed(docs(spark, *TEXTS)))
    assert got == {i: fixed(t) for i, t in enumerate(TEXTS)}


def test_empty_and_null_texts_have_no_chunks(spark):
    empty = docs(spark, "", None)
    assert chunk_fixed(empty).count() == 0 and chunk_separators(empty).count() == 0


@pytest.mark.parametrize("size,overlap", [(1000, 200), (50, 10)])
def test_separator_chunk_rules(spark, size, overlap):
    got = chunks(chunk_separators(docs(spark, *TEXTS), size=size, overlap=overlap))
    for i, whole in enumerate(TEXTS):
        rest, segment = whole, ""
        for chunk in got[i]:
            assert len(chunk) <= size
            shared = segment if len(segment) <= overlap else re.sub(r"^[^ \n]*[ \n]+", "", segment[-overlap:])
            assert len(shared) <= overlap and chunk.startswith(shared)
            segment = chunk[len(shared) :]
            assert segment and rest.startswith(segment)
            rest = rest[len(segment) :]
            window = segment + rest[: size - overlap - len(segment)]
            if rest and not segment.endswith("\n\n"):
                # A coarser separator would have been taken if one fitted.
                assert "\n\n" not in window
                if not segment.endswith("\n"):
                    assert "\n" not in window
                    assert segment.endswith(" ") or " " not in window
        assert rest == ""


def test_paragraphs_are_kept_together(spark):
    paragraphs = ["p" * 300 + " end", "q" * 400 + " end", "r" * 500 + " end"]
    got = chunks(chunk_separators(docs(spark, "\n\n".join(paragraphs))))[0]
    assert got[0] == paragraphs[0] + "\n\n" + paragraphs[1] + "\n\n"
    assert got[1].endswith(paragraphs[2])


def test_long_word_is_cut_hard(spark):
    got = chunks(chunk_separators(docs(spark, "b" * 3000)))[0]
    assert [len(c) for c in got] == [800, 1000, 1000, 800]


def test_chunk_ids_are_stable_and_distinct(spark):
    made = chunk_ids(chunk_fixed(docs(spark, *TEXTS)))
    assert made.select("chunk_id").distinct().count() == made.count()
    assert sorted(made.collect()) == sorted(chunk_ids(chunk_fixed(docs(spark, *TEXTS)).repartition(7)).collect())


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT valid_postcode('1234') a, valid_postcode('12a4') b, valid_postcode(NULL) c").first()
    assert tuple(row) == (True, False, False)
    assert spark.sql("SELECT cosine(array(1D, 0D), array(0D, 2D)) x").first().x == 0
    assert spark.sql("SELECT cosine(array(0D, 0D), array(0D, 2D)) x").first().x is None
    docs(spark, *TEXTS).createOrReplaceTempView("some_docs")
    rows = spark.sql("SELECT doc_id, c.* FROM some_docs, LATERAL chunk_rows(text) c")
    assert sorted(rows.collect()) == sorted(chunk_separators(docs(spark, *TEXTS)).collect())


def test_sql_chunks_of_any_size(spark):
    register_functions(spark)
    docs(spark, *TEXTS).createOrReplaceTempView("some_docs")
    rows = spark.sql("SELECT doc_id, c.* FROM some_docs, LATERAL chunk_rows(text, 30, 10) c")
    assert sorted(rows.collect()) == sorted(chunk_separators(docs(spark, *TEXTS), size=30, overlap=10).collect())


def test_html_text(spark):
    page = "<html><script>if (a<b) {}</script><!-- x --><p>One &amp; two</p>\n<P CLASS='x'>three&nbsp;&lt;3</P></html>"
    assert one(spark, text.html_text(F.lit(page))) == "One & two three <3"


def test_template_text_is_not_searched_again(spark):
    column = text.fill_template("c={context} q={question}.", context=F.lit("{question}"), question=F.lit("why"))
    assert one(spark, column) == "c={question} q=why."
    assert one(spark, text.fill_template("{a}{b}", a=F.lit(None).cast("string"), b=F.lit("x"))) == "x"


def test_outage_line_without_end(spark):
    start = F.lit("2030-01-01 08:00:00").cast("timestamp_ntz")
    line = text.outage_line(start, F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("string"))
    assert one(spark, line) == "2030-01-01 08:00 to further notice: no reason given"


def test_basename(spark):
    for path, name in [("file:/a/b.pdf", "b.pdf"), ("http://x.y/z/1?page=2#top", "1"), ("plain", "plain")]:
        assert one(spark, scalars.basename(F.lit(path))) == name


def test_relative_ranges(spark):
    cases = {
        "Next Week": ("2030-03-18", "2030-03-24"),
        "this week": ("2030-03-11", "2030-03-17"),
        "tomorrow": ("2030-03-14", "2030-03-14"),
        "next month": ("2030-04-01", "2030-04-30"),
        "someday": ("None", "None"),
    }
    for phrase, expected in cases.items():
        got = one(spark, scalars.relative_range(F.lit("2030-03-13"), F.lit(phrase)))
        assert (str(got.start_date), str(got.end_date)) == expected


def test_now_is_text_and_repeatable_when_given(spark):
    assert len(one(spark, scalars.as_of())) == 19
    given = scalars.as_of(F.lit("2030-03-13 04:05:06").cast("timestamp_ntz"))
    assert one(spark, given) == "2030-03-13 04:05:06"


def test_classify(spark):
    cases = [("Thunder and rain", 10.0, "Storms"), ("Light RAIN", 40.0, "Rain"), ("Clear", 35.0, "High Temperature")]
    cases += [("Clear", 34.9, "Fine_Conditions"), (None, None, "Fine_Conditions")]
    df = spark.createDataFrame(cases, "t string, c double, e string")
    assert df.where(classify_weather("t", "c") != F.col("e")).count() == 0


def test_place_and_normalise(spark):
    assert one(spark, scalars.place_query(F.lit("Alder"))) == "Alder, AU"
    assert one(spark, scalars.normalise_postcode(F.lit(2001))) == "2001"
