import random
import re

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, row_key STRING, base INT, copies STRING, n_words STRING, fit STRING"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def table(spark, rows):
    """Rows (doc_id, text, source) as documents with further columns whose names the operators use themselves."""
    full = [(i, t, "en", s, len(t) if t else 0, "x", 1, "y", "z", "w") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Null and empty texts, null ids and sources, ties, repeated rows, copies, and a very long text."""
    rng = random.Random(5)
    long_text, text, tail = prose(rng, 20_000), prose(rng, 60), prose(rng, 40)
    return [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "a"), (4, "one", "a"), (None, "two words", None),
        (None, None, None), (7, text, "b"), (8, text, "b"), (9, text.upper(), "b"), (10, text + " " + tail, "c"),
        (11, tail, "c"), (12, long_text, "c"), (13, long_text + " end", None), (None, text, "b"), (7, text, "b"),
    ]
