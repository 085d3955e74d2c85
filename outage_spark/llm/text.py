"""Words, hashes and stored tables shared by the corpus operators.

A *word* is a run of characters other than the six ASCII blanks (space and U+0009 to U+000D); these are
the bytes at which ``bytes.split()`` cuts, so Python and JVM code agree. A null text has no words.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outage_spark.operators.spread import checkpoint_folder

BLANKS = r"[\x20\x09-\x0D]+"
BATCH_BYTES, MAX_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
NOT_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ALNUM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | Column) -> Column:
    """Array of the words of a text column; empty for null."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def word_count(text: str | Column, blanks: str = BLANKS) -> Column:
    """Number of words as BIGINT, without a lambda: pieces after blanks at either end are cut off."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    inner = F.regexp_replace(text, rf"^{blanks}|{blanks}$", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, blanks))).cast("bigint")


def ascii_lower(text: str | Column) -> Column:
    """A-Z to lower case and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.col(text) if isinstance(text, str) else text, upper, upper.lower())


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, wherever the optimiser moves or copies the expression.

    A filter above a projection is pushed below it with its columns written out; inside a lambda they
    would then be computed again for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def split_lower_words(text: str | None) -> list[bytes]:
    """Words after A-Z were lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def split_alnum_words(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z and characters outside ASCII, after A-Z were lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split() if text else []


def hash_words(words: Iterable[bytes]) -> np.ndarray:
    hashed = xxhash.xxh3_64_intdigest
    return np.fromiter(map(hashed, words), np.uint64)


_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_windows(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each window of ``size`` word hashes; empty if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n] * _POWERS[0]
    for i in range(1, size):
        total += words[i : i + n] * _POWERS[i]
    return mix(total + _POWERS[size])


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def nullable(schema: T.StructType) -> T.StructType:
    """The schema of what a Python function returns: any column may be null."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most MAX_BATCH bytes from now on, unless the session has a limit of its own.

    The default is 10,000 rows whatever their length, so a batch of long texts, which Spark and Python both hold, has
    no limit in bytes. It is read when a plan runs, so it is not taken back here.
    """
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, str(MAX_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups from a stream sorted by ``keys``: a table of some groups, and where each begins (and the last ends)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for name in keys:
            values = batch.column(name).to_numpy(zero_copy_only=False)
            changed[1:] |= values[1:] != values[:-1]
        if held:
            last = held[-1]
            changed[0] = any(last.column(k)[last.num_rows - 1] != batch.column(k)[0] for k in keys)
        cuts = np.flatnonzero(changed)
        if len(cuts):
            whole = pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))]) if held or cuts[-1] else None
            if whole is not None and whole.num_rows:
                yield whole, _begins(whole, keys)
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        whole = pa.Table.from_batches(held)
        yield whole, _begins(whole, keys)


def _begins(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    changed = np.ones(table.num_rows, bool)
    changed[1:] = False
    for name in keys:
        values = table.column(name).to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(changed), table.num_rows)
