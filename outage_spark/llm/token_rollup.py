"""Token counts as delta-maintained rollups.

A batch of changes (inserts, deletes, revised counts) becomes signed rows in a ledger; their sums by
source, language and tokenizer version are the batch's delta, and totals are the sum of all deltas, so
they are never recounted. A revised count is its old row with a minus sign and the new row.

Commits are idempotent. A batch writes its ledger rows and then its delta, each into a folder named after
the batch and overwritten as a whole; the finished delta is the commit. A batch that is committed is
skipped, one that was cut off is written again. Readers open the folders of finished deltas only, and of the
ledger those of the same batches. Batches are committed one after another; the caller names them.

Signed rows of a key are summed by a shuffle with partial sums; the keys of a batch are broadcast to the
ledger only if they are measured to be few. Sources of any size are plain sums.

Defined results: in one batch, rows with the same key (document and tokenizer) count once: where the caller
names an order column, the last one (null is first); of equal ones a delete wins, then the largest count; an insert of a live key is a revision, a revision or delete of an absent key is an insert
or nothing; null source or language are groups of their own; a row with a null ``doc_id`` has no key: it
is added as often as it is inserted and cannot be revised or deleted; a null count is 0; empty batches
commit nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outage_spark.llm.text import NOT_ALNUM, nullable, store, table, word_count
from outage_spark.operators.spread import checkpoint_folder, lookup_join

GROUP = ("source", "lang", "tokenizer")
KEY = ("doc_id", "tokenizer")
BPE, BPE_FILE = "byte-pair-50k", "byte_bpe_50k.tiktoken"
LEDGER = "doc_id bigint, source string, lang string, tokenizer string, sign int, n_tokens bigint, batch string"
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, batch string"


class TokenRollup:
    """The ledger and deltas below ``folder``, which all machines share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _finished(self) -> list[str]:
        """Folder names of the committed batches; the driver holds one name per batch."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/delta")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        marks = files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(at, "batch=*/_SUCCESS"))
        return sorted(mark.getPath().getParent().getName() for mark in marks)

    def committed(self, batch: str) -> bool:
        return f"batch={batch}" in self._finished()

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{name}/{batch}" for batch in self._finished()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def ledger(self) -> DataFrame:
        """Signed rows of committed batches."""
        return self._read("ledger", LEDGER)

    def live(self, keys: DataFrame | None = None) -> DataFrame:
        """The rows that count now: those whose signs sum to one; only of ``keys``, if given."""
        rows = self.ledger().where(F.col("doc_id").isNotNull())
        if keys is not None:
            rows = lookup_join(rows, keys.select(*KEY), KEY, "inner")
        rows = rows.groupBy(*KEY, "source", "lang", "n_tokens").agg(F.sum("sign").alias("sign"))
        return rows.where(F.col("sign") > 0).drop("sign")

    def commit(self, batch: str, changes: DataFrame, order: str | None = None) -> bool:
        """Apply ``changes`` (op, doc_id, source, lang, tokenizer, n_tokens); False if the batch was there already.

        ``order`` names a column by which later rows of a key replace earlier ones of the batch.
        """
        if self.committed(batch):
            return False
        rows = changes.select(
            "op", F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", "tokenizer",
            F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint").alias("n_tokens"), (F.col(order) if order else F.lit(0)).alias("nth"),
        )
        keyed = rows.where(F.col("doc_id").isNotNull()).groupBy(*KEY).agg(
            F.max(F.struct("nth", F.col("op") == "delete", "n_tokens", "source", "lang", "op")).alias("r")
        )
        keyed = store(keyed.select(*KEY, "r.op", "r.source", "r.lang", "r.n_tokens"))
        columns = ["doc_id", "source", "lang", "tokenizer"]
        old = self.live(keyed).select(*columns, F.lit(-1).alias("sign"), "n_tokens")
        new = keyed.where(F.col("op") != "delete").select(*columns, F.lit(1).alias("sign"), "n_tokens")
        free = rows.where(F.col("doc_id").isNull() & (F.col("op") == "insert"))
        signed = old.unionByName(new).unionByName(free.select(*columns, F.lit(1).alias("sign"), "n_tokens"))
        signed.write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")
        written = self.spark.read.schema(LEDGER).parquet(f"{self.folder}/ledger/batch={batch}")
        delta = written.groupBy(*GROUP).agg(
            F.sum("sign").cast("bigint").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("bigint").alias("n_tokens")
        )
        delta.write.mode("overwrite").parquet(f"{self.folder}/delta/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens`` of what counts now."""
        sums = self._read("delta", DELTA).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where(F.col("n_docs") > 0)


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of byte-pair tokens of each whole text; ``vocabulary`` is a file of ranks.

    The driver reads the file and sends the ranks to the tasks: their number is the vocabulary's size.
    """
    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = nullable(docs.select("*", F.lit(0).cast("bigint").alias(name)).schema)
    at = docs.columns.index(text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t.as_py() or "")) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], schema.names)

    return docs.mapInArrow(read, schema)


def op8_token_rollup(spark, sf_dir: str) -> DataFrame:
    """Load all documents under two tokenizer versions, revise one after junk is cut from rows of low quality,
    take toxic rows out, and deliver the last batch twice."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    versions = F.array(
        F.struct(F.lit("blank-1").alias("tokenizer"), word_count("text").alias("n_tokens")),
        F.struct(F.lit("alnum-1").alias("tokenizer"), word_count("text", NOT_ALNUM).alias("n_tokens")),
    )
    rollup = TokenRollup(spark, f"{checkpoint_folder(spark)}/rollup-{uuid.uuid4().hex}")
    columns = ["doc_id", "source", "lang"]
    loaded = docs.select(F.lit("insert").alias("op"), *columns, F.explode(versions).alias("v"))
    rollup.commit("load", loaded.select("op", *columns, "v.*"))
    poor = labels.where(F.col("quality") == 0).select("doc_id").distinct()
    cut = word_count(F.translate("text", "#*$%&|<>", ""))
    poor_docs = lookup_join(docs.select("text", *columns), poor, ["doc_id"], "inner")
    rollup.commit("clean", poor_docs.select(F.lit("revise").alias("op"), *columns, F.lit("blank-1").alias("tokenizer"), cut.alias("n_tokens")))
    toxic = labels.where(F.col("toxic") == 1).select("doc_id").distinct()
    toxic_docs = lookup_join(docs.select(*columns), toxic, ["doc_id"], "inner")
    names = F.explode(F.array(F.lit("blank-1"), F.lit("alnum-1"))).alias("tokenizer")
    gone = toxic_docs.select(F.lit("delete").alias("op"), *columns, names, F.lit(0).alias("n_tokens"))
    for _ in range(2):
        rollup.commit("takedown", gone)
    return rollup.totals()


def byte_pair_rollup(spark, sf_dir: str) -> DataFrame:
    """The same load, revision and takedown, with the byte-pair tokens of all documents as tokenizer version."""
    import public_tokenizers

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    columns = ["doc_id", "source", "lang"]

    def changes(op: str, rows: DataFrame) -> DataFrame:
        counted = count_tokens(rows.select(*columns, "text"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)
        return counted.select(F.lit(op).alias("op"), *columns, F.lit(BPE).alias("tokenizer"), "n_tokens")

    rollup = TokenRollup(spark, f"{checkpoint_folder(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", changes("insert", docs))
    poor = labels.where(F.col("quality") == 0).select("doc_id").distinct()
    poor_docs = lookup_join(docs.select("text", *columns), poor, ["doc_id"], "inner")
    rollup.commit("clean", changes("revise", poor_docs.withColumn("text", F.translate("text", "#*$%&|<>", ""))))
    toxic = labels.where(F.col("toxic") == 1).select("doc_id").distinct()
    toxic_docs = lookup_join(docs.select(*columns), toxic, ["doc_id"], "inner")
    gone = toxic_docs.select(F.lit("delete").alias("op"), *columns, F.lit(BPE).alias("tokenizer"), F.lit(0).alias("n_tokens"))
    for _ in range(2):
        rollup.commit("takedown", gone)
    return rollup.totals()


OP8_SQL = r"""
WITH poor AS (SELECT DISTINCT doc_id, true AS poor FROM labels WHERE quality = 0),
toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
d AS (SELECT documents.doc_id, source, lang, coalesce(text, '') AS text, coalesce(poor, false) AS poor FROM documents LEFT JOIN poor USING (doc_id)),
counts AS (
  SELECT doc_id, source, lang, 'blank-1' AS tokenizer,
         len(regexp_extract_all(CASE WHEN poor THEN regexp_replace(text, '[#*$%&|<>]', '', 'g') ELSE text END, '[^\x20\x09-\x0D]+')) AS n FROM d
  UNION ALL
  SELECT doc_id, source, lang, 'alnum-1', len(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM d)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM counts ANTI JOIN toxic USING (doc_id) GROUP BY ALL
"""
