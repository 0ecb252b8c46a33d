"""Token counts as rollups kept by signed deltas.

A batch of changes (inserts, deletes, revised counts) is reduced to signed totals by source, language and
tokenizer version before it is stored. Totals are additive, so the rollup is the sum over the stored batches, whatever
their order. A batch is stored under its id and committed by a marker; committing an id again changes nothing,
and a batch that failed half way is written anew.
"""

from __future__ import annotations

import base64
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, small_batches, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How text is cut before merging: the vocabulary's own pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ["source", "lang", "tokenizer"]


@lru_cache(maxsize=1)
def _encoding(table: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in table.splitlines() if line)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of each row; null and empty texts have no tokens."""
    small_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:  # on the driver: executors get the table with the task
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    chosen = docs.select(F.col(text_col).cast("string").alias("_text"), *(keep or []))
    out = T.StructType([*chosen.schema.fields[1:], T.StructField("n_tokens", T.LongType())])

    def run(batches):
        encode = _encoding(shared.value).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], out.names)

    return chosen.mapInArrow(run, out)


def inserts(counted: DataFrame) -> DataFrame:
    """Signed rows that add counted documents (columns ``KEYS`` and ``n_tokens``)."""
    return counted.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("tokens"))


def deletes(counted: DataFrame) -> DataFrame:
    """Signed rows that take counted documents away."""
    return inserts(counted).withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")})


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows that replace counts, keys included, by revised ones."""
    return deletes(before).unionByName(inserts(after))


class Ledger:
    """Committed batches under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self.path}/committed/batch={batch}/_SUCCESS")

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Stores a batch's totals, unless its id is committed; says whether it did.

        The one file output that counts is the marker that the finished write leaves: before it, a batch is not read and
        a further attempt overwrites what there is.
        """
        if self.committed(batch):
            return False
        totals = signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        totals.write.mode("overwrite").parquet(f"{self.path}/committed/batch={batch}")
        return True

    def rollup(self, batches: list[str]) -> DataFrame:
        """Totals by key over the given batches that are committed; keys whose documents are all gone are left out."""
        kinds = "source string, lang string, tokenizer string, docs long, tokens long"
        paths = [f"{self.path}/committed/batch={b}" for b in dict.fromkeys(batches) if self.committed(b)]
        both = self.spark.read.schema(kinds).parquet(*paths) if paths else self.spark.createDataFrame([], kinds)
        return both.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def op2(docs: DataFrame) -> DataFrame:
    """Totals of all documents after three batches: all are loaded; exact copies (of each text all but the
    lowest id) are deleted; the rest is revised to version 2 of the count, which has one more token, the end of the
    text. The load is sent twice, as after a lost answer, and counts once.

    Null sources and languages are keys of their own; null texts count as empty and as copies of each other;
    repeated rows are copies: of rows with one text and one id, one stays.
    """
    spark = docs.sparkSession
    with_hash = docs.select("doc_id", "source", "lang", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    counted = stored(
        count(with_hash, keep=["doc_id", "source", "lang", "h"]).withColumn("tokenizer", F.lit("byte_bpe_multi_50k/1"))
        .withColumn("row", F.monotonically_increasing_id()), "token-counts")
    first = counted.groupBy("h").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    stays = stored(first.select(F.col("first.row").alias("row")), "first-rows")  # row numbers are unique: no key of these joins is hot
    copies, kept = counted.join(stays, "row", "left_anti"), counted.join(stays, "row", "left_semi")
    ledger = Ledger(spark, f"{shared_dir(spark)}/riskloom/ledger-{uuid.uuid4().hex}")
    ledger.commit("load", inserts(counted))
    ledger.commit("load", inserts(counted))
    ledger.commit("copies", deletes(copies))
    ledger.commit("end-marks", revisions(kept, kept.withColumns({"tokenizer": F.lit("byte_bpe_multi_50k/2"), "n_tokens": F.col("n_tokens") + 1})))
    return ledger.rollup(["load", "copies", "end-marks"])
