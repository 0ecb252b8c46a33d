"""Shared helpers of the corpus operators: input columns, shared storage, word bytes."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts may be long, so a batch is kept small.
BATCH_ROWS = 512

#: Keys that hold more than one in so many rows are hot: fewer keys than this number, whatever the table.
HOT = 4096


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; a local session without one gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="riskloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there.

    A lost executor costs only the tasks that it ran; the files stay.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/riskloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, classes: DataFrame, key: str, total: int, hot: int = HOT) -> DataFrame:
    """``rows`` joined with ``classes``, which has one row for each key and, as ``n``, how many rows have the key.

    Keys that hold more than ``total / hot`` rows, fewer than ``hot`` as ``total`` is the number of rows, are broadcast and
    joined where the rows are; only the others are shuffled, so no task gets the rows of a hot key.
    """
    most = total // hot
    heavy, light = classes.where(F.col("n") > most).drop("n"), classes.where(F.col("n") <= most).drop("n")
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return rows.join(F.broadcast(heavy), key).unionByName(rest)


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows that a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def crc_mod(id_col: str, mod: int) -> Column:
    """crc32 of the id's text, modulo ``mod``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(mod), F.lit(0))
