"""Arrivals of a stream as committed batches, with late rows on the side.

Each micro-batch becomes one folder that appears whole: it is written under a hidden name and then renamed, and a batch that
is sent again (after a crash between its steps, say) finds what it has already committed and leaves it alone. So a
restart in the middle of a batch changes nothing. Readers see committed folders only, as a table or as the next stream.

A row is late if its time is at or before the newest time of all earlier batches less ``delay``, which is the
watermark that Spark keeps for the stream. Late rows stay in the table, marked, where they can be counted and looked at; a stateful
stream that reads the others with the same ``delay`` drops none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import schema_of


def _name(number: int) -> str:
    return f"batch-{number:09d}"


def _fs(spark: SparkSession, path: str):
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark._jsc.hadoopConfiguration()), kind


def is_committed(spark: SparkSession, path: str, number: int) -> bool:
    fs, kind = _fs(spark, path)
    return fs.exists(kind(f"{path}/{_name(number)}"))


def commit(df: DataFrame, path: str, number: int) -> bool:
    """Writes ``df`` as batch ``number`` of the table at ``path`` and says whether it did; a committed batch stays as it is."""
    spark = df.sparkSession
    fs, kind = _fs(spark, path)
    final, draft = kind(f"{path}/{_name(number)}"), f"{path}/_{_name(number)}"
    if fs.exists(final):
        return False
    df.write.mode("overwrite").parquet(draft)
    if not fs.rename(kind(draft), final):
        raise OSError(f"{draft} could not be renamed")
    return True


def committed(spark: SparkSession, path: str, schema: T.StructType, number: int | None = None) -> DataFrame:
    """The committed batches of a table, or one of them; without any, an empty table."""
    fs, kind = _fs(spark, path)
    pattern = f"{path}/{'batch-*' if number is None else _name(number)}"
    found = fs.globStatus(kind(pattern))
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(pattern)


def following(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The committed batches of a table as a stream, whole batches in their order."""
    return spark.readStream.schema(schema).parquet(f"{path}/batch-*")


MARK = schema_of("newest timestamp, n_rows long, n_late long")


def arrived_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*(T.StructField(f.name, f.dataType) for f in schema), T.StructField("late", T.BooleanType())])


def accept(stream: DataFrame, root: str, checkpoint: str, time_col: str = "ts", delay: str = "1 hour"):
    """Commits each batch to ``root/arrived``, with ``late`` beside its columns, and one row about it to ``root/marks``.

    A row without a time is late. Returns the started query, which takes what there is and ends.
    """
    spark = stream.sparkSession
    marks, arrived = f"{root}/marks", f"{root}/arrived"
    schema = arrived_schema(stream.schema)

    def one(batch: DataFrame, number: int) -> None:
        before = committed(batch.sparkSession, marks, MARK, number - 1).first() if number else None
        newest = before["newest"] if before else None
        horizon = F.lit(newest) - F.expr(f"INTERVAL {delay}")
        late = F.lit(False) if newest is None else F.col(time_col) <= horizon
        commit(batch.withColumn("late", F.coalesce(late, F.lit(True)) | F.col(time_col).isNull()), arrived, number)
        own = committed(batch.sparkSession, arrived, schema, number)
        row = own.agg(F.greatest(F.max(time_col), F.lit(newest).cast("timestamp")).alias("newest"), F.count(F.lit(1)).alias("n_rows"), F.count_if("late").alias("n_late"))
        commit(row, marks, number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(spark: SparkSession, root: str) -> DataFrame:
    """``newest, n_rows, n_late`` of each batch that came."""
    return committed(spark, f"{root}/marks", MARK)


def on_time(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows that came in time, as a stream of ``schema``."""
    return following(spark, f"{root}/arrived", arrived_schema(schema)).where("not late").drop("late")
