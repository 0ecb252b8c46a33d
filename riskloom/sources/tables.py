"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}
_KINDS |= {f"array<{k}>": T.ArrayType(v) for k, v in _KINDS.items()}


def schema_of(columns: str, **nested: T.DataType) -> T.StructType:
    """A schema from ``name kind, name kind``, before there is a session; ``nested`` gives further kinds."""
    kinds = _KINDS | nested
    return T.StructType([T.StructField(*(kinds[x] if i else x for i, x in enumerate(c.split()))) for c in columns.split(",")])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; a local session without one gets a folder of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="riskloom-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def spread(table: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has cores (a small table in one file) dealt out to all of them; any other as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the folder that the cluster shares: what reads it starts from a plain scan."""
    path = f"{shared_folder(df.sparkSession)}/riskloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
