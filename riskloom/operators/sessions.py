"""Sessions of a user: artefacts less than a gap apart, as chains.

``sessionized`` is the batch form. A user's rows are cut into slices of time, the gap before a row is looked for inside its
slice, and only slices' edges are ordered over the whole of a user, so a user who has a third of all rows is spread over as many tasks as
there are slices. The stream form in ``streaming.live`` gives the same chains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAIN = ["chain_id", "idx", "user_id", "item_id", "ts", "type", "content"]


def chain_name(user: Column, start: Column) -> Column:
    """The name of a user's session that starts at a time."""
    return F.concat(user, F.lit("@"), F.unix_micros(start).cast("string"))


def sessionized(artefacts: DataFrame, gap: str = "30 minutes", slice_: str = "1 day") -> DataFrame:
    """``CHAIN``: each artefact (``user_id, item_id, ts, type, content``) with its session and its place there, from 0.

    A session ends where the next artefact comes ``gap`` or more after the last. Rows without a time are left out, rows without a user are
    one user's; rows of one time are ordered by ``item_id``. Other columns are ignored.
    """
    user = F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("user_id")
    rows = artefacts.select(user, F.col("item_id").cast("string").alias("item_id"), F.col("ts").cast("timestamp").alias("ts"), "type", "content").where("ts is not null").withColumn("_slice", F.window("ts", slice_)["start"])
    edges = rows.groupBy("user_id", "_slice").agg(F.max("ts").alias("_last"))
    before = Window.partitionBy("user_id").orderBy("_slice")  # a row a slice, not a row an artefact
    edges = edges.select(F.col("user_id").alias("_user"), F.col("_slice").alias("_edge"), F.lag("_last").over(before).alias("_before"))
    inside = Window.partitionBy("user_id", "_slice").orderBy("ts", "item_id")
    own = rows.withColumn("_prev", F.lag("ts").over(inside)).join(edges, (F.col("user_id") == F.col("_user")) & (F.col("_slice") == F.col("_edge"))).drop("_user", "_edge")
    prev = F.coalesce("_prev", "_before")
    own = own.withColumn("_new", prev.isNull() | (F.col("ts") >= prev + F.expr(f"INTERVAL {gap}")))
    starts = own.groupBy("user_id", "_slice").agg(F.max(F.when(F.col("_new"), F.col("ts"))).alias("_start"))
    carried = F.last("_start", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select(F.col("user_id").alias("_user"), F.col("_slice").alias("_edge"), carried.alias("_open"))
    began = F.last(F.when(F.col("_new"), F.col("ts")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    met = own.withColumn("_own", began).join(starts, (F.col("user_id") == F.col("_user")) & (F.col("_slice") == F.col("_edge")))
    named = met.withColumn("chain_id", chain_name(F.col("user_id"), F.coalesce("_own", "_open")))
    place = F.row_number().over(Window.partitionBy("chain_id").orderBy("ts", "item_id")) - 1
    return named.withColumn("idx", place.cast("long")).select(*CHAIN)
