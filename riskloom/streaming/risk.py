"""Streams of messages: scoring, dedupe, windowed counts and sessions. Jobs on single rows run on streams unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import messages as M
from ..operators.hygiene import text_key


def deduplicated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first message of each text within the watermark."""
    return stream.withColumn("_key", text_key(F.col("text"))).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def level_counts(scored: DataFrame, window: str = "10 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Messages by window and risk level; rows behind the watermark are dropped."""
    return scored.withWatermark("ts", delay).groupBy(F.window("ts", window, slide or window).alias("w"), "risk_level").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "risk_level", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """One row for each user's session: its messages in order."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "text")))
    return stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(ordered.alias("messages")).select("user_id", "w.start", "w.end", "messages")


def score_batches(stream: DataFrame, path: str, checkpoint: str):
    """Scores each micro-batch with the batch job and appends it to ``path``; a batch that is sent again overwrites its own folder."""
    def one(batch: DataFrame, number: int) -> None:
        M.message_scores(M.indicators(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
