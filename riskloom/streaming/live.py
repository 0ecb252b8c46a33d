"""Streams of mixed artefacts: verdicts, windows over them, and chains from live sessions.

An artefact has ``user_id, item_id, ts, type, content``. ``arrivals.accept`` commits what comes and sets late rows apart; the streams here read what
came in time. Each keeps its own checkpoint, commits its results batch by batch, and after a crash goes on where it was.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import verdicts as V
from ..operators.sessions import CHAIN
from ..sources.tables import schema_of
from .arrivals import commit, following, is_committed

ARTEFACT = schema_of("user_id string, item_id string, ts timestamp, type string, content string")
#: Verdicts of a stream carry the time and the user of their artefact in their id.
VERDICT = schema_of(
    "item_id item, kind string, status string, content_type string, risk_score int, risk_level string, is_suspicious boolean, scam_type string, confidence double, indicators array<string>",
    item=schema_of("user_id string, item_id string, ts timestamp"))
LEVELS = schema_of("start timestamp, end timestamp, kind string, risk_level string, n long")
CHAIN_SCHEMA = schema_of("chain_id string, idx long, user_id string, item_id string, ts timestamp, type string, content string")
CHAIN_VERDICT = schema_of("chain_id string, n_stages long, n_flagged long, n_edges long, pattern string, risk_score int, risk_level string, classification string, indicators array<string>")
_STATE = "us array<long>, item_id array<string>, type array<string>, content array<string>"
_ROW = "chain_id string, idx long, user_id string, item_id string, us long, type string, content string"


def _run(stream: DataFrame, one, checkpoint: str, mode: str = "append"):
    return stream.writeStream.outputMode(mode).foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_artefacts(stream: DataFrame, root: str, checkpoint: str):
    """Verdicts of each batch's artefacts to ``root/verdicts`` and those that no job can take to ``root/errors``.

    A batch goes through the same four jobs as a table does. It counts as done when both of its tables are committed.
    """
    def one(batch: DataFrame, number: int) -> None:
        if is_committed(batch.sparkSession, f"{root}/verdicts", number) and is_committed(batch.sparkSession, f"{root}/errors", number):
            return
        found = V.verdicts(batch.select(F.struct("user_id", "item_id", "ts").alias("item_id"), "type", "content"))
        commit(_typed(found.where("status <> 'ERROR'"), VERDICT), f"{root}/verdicts", number)
        commit(_typed(found.where("status = 'ERROR'"), VERDICT), f"{root}/errors", number)

    return _run(stream, one, checkpoint)


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def verdict_stream(spark: SparkSession, root: str) -> DataFrame:
    """The committed verdicts as a stream."""
    return following(spark, f"{root}/verdicts", VERDICT)


def count_levels(verdicts: DataFrame, root: str, checkpoint: str, window: str = "10 minutes", slide: str = "5 minutes", delay: str = "1 hour"):
    """Verdicts by sliding window, kind and level to ``root/levels``, each window once, when the watermark has passed its end."""
    timed = verdicts.select(F.col("item_id.ts").alias("ts"), "kind", "risk_level").withWatermark("ts", delay)
    counts = timed.groupBy(F.window("ts", window, slide).alias("w"), "kind", "risk_level").agg(F.count(F.lit(1)).alias("n"))
    return _run(counts.select("w.start", "w.end", "kind", "risk_level", "n"), lambda batch, number: commit(_typed(batch, LEVELS), f"{root}/levels", number), checkpoint)


def _close(gap_us: int):
    """A user's state: the artefacts of sessions that may still grow. What has been silent for the gap is handed on and forgotten."""
    def update(key, batches, state: GroupState):
        held = [list(x) for x in state.get] if state.exists else [[], [], [], []]
        if not state.hasTimedOut:
            for b in batches:
                held[0] += [int(x) for x in b["us"]]
                for k, name in enumerate(("item_id", "type", "content"), 1):
                    held[k] += [None if v is None or v != v else str(v) for v in b[name]]
        sessions: list[list] = []
        for r in sorted(zip(*held), key=lambda r: (r[0], r[1] is not None, r[1] or "")):
            if not sessions or r[0] >= sessions[-1][-1][0] + gap_us:
                sessions.append([])
            sessions[-1].append(r)
        over = state.getCurrentWatermarkMs()
        ends = [(s[-1][0] + gap_us) // 1000 for s in sessions]
        n = sum(e < over for e in ends)  # ends rise, so the first n
        if kept := [r for s in sessions[n:] for r in s]:
            state.update(tuple(list(c) for c in zip(*kept)))
            state.setTimeoutTimestamp(max(ends[n], over + 1))
        elif state.exists:
            state.remove()
        out = [(f"{key[0]}@{s[0][0]}", i, key[0], r[1], r[0], r[2], r[3]) for s in sessions[:n] for i, r in enumerate(s)]
        yield pd.DataFrame(out, columns=["chain_id", "idx", "user_id", "item_id", "us", "type", "content"])

    return update


def closed_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """``CHAIN``: the artefacts of each user's session, once it is silent for ``gap`` and the watermark (``delay`` behind) has passed that.

    Sessions are those of ``sessions.sessionized``: artefacts may come in any order as long as they are not late. A state holds one user's
    open sessions, with a timer on the first that may end.
    """
    gap_us = pd.Timedelta(gap) // pd.Timedelta("1us")
    timed = stream.select(F.coalesce("user_id", F.lit("")).alias("user_id"), "item_id", "ts", F.unix_micros("ts").alias("us"), "type", "content").withWatermark("ts", delay)
    out = timed.groupBy("user_id").applyInPandasWithState(_close(gap_us), _ROW, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("ts", F.timestamp_micros("us")).select(*CHAIN)


def chain_sessions(stream: DataFrame, root: str, checkpoint: str, gap: str = "30 minutes", delay: str = "1 hour"):
    """Closed sessions to ``root/sessions`` and their verdicts as chains to ``root/chains``, batch by batch."""
    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        commit(_typed(batch, CHAIN_SCHEMA), f"{root}/sessions", number)
        if not is_committed(spark, f"{root}/chains", number):
            own = spark.read.schema(CHAIN_SCHEMA).parquet(f"{root}/sessions/batch-{number:09d}")
            commit(_typed(V.chain_verdicts(own), CHAIN_VERDICT), f"{root}/chains", number)

    return _run(closed_sessions(stream, gap, delay), one, checkpoint)
