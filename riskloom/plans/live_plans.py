"""Registered queries that run as streams over the table of events, and the same in one pass of SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import chains as C
from ..operators import sessions
from ..sources.tables import shared_folder
from ..streaming import arrivals, live
from .verdict_plans import SCORED_VERDICTS, routed_sql, scored_ctes

GAP, DELAY = "12 hours", "1 day"
WINDOW, SLIDE = "6 hours", "2 hours"
#: Artefacts of users: every event stands for a message, a link, a payment link, a code, or something that no job takes.
_EVENTS = """SELECT CAST(user_id AS {text}) AS user_id, CAST(event_id AS {text}) AS item_id, CAST(ts AS TIMESTAMP) AS ts,
  CASE WHEN event_id % 23 = 22 THEN 'fax' WHEN event_id % 4 = 0 THEN 'message' WHEN event_id % 4 = 1 THEN 'url' WHEN event_id % 4 = 2 THEN 'upi' ELSE 'qr' END AS type,
  CASE event_id % 4 WHEN 0 THEN CASE event_id % 3 WHEN 0 THEN 'URGENT: KYC expired, share OTP, update at http://sbi-verify.site' WHEN 1 THEN 'You have won a lottery prize, pay the processing fee at http://pay.site' ELSE 'See http://www.site' END || CAST(user_id % 5 AS {text}) || '.example.com/login ' || event_type || ' ' || props
    WHEN 2 THEN 'upi://pay?pa=shop' || CAST(user_id % 11 AS {text}) || '@upi&am=' || CAST(CAST(floor(value * 300) AS BIGINT) AS {text}) || '&tn=urgent%20refund%20claim%20now'
    ELSE 'http://sbi-verify.site' || CAST(user_id % 5 AS {text}) || '.example.com/login?otp=1&redirect=' || event_type END AS content FROM {events}"""


def _arrived(spark, sf_dir):
    """The events accepted into a new folder; its name."""
    root = f"{shared_folder(spark)}/riskloom/live-{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    view = f"events_{uuid.uuid4().hex}"
    spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*").createOrReplaceTempView(view)  # as a pattern, as a lone file is no folder
    arrivals.accept(spark.sql(_EVENTS.format(text="STRING", events=view)).select(*live.ARTEFACT.names), root, f"{root}/_accept", delay=DELAY).awaitTermination()
    return root


def _verdicts(spark, sf_dir):
    root = _arrived(spark, sf_dir)
    live.score_artefacts(arrivals.on_time(spark, root, live.ARTEFACT), root, f"{root}/_score").awaitTermination()
    both = (arrivals.committed(spark, f"{root}/{t}", live.VERDICT) for t in ("verdicts", "errors"))
    return root, next(both).unionByName(next(both))


def _live_verdicts(spark, sf_dir):
    return _verdicts(spark, sf_dir)[1].select("item_id.*", "kind", "status", "content_type", "risk_score", "risk_level", "scam_type", "confidence", F.array_join("indicators", ",").alias("indicators")).drop("ts")


def _live_levels(spark, sf_dir):
    root, _ = _verdicts(spark, sf_dir)
    live.count_levels(live.verdict_stream(spark, root), root, f"{root}/_levels", WINDOW, SLIDE, DELAY).awaitTermination()
    return arrivals.committed(spark, f"{root}/levels", live.LEVELS).select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "kind", "risk_level", "n")


def _live_chains(spark, sf_dir):
    root = _arrived(spark, sf_dir)
    live.chain_sessions(arrivals.on_time(spark, root, live.ARTEFACT), root, f"{root}/_chains", GAP, DELAY).awaitTermination()
    return arrivals.committed(spark, f"{root}/chains", live.CHAIN_VERDICT).withColumn("indicators", F.array_join("indicators", ","))


def _sessions(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    found = sessions.sessionized(spark.sql(_EVENTS.format(text="STRING", events="events")), GAP)
    return found.select("chain_id", "idx", "user_id", "item_id", "type", "content")


QUERIES = {"live_verdicts": _live_verdicts, "live_level_windows": _live_levels, "live_chain_verdicts": _live_chains, "event_sessions": _sessions}

_E = _EVENTS.format(text="VARCHAR", events="events")
_SESSIONS = f"""SELECT *, user_id || '@' || CAST(epoch_us(min(ts) OVER (PARTITION BY user_id, s)) AS VARCHAR) AS chain_id, row_number() OVER (PARTITION BY user_id, s ORDER BY ts, item_id) - 1 AS idx, max(ts) OVER (PARTITION BY user_id, s) AS last_ts
  FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, item_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, item_id) + INTERVAL {GAP} THEN 0 ELSE 1 END AS new FROM ({_E})))"""
_OVER = f"(SELECT epoch_ms(max(ts)) FROM events) - epoch_ms(INTERVAL {DELAY})"
_CLOSED = f"SELECT chain_id || ':' || CAST(idx AS VARCHAR) AS item_id, type, content FROM ({_SESSIONS}) WHERE epoch_ms(last_ts + INTERVAL {GAP}) < {_OVER}"
_STAGED = """SELECT split_part(item_id, ':', 1) AS chain_id, CAST(split_part(item_id, ':', 2) AS BIGINT) AS idx, kind AS type, risk_score, is_suspicious, category AS scam_type, replace(names, ',', ' ') AS indicators, url, payee, words AS content FROM parts WHERE kind <> 'error'"""
_SLIDE_US = 2 * 3600 * 1_000_000
ORACLE = {
    "event_sessions": f"SELECT chain_id, idx, user_id, item_id, type, content FROM ({_SESSIONS})",
    "live_verdicts": f"""WITH {scored_ctes(routed_sql(f"SELECT item_id, type, content FROM ({_E})"))}, verdicts AS ({SCORED_VERDICTS})
      SELECT e.user_id, v.item_id, kind, status, content_type, risk_score, risk_level, scam_type, confidence, indicators FROM verdicts v JOIN ({_E}) e ON v.item_id = e.item_id""",
    "live_level_windows": f"""WITH {scored_ctes(routed_sql(f"SELECT item_id, type, content FROM ({_E})"))}, verdicts AS ({SCORED_VERDICTS}),
      placed AS (SELECT kind, risk_level, epoch_us(ts) // {_SLIDE_US} * {_SLIDE_US} - k * {_SLIDE_US} AS start_us FROM verdicts v JOIN ({_E}) e ON v.item_id = e.item_id, range(3) AS r(k) WHERE status <> 'ERROR')
      SELECT start_us, start_us + 3 * {_SLIDE_US} AS end_us, kind, risk_level, count(*) AS n FROM placed
      WHERE start_us + 3 * {_SLIDE_US} <= ((SELECT epoch_ms(max(ts)) FROM ({_E}) WHERE type <> 'fax') - epoch_ms(INTERVAL {DELAY})) * 1000 GROUP BY ALL""",
    "live_chain_verdicts": f"""WITH {scored_ctes(routed_sql(_CLOSED))}, {C.oracle_ctes(_STAGED)},
      each AS (SELECT chain_id, idx, i, x FROM (SELECT chain_id, idx, unnest(range(len(l))) AS i, unnest(l) AS x FROM (SELECT chain_id, idx, string_split(indicators, ' ') AS l FROM ({_STAGED}))) WHERE x <> ''),
      named AS (SELECT chain_id, string_agg(x, ',' ORDER BY idx, i) AS indicators FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, lower(x) ORDER BY idx, i) AS r FROM each) WHERE r = 1 GROUP BY chain_id)
      SELECT c.*, coalesce(indicators, '') AS indicators FROM chains c LEFT JOIN named n ON c.chain_id = n.chain_id""",
}
