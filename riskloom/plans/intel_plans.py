"""Registered queries over threat patterns and embedded destinations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import Duck  # noqa: F401
from ..operators import destinations as D
from ..operators import intel as I
from ..operators import messages as M
from ..sources.tables import written
from .fixtures import MESSAGES, URLS, read


def _artefacts(s, d):
    found = M.indicators(read(s, d, MESSAGES, "documents"))
    tokens = F.array_compact(F.array(*(F.when(F.col(f"s_{x}").isNotNull(), F.lit(x)) for x in M.INDICATORS)))
    scored = M.with_scores(found).select(F.col("msg_id").alias("artifact_id"), "risk_score", F.col("is_scam").alias("is_suspicious"), tokens.alias("tokens"))
    return written(scored, "scored-messages")


def _urls(s, d):
    return read(s, d, URLS, "pages")


QUERIES = {
    "pattern_matches": lambda s, d: I.pattern_matches(_artefacts(s, d)),
    "destination_candidates": lambda s, d: D.candidates(_urls(s, d)),
    "destination_choice": lambda s, d: D.choices(D.statuses(D.candidates(_urls(s, d)))),
    "url_normalized": lambda s, d: D.normalized(_urls(s, d)),
}
_TOKENS = "concat_ws(',', " + ", ".join(f"CASE WHEN s_{x} IS NOT NULL THEN '{x}' END" for x in M.INDICATORS) + ")"
ORACLE = {
    "pattern_matches": I.oracle("SELECT msg_id AS artifact_id, risk_score, is_scam AS is_suspicious, tokens FROM scores_").replace(
        "WITH a AS", f"WITH {M.oracle_ctes(MESSAGES)}, scores_ AS (SELECT f.msg_id, risk_score, is_scam, {_TOKENS} AS tokens FROM found f JOIN message_scores m ON f.msg_id = m.msg_id), a AS", 1),
}
