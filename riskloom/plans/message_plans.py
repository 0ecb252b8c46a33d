"""Registered queries over messages."""

from __future__ import annotations

from ..functions.dialect import Duck  # noqa: F401
from ..operators import messages as M
from ..operators.detectors import message_registry
from .fixtures import MESSAGES, read


def _messages(spark, sf_dir):
    return read(spark, sf_dir, MESSAGES, "documents")


def _found(spark, sf_dir):
    return M.indicators(_messages(spark, sf_dir))


def _levels(spark, sf_dir):
    return M.message_scores(_found(spark, sf_dir)).groupBy("lang", "risk_level").count().withColumnRenamed("count", "n_messages")


QUERIES = {
    "message_risk_levels": _levels,
    "lexicon_hits": lambda spark, sf_dir: M.lexicon_hits(_messages(spark, sf_dir)).where(f"list in ({', '.join(repr(x) for x in M.LISTS)})").groupBy("msg_id", "list").count().withColumnRenamed("count", "n_hits"),
    "message_facts": lambda spark, sf_dir: M.message_facts(_found(spark, sf_dir)),
    "message_scores": lambda spark, sf_dir: M.message_scores(_found(spark, sf_dir)),
    "detector_facts": lambda spark, sf_dir: message_registry().facts(_messages(spark, sf_dir)),
    "message_category": lambda spark, sf_dir: M.message_scores(_found(spark, sf_dir)).groupBy("category").count().withColumnRenamed("count", "n_messages"),
}

_CTES = "WITH " + M.oracle_ctes(MESSAGES)
_FACTS = " UNION ALL ".join(f"SELECT msg_id, '{x}' AS indicator, s_{x} AS severity, CAST({M._tenths(x)} AS DOUBLE) / 10 AS points FROM found WHERE s_{x} IS NOT NULL" for x in M.INDICATORS)
ORACLE = {
    "message_risk_levels": f"{_CTES} SELECT lang, risk_level, count(*) AS n_messages FROM message_scores GROUP BY lang, risk_level",
    "lexicon_hits": f"{_CTES} SELECT msg_id, list, count(*) AS n_hits FROM hits GROUP BY msg_id, list",
    "message_facts": f"{_CTES} {_FACTS}",
    "detector_facts": f"{_CTES} {_FACTS}",
    "message_scores": f"{_CTES} SELECT * FROM message_scores",
    "message_category": f"{_CTES} SELECT category, count(*) AS n_messages FROM message_scores GROUP BY category",
}
