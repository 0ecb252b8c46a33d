"""Registered queries over links."""

from __future__ import annotations

from ..functions.dialect import Duck, Spark
from ..operators import lookalikes as L
from ..operators import messages as M
from ..operators import urls as U
from .fixtures import MESSAGES, URLS, duck, read


def _urls(spark, sf_dir):
    return read(spark, sf_dir, URLS, "pages")


_PARTS = ["url_id", *U.PARTS]
_SCORES = ["url_id", "total", "risk_score", "risk_level", "is_suspicious", "confidence", "n_indicators"]


def _combined(spark, sf_dir):
    """Messages meet the scores of their links: each distinct link is scored once."""
    both = U.with_links(read(spark, sf_dir, MESSAGES, "documents")).withColumnRenamed("risk_score", "message_score")
    return both.selectExpr("msg_id", "message_score", "url_score", "n_urls", f"{U.combined_sql(Spark, 'message_score', 'url_score')} AS score")


QUERIES = {
    "url_parts": lambda spark, sf_dir: U.url_parts(_urls(spark, sf_dir)).select(*_PARTS),
    "url_indicator_facts": lambda spark, sf_dir: U.url_facts(U.url_indicators(_urls(spark, sf_dir))),
    "url_scores": lambda spark, sf_dir: U.url_scores(_urls(spark, sf_dir)).select(*_SCORES),
    "message_url_combined": _combined,
    "brand_lookalikes": lambda spark, sf_dir: L.found(U.url_parts(_urls(spark, sf_dir)).select("url_id", "host"), L.brands(spark)),
    "url_scores_by_brand_table": lambda spark, sf_dir: L.with_brands(_urls(spark, sf_dir), L.brands(spark)).select(*_SCORES),
}

_FACTS = " UNION ALL ".join(f"SELECT url_id, '{x}' AS indicator, p_{x} AS points FROM i WHERE p_{x} IS NOT NULL" for x in U.INDICATORS)
_FOUND = f"list_distinct(list_filter(list_transform(regexp_extract_all(text, '{M.URL_PATTERN}'), lambda u: regexp_replace(u, '{M.URL_TRAILER}', '')), lambda u: u <> ''))"
ORACLE = {
    "url_parts": f"SELECT {', '.join(_PARTS)} FROM ({U.oracle_parts(duck(URLS))})",
    "url_indicator_facts": f"WITH i AS ({U.oracle_indicators(duck(URLS))}) {_FACTS}",
    "url_scores": f"SELECT {', '.join(_SCORES)} FROM ({U.oracle_scores(duck(URLS))})",
    "brand_lookalikes": L.oracle(f"SELECT url_id, host FROM ({U.oracle_parts(duck(URLS))})"),
    "url_scores_by_brand_table": f"SELECT {', '.join(_SCORES)} FROM ({U.oracle_scores(duck(URLS))})",
    "message_url_combined": f"""WITH {M.oracle_ctes(MESSAGES)}, mentions AS (SELECT msg_id, unnest({_FOUND}) AS url FROM messages),
      scored_urls AS ({U.oracle_scores('SELECT DISTINCT url FROM mentions')}),
      best AS (SELECT msg_id, max(risk_score) AS url_score, count(*) AS n_urls FROM mentions m JOIN scored_urls s ON m.url = s.url GROUP BY msg_id)
      SELECT m.msg_id, risk_score AS message_score, url_score, coalesce(n_urls, 0) AS n_urls, {U.combined_sql(Duck, 'risk_score', 'url_score')} AS score FROM message_scores m LEFT JOIN best b ON m.msg_id = b.msg_id""",
}
