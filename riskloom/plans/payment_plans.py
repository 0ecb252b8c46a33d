"""Registered queries over payment links, payloads, senders, attachments and link changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import Duck, Spark
from ..operators import inspections as I
from ..operators import links as L
from ..operators import messages as M
from ..operators import payments as P
from ..operators import urls as U
from .fixtures import LINKS, MESSAGES, PAYMENTS, SENDERS, URLS, duck, read

_PAY_FIELDS, _PAY_SCORES = ["pay_id", *P.FIELDS], ["pay_id", "total", "risk_score", "risk_level", "is_suspicious", "confidence"]
_ATTACHMENT = ["sender_id", "extension", "attachment_score", "attachment_level", "attachment_suspicious"]
_SENDER = ["sender_id", "claimed", "sender_brand_mismatch", "sender_score"]
_PAYLOADS = """SELECT CAST(floor(id / 3) AS BIGINT) AS container, CAST(id % 3 + 3 * kind AS BIGINT) AS pos, payload FROM (
  SELECT url_id AS id, 0 AS kind, url AS payload FROM ({urls}) UNION ALL SELECT pay_id AS id, 1 AS kind, uri AS payload FROM ({pays})
  UNION ALL SELECT msg_id AS id, 2 AS kind, text AS payload FROM ({msgs}))"""


def _payments(spark, sf_dir):
    return read(spark, sf_dir, PAYMENTS, "orders")


def _sides(spark, sf_dir):
    return L.both_sides(read(spark, sf_dir, LINKS, "pages"))


def _payloads(spark, sf_dir):
    sql = _PAYLOADS.format(urls=URLS.format(text="STRING"), pays=PAYMENTS.format(text="STRING"), msgs=MESSAGES)
    return read(spark, sf_dir, sql, "pages", "orders", "documents").selectExpr("container", "pos", "payload", f"{P.content_type_sql(Spark)} AS content_type")


def _payload_combined(spark, sf_dir):
    """Each kind of payload goes through its own job; the scores meet again by container."""
    rows = _payloads(spark, sf_dir)
    keys = ["container", "pos", "content_type"]
    url = U.url_scores(rows.where("content_type = 'url'").withColumnRenamed("payload", "url")).select(*keys, "risk_score")
    upi = P.payment_scores(rows.where("content_type = 'upi'").withColumnRenamed("payload", "uri")).select(*keys, "risk_score")
    texts = rows.where("content_type = 'text'").selectExpr("struct(container, pos, content_type) AS msg_id", "'' AS lang", "payload AS text")
    message = M.message_scores(M.indicators(texts)).select("msg_id.*", "risk_score")
    unknown = rows.where("content_type = 'unknown'").selectExpr(*keys, "0 AS risk_score")
    return P.combined_scores(url.unionByName(upi).unionByName(message).unionByName(unknown))


#: Requests of all kinds: links alone, links with a baseline, pairs, blanks and nothing.
_REQUESTS = f"""SELECT link_id AS request_id, CASE WHEN link_id % 5 < 2 THEN current_url WHEN link_id % 15 = 4 THEN ' ' END AS url, CASE WHEN link_id % 5 IN (1, 3) THEN baseline_url WHEN link_id % 5 = 2 THEN '' END AS baseline_url,
  CASE WHEN link_id % 5 IN (2, 3) THEN current_url || CASE WHEN link_id % 3 = 0 THEN '&a+b=c%20d&next=http%253A%252F%252Fevil.example' ELSE '' END END AS current_url FROM ({LINKS})"""


def _inspections(s, d):
    found = I.inspected(read(s, d, _REQUESTS, "pages"))
    values = F.array_join(F.transform("decoded_values", lambda v: F.concat(v["name"], F.lit("="), v["value"])), "&")
    return found.select(
        "request_id", "mode", "error", "risk_score", "decoded_path", "decoded_query", values.alias("decoded_values"), F.array_join("hidden", " | ").alias("hidden"), "redirect", "nested", "encoded_destination", "obfuscated",
        "n_changes", "impact_points", "risk_delta")


QUERIES = {
    "link_inspections": _inspections,
    "upi_fields": lambda s, d: P.payment_fields(_payments(s, d)).select(*_PAY_FIELDS),
    "upi_scores": lambda s, d: P.payment_scores(_payments(s, d)).select(*_PAY_SCORES),
    "upi_facts": lambda s, d: P.payment_facts(P.payment_scores(_payments(s, d))),
    "payload_types": lambda s, d: _payloads(s, d).groupBy("content_type").count().withColumnRenamed("count", "n_payloads"),
    "payload_combined": _payload_combined,
    "attachment_risk": lambda s, d: P.attachment_risk(read(s, d, SENDERS, "supplier")).select(*_ATTACHMENT),
    "sender_mismatch": lambda s, d: P.sender_risk(read(s, d, SENDERS, "supplier")).select(*_SENDER),
    "link_field_changes": lambda s, d: L.field_changes(_sides(s, d)),
    "link_indicator_changes": lambda s, d: L.indicator_changes(_sides(s, d)),
    "link_param_changes": lambda s, d: L.param_changes(_sides(s, d)),
    "change_impact": lambda s, d: L.change_impact(_sides(s, d)),
    "link_flags": lambda s, d: L.flags(_sides(s, d).where("b_url is not null")),
}

_SCORED = P.oracle_scores(duck(PAYMENTS))
_UPI_FACTS = " UNION ALL ".join(f"SELECT pay_id, '{x}' AS indicator, p_{x} AS points FROM i WHERE p_{x} IS NOT NULL" for x in P.INDICATORS)
_ROWS = f"(SELECT container, pos, payload, {P.content_type_sql(Duck)} AS content_type FROM ({_PAYLOADS.format(urls=duck(URLS), pays=duck(PAYMENTS), msgs=MESSAGES)}))"
_LINKS = "WITH " + L.oracle_ctes(duck(LINKS))
_TEXTS = "SELECT container * 9 + pos AS msg_id, '' AS lang, payload AS text FROM rows_ WHERE content_type = 'text'"
ORACLE = {
    "link_inspections": I.oracle(duck(_REQUESTS)),
    "upi_fields": f"SELECT {', '.join(_PAY_FIELDS)} FROM ({P.oracle_fields(duck(PAYMENTS))})",
    "upi_scores": f"SELECT {', '.join(_PAY_SCORES)} FROM ({_SCORED})",
    "upi_facts": f"WITH i AS ({_SCORED}) {_UPI_FACTS}",
    "payload_types": f"SELECT content_type, count(*) AS n_payloads FROM {_ROWS} GROUP BY content_type",
    "payload_combined": f"""WITH rows_ AS {_ROWS}, {M.oracle_ctes(_TEXTS)},
      parts AS (SELECT container, pos, content_type, risk_score FROM ({U.oracle_scores("SELECT container, pos, content_type, payload AS url FROM rows_ WHERE content_type = 'url'")})
        UNION ALL SELECT container, pos, content_type, risk_score FROM ({P.oracle_scores("SELECT container, pos, content_type, payload AS uri FROM rows_ WHERE content_type = 'upi'")})
        UNION ALL SELECT CAST(floor(msg_id / 9) AS BIGINT), msg_id % 9, 'text', risk_score FROM message_scores
        UNION ALL SELECT container, pos, content_type, 0 FROM rows_ WHERE content_type = 'unknown'),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY container ORDER BY risk_score DESC, pos) AS rn FROM parts)
      SELECT container, count(*) AS n_payloads, round_even(100 - exp(sum(CASE WHEN rn = 1 THEN CASE WHEN risk_score >= 100 THEN -1000 ELSE ln(CAST(100 - risk_score AS DOUBLE)) END ELSE ln(1 - CAST(risk_score AS DOUBLE) / 100 * CAST(0.7 AS DOUBLE)) END)), 6) AS score,
        min_by(content_type, pos) AS primary_type FROM ranked GROUP BY container""",
    "attachment_risk": f"SELECT {', '.join(_ATTACHMENT)} FROM ({U.nested_sql(SENDERS, P.attachment_steps(Duck))})",
    "sender_mismatch": f"SELECT {', '.join(_SENDER)} FROM ({U.nested_sql(SENDERS, P.sender_steps(Duck))})",
    "link_field_changes": f"{_LINKS} SELECT * FROM field_changes",
    "link_indicator_changes": f"{_LINKS} SELECT * FROM indicator_changes",
    "link_param_changes": f"{_LINKS} SELECT * FROM param_changes",
    "change_impact": f"{_LINKS} SELECT * FROM change_impact",
    "link_flags": f"{_LINKS} SELECT link_id, redirect, nested, encoded_destination, obfuscated FROM flags",
}
