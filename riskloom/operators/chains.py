"""Chains of artefacts: pairs that belong together, patterns, scores and classes.

``stages`` has ``chain_id, idx, type, risk_score, is_suspicious, scam_type, indicators`` (blank-joined), ``url, payee, content``.
Every ordered pair of a chain may be an edge, as the result lists edges between stages that are not neighbours; a
chain is one user's session, so its length is bounded by what its owner did.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import Duck, Spark
from .messages import level_sql

# Categories by family.
FAMILIES = {
    "credential": ("fake_kyc", "kyc", "credential_phishing", "phishing", "account_security", "account_freeze", "otp"),
    "payment": ("payment_fraud", "prize", "prize_scam", "refund", "refund_scam", "reward", "loan", "loan_scam", "investment", "investment_scam", "job", "job_scam",
                "fake_fee", "fee", "cashback", "upi_fraud", "upi_payment", "upi", "recharge", "lottery", "gift", "shopping", "product"),
    "support": ("fake_customer_care", "customer_care", "tech_support", "fake_customer_support"),
}
# Parts of a stage's text that signal what it is about.
SIGNALS = {
    "credential": ("signs", ("kyc", "credential", "aadhaar", "pan", "otp", "password", "verify", "sensitive")),
    "payment": ("words", ("payment", "upi", "refund", "prize", "claim", "reward", "fee", "cashback", "pay", "transaction")),
    "language": ("signs", ("urgency", "urgent", "blocked", "expired", "immediately", "last", "suspended", "limited", "action_required", "kyc")),
    "prize": ("words", ("prize", "refund", "reward", "lucky", "cashback", "rebate", "gift", "won", "draw", "lottery")),
    "support": ("words", ("customer_care", "customer care", "helpline", "support", "service_center", "representative", "executive")),
    "job": ("words", ("job", "work from home", "wfh", "part time", "part-time", "salary", "earn", "hiring")),
    "investment": ("words", ("invest", "stock", "share", "crypto", "bitcoin", "returns", "profit", "trading")),
    "loan": ("words", ("loan", "credit", "approval", "sanctioned", "borrow")),
}
_URL_SECRETS = ("login", "verify", "kyc", "otp")


def stage_steps(d) -> list[list[str]]:
    """Families, domains and signals of each stage."""
    family = " ".join(f"WHEN lower(scam_type) IN ({', '.join(repr(x) for x in xs)}) THEN '{f}'" for f, xs in FAMILIES.items())
    has = lambda text, parts: "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"
    flags = [f"{has(text, parts)} AS sig_{n}" for n, (text, parts) in SIGNALS.items() if n not in ("credential", "payment")]
    flags.append(f"({has('signs', SIGNALS['credential'][1])} OR {has('low_url', _URL_SECRETS)}) AS sig_credential")
    flags.append(f"(type = 'upi' OR {has('words', SIGNALS['payment'][1])}) AS sig_payment")
    host = d.part("low_url", "^[a-z]+://([^/?#:]*)", 1)
    return [
        ["lower(coalesce(indicators, '') || ' ' || coalesce(scam_type, '')) AS signs", "lower(coalesce(url, '')) AS low_url", f"CASE {family} END AS family"],
        ["signs || ' ' || lower(coalesce(content, '')) AS words", f"{host} AS host"],
        [*flags, f"CASE WHEN {d.part('host', '([^.]+[.][^.]+)$', 1)} = '' THEN host ELSE {d.part('host', '([^.]+[.][^.]+)$', 1)} END AS root"],
    ]


RELATION = """CASE
  WHEN a_type = 'message' AND b_type IN ('url', 'qr') THEN CASE WHEN a_low_url <> '' OR a_is_suspicious OR a_sig_credential OR a_sig_payment OR a_sig_language THEN 'message_leads_to_url' END
  WHEN a_type = 'message' AND b_type = 'upi' THEN CASE WHEN a_sig_payment OR a_sig_language THEN 'message_leads_to_payment' END
  WHEN a_type = 'url' AND b_type = 'upi' THEN 'url_to_payment_continuation'
  WHEN a_type = 'qr' AND b_type = 'url' THEN 'qr_to_url_continuation'
  WHEN a_type = 'qr' AND b_type = 'upi' THEN 'qr_to_upi_continuation'
  WHEN a_is_suspicious AND b_is_suspicious AND a_family = b_family THEN 'consistent_flagged_sequence' END"""
EDGE_STEPS = [
    [f"{RELATION} AS relation", "CASE WHEN a_host <> '' AND (a_host = b_host OR a_host = b_root) THEN a_host WHEN a_root <> '' AND a_root IN (b_host, b_root) THEN a_root END AS shared_domain",
     "coalesce(lower(trim(a_payee)) = lower(trim(b_payee)) AND a_payee <> '', 1 = 0) AS same_payee", "a_low_url <> '' AND a_url = b_url AS same_url"],
    ["CASE relation WHEN 'message_leads_to_url' THEN 45 WHEN 'consistent_flagged_sequence' THEN 30 ELSE 50 END AS base"],
    ["least(100, base + CASE WHEN shared_domain IS NOT NULL THEN 35 ELSE 0 END + CASE WHEN same_payee THEN 35 ELSE 0 END"
     " + CASE WHEN same_url AND relation NOT IN ('url_to_payment_continuation', 'qr_to_upi_continuation') THEN 40 ELSE 0 END + CASE WHEN a_sig_credential OR a_sig_language THEN 15 ELSE 0 END"
     " + CASE WHEN b_sig_payment AND relation IN ('message_leads_to_payment', 'url_to_payment_continuation', 'qr_to_upi_continuation') THEN 12 ELSE 0 END"
     " + CASE WHEN coalesce(a_family = b_family, 1 = 0) THEN 10 ELSE 0 END + CASE WHEN a_is_suspicious AND b_is_suspicious THEN 10 ELSE 0 END) AS strength_pct",
     "CASE WHEN same_url AND relation NOT IN ('url_to_payment_continuation', 'qr_to_upi_continuation') THEN 'exact' WHEN shared_domain IS NOT NULL THEN 'domain' WHEN same_payee THEN 'upi' ELSE 'none' END AS match_type"],
]
_USED = ["type", "is_suspicious", "family", "low_url", "url", "host", "root", "payee", *(f"sig_{x}" for x in SIGNALS)]
EDGE = ["chain_id", "from_stage", "to_stage", "relation", "strength_pct", "match_type", "shared_domain"]

_CHAIN_AGGS = {
    "n_stages": "count(*)", "n_flagged": "count(CASE WHEN is_suspicious THEN 1 END)", "floor_": "max(risk_score)",
    **{f"n_{f}": f"count(CASE WHEN is_suspicious AND family = '{f}' THEN 1 END)" for f in FAMILIES},
    "first_source": "min(CASE WHEN type IN ('message', 'qr') THEN idx END)", "last_dest": "max(CASE WHEN sig_payment OR sig_credential THEN idx END)",
    "last_cred": "max(CASE WHEN sig_credential THEN idx END)", "last_pay": "max(CASE WHEN sig_payment THEN idx END)", "last_open": "max(CASE WHEN sig_payment OR type IN ('url', 'qr') THEN idx END)", "start": "min(idx)",
}
_FIRST = ["type", "sig_credential", "sig_payment", "sig_language", "sig_prize", "sig_job", "sig_investment", "sig_loan", "sig_support", "low_url"]
_SCORE_STEPS = [
    ["""CASE WHEN n_stages < 2 THEN NULL
      WHEN f_type IN ('message', 'qr') AND (f_sig_credential OR (f_type = 'qr' AND f_low_url <> '')) AND last_cred > start THEN 'kyc_phishing'
      WHEN f_type = 'qr' AND last_pay > start OR f_type = 'message' AND (f_sig_payment OR f_sig_language) AND NOT (f_sig_prize OR f_sig_job OR f_sig_investment OR f_sig_loan OR f_sig_support) AND last_pay > start THEN 'payment_scam'
      WHEN f_type IN ('message', 'qr') AND f_sig_prize AND last_pay > start THEN 'prize_refund'
      WHEN f_sig_support AND last_open > start THEN 'fake_customer_care' WHEN f_sig_job AND last_open > start THEN 'job_scam'
      WHEN f_sig_investment AND last_open > start THEN 'investment_scam' WHEN f_sig_loan AND last_open > start THEN 'loan_scam' END AS pattern""",
     "greatest(n_credential, n_payment, n_support) AS n_same"],
    ["least(CAST(100 AS DOUBLE), floor_ + CASE WHEN n_flagged > 1 THEN 14 * (1 - power(CAST(2 AS DOUBLE), 1 - n_flagged)) ELSE 0 END + least(CAST(40 AS DOUBLE), squares * 26 / 10000)"
     " + CASE WHEN n_same >= 2 THEN least(8, 4 * n_same) ELSE 0 END + CASE WHEN first_source < last_dest THEN 8 ELSE 0 END + CASE WHEN pattern IS NOT NULL THEN 6 ELSE 0 END) AS total"],
    ["CAST(floor(total + CAST(0.5 AS DOUBLE)) AS INT) AS risk_score"],
    [f"{level_sql('risk_score')} AS risk_level", """CASE WHEN n_stages < 2 OR n_flagged = 0 THEN 'none' WHEN risk_score >= 65 AND n_edges >= 1 AND n_flagged >= 2 OR pattern IS NOT NULL AND risk_score >= 50 THEN 'multi_stage_scam'
      WHEN n_edges >= 1 THEN 'potential_chain' ELSE 'none' END AS classification"""],
]
CHAIN = ["chain_id", "n_stages", "n_flagged", "n_edges", "pattern", "risk_score", "risk_level", "classification"]


def _through(df: DataFrame, steps) -> DataFrame:
    for items in steps:
        df = df.selectExpr("*", *items)
    return df


def with_signals(stages: DataFrame) -> DataFrame:
    return _through(stages, stage_steps(Spark))


def edges(signalled: DataFrame) -> DataFrame:
    a = signalled.select("chain_id", F.col("idx").alias("from_stage"), *(F.col(x).alias(f"a_{x}") for x in _USED))
    b = signalled.select("chain_id", F.col("idx").alias("to_stage"), *(F.col(x).alias(f"b_{x}") for x in _USED))
    pairs = a.join(b, "chain_id").where("from_stage < to_stage")
    return _through(pairs, EDGE_STEPS).where("relation is not null").select(*EDGE)


def ordered(found: DataFrame) -> DataFrame:
    """Edges in the order of a report: by chain, neighbours first, then the strongest, then by stage. Sorted by ranges."""
    near = F.when(F.col("to_stage") == F.col("from_stage") + 1, 0).otherwise(1)
    return found.orderBy("chain_id", near, F.desc("strength_pct"), "from_stage", "to_stage")


def chain_scores(signalled: DataFrame, found: DataFrame) -> DataFrame:
    """Pattern, score and class of each chain; edges are summed before they meet the chains."""
    per = signalled.groupBy("chain_id").agg(
        *(F.expr(x).alias(n) for n, x in _CHAIN_AGGS.items()), *(F.min_by(c, "idx").alias(f"f_{c}") for c in _FIRST))
    linked = found.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("strength_pct") * F.col("strength_pct")).alias("squares"))
    both = per.join(linked, "chain_id", "left").fillna(0, ["n_edges", "squares"])
    return _through(both, _SCORE_STEPS).select(*CHAIN)


def _nest(source: str, steps) -> str:
    for items in steps:
        source = f"SELECT *, {', '.join(items)} FROM ({source})"
    return source


def oracle_ctes(stages: str) -> str:
    d = Duck
    a, b = (", ".join(f"{s}.{x} AS {s}_{x}" for x in _USED) for s in "ab")
    pairs = f"SELECT a.chain_id, a.idx AS from_stage, b.idx AS to_stage, {a}, {b} FROM signalled a JOIN signalled b ON a.chain_id = b.chain_id AND a.idx < b.idx"
    aggs = ", ".join([*(f"{x} AS {n}" for n, x in _CHAIN_AGGS.items()), *(f"min_by({c}, idx) AS f_{c}" for c in _FIRST)])
    both = f"""SELECT p.*, coalesce(n_edges, 0) AS n_edges, coalesce(squares, 0) AS squares FROM (SELECT chain_id, {aggs} FROM signalled GROUP BY chain_id) p
      LEFT JOIN (SELECT chain_id, count(*) AS n_edges, sum(strength_pct * strength_pct) AS squares FROM edges GROUP BY chain_id) e ON p.chain_id = e.chain_id"""
    return f"""signalled AS ({_nest(stages, stage_steps(d))}), edges AS (SELECT {', '.join(EDGE)} FROM ({_nest(pairs, EDGE_STEPS)}) WHERE relation IS NOT NULL),
chains AS (SELECT {', '.join(CHAIN)} FROM ({_nest(both, _SCORE_STEPS)}))"""
