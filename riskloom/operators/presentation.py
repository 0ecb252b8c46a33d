"""Zones and factor breakdowns of scored artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Factor categories of indicators, in order; others are "Detection Signals".
FACTORS = (
    ("Brand Impersonation", ("brand_impersonation", "brand_in_subdomain", "brand_in_path", "possible_brand_typosquatting")),
    ("Phishing Indicators", ("suspicious_keyword", "keyword_cluster", "suspicious_link")),
    ("Suspicious Redirect", ("suspicious_redirect_parameter", "short_url_redirector")),
    ("Embedded / Hidden Destination", ("nested_url", "encoded_nested_url")),
    ("Obfuscation", ("encoding_obfuscation", "hex_encoded_host", "multiple_at", "confusing_userinfo", "embedded_credentials")),
    ("Domain Intelligence", ("unusual_tld", "punycode_domain", "internationalized_host", "mixed_script_host", "ip_address_host", "numeric_domain", "excessive_hyphens", "excessive_subdomains", "long_hostname")),
    ("URL Structure", ("http_scheme", "unusual_scheme", "unusual_port", "long_url", "excessive_separators")),
    ("Credential / OTP Harvesting", ("otp_request", "credential_request", "kyc_request", "kyc_unblock_account_language")),
    ("Payment Indicators", ("payment_destination_detected", "recipient_not_named", "embedded_payment_amount", "payment_amount_threshold_1", "payment_amount_threshold_2", "urgent_payment_request", "refund_reward_prize_language")),
    ("Urgency & Social Engineering", ("urgency",)),
)
ZONE = "CASE WHEN risk_score >= 60 THEN 'red' WHEN risk_score >= 25 THEN 'yellow' ELSE 'green' END"
FACTOR = "CASE " + " ".join(f"WHEN indicator IN ({', '.join(repr(x) for x in xs)}) THEN '{n}'" for n, xs in FACTORS) + " ELSE 'Detection Signals' END"


def zones(scored: DataFrame) -> DataFrame:
    return scored.withColumn("zone", F.expr(ZONE))


def factor_breakdown(facts: DataFrame, key: str) -> DataFrame:
    """``key, factor, contribution, indicators`` (sorted, comma-joined) from ``key, indicator, points``."""
    named = facts.withColumn("factor", F.expr(FACTOR))
    return named.groupBy(key, "factor").agg(F.sum("points").alias("contribution"), F.array_join(F.sort_array(F.collect_set("indicator")), ",").alias("indicators"))


def top_reasons(facts: DataFrame, key: str, most: int = 10) -> DataFrame:
    """The strongest indicators of each artefact in order, ``most`` at most (the feature is a short list)."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("points")).alias("p"), "indicator")))
    return facts.groupBy(key).agg(F.array_join(F.transform(F.slice(ordered, 1, most), lambda x: x["indicator"]), ",").alias("reasons"))
