"""Phrases of indicators, and entities that are often impersonated: fixed values that tables are made of."""

# What a reader is told about an indicator.
REASONS = {
    "unusual_tld": "Suspicious top-level domain detected",
    "suspicious_tld_introduced": "Suspicious top-level domain detected",
    "punycode_domain": "Punycode-encoded domain detected",
    "internationalized_host": "Internationalized (IDN) host detected",
    "mixed_script_host": "Mixed-script (homoglyph-style) characters in host detected",
    "ip_address_host": "Raw IP address used instead of a real domain",
    "numeric_domain": "Numeric-looking domain detected",
    "host_became_ip": "Host changed to a raw IP address",
    "excessive_hyphens": "Obfuscated domain structure (excessive hyphens)",
    "excessive_subdomains": "Obfuscated domain structure (excessive subdomains)",
    "long_hostname": "Unusually long hostname detected",
    "domain_complexity_increased": "Domain complexity increased versus the baseline",
    "http_scheme": "Plain, unencrypted HTTP scheme detected",
    "plain_http_introduced": "Plain HTTP scheme introduced",
    "unusual_scheme": "Unusual URL scheme detected",
    "unusual_port": "Unusual port detected",
    "port_changed": "Port changed versus the baseline",
    "long_url": "Unusually long URL detected",
    "excessive_separators": "Excessive separators used to obfuscate the URL",
    "link_changed_from_baseline": "Link changed from the previously observed baseline",
    "suspicious_keyword": "Credential-harvesting keyword indicators detected",
    "keyword_cluster": "Cluster of security-related words detected (typical of phishing pages)",
    "suspicious_link": "Suspicious link and click-pressure detected",
    "brand_impersonation": "Brand impersonation detected",
    "brand_in_subdomain": "Brand name placed in a sub-domain of an unrelated site",
    "brand_in_path": "Brand name placed in the path of an unrelated site",
    "possible_brand_typosquatting": "Possible brand typosquatting detected",
    "brand_similarity_introduced": "Brand similarity introduced versus the baseline",
    "encoding_obfuscation": "Encoding obfuscation detected",
    "encoding_increased": "Percent-encoding obfuscation increased",
    "hex_encoded_host": "Hex-encoded host detected",
    "multiple_at": "Multiple '@' separators (obfuscation) detected",
    "confusing_userinfo": "Confusing userinfo segment detected",
    "embedded_credentials": "Embedded credentials in the URL detected",
    "obfuscation_present": "Obfuscation / hidden components detected",
    "unicode_or_homoglyph_introduced": "Unicode / homoglyph-style characters introduced",
    "suspicious_redirect_parameter": "Suspicious redirect parameter detected",
    "redirect_parameter_present": "Redirect parameter detected",
    "redirect_parameter_added": "Redirect parameter added",
    "short_url_redirector": "Short-link redirector detected",
    "nested_url": "A complete address is nested inside the link",
    "encoded_nested_url": "An encoded destination is hidden inside the link",
    "nested_url_present": "Nested URL present in the link",
    "encoded_destination_present": "Encoded destination present in the link",
    "encoded_destination_appeared": "Encoded destination introduced",
    "otp_request": "OTP harvesting attempt detected",
    "credential_request": "Credential harvesting attempt detected",
    "credential_theft": "Credential-theft indicators detected",
    "kyc_request": "Fake KYC / identity-verification demand detected",
    "kyc_unblock_account_language": "Fake KYC / account-unblock language detected",
    "upi_payment_uri": "UPI payment request embedded",
    "payment_destination_detected": "Unverified payment destination detected",
    "recipient_not_named": "Payment recipient is not named (cannot be verified)",
    "embedded_payment_amount": "Pre-filled payment amount flagged",
    "payment_amount_threshold_1": "Pre-filled amount over the warning threshold",
    "payment_amount_threshold_2": "Pre-filled amount over the high threshold",
    "urgent_payment_request": "Urgent payment-request language detected",
    "refund_reward_prize_language": "Advance-fraud reward / refund language detected",
    "urgency": "Urgency pressure detected",
}
#: Said of a combination that has no phrase of its own.
COMBINATION = "Combined evidence of multiple detected patterns"

# Entity, brand, category, and whether its key has to stand alone.
ENTITIES = (
    ("sbi", "SBI", "banking", True), ("sbi_yono", "SBI YONO", "banking", False), ("hdfc", "HDFC Bank", "banking", False), ("icici", "ICICI Bank", "banking", False),
    ("axis", "Axis Bank", "banking", True), ("kotak", "Kotak Mahindra Bank", "banking", False), ("canara", "Canara Bank", "banking", False),
    ("pnb", "Punjab National Bank", "banking", False), ("bank_of_baroda", "Bank of Baroda", "banking", False), ("union_bank", "Union Bank of India", "banking", False),
    ("upi", "UPI", "payments", True), ("phonepe", "PhonePe", "payments", False), ("paytm", "Paytm", "payments", False), ("google_pay", "Google Pay", "payments", False),
    ("gpay", "Google Pay", "payments", True), ("irctc", "IRCTC", "travel", False), ("uidai", "UIDAI / Aadhaar", "government", False), ("aadhaar", "UIDAI / Aadhaar", "government", False),
    ("income_tax", "Income Tax Department", "government", False), ("india_post", "India Post", "government_post", False), ("jio", "Jio", "telecom", True),
    ("airtel", "Airtel", "telecom", False), ("vi", "Vodafone Idea", "telecom", True),
)
# Indicators that say somebody is impersonated.
IMPERSONATION = (
    "bank_impersonation", "brand_impersonation", "government_impersonation", "social_impersonation", "technology_impersonation", "brand_in_subdomain", "brand_in_path",
    "possible_brand_typosquatting",
)
