"""Payment links, decoded payloads, attachments and senders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dialect import Duck, Spark
from .messages import level_sql
from .urls import BRACKET, _edged, _official, _through, edged_term, nested_sql  # noqa: F401


def field_steps(d) -> list[list[str]]:
    """From ``uri`` to the fields of a payment link; the first value of a name counts."""
    first = lambda *names: d.part("query", f"(?:^|&)(?i:{'|'.join(names)})=([^&]*)", 1)
    clean = lambda x: f"nullif(trim({d.decode(d.form(x))}), '')"
    amount = d.number(f"nullif(replace(trim({d.form(first('am'))}), ',', ''), '')")
    return [
        ["trim(coalesce(uri, '')) AS raw"],
        [f"{d.match('raw', '^(?i:upi):')} AS is_upi", f"{d.part('raw', '^[^?#]*[?]([^#]*)', 1)} AS query"],
        [f"CASE WHEN is_upi THEN lower({d.swap(d.part('raw', '^[A-Za-z]+:(?://([^/?#]+)|(?://)?([^?#]*))', 1) + ' || ' + d.part('raw', '^[A-Za-z]+:(?://([^/?#]+)|(?://)?([^?#]*))', 2), '^/+', '')}) ELSE '' END AS action",
         f"CASE WHEN is_upi THEN {clean(first('pa'))} END AS payee_address", f"CASE WHEN is_upi THEN {clean(first('pn'))} END AS payee_name",
         f"CASE WHEN is_upi AND {amount} >= 0 AND {amount} < CAST(1e300 AS DOUBLE) THEN {amount} END AS amount", f"CASE WHEN is_upi THEN {clean(first('cu'))} END AS currency",
         f"CASE WHEN is_upi THEN {clean(first('tn'))} END AS note", f"CASE WHEN is_upi THEN {clean(first('mc'))} END AS merchant_code",
         f"CASE WHEN is_upi THEN coalesce({clean(first('tr'))}, {clean(first('tid'))}) END AS ref"],
        ["action = 'pay' AND coalesce(payee_address, payee_name) IS NOT NULL AS valid_upi",
         "NOT is_upi OR (action = 'pay' AND coalesce(payee_address, payee_name) IS NULL) AS malformed"],
    ]


FIELDS = ["action", "payee_address", "payee_name", "amount", "currency", "note", "merchant_code", "ref", "valid_upi", "malformed"]
POINTS = {
    "malformed_upi_uri": "CASE WHEN malformed THEN 8 END",
    "non_pay_action": "CASE WHEN action <> '' AND action <> 'pay' THEN 4 END",
    "payment_destination_detected": "CASE WHEN payee_address IS NOT NULL THEN 8 END",
    "recipient_not_named": "CASE WHEN payee_address IS NOT NULL AND payee_name IS NULL THEN 6 END",
    "embedded_payment_amount": "CASE WHEN amount IS NOT NULL THEN 10 END",
    "payment_amount_threshold_3": "CASE WHEN amount >= 100000 THEN 22 END",
    "payment_amount_threshold_2": "CASE WHEN amount >= 50000 AND amount < 100000 THEN 14 END",
    "payment_amount_threshold_1": "CASE WHEN amount >= 10000 AND amount < 50000 THEN 8 END",
}
INDICATORS = [*POINTS, *(f for f, _, _ in rules.NOTE_FAMILIES)]


def score_steps(d) -> list[list[str]]:
    words = {f: d.match("low_note", f"(^|[^a-z])({'|'.join(ws)})($|[^a-z])") for f, _, ws in rules.NOTE_FAMILIES}
    notes = [f for f, _, _ in rules.NOTE_FAMILIES]
    note_points = " + ".join(f"coalesce(p_{f}, 0)" for f in notes)
    pairs = " + ".join(f"CASE WHEN p_{a} IS NOT NULL AND p_{b} IS NOT NULL THEN {p} ELSE 0 END" for a, b, p in rules.PAYMENT_PAIRS)
    cluster = " + ".join(f"CAST(p_{f} IS NOT NULL AS INT)" for f in notes)
    return [
        ["lower(coalesce(note, '')) AS low_note"],
        [f"CAST({x} AS DOUBLE) AS p_{n}" for n, x in POINTS.items()] + [f"CAST(CASE WHEN {words[f]} THEN {p} END AS DOUBLE) AS p_{f}" for f, p, _ in rules.NOTE_FAMILIES],
        [f"least(CAST(100 AS DOUBLE), {' + '.join(f'coalesce(p_{x}, 0)' for x in POINTS)} + least(CAST(45 AS DOUBLE), {note_points}) + {pairs} + CASE WHEN {cluster} >= 3 THEN 10 ELSE 0 END) AS total"],
        [f"CAST({d.even}(total, 0) AS INT) AS risk_score", f"{level_sql('total')} AS risk_level", "total >= 50 AS is_suspicious", "least(92, 45 + CAST(floor(total * 45 / 100) AS INT)) AS confidence"],
    ]


def payment_fields(payments: DataFrame) -> DataFrame:
    return _through(payments, field_steps(Spark))


def payment_scores(payments: DataFrame) -> DataFrame:
    return _through(payment_fields(payments), score_steps(Spark))


def payment_facts(scored: DataFrame, key: str = "pay_id") -> DataFrame:
    facts = F.array(*(F.struct(F.lit(x).alias("indicator"), F.col(f"p_{x}").alias("points")) for x in INDICATORS))
    return scored.select(key, F.explode(facts).alias("f")).select(key, "f.*").where("points is not null")


# ---- payloads -----------------------------------------------------------------------------------

def content_type_sql(d) -> str:
    p = "trim(coalesce(payload, ''))"
    return (f"CASE WHEN {p} = '' THEN 'unknown' WHEN {d.match(p, '^(?i:https?)://')} THEN 'url' WHEN {d.match(p, '^(?i:upi):')} THEN 'upi' "
            f"WHEN contains({p}, chr(10)) OR contains({p}, chr(13)) THEN 'text' WHEN {d.match(p, '^[A-Za-z][A-Za-z0-9+.-]*:')} THEN 'unknown' ELSE 'text' END")


def input_type_sql(d) -> str:
    return f"CASE WHEN {d.match('trim(content)', '^(?i:https?)://')} THEN 'url' WHEN {d.match('trim(content)', '^(?i:upi):')} THEN 'upi' ELSE 'message' END"


def combined_scores(scored: DataFrame) -> DataFrame:
    """From ``container, pos, content_type, risk_score`` to one verdict for each container: scores fold from the
    strongest down, each taking up to seven tenths of what is left."""
    fold = F.aggregate(
        F.sort_array(F.collect_list(F.coalesce("risk_score", F.lit(0)).cast("double")), asc=False), F.lit(0.0),
        lambda total, s: total + (100.0 - total) * (s / 100.0) * F.when(total == 0, 1.0).otherwise(0.7),
    )
    return scored.groupBy("container").agg(F.count(F.lit(1)).alias("n_payloads"), F.bround(fold, 6).alias("score"), F.min_by("content_type", "pos").alias("primary_type"))


# ---- attachments and senders ---------------------------------------------------------------------

def attachment_steps(d) -> list[list[str]]:
    cases = " ".join(f"WHEN '{e}' THEN {p}" for e, p in rules.ATTACHMENTS)
    return [
        ["trim(coalesce(filename, '')) AS name"],
        [f"lower({d.part('name', '([.][^.]*)$', 1)}) AS extension"],
        [f"CASE extension {cases} ELSE 0 END AS attachment_score"],
        ["CASE WHEN attachment_score >= 50 THEN 'HIGH' WHEN attachment_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS attachment_level", "attachment_score >= 50 AS attachment_suspicious"],
    ]


def sender_steps(d) -> list[list[str]]:
    claims = " ".join(f"WHEN contains(edged_display, '{edged_term(t)}') THEN '{t}'" for t, _, need, _ in rules.BRANDS if not need)
    trusted = " ".join(f"WHEN claimed = '{t}' THEN {_official(dom)} OR contains(edged_domain, '{edged_term(t)}')" for t, dom, need, _ in rules.BRANDS if not need)
    return [
        ["lower(coalesce(display_name, '')) AS display", f"lower(CASE WHEN contains(coalesce(sender_email, ''), '@') THEN {d.part('trim(sender_email)', '([^@]*)$', 1)} ELSE coalesce(sender_domain, '') END) AS host"],
        [f"{_edged(d, 'display')} AS edged_display", f"{_edged(d, 'host')} AS edged_domain"],
        [f"CASE WHEN display = '' OR host = '' THEN NULL {claims} END AS claimed"],
        [f"coalesce(NOT CASE {trusted} END, 1 = 0) AS sender_brand_mismatch"],
        ["CASE WHEN sender_brand_mismatch THEN 22 ELSE 0 END AS sender_score"],
    ]


def attachment_risk(files: DataFrame) -> DataFrame:
    return _through(files, attachment_steps(Spark))


def sender_risk(senders: DataFrame) -> DataFrame:
    return _through(senders, sender_steps(Spark))


def oracle_fields(source: str) -> str:
    return nested_sql(source, field_steps(Duck))


def oracle_scores(source: str) -> str:
    return nested_sql(source, field_steps(Duck) + score_steps(Duck))
