"""Registered queries over mixed artefacts, containers, promoted chains and the evaluation of the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dialect import Duck, Spark
from ..operators import chains as C
from ..operators import classifier as K
from ..operators import evaluation as E
from ..operators import hygiene as H
from ..operators import messages as M
from ..operators import payments as P
from ..operators import research as R
from ..operators import urls as U
from ..operators import verdicts as V
from ..sources.files import ALIASES
from ..sources.tables import written
from .fixtures import LABELLED, MESSAGES, PAYMENTS, URLS, duck, read
from .payment_plans import _PAYLOADS

_ALL = ["documents", "pages", "orders"]
_ITEMS = """SELECT 'm' || CAST(msg_id AS {text}) AS item_id, CASE msg_id % 5 WHEN 0 THEN 'SMS message' WHEN 1 THEN ' MSG ' WHEN 2 THEN 'text' WHEN 3 THEN 'qr_image' END AS type, text AS content FROM ({messages})
  UNION ALL SELECT 'u' || CAST(url_id AS {text}), CASE url_id % 4 WHEN 0 THEN 'link' WHEN 1 THEN 'url' WHEN 2 THEN 'qrcode' END, url FROM ({urls})
  UNION ALL SELECT 'p' || CAST(pay_id AS {text}), CASE pay_id % 4 WHEN 0 THEN 'upi_uri' WHEN 1 THEN 'qr' WHEN 2 THEN 'chain' END, uri FROM ({pays})"""
#: Artefacts of a session: the message of the session's words, a link, a payment link or a code with a link.
_ARTEFACTS = """SELECT conv_id AS chain_id, turn AS idx, CASE (conv_id + turn) % 4 WHEN 0 THEN 'message' WHEN 1 THEN 'url' WHEN 2 THEN 'upi' ELSE 'qr' END AS type,
  CASE (conv_id + turn) % 4 WHEN 0 THEN CASE conv_id % 3 WHEN 0 THEN 'URGENT: KYC expired, share OTP, update at http://sbi-verify.site' WHEN 1 THEN 'You have won a lottery prize, pay the processing fee at http://pay.site' ELSE 'See http://www.site' END || CAST(conv_id % 5 AS {text}) || '.example.com/login ' || text
    WHEN 2 THEN 'upi://pay?pa=shop' || CAST(conv_id % 11 AS {text}) || '@upi&am=60000&tn=urgent%20refund%20claim%20now'
    ELSE 'http://sbi-verify.site' || CAST(conv_id % 5 AS {text}) || '.example.com/login?otp=1&redirect=x' END AS content FROM conversations"""
_EVALUATED = f"""SELECT m.msg_id AS id, m.text, m.lang AS language, CASE WHEN m.msg_id % 24 < 9 THEN 'scam' ELSE 'safe' END AS label,
  CASE m.msg_id % 24 WHEN 0 THEN 'kyc' WHEN 1 THEN 'credential_theft' WHEN 2 THEN 'lottery' WHEN 3 THEN 'job' WHEN 4 THEN 'investment' WHEN 5 THEN 'loan' WHEN 6 THEN 'delivery' WHEN 7 THEN 'government_impersonation'
    WHEN 8 THEN 'social_impersonation' ELSE 'safe' END AS scam_type FROM ({MESSAGES}) m"""


def _items_sql(engine) -> str:
    text = engine.text_type
    return _ITEMS.format(text=text, messages=MESSAGES, urls=URLS.format(text=text), pays=PAYMENTS.format(text=text))


def _payloads_sql(engine) -> str:
    text = engine.text_type
    return _PAYLOADS.format(urls=URLS.format(text=text), pays=PAYMENTS.format(text=text), msgs=MESSAGES)


def _items(s, d):
    return read(s, d, _items_sql(Spark), *_ALL)


def _containers(s, d):
    return V.container_verdicts(read(s, d, _payloads_sql(Spark), *_ALL))


def _stages(s, d):
    return written(V.stages(read(s, d, _ARTEFACTS, "conversations")), "stages")


def _chain_verdicts(s, d):
    return V.chain_verdicts(read(s, d, _ARTEFACTS, "conversations")).withColumn("indicators", F.array_join("indicators", ","))


def _answers(s, d):
    """The rules' answers alone, and together with the links of a message, for each labelled message."""
    rows = read(s, d, _EVALUATED, "documents")
    texts = rows.select(F.col("id").alias("msg_id"), F.col("language").alias("lang"), "text")
    scored = U.with_links(texts).select(F.col("msg_id").alias("id"), "risk_score", F.expr(U.combined_sql(Spark, "risk_score", "url_score")).alias("both"), E.dataset_category().alias("predicted_type"))
    scores = written(scored, "rule-scores")
    said = lambda score: F.when(score >= 50, "scam").otherwise("safe").alias("prediction")
    return written(E.predictions(
        rows, rules=scores.select("id", said(F.col("risk_score")), "predicted_type"), combined=scores.select("id", said(F.col("both")), "predicted_type")), "answers")


def _evaluation(s, d):
    """The whole evaluation: split, the exact classifier fitted on the training part, and all tables of the test part."""
    return R.run(_split_rows(s, d))


def _chains(s, d):
    """The stages of real sessions with their signals, and their edges."""
    signalled = written(C.with_signals(_stages(s, d)), "signalled")
    return signalled, C.edges(signalled)


def _split_rows(s, d):
    return H.stratified_split(read(s, d, LABELLED, "documents", "labels"), ["label", "scam_type", "language"])


QUERIES = {
    "verdicts": lambda s, d: V.verdicts(_items(s, d)).withColumn("indicators", F.array_join("indicators", ",")),
    "verdict_levels": lambda s, d: V.verdicts(_items(s, d)).groupBy("kind", "status", "risk_level", "scam_type").agg(F.count(F.lit(1)).alias("n_items")),
    "container_verdicts": lambda s, d: _containers(s, d).withColumn("indicators", F.array_join("indicators", ",")),
    "chain_stages": lambda s, d: _stages(s, d).drop("content"),
    "chain_verdicts": _chain_verdicts,
    "rule_confusion": lambda s, d: E.confusion(_answers(s, d), "system"),
    "category_confusion": lambda s, d: E.category_confusion(_answers(s, d)),
    "system_comparison": lambda s, d: E.comparison(_answers(s, d), ["rules", "combined", "classifier"]),
    "prediction_outcomes": lambda s, d: E.outcomes(_answers(s, d)),
    "confusion_overall": lambda s, d: E.confusion(_answers(s, d), "system"),
    "metrics_by_language": lambda s, d: E.confusion(_answers(s, d), "system", "language").where("n >= 5"),
    "metrics_by_category": lambda s, d: E.by_category(_answers(s, d).where("system = 'combined'")),
    "error_examples": lambda s, d: R.redacted_examples(_answers(s, d), read(s, d, _EVALUATED, "documents"), 3).select("system", "error", "rank", "id", "excerpt"),
    "chain_edges": lambda s, d: _chains(s, d)[1],
    "chain_scores": lambda s, d: C.chain_scores(*_chains(s, d)),
    "chain_patterns": lambda s, d: C.chain_scores(*_chains(s, d)).groupBy("pattern", "classification").agg(F.count(F.lit(1)).alias("n_chains")),
    "evaluation_job": lambda s, d: _evaluation(s, d)["comparison"],
    "leakage_totals": lambda s, d: H.leakage_totals(_split_rows(s, d)),
    "label_counts": lambda s, d: H.value_counts(read(s, d, LABELLED, "documents", "labels"), "scam_type"),
    "numbered_rows": lambda s, d: H.numbered(_split_rows(s, d).select("id", "split"), "split", "id"),
    "placeholder_text": lambda s, d: read(s, d, "SELECT doc_id, text FROM documents", "documents").select("doc_id", H.placeholders(F.col("text")).alias("clean")),
    "url_identity": lambda s, d: U.identity(U.url_parts(read(s, d, URLS, "pages"))).groupBy("url_key", "domain_key").agg(F.count(F.lit(1)).alias("n_urls")),
    "brand_evidence": lambda s, d: U.brand_evidence(U.url_indicators(read(s, d, URLS, "pages"))),
    "tfidf_char_terms": lambda s, d: K.tfidf(read(s, d, LABELLED, "documents", "labels"), of=K.char_terms),
    "tfidf_union": lambda s, d: K.term_numbers(read(s, d, LABELLED, "documents", "labels"), of=K.both_terms, max_features=120_000),
}


# ---- the same in the checking engine: results of each kind joined back by id, folds as lists ----------------------

def _names(prefix: str, names, guarded: tuple = ()) -> str:
    cases = (f"CASE WHEN {prefix}{x} IS NOT NULL{' AND NOT guarded' if x in guarded else ''} THEN '{x}' END" for x in names)
    return f"concat_ws(',', {', '.join(cases)})"


def scored_ctes(rows: str) -> str:
    """``parts``: every scored row of ``rows`` (``item_id, kind, content, content_type``)."""
    found = f"list_filter(list_transform(regexp_extract_all(content, '{M.URL_PATTERN}'), lambda u: regexp_replace(u, '{M.URL_TRAILER}', '')), lambda u: u <> '')"
    return f"""routed AS ({rows}), {M.oracle_ctes("SELECT item_id AS msg_id, '' AS lang, content AS text FROM routed WHERE content_type = 'text'")},
      text_scores AS (SELECT f.msg_id AS item_id, m.risk_score, m.risk_level, m.is_scam AS is_suspicious, m.confidence, m.category, {_names('f.s_', M.INDICATORS, rules.WEAK).replace('NOT guarded', 'NOT m.guarded')} AS indicators
        FROM found f JOIN message_scores m ON f.msg_id = m.msg_id),
      link_scores AS (SELECT item_id, url, risk_score, risk_level, is_suspicious, confidence, {_names('p_', U.INDICATORS)} AS indicators FROM ({U.oracle_scores("SELECT item_id, content AS url FROM routed WHERE content_type = 'url'")})),
      pay_scores AS (SELECT item_id, payee_address, risk_score, risk_level, is_suspicious, confidence, {_names('p_', P.INDICATORS)} AS indicators FROM ({P.oracle_scores("SELECT item_id, content AS uri FROM routed WHERE content_type = 'upi'")})),
      parts AS (SELECT r.item_id, r.kind, r.content_type, coalesce(t.risk_score, l.risk_score, p.risk_score, 0) AS risk_score, coalesce(t.risk_level, l.risk_level, p.risk_level, 'LOW') AS risk_level,
          coalesce(t.is_suspicious, l.is_suspicious, p.is_suspicious, false) AS is_suspicious, CAST(coalesce(t.confidence, l.confidence, p.confidence, CASE WHEN r.content_type = 'unknown' THEN 25 ELSE 0 END) AS DOUBLE) AS confidence,
          t.category, coalesce(t.indicators, l.indicators, p.indicators, '') AS names, CASE WHEN r.content_type = 'text' THEN ({found})[1] ELSE l.url END AS url, p.payee_address AS payee,
          CASE WHEN r.content_type = 'text' THEN content END AS words, CASE WHEN kind IN ('qr', 'upi') THEN CASE r.content_type WHEN 'url' THEN 'embedded_url_in_qr' WHEN 'upi' THEN 'upi_payment_uri' WHEN 'text' THEN 'embedded_text_in_qr' END END AS context
        FROM routed r LEFT JOIN text_scores t ON r.item_id = t.item_id LEFT JOIN link_scores l ON r.item_id = l.item_id LEFT JOIN pay_scores p ON r.item_id = p.item_id)"""


def routed_sql(items: str) -> str:
    known = ", ".join(f"('{a}', '{k}')" for a, k in ALIASES.items())
    return f"""SELECT item_id, kind, CASE WHEN kind = 'message' THEN content ELSE payload END AS content, CASE kind WHEN 'message' THEN 'text' WHEN 'url' THEN 'url' WHEN 'error' THEN NULL ELSE {P.content_type_sql(Duck)} END AS content_type
      FROM (SELECT item_id, content, trim(content) AS payload, CASE WHEN trim(coalesce(content, '')) = '' THEN 'error' WHEN trim(coalesce(type, '')) = '' THEN {P.input_type_sql(Duck)} WHEN k.kind IN ('message', 'url', 'upi', 'qr') THEN k.kind ELSE 'error' END AS kind
        FROM ({items}) i LEFT JOIN (VALUES {known}) AS k(alias, kind) ON lower(trim(i.type)) = k.alias)"""


SCORED_VERDICTS = """SELECT item_id, kind, CASE WHEN kind = 'error' THEN 'ERROR' WHEN kind IN ('qr', 'upi') THEN 'DECODED' ELSE 'ANALYSED' END AS status, content_type, risk_score, risk_level, is_suspicious,
    CASE WHEN kind = 'error' THEN NULL WHEN kind = 'message' OR kind = 'qr' AND content_type = 'text' THEN category WHEN NOT is_suspicious THEN 'safe' WHEN kind = 'upi' OR content_type = 'upi' THEN 'upi_payment' WHEN content_type = 'url' THEN 'phishing' ELSE 'other' END AS scam_type,
    confidence, concat_ws(',', context, nullif(names, '')) AS indicators FROM parts"""
_VERDICTS = f"WITH {scored_ctes(routed_sql(_items_sql(Duck)))}, verdicts AS ({SCORED_VERDICTS})"
_CONTAINERS = f"""WITH {scored_ctes(f"SELECT CAST(container AS VARCHAR) || ':' || CAST(pos AS VARCHAR) AS item_id, 'qr' AS kind, trim(coalesce(payload, '')) AS content, {P.content_type_sql(Duck)} AS content_type FROM ({_payloads_sql(Duck)})")},
    placed AS (SELECT *, CAST(split_part(item_id, ':', 1) AS BIGINT) AS container, CAST(split_part(item_id, ':', 2) AS BIGINT) AS pos FROM parts),
    folds AS (SELECT container, count(*) AS n_payloads, min_by(content_type, pos) AS primary_type, max(confidence) AS confidence,
      list_reduce(list_transform(list(risk_score ORDER BY risk_score DESC), lambda x: CAST(x AS DOUBLE)), lambda a, b: a + (100 - a) * b / 100 * CAST(0.7 AS DOUBLE)) AS score FROM placed GROUP BY container),
    each AS (SELECT container, pos, i, x FROM (SELECT container, pos, unnest(range(len(l))) AS i, unnest(l) AS x FROM (SELECT container, pos, string_split(concat_ws(',', context, nullif(names, '')), ',') AS l FROM placed)) WHERE x <> ''),
    named AS (SELECT container, string_agg(x, ',' ORDER BY pos, i) AS indicators FROM (SELECT *, row_number() OVER (PARTITION BY container, lower(x) ORDER BY pos, i) AS r FROM each) WHERE r = 1 GROUP BY container)
    SELECT f.container, n_payloads, primary_type, round_even(score, 6) AS score, CAST(round_even(round_even(score, 6), 0) AS INT) AS risk_score, {M.level_sql('round_even(score, 6)')} AS risk_level, round_even(score, 6) >= 50 AS is_suspicious, confidence, coalesce(indicators, '') AS indicators
    FROM folds f LEFT JOIN named n ON f.container = n.container"""
_STAGED = f"""SELECT CAST(split_part(item_id, ':', 1) AS BIGINT) AS chain_id, CAST(split_part(item_id, ':', 2) AS BIGINT) AS idx, kind AS type, risk_score, is_suspicious, category AS scam_type, replace(names, ',', ' ') AS indicators, url, payee, words AS content FROM parts WHERE kind <> 'error'"""
_PROMOTED = scored_ctes(routed_sql(f"SELECT CAST(chain_id AS VARCHAR) || ':' || CAST(idx AS VARCHAR) AS item_id, type, content FROM ({duck(_ARTEFACTS)})"))
_DATASET = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.DATASET_CATEGORY.items()) + " ELSE 'other' END"
_FOUND = f"list_distinct(list_filter(list_transform(regexp_extract_all(text, '{M.URL_PATTERN}'), lambda u: regexp_replace(u, '{M.URL_TRAILER}', '')), lambda u: u <> ''))"
_ANSWERS = f"""WITH rows_ AS ({_EVALUATED}), {M.oracle_ctes('SELECT id AS msg_id, language AS lang, text FROM rows_')}, mentions AS (SELECT id, unnest({_FOUND}) AS url FROM rows_),
    scored_urls AS ({U.oracle_scores('SELECT DISTINCT url FROM mentions')}), best AS (SELECT id, max(risk_score) AS url_score FROM mentions m JOIN scored_urls s ON m.url = s.url GROUP BY id),
    both_ AS (SELECT r.id, label, language, scam_type, m.risk_score, {U.combined_sql(Duck, 'm.risk_score', 'url_score')} AS both_score, {_DATASET} AS predicted_type FROM rows_ r JOIN message_scores m ON r.id = m.msg_id LEFT JOIN best b ON r.id = b.id),
    answers AS (SELECT 'rules' AS system, *, CASE WHEN risk_score >= 50 THEN 'scam' ELSE 'safe' END AS prediction FROM both_ UNION ALL SELECT 'combined', *, CASE WHEN both_score >= 50 THEN 'scam' ELSE 'safe' END FROM both_)"""
_COUNTS = "count(*) AS n, " + ", ".join(f"count(CASE WHEN {t} THEN 1 END) AS {c}" for c, t in E.COUNTS.items())
_CONFUSION = f"SELECT *, {', '.join(E.RATES)} FROM (SELECT system, {_COUNTS} FROM answers GROUP BY system)"
_L = duck(LABELLED)
_SPLIT = f"(SELECT *, {H.SPLIT_SQL} AS split FROM (SELECT *, count(*) OVER (PARTITION BY label, scam_type, language) AS _n, row_number() OVER (PARTITION BY label, scam_type, language ORDER BY md5('42' || CAST(id AS VARCHAR)), id) AS _r FROM ({_L})))"
_BRANDS = ", ".join(f"('{t}', '{','.join(sorted(dom))}')" for t, dom, _, _ in rules.BRANDS)
_CHARS = f"""SELECT id, unnest(flatten(list_transform(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> ''), lambda w: list_transform(flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, greatest(length(w) + 4 - n, 1)), lambda i: [i, n]))), lambda x: substr(' ' || w || ' ', x[1], x[2]))))) AS term FROM ({_L})"""
ORACLE = {
    "verdicts": f"{_VERDICTS} SELECT * FROM verdicts",
    "verdict_levels": f"{_VERDICTS} SELECT kind, status, risk_level, scam_type, count(*) AS n_items FROM verdicts GROUP BY ALL",
    "container_verdicts": _CONTAINERS,
    "chain_stages": f"WITH {_PROMOTED} SELECT * EXCLUDE (content) FROM ({_STAGED})",
    "chain_verdicts": f"""WITH {_PROMOTED}, {C.oracle_ctes(_STAGED)},
      each AS (SELECT chain_id, idx, i, x FROM (SELECT chain_id, idx, unnest(range(len(l))) AS i, unnest(l) AS x FROM (SELECT chain_id, idx, string_split(indicators, ' ') AS l FROM ({_STAGED}))) WHERE x <> ''),
      named AS (SELECT chain_id, string_agg(x, ',' ORDER BY idx, i) AS indicators FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, lower(x) ORDER BY idx, i) AS r FROM each) WHERE r = 1 GROUP BY chain_id)
      SELECT c.*, coalesce(indicators, '') AS indicators FROM chains c LEFT JOIN named n ON c.chain_id = n.chain_id""",
    "rule_confusion": f"{_ANSWERS} {_CONFUSION}",
    "category_confusion": f"""{_ANSWERS}, cats AS (SELECT system, scam_type AS category FROM answers UNION SELECT system, predicted_type FROM answers)
      SELECT c.system, category, count(*) AS n, count(CASE WHEN scam_type = category AND predicted_type = category THEN 1 END) AS tp, count(CASE WHEN scam_type = category AND predicted_type <> category THEN 1 END) AS fn,
        count(CASE WHEN scam_type <> category AND predicted_type = category THEN 1 END) AS fp, count(CASE WHEN scam_type <> category AND predicted_type <> category THEN 1 END) AS tn
      FROM cats c JOIN answers a ON c.system = a.system GROUP BY c.system, category""",
    "confusion_overall": f"{_ANSWERS} {_CONFUSION}",
    "metrics_by_language": f"{_ANSWERS} SELECT *, {', '.join(E.RATES)} FROM (SELECT system, language, {_COUNTS} FROM answers GROUP BY system, language) WHERE n >= 5",
    "metrics_by_category": f"""{_ANSWERS}, p AS (SELECT * FROM answers WHERE system = 'combined') SELECT *, {', '.join(E.RATES)} FROM (SELECT o.scam_type, count(*) AS n, count(CASE WHEN {E.COUNTS['tp']} THEN 1 END) AS tp, count(CASE WHEN {E.COUNTS['fn']} THEN 1 END) AS fn,
      (SELECT count(*) FROM p q WHERE q.prediction = 'scam') - count(CASE WHEN prediction = 'scam' THEN 1 END) AS fp, (SELECT count(*) FROM p q WHERE q.prediction = 'safe') - count(CASE WHEN prediction = 'safe' THEN 1 END) AS tn
      FROM p o GROUP BY o.scam_type) WHERE scam_type <> 'safe' AND n >= 5""",
    "error_examples": f"""{_ANSWERS}, wrong AS (SELECT system, error, rank, id FROM (SELECT *, CAST(row_number() OVER (PARTITION BY system, error ORDER BY id) AS INT) AS rank
        FROM (SELECT system, id, CASE WHEN label = 'scam' THEN 'false_negative' ELSE 'false_positive' END AS error FROM answers WHERE label <> prediction)) WHERE rank <= 3),
      clean AS (SELECT id, {H.redaction_sql(True)} AS clean FROM rows_ WHERE id IN (SELECT id FROM wrong))
      SELECT system, error, rank, w.id, {H.shortened_sql('clean')} AS excerpt FROM wrong w JOIN clean c ON w.id = c.id""",
    "chain_edges": f"WITH {_PROMOTED}, {C.oracle_ctes(_STAGED)} SELECT * FROM edges",
    "chain_scores": f"WITH {_PROMOTED}, {C.oracle_ctes(_STAGED)} SELECT * FROM chains",
    "chain_patterns": f"WITH {_PROMOTED}, {C.oracle_ctes(_STAGED)} SELECT pattern, classification, count(*) AS n_chains FROM chains GROUP BY pattern, classification",
    "system_comparison": f"""{_ANSWERS}, rates AS ({_CONFUSION}) SELECT s.system, coalesce(n, 0) AS n, accuracy, precision_, recall_, f1, CASE WHEN n IS NULL THEN 'no answers, rates not computed' ELSE '' END AS note
      FROM (VALUES ('rules'), ('combined'), ('classifier')) AS s(system) LEFT JOIN rates r ON s.system = r.system""",
    "prediction_outcomes": f"{_ANSWERS} SELECT system, count(*) AS total, count(*) AS available, 0 AS failures, count(CASE WHEN prediction = 'scam' THEN 1 END) AS scam, count(CASE WHEN prediction = 'safe' THEN 1 END) AS safe FROM answers GROUP BY system",
    "leakage_totals": f"""WITH s AS (SELECT split, coalesce(text, '') AS text, {H.TEXT_KEY_SQL} AS key FROM {_SPLIT}), e AS (SELECT text, any_value(key) AS key FROM s GROUP BY text HAVING count(DISTINCT split) > 1),
      k AS (SELECT key, string_agg(DISTINCT split, '+' ORDER BY split) AS splits FROM s GROUP BY key HAVING count(DISTINCT split) > 1)
      SELECT (SELECT count(*) FROM e) AS n_exact, (SELECT count(*) FROM k) AS n_normalized, (SELECT count(*) FROM (SELECT key FROM e UNION SELECT key FROM k)) AS n_either, coalesce((SELECT string_agg(DISTINCT splits, ',' ORDER BY splits) FROM k), '') AS pairs""",
    "label_counts": f"SELECT scam_type, count(*) AS n FROM ({_L}) GROUP BY scam_type",
    "numbered_rows": f"SELECT id, split, 'row-' || lpad(CAST(row_number() OVER (ORDER BY split, id) AS VARCHAR), 6, '0') AS row_id FROM {_SPLIT}",
    "url_identity": f"SELECT url_key, domain_key, count(*) AS n_urls FROM (SELECT CASE WHEN host <> '' THEN host || lower(path) END AS url_key, CASE WHEN host <> '' THEN root END AS domain_key FROM ({U.oracle_parts(duck(URLS))})) GROUP BY ALL",
    "brand_evidence": f"SELECT url_id, coalesce(i.brand, typo) AS brand, CASE WHEN i.brand IS NOT NULL THEN 'named' ELSE 'lookalike' END AS finding, expected FROM ({U.oracle_indicators(duck(URLS))}) i JOIN (VALUES {_BRANDS}) AS b(brand, expected) ON b.brand = coalesce(i.brand, i.typo)",
    "tfidf_char_terms": f"""WITH tf AS (SELECT id, term, count(*) AS tf FROM ({_CHARS}) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
      raw AS (SELECT id, tf.term, (1 + ln(tf)) * (ln((1 + CAST((SELECT count(*) FROM ({_L})) AS DOUBLE)) / (1 + df)) + 1) AS x FROM tf JOIN df ON tf.term = df.term)
      SELECT r.id, term, round(x / norm, 9) AS weight FROM raw r JOIN (SELECT id, sqrt(sum(x * x)) AS norm FROM raw GROUP BY id) n ON r.id = n.id""",
}
