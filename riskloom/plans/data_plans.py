"""Registered queries over labelled data and presentations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import Spark  # noqa: F401
from ..operators import classifier as K
from ..operators import hygiene as H
from ..operators import presentation as Z
from ..operators import urls as U
from .fixtures import LABELLED, URLS, duck, read

_T = ["documents", "labels"]
_STRATA = ["label", "scam_type", "language"]

def _rows(s, d):
    return read(s, d, LABELLED, *_T)


def _split(s, d):
    return H.stratified_split(_rows(s, d), _STRATA)


def _url_facts(s, d):
    return U.url_facts(U.url_indicators(read(s, d, URLS, "pages")))


def _classified(s, d):
    split = _split(s, d)
    return K.predict(K.fit(split.where("split = 'train'")), split.where("split = 'test'"))


QUERIES = {
    "dedupe_keep_first": lambda s, d: H.keep_first(_rows(s, d), H.text_key(F.col("text"))).select("id", "label"),
    "dedupe_by_language": lambda s, d: H.keep_first(_rows(s, d), F.lower(F.trim("text")), F.col("language")).select("id", "language"),
    "stratified_split": lambda s, d: _split(s, d).select("id", "split"),
    "split_sizes": lambda s, d: _split(s, d).groupBy(*_STRATA, "split").count().withColumnRenamed("count", "n"),
    "leakage_pairs": lambda s, d: H.overlaps(_split(s, d), H.text_key(F.col("text"))),
    "leakage_exact": lambda s, d: H.overlaps(_split(s, d), F.col("text")),
    "leakage_clean": lambda s, d: H.leakage_clean(_split(s, d)).select("id"),
    "profile_sets": lambda s, d: H.profile(_split(s, d)),
    "label_problems": lambda s, d: H.validate(_rows(s, d).withColumn("label", F.when(F.col("id") % 10 == 0, "odd").otherwise(F.col("label"))), ["id", "text", "label"]).withColumnRenamed("count", "n"),
    "redacted_text": lambda s, d: H.redacted(read(s, d, "SELECT doc_id, text FROM documents", "documents")).selectExpr("doc_id", f"{H.shortened_sql('clean')} AS redacted"),
    "weak_category": lambda s, d: _rows(s, d).selectExpr("id", f"{H.WEAK_CATEGORY} AS category"),
    "weak_indicators": lambda s, d: _rows(s, d).selectExpr("id", "text", f"{H.WEAK_CATEGORY} AS category").selectExpr("id", f"{H.weak_indicators_sql()} AS indicators"),
    "zone_counts": lambda s, d: Z.zones(U.url_scores(read(s, d, URLS, "pages"))).groupBy("zone").count().withColumnRenamed("count", "n_urls"),
    "factor_breakdown": lambda s, d: Z.factor_breakdown(_url_facts(s, d), "url_id"),
    "top_reasons": lambda s, d: Z.top_reasons(_url_facts(s, d), "url_id"),
    "tfidf_terms": lambda s, d: K.tfidf(_rows(s, d)),
    "classifier_predictions": _classified,
}

_L = duck(LABELLED)
_SPLIT = f"(SELECT *, {H.SPLIT_SQL} AS split FROM (SELECT *, count(*) OVER (PARTITION BY label, scam_type, language) AS _n, row_number() OVER (PARTITION BY label, scam_type, language ORDER BY md5('42' || CAST(id AS VARCHAR)), id) AS _r FROM ({_L})))"


def _overlap(key: str) -> str:
    return f"SELECT splits, count(*) AS n_texts FROM (SELECT key, string_agg(split, '+' ORDER BY split) AS splits, count(*) AS n FROM (SELECT DISTINCT {key} AS key, split FROM {_SPLIT}) GROUP BY key) WHERE n > 1 GROUP BY splits"


_GRAMS = r"""SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM (%s))""" % _L
_FACTS = " UNION ALL ".join(f"SELECT url_id, '{x}' AS indicator, p_{x} AS points FROM i WHERE p_{x} IS NOT NULL" for x in U.INDICATORS)
_FACTED = f"WITH i AS ({U.oracle_indicators(duck(URLS))}), facts AS ({_FACTS})"
ORACLE = {
    "dedupe_keep_first": f"SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY {H.TEXT_KEY_SQL} ORDER BY id) AS r FROM ({_L})) WHERE r = 1",
    "dedupe_by_language": f"SELECT id, language FROM (SELECT id, language, row_number() OVER (PARTITION BY lower(trim(text)), language ORDER BY id) AS r FROM ({_L})) WHERE r = 1",
    "stratified_split": f"SELECT id, split FROM {_SPLIT}",
    "split_sizes": f"SELECT label, scam_type, language, split, count(*) AS n FROM {_SPLIT} GROUP BY ALL",
    "leakage_pairs": _overlap(H.TEXT_KEY_SQL),
    "leakage_exact": _overlap("text"),
    "leakage_clean": f"WITH s AS (SELECT id, split, {H.TEXT_KEY_SQL} AS key FROM {_SPLIT}) SELECT id FROM s WHERE split = 'test' AND key NOT IN (SELECT key FROM s WHERE split <> 'test')",
    "profile_sets": f"SELECT split, label, scam_type, language, source, count(*) AS n FROM {_SPLIT} GROUP BY GROUPING SETS ((split), (split, label), (split, scam_type), (split, language), (split, source))",
    "label_problems": f"SELECT 'odd' AS label, count(*) AS n FROM ({_L}) WHERE id % 10 = 0 HAVING count(*) > 0",
    "redacted_text": f"SELECT doc_id, {H.shortened_sql('clean')} AS redacted FROM (SELECT doc_id, {H.redaction_sql(True)} AS clean FROM documents)",
    "weak_category": f"SELECT id, {H.WEAK_CATEGORY} AS category FROM ({_L})",
    "weak_indicators": f"SELECT id, {H.weak_indicators_sql()} AS indicators FROM (SELECT id, text, {H.WEAK_CATEGORY} AS category FROM ({_L}))",
    "zone_counts": f"SELECT zone, count(*) AS n_urls FROM (SELECT {Z.ZONE} AS zone FROM ({U.oracle_scores(duck(URLS))})) GROUP BY zone",
    "factor_breakdown": f"{_FACTED} SELECT url_id, factor, sum(points) AS contribution, string_agg(indicator, ',' ORDER BY indicator) AS indicators FROM (SELECT *, {Z.FACTOR} AS factor FROM facts) GROUP BY url_id, factor",
    "top_reasons": f"{_FACTED} SELECT url_id, string_agg(indicator, ',' ORDER BY r) AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY url_id ORDER BY points DESC, indicator) AS r FROM facts) WHERE r <= 10 GROUP BY url_id",
    "tfidf_terms": f"""WITH tf AS (SELECT id, term, count(*) AS tf FROM ({_GRAMS}) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
      raw AS (SELECT id, tf.term, (1 + ln(tf)) * (ln((1 + CAST((SELECT count(*) FROM ({_L})) AS DOUBLE)) / (1 + df)) + 1) AS x FROM tf JOIN df ON tf.term = df.term)
      SELECT r.id, term, round(x / norm, 9) AS weight FROM raw r JOIN (SELECT id, sqrt(sum(x * x)) AS norm FROM raw GROUP BY id) n ON r.id = n.id""",
}
