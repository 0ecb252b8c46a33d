"""Registered queries over explanations, evidence and named entities of messages, links and payment links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import Duck
from ..functions.phrases import REASONS
from ..operators import entities as N
from ..operators import explain as X
from ..operators import messages as M
from ..operators import payments as P
from ..operators import urls as U
from ..sources.tables import written
from .fixtures import MESSAGES, PAYMENTS, URLS, duck, read


def _scored(s, d):
    """The results of the three scoring jobs, as tables: kind, their key, and whether a row is suspicious."""
    messages = written(M.with_scores(M.indicators(read(s, d, MESSAGES, "documents"))), "scored-messages")
    links = written(U.url_scores(read(s, d, URLS, "pages")), "scored-links")
    pays = written(P.payment_scores(read(s, d, PAYMENTS, "orders")), "scored-payments")
    return {"message": (messages, "msg_id", "is_scam"), "url": (links, "url_id", "is_suspicious"), "upi": (pays, "pay_id", "is_suspicious")}


def _explained(s, d, *kinds):
    found = None
    for kind, (rows, key, _) in _scored(s, d).items():
        if not kinds or kind in kinds:
            own = X.entries(rows, kind, key)
            found = own if found is None else found.unionByName(own)
    return X.explained(found)


def _told(s, d):
    """Every artefact with its parts and their phrases in one row."""
    parts = [X.told(rows, kind, key) for kind, (rows, key, _) in _scored(s, d).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _entities(s, d):
    """Of messages and links; a link's brand is part of its evidence."""
    out = None
    for kind, (rows, key, bad) in _scored(s, d).items():
        if kind == "upi":
            continue
        own = X.evidence_told(X.told(rows, kind, key))
        brand = F.coalesce("brand", "typo") if kind == "url" else F.lit(None).cast("string")
        flagged = rows.select(F.col(key).alias("key"), F.col(bad).alias("is_suspicious"), F.array_compact(F.array(F.lower(brand))).alias("brands"))
        met = own.join(flagged, "key").withColumn("texts", F.concat("texts", "brands")).withColumn("artifact_id", F.concat("kind", F.lit(":"), F.col("key").cast("string")))
        part = N.named(met, N.entities(s))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    "explanations": lambda s, d: X.listed(_explained(s, d)).drop("place"),
    "top_phrases": lambda s, d: X.top_phrases_told(_told(s, d)).withColumn("reasons", F.array_join("reasons", " | ")),
    "evidence_texts": lambda s, d: X.evidence_told(_told(s, d)).select("kind", "key", F.array_join("tokens", " ").alias("tokens"), F.array_join("texts", " | ").alias("texts")),
    "named_entities": _entities,
}

_PHRASES = ", ".join(f"('{n}', '{p.replace(chr(39), chr(39) * 2)}')" for n, p in REASONS.items())
_ENTRIES = f"""WITH {M.oracle_ctes(MESSAGES)}, flags AS MATERIALIZED (SELECT f.*, m.guarded, m.is_scam FROM found f JOIN message_scores m ON f.msg_id = m.msg_id),
  links AS MATERIALIZED ({U.oracle_scores(duck(URLS))}), pays AS MATERIALIZED ({P.oracle_scores(duck(PAYMENTS))}),
  entries AS ({X.oracle_entries('flags', 'message', 'msg_id', X.message_parts())} UNION ALL {X.oracle_entries('links', 'url', 'url_id', X.url_parts(Duck))} UNION ALL {X.oracle_entries('pays', 'upi', 'pay_id', X.payment_parts(Duck))}),
  told AS MATERIALIZED (SELECT kind, key, e.name, points, place, coalesce(phrase, {X.oracle_phrase('e.name')}) AS phrase FROM entries e LEFT JOIN (VALUES {_PHRASES}) AS r(name, phrase) ON e.name = r.name)"""
_EVIDENCE = """words AS (SELECT kind, key, place, i, w FROM (SELECT kind, key, place, unnest(range(len(l))) AS i, unnest(l) AS w FROM (SELECT *, string_split(lower(regexp_replace(name, '[^A-Za-z0-9_]', ' ', 'g')), ' ') AS l FROM told)) WHERE w <> ''),
  tokens AS (SELECT kind, key, string_agg(w, ' ' ORDER BY place, i) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY kind, key, w ORDER BY place, i) AS r FROM words) WHERE r = 1 GROUP BY kind, key),
  texts AS (SELECT kind, key, string_agg(lower(phrase), ' | ' ORDER BY place) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY kind, key, lower(phrase) ORDER BY place) AS r FROM told) WHERE r = 1 GROUP BY kind, key),
  evidence AS MATERIALIZED (SELECT t.kind, t.key, tokens, texts FROM tokens t JOIN texts x ON t.kind = x.kind AND t.key = x.key)"""
_ARTEFACTS = """SELECT e.kind || ':' || CAST(e.key AS VARCHAR) AS artifact_id, coalesce(f.is_scam, l.is_suspicious) AS is_suspicious, lower(tokens || ' ' || replace(texts, ' | ', ' ') || coalesce(' ' || coalesce(l.brand, l.typo), '')) AS text
  FROM evidence e LEFT JOIN flags f ON e.kind = 'message' AND e.key = f.msg_id LEFT JOIN links l ON e.kind = 'url' AND e.key = l.url_id WHERE e.kind <> 'upi'"""
ORACLE = {
    "explanations": f"{_ENTRIES} SELECT kind, key, name, points, phrase, row_number() OVER (PARTITION BY kind, key ORDER BY points DESC, place) AS rank FROM told",
    "top_phrases": f"""{_ENTRIES} SELECT kind, key, string_agg(phrase, ' | ' ORDER BY place) AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY place) AS n
      FROM (SELECT kind, key, phrase, min(place) AS place FROM told GROUP BY kind, key, phrase)) WHERE n <= 10 GROUP BY kind, key""",
    "evidence_texts": f"{_ENTRIES}, {_EVIDENCE} SELECT * FROM evidence",
    "named_entities": f"{_ENTRIES}, {_EVIDENCE} {N.oracle(_ARTEFACTS)}",
}
