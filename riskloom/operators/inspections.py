"""Requests about links: one link is inspected, two are compared, anything less is an error row.

A request has ``request_id`` (unique), ``url``, ``baseline_url`` and ``current_url``; null means not given. A link alone is inspected;
with a baseline it is compared with it; without a link, the baseline and the current link are compared. All requests go through the
same jobs at once: distinct links are analysed and taken apart once and meet the requests again by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import Duck, Spark
from ..sources.tables import written
from . import destinations as D
from . import links as L
from . import urls as U

# What an unusable request is told.
ERRORS = {
    "nothing": "Provide 'baseline_url' and 'current_url' to compare, or 'url' to inspect a single link.", "url": "The URL to inspect must be a non-empty string.",
    "current": "The current URL must be a non-empty string.", "baseline": "The baseline URL must be a non-empty string.",
}
NESTED = "another web address is nested inside the URL"


def routed_sql() -> list[list[str]]:
    """Select lists, one after the other, from a request to ``mode`` (inspect, compare, error), ``error`` and its two links."""
    wants = "url IS NULL AND (baseline_url IS NULL OR current_url IS NULL)"
    alone = "url IS NOT NULL AND baseline_url IS NULL"
    error = (f"CASE WHEN {wants} THEN '{ERRORS['nothing'].replace(chr(39), chr(39) * 2)}' WHEN {alone} AND trim(url) = '' THEN '{ERRORS['url']}' WHEN trim(coalesce(url, current_url)) = '' THEN '{ERRORS['current']}' "
             f"WHEN NOT ({alone}) AND trim(baseline_url) = '' THEN '{ERRORS['baseline']}' END")
    return [[f"{error} AS error", f"{alone} AS alone"],
            ["CASE WHEN error IS NOT NULL THEN 'error' WHEN alone THEN 'inspect' ELSE 'compare' END AS mode"],
            ["CASE WHEN mode = 'compare' THEN trim(baseline_url) END AS before", "CASE WHEN mode <> 'error' THEN trim(coalesce(url, current_url)) END AS now"]]


def routed(requests: DataFrame) -> DataFrame:
    rows = requests.select("request_id", *(F.col(c).cast("string").alias(c) for c in ("url", "baseline_url", "current_url")))
    for items in routed_sql():
        rows = rows.selectExpr("*", *items)
    return rows.select("request_id", "mode", "error", "before", "now")


def _opened(text: Column) -> Column:
    return L._unescaped(text)


def details(links: DataFrame) -> DataFrame:
    """``url, ok, normalized, decoded_path, decoded_query, decoded_values, hidden`` of each distinct ``url``.

    ``decoded_values`` are the parameters in order, names and values decoded, values once more; ``hidden`` says what the link keeps out of
    sight: web addresses in values, and a further one inside the link. Nothing is repaired.
    """
    own = written(U.url_parts(links.select("url").where("url is not null").distinct()), "link-parts")
    display = D.normalized(own.select(F.col("url").alias("url_id"), "url")).select(F.col("url_id").alias("url"), "normalized")
    form = lambda t: _opened(F.replace(t, F.lit("+"), F.lit(" ")))
    items = F.filter(F.split("query", "&"), lambda x: x != "")
    values = F.transform(items, lambda x: F.struct(form(F.regexp_extract(x, "(?s)^([^=]*)", 1)).alias("name"), _opened(form(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1))).alias("value")))
    marks = lambda t: (F.length(t) - F.length(F.replace(t, F.lit("://"), F.lit("")))) / 3
    opened = own.select("url", "host", "scheme", "path", "raw", _opened(F.col("path")).alias("decoded_path"), _opened(F.col("query")).alias("decoded_query"), values.alias("decoded_values"), _opened(F.col("raw")).alias("_open"))
    said = F.transform(F.filter("decoded_values", lambda v: F.contains(F.lower(v["value"]), F.lit("://"))), lambda v: F.concat(F.lit("parameter '"), v["name"], F.lit("' hides a complete web address in its (decoded) value")))
    nested = F.when((marks(F.col("raw")) > 1) | (marks(F.col("_open")) > 1), F.array(F.lit(NESTED))).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))
    usable = (F.col("host") != "") | (F.col("scheme") != "") | (F.col("path") != "")
    return opened.select("url", usable.alias("ok"), "decoded_path", "decoded_query", "decoded_values", F.concat(said, nested).alias("hidden")).join(display, "url")


def inspected(requests: DataFrame) -> DataFrame:
    """One row a request: ``mode, error``, the current link's score, flags and details, and what changed.

    An inspected link has no changes and a ``risk_delta`` of zero, an unusable request has score zero, level LOW and nulls.
    """
    rows = written(routed(requests), "requests")
    links = rows.where("mode <> 'error'").select(F.col("request_id").alias("link_id"), F.col("before").alias("baseline_url"), F.col("now").alias("current_url"))
    sides = written(L.both_sides(links), "sides")
    scores = sides.select("link_id", F.col("c_risk_score").alias("risk_score"))
    changes = L.change_impact(sides)
    known = written(details(links.select(F.col("current_url").alias("url"))), "details")
    found = rows.join(scores.withColumnRenamed("link_id", "request_id"), "request_id", "left").join(L.flags(sides).withColumnRenamed("link_id", "request_id"), "request_id", "left")
    found = found.join(changes.withColumnRenamed("link_id", "request_id"), "request_id", "left").join(known, F.col("now") == F.col("url"), "left")
    zero = lambda c, kind="long": F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    score = F.coalesce("risk_score", F.lit(0))
    level = F.when(score < 25, "LOW").when(score < 50, "MEDIUM").when(score < 75, "HIGH").otherwise("CRITICAL")
    return found.select(
        "request_id", "mode", "error", score.cast("int").alias("risk_score"), level.alias("risk_level"), "normalized", "decoded_path", "decoded_query", "decoded_values", "hidden",
        "redirect", "nested", "encoded_destination", "obfuscated", zero("n_changes"), zero("n_risky"), zero("impact_points"), zero("risk_delta", "int"), (F.coalesce("risk_delta", F.lit(0)) > 0).alias("risk_increased"))


def oracle(requests: str) -> str:
    """The same but the display form, with values and hidden parts joined, for ``request_id, url, baseline_url, current_url``."""
    d = Duck
    items = "list_filter(string_split(c_query, '&'), lambda x: x <> '')"
    pair = "[url_decode(replace(string_split(x, '=')[1], '+', ' ')), CASE WHEN contains(x, '=') THEN url_decode(url_decode(replace(substr(x, strpos(x, '=') + 1), '+', ' '))) ELSE '' END]"
    return f"""WITH routed AS ({U.nested_sql(f"({requests})", routed_sql())}),
      {L.oracle_ctes("SELECT request_id AS link_id, before AS baseline_url, now AS current_url FROM routed WHERE mode <> 'error'", "true")},
      open_ AS (SELECT link_id, c_risk_score, {d.decode('c_path')} AS decoded_path, {d.decode('c_query')} AS decoded_query, c_raw, list_transform({items}, lambda x: {pair}) AS vals FROM sides),
      told AS (SELECT *, list_concat(list_transform(list_filter(vals, lambda v: contains(lower(v[2]), '://')), lambda v: 'parameter ''' || v[1] || ''' hides a complete web address in its (decoded) value'),
        CASE WHEN len(string_split(c_raw, '://')) > 2 OR len(string_split(url_decode(c_raw), '://')) > 2 THEN ['{NESTED}'] ELSE [] END) AS hidden FROM open_)
      SELECT r.request_id, mode, error, CAST(coalesce(c_risk_score, 0) AS INT) AS risk_score, decoded_path, decoded_query, array_to_string(list_transform(vals, lambda v: v[1] || '=' || v[2]), '&') AS decoded_values,
        array_to_string(hidden, ' | ') AS hidden, redirect, nested, encoded_destination, obfuscated, CASE WHEN mode = 'compare' THEN n_changes ELSE 0 END AS n_changes, CASE WHEN mode = 'compare' THEN impact_points ELSE 0 END AS impact_points,
        CASE WHEN mode = 'compare' THEN c.risk_delta ELSE 0 END AS risk_delta
      FROM routed r LEFT JOIN told t ON r.request_id = t.link_id LEFT JOIN flags f ON r.request_id = f.link_id LEFT JOIN change_impact c ON r.request_id = c.link_id"""
