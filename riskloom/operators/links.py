"""Changes between a link's baseline and its current form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dialect import Duck, Spark
from ..sources.tables import written
from . import urls as U

_SIDES = ("b", "c")
_KEPT = ["raw", "scheme", "host", "port", "path", "fragment", "query", "root", "subdomains", "tld", *(f"p_{x}" for x in U.INDICATORS)]


def both_sides(links: DataFrame) -> DataFrame:
    """Each distinct link is analysed once and joined to both sides."""
    every = links.select(F.col("baseline_url").alias("url")).unionByName(links.select(F.col("current_url").alias("url")))
    known = written(U.distinct_urls(every).select("url", "risk_score", *_KEPT), "analysed-links")
    side = lambda s: known.select(F.col("url").alias(f"{s}_url"), *(F.col(x).alias(f"{s}_{x}") for x in ("risk_score", *_KEPT)))
    return (
        links.where("current_url is not null").join(side("c"), F.col("current_url") == F.col("c_url"))
        .join(side("b"), F.col("baseline_url") == F.col("b_url"), "left")
    )


def _impact(name: str) -> str:
    if name == "scheme":
        return "CASE WHEN c_scheme = 'http' AND b_scheme = 'https' THEN 'risk_increasing' WHEN c_scheme = 'https' AND b_scheme = 'http' THEN 'negative' ELSE 'neutral' END"
    if name == "port":
        return "CASE WHEN c_port NOT IN (80, 443) THEN 'risk_increasing' WHEN b_port NOT IN (80, 443) THEN 'negative' ELSE 'neutral' END"
    return "'neutral'"


def field_changes_sql() -> list[tuple[str, str, str]]:
    """(category, condition, impact) of each structural change; both sides are links."""
    host = "b_host <> '' AND c_host <> '' AND b_host <> c_host"
    found = [
        ("scheme_changed", "b_scheme <> c_scheme AND b_scheme <> '' AND c_scheme <> ''", _impact("scheme")),
        ("hostname_changed", host, "'neutral'"), ("root_domain_changed", f"{host} AND b_root <> c_root", "'neutral'"),
        ("subdomain_changed", f"{host} AND b_subdomains <> c_subdomains", "'neutral'"), ("tld_changed", f"{host} AND b_tld <> c_tld", "'neutral'"),
        ("port_changed", "coalesce(b_port, -1) <> coalesce(c_port, -1)", _impact("port")),
        ("path_changed", "b_path <> c_path", "'neutral'"), ("fragment_changed", "b_fragment <> c_fragment", "'neutral'"),
    ]
    b, c = U._count("b_raw", "%"), U._count("c_raw", "%")
    return [*found, ("encoding_increased", f"{c} >= 4 AND {c} > {b}", "'risk_increasing'")]


def field_changes(sides: DataFrame) -> DataFrame:
    """``link_id, category, impact`` of structural changes."""
    facts = F.array(*(F.when(F.expr(cond), F.struct(F.lit(cat).alias("category"), F.expr(impact).alias("impact"))) for cat, cond, impact in field_changes_sql()))
    return sides.where("b_url is not null").select("link_id", F.explode(F.array_compact(facts)).alias("f")).select("link_id", "f.*")


def indicator_changes(sides: DataFrame) -> DataFrame:
    """Indicators that only one side has, as changes; the baseline has to be a usable link."""
    facts = F.array(*(
        F.when(F.col(f"c_p_{i}").isNotNull() & F.col(f"b_p_{i}").isNull(), F.struct(F.lit(c).alias("category"), F.lit(i).alias("indicator"), F.lit("risk_increasing").alias("impact")))
        .when(F.col(f"b_p_{i}").isNotNull() & F.col(f"c_p_{i}").isNull(), F.struct(F.lit(c).alias("category"), F.lit(i).alias("indicator"), F.lit("negative").alias("impact")))
        for i, c in rules.INDICATOR_CHANGES.items()
    ))
    return sides.where("b_host <> ''").select("link_id", F.explode(F.array_compact(facts)).alias("f")).select("link_id", "f.*")


def _params(sides: DataFrame, side: str) -> DataFrame:
    """``link_id, name, vals``: values of each parameter in order, names in lower case."""
    items = sides.where("b_url is not null").select("link_id", F.posexplode(F.split(f"{side}_query", "&")).alias("pos", "item")).where("item <> ''")
    cut = items.selectExpr("link_id", "pos", f"lower({Spark.form(Spark.part('item', '^([^=]*)', 1))}) AS name", f"{Spark.form(Spark.part('item', '^[^=]*=(.*)$', 1))} AS value")
    listed = cut.groupBy("link_id", "name").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("v"))
    return listed.select("link_id", "name", F.array_join(F.transform("v", lambda x: x["value"]), ", ").alias("vals"))


def _names(items) -> str:
    return rules.listed(items)


def param_category_sql() -> tuple[str, str]:
    tracking = f"(name IN ({_names(rules.TRACKING_PARAMS)}) OR name LIKE '%utm\\_source' OR name LIKE '%utm\\_medium' OR name LIKE '%utm\\_campaign')".replace("\\_", "_")
    dest = "contains(lower(coalesce(decoded, '')), '://')"
    category = (f"CASE WHEN old IS NULL THEN CASE WHEN name IN ({_names(rules.REDIRECT_PARAMS)}) THEN 'redirect_parameter_added' WHEN {dest} THEN 'destination_like_value_added' "
                f"WHEN name IN ({_names(rules.SECRET_PARAMS)}) THEN 'sensitive_query_parameter_added' WHEN {tracking} THEN 'tracking_parameter_added' ELSE 'query_parameter_added' END "
                f"WHEN new IS NULL THEN CASE WHEN name IN ({_names((*rules.REDIRECT_PARAMS, *rules.SECRET_PARAMS))}) THEN 'suspicious_query_parameter_removed' ELSE 'query_parameter_removed' END "
                f"ELSE 'query_parameter_value_changed' END")
    impact = (f"CASE WHEN category IN ('redirect_parameter_added', 'destination_like_value_added', 'sensitive_query_parameter_added') THEN 'risk_increasing' "
              f"WHEN category = 'suspicious_query_parameter_removed' THEN 'negative' "
              f"WHEN category = 'query_parameter_value_changed' AND (name IN ({_names(rules.REDIRECT_PARAMS)}) OR {dest}) THEN 'risk_increasing' ELSE 'neutral' END")
    return category, impact


def param_changes(sides: DataFrame) -> DataFrame:
    """Parameters added, removed or changed between the sides, most specific category first."""
    b, c = _params(sides, "b").withColumnRenamed("vals", "old"), _params(sides, "c").withColumnRenamed("vals", "new")
    both = b.join(c, ["link_id", "name"], "full_outer").where("old is null or new is null or old <> new")
    category, impact = param_category_sql()
    return both.selectExpr("*", f"{Spark.decode('new')} AS decoded").selectExpr("*", f"{category} AS category").selectExpr("link_id", "name", "category", f"{impact} AS impact")


#: Indicators that count as obfuscation.
OBFUSCATION = (
    "encoding_obfuscation", "hex_encoded_host", "punycode_domain", "internationalized_host", "mixed_script_host", "multiple_at", "confusing_userinfo", "embedded_credentials",
    "excessive_separators",
)


def flags(sides: DataFrame, side: str = "c") -> DataFrame:
    """``link_id`` and what one side's link hides: ``redirect, nested, encoded_destination, obfuscated``.

    A link may be inspected alone: the baseline plays no part.
    """
    p = lambda *names: _any(F.col(f"{side}_p_{n}").isNotNull() for n in names)
    raw = F.col(f"{side}_raw")
    marks = lambda t: (F.length(t) - F.length(F.replace(t, F.lit("://"), F.lit("")))) / 3
    decoded = F.coalesce(F.expr(Spark.decode(f"{side}_raw")), raw)
    visible, hidden = marks(raw) > 1, marks(decoded) > marks(raw)
    values = F.transform(F.filter(F.split(F.col(f"{side}_query"), "&"), lambda x: x != ""), lambda x: F.regexp_extract(x, "^[^=]*=(.*)$", 1))
    twice = F.transform(values, lambda v: _unescaped(_unescaped(F.replace(v, F.lit("+"), F.lit(" ")))))
    in_value = F.exists(twice, lambda v: F.contains(v, F.lit("://")))
    return sides.select(
        "link_id", (p("suspicious_redirect_parameter", "short_url_redirector") | visible).alias("redirect"), (p("nested_url", "encoded_nested_url") | visible | hidden).alias("nested"),
        (p("encoded_nested_url", "nested_url") | in_value).alias("encoded_destination"), (p(*OBFUSCATION) | in_value | visible | (marks(decoded) > 1)).alias("obfuscated"),
    )


def _any(tests):
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _unescaped(text):
    return F.coalesce(F.try_url_decode(F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f][0-9A-Fa-f])", "%25")), text)


def change_impact(sides: DataFrame) -> DataFrame:
    """``link_id, n_changes, n_risky, impact_points, risk_delta`` of each compared link.

    Points are those of the changes that add risk, five for an encoded destination and three for obfuscation of the current
    link, 70 at most; ``risk_delta`` is the current link's score less the baseline's.
    """
    every = (
        field_changes(sides).select("link_id", "category", "impact", F.lit("").alias("evidence"))
        .unionByName(indicator_changes(sides).select("link_id", "category", "impact", F.col("indicator").alias("evidence")))
        .unionByName(param_changes(sides).select("link_id", "category", "impact", F.col("name").alias("evidence")))
    ).distinct()
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.CHANGE_POINTS.items())
    points = F.when(F.col("impact") == "risk_increasing", F.expr(f"CASE category {cases} ELSE 4 END")).otherwise(0)
    summed = every.groupBy("link_id").agg(
        F.count(F.lit(1)).alias("n_changes"), F.count(F.when(F.col("impact") == "risk_increasing", 1)).alias("n_risky"), F.sum(points).alias("points"))
    compared = sides.where("b_url is not null")
    extra = flags(compared).select("link_id", F.when(F.col("encoded_destination"), 5).otherwise(0).alias("e"), F.when(F.col("obfuscated"), 3).otherwise(0).alias("o"))
    delta = compared.select("link_id", (F.col("c_risk_score") - F.col("b_risk_score")).alias("risk_delta"))
    both = delta.join(extra, "link_id").join(summed, "link_id", "left").fillna(0, ["n_changes", "n_risky", "points"])
    return both.select("link_id", "n_changes", "n_risky", F.least(F.lit(70), F.col("points") + F.col("e") + F.col("o")).cast("long").alias("impact_points"), F.col("risk_delta").cast("int").alias("risk_delta"))


def oracle_ctes(links: str, looked_at: str = "b_url IS NOT NULL") -> str:
    """``looked_at``: the links whose flags are wanted, with a baseline or not."""
    d = Duck
    cols = ", ".join(f"{s}.{x} AS {s}_{x}" for s in _SIDES for x in ("url", "risk_score", *_KEPT))
    fields = " UNION ALL ".join(f"SELECT link_id, '{c}' AS category, {i} AS impact FROM sides WHERE b_url IS NOT NULL AND {w}" for c, w, i in field_changes_sql())
    inds = " UNION ALL ".join(
        f"SELECT link_id, '{c}' AS category, '{i}' AS indicator, CASE WHEN c_p_{i} IS NOT NULL THEN 'risk_increasing' ELSE 'negative' END AS impact FROM sides WHERE b_host <> '' AND (c_p_{i} IS NULL) <> (b_p_{i} IS NULL)"
        for i, c in rules.INDICATOR_CHANGES.items())
    category, impact = param_category_sql()

    def params(s: str) -> str:
        return f"""(SELECT link_id, name, string_agg(value, ', ' ORDER BY pos) AS vals FROM (
          SELECT link_id, pos, lower({d.form(d.part('item', '^([^=]*)', 1))}) AS name, {d.form(d.part('item', '^[^=]*=(.*)$', 1))} AS value FROM (
            SELECT link_id, unnest(range(len(string_split({s}_query, '&')))) AS pos, unnest(string_split({s}_query, '&')) AS item FROM sides WHERE b_url IS NOT NULL) WHERE item <> '') GROUP BY link_id, name)"""

    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.CHANGE_POINTS.items())
    return f"""
links AS ({links}), every_url AS (SELECT DISTINCT url FROM (SELECT baseline_url AS url FROM links UNION ALL SELECT current_url FROM links) WHERE url IS NOT NULL),
known AS ({U.oracle_scores('SELECT url FROM every_url')}),
sides AS (SELECT l.link_id, {cols} FROM links l JOIN known c ON l.current_url = c.url LEFT JOIN known b ON l.baseline_url = b.url),
field_changes AS ({fields}), indicator_changes AS ({inds}),
param_sides AS (SELECT coalesce(o.link_id, n.link_id) AS link_id, coalesce(o.name, n.name) AS name, o.vals AS old, n.vals AS new, {d.decode('n.vals')} AS decoded
  FROM {params('b')} o FULL OUTER JOIN {params('c')} n ON o.link_id = n.link_id AND o.name = n.name),
param_changes AS (SELECT link_id, name, category, {impact} AS impact FROM (SELECT *, {category} AS category FROM param_sides WHERE old IS NULL OR new IS NULL OR old <> new)),
all_changes AS (SELECT link_id, category, impact, '' AS evidence FROM field_changes UNION SELECT link_id, category, impact, indicator FROM indicator_changes UNION SELECT link_id, category, impact, name FROM param_changes),
summed AS (SELECT link_id, count(*) AS n_changes, count(CASE WHEN impact = 'risk_increasing' THEN 1 END) AS n_risky,
  sum(CASE WHEN impact = 'risk_increasing' THEN CASE category {cases} ELSE 4 END ELSE 0 END) AS points FROM all_changes GROUP BY link_id),
looked AS (SELECT link_id, c_risk_score - b_risk_score AS risk_delta, len(string_split(c_raw, '://')) - 1 AS seen, len(string_split(url_decode(c_raw), '://')) - 1 AS seen_decoded,
  len(list_filter(string_split(c_query, '&'), lambda x: contains(x, '=') AND contains(url_decode(url_decode(replace(substr(x, strpos(x, '=') + 1), '+', ' '))), '://'))) > 0 AS in_value,
  {' OR '.join(f'coalesce(c_p_{x}, 0) > 0' for x in ('nested_url', 'encoded_nested_url'))} AS nests, {' OR '.join(f'coalesce(c_p_{x}, 0) > 0' for x in OBFUSCATION)} AS hides,
  coalesce(c_p_suspicious_redirect_parameter, c_p_short_url_redirector, 0) > 0 AS sends FROM sides WHERE {looked_at}),
flags AS (SELECT link_id, risk_delta, sends OR seen > 1 AS redirect, nests OR seen > 1 OR seen_decoded > seen AS nested, nests OR in_value AS encoded_destination,
  hides OR in_value OR seen > 1 OR seen_decoded > 1 AS obfuscated FROM looked),
change_impact AS (SELECT f.link_id, coalesce(n_changes, 0) AS n_changes, coalesce(n_risky, 0) AS n_risky,
  CAST(least(70, coalesce(points, 0) + CASE WHEN encoded_destination THEN 5 ELSE 0 END + CASE WHEN obfuscated THEN 3 ELSE 0 END) AS BIGINT) AS impact_points, CAST(risk_delta AS INT) AS risk_delta
  FROM flags f LEFT JOIN summed s ON f.link_id = s.link_id)"""
