"""Link risk: parts, indicators with points, scores.

Distinct links are analysed once, in one pass without a shuffle of their own: every rule is a column over the link's
parts. Words are looked for in a copy of the text whose punctuation is set off by bars, so one substring test
checks both of a word's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dialect import Duck, Spark
from ..sources.tables import written
from . import messages as M
from .messages import level_sql

BRACKET, BRACKETED = r"^\[", r"^\[([^\]]*)\]"
_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"
_IP4 = "^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"


def part_steps(d) -> list[list[str]]:
    """Select lists, one after the other, from ``url`` to its parts."""
    scheme = d.part("raw", _SCHEME, 1)
    return [
        ["trim(coalesce(url, '')) AS raw"],
        [f"CASE WHEN raw = '' OR contains(raw, '://') THEN raw WHEN {scheme} = '' OR contains({scheme}, '.') OR {d.match('raw', '^[A-Za-z][A-Za-z0-9+.-]*:[0-9]+([/?#]|$)')} THEN 'http://' || raw ELSE raw END AS work"],
        [f"lower({d.part('work', _SCHEME, 1)}) AS scheme"],
        ["CASE WHEN scheme = '' THEN work ELSE substr(work, length(scheme) + 2) END AS rest"],
        [f"{d.part('rest', '^//([^/?#]*)', 1)} AS netloc", f"{d.part('rest', '^(?://[^/?#]*)?([^?#]*)', 1)} AS path",
         f"{d.part('rest', '^[^?#]*[?]([^#]*)', 1)} AS query", f"{d.part('rest', '^[^#]*#(.*)$', 1)} AS fragment"],
        [f"CASE WHEN contains(netloc, '@') THEN {d.part('netloc', '^(.*)@[^@]*$', 1)} ELSE '' END AS userinfo", f"{d.part('netloc', '([^@]*)$', 1)} AS hostport"],
        [f"{d.part('userinfo', '^([^:]*)', 1)} AS username", f"{d.part('userinfo', '^[^:]*:(.*)$', 1)} AS password",
         f"lower({d.swap('CASE WHEN ' + d.match('hostport', BRACKET) + ' THEN ' + d.part('hostport', BRACKETED, 1) + ' ELSE ' + d.part('hostport', '^([^:]*)', 1) + ' END', '[.]+$', '')}) AS host",
         f"CASE WHEN {d.number(d.part('hostport', ':([0-9]+)$', 1))} <= 65535 THEN CAST({d.number(d.part('hostport', ':([0-9]+)$', 1))} AS INT) END AS port"],
        [f"{d.match('host', _IP4)} OR contains(host, ':') AS is_ip", f"{d.part('host', '([^.]+[.][^.]+)$', 1)} AS last2", f"{d.part('host', '([^.]+[.][^.]+[.][^.]+)$', 1)} AS last3"],
        [f"CASE WHEN is_ip OR last2 = '' THEN host WHEN last2 IN ({rules.listed(rules.SUFFIXES)}) THEN CASE WHEN last3 = '' THEN host ELSE last3 END ELSE last2 END AS root",
         f"CASE WHEN is_ip OR last2 = '' THEN '' WHEN last2 IN ({rules.listed(rules.SUFFIXES)}) THEN last2 ELSE {d.part('host', '([^.]+)$', 1)} END AS tld"],
        ["CASE WHEN length(host) > length(root) THEN substr(host, 1, length(host) - length(root) - 1) ELSE '' END AS subdomains"],
    ]


PARTS = ["raw", "scheme", "host", "port", "username", "password", "path", "query", "fragment", "root", "subdomains", "tld"]


def _edged(d, text: str) -> str:
    swapped = f"regexp_replace({text}, r'([^\\p{{L}}\\p{{N}}_])', r'|$1|')" if not d.duck else f"regexp_replace({text}, '([^\\p{{L}}\\p{{N}}_])', '|\\1|', 'g')"
    return f"('|' || {swapped} || '|')"


def edged_term(term: str) -> str:
    return "|" + "".join(c if c.isalnum() or c == "_" else f"|{c}|" for c in term) + "|"


def _has(text: str, term: str) -> str:
    return f"contains({text}, '{edged_term(term)}')"


def _count(text: str, part: str) -> str:
    return f"((length({text}) - length(replace({text}, '{part}', ''))) / {len(part)})"


def _param(d, names) -> str:
    return d.match("low_query", f"(^|&)({'|'.join(names)})(=|&|$)")


def _official(domains) -> str:
    return "(" + " OR ".join([f"host = '{x}' OR host LIKE '%.{x}'" for x in domains] or ["1 = 0"]) + ")"


def _brand_in(d, text: str, edged: str, token: str, more) -> str:
    tests = [f"{_has(edged, c)} OR {d.match(text, f'(^|[.])[-_]*{c}[a-z]+[-_]*([.]|$)')}" for c in (token, *more)]
    return "(" + " OR ".join(tests) + ")"


def _folded(text: str) -> str:
    return f"translate(replace(lower({text}), 'rn', 'm'), '0134578|!@$', 'oleastblias')"


def _looks_like(d, token: str) -> str:
    fold = token.lower().replace("rn", "m").translate(str.maketrans("0134578|!@$", "oleastblias"))
    near = [f"{_folded('l')} = '{fold}'"]
    if len(token) >= 5:
        near.append(f"levenshtein(l, '{token}') <= 1")
    if len(token) >= 6:
        near.append(f"(length(l) = {len(token)} AND levenshtein(l, '{token}') <= 2)")
    body = f"l <> '' AND l <> '{token}' AND ({' OR '.join(near)})"
    return f"exists(split(host, '[.]'), l -> {body})" if not d.duck else f"len(list_filter(string_split(host, '.'), lambda l: {body})) > 0"


_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Devanagari", "Arabic", "Han")
STRONG = ("kyc", "otp", "password", "login", "verify", "verification", "wallet", "suspended", "unblock", "netbanking")  # fixed values


def indicator_steps(d) -> list[list[str]]:
    """Select lists from the parts to the points ``p_<indicator>`` of each indicator (null: absent)."""
    slashes, dots, percents = _count("path", "/"), _count("host", "."), _count("raw", "%")
    label = d.part("root", "^([^.]*)", 1)
    scripts = " + ".join(f"CAST({d.match('name', chr(92) + 'p{' + ('' if d.duck else 'Is') + s + '}')} AS INT)" for s in _SCRIPTS)
    words = " + ".join(f"CAST({_has('hay', k)} AS INT)" for k in rules.KEYWORDS)
    secrets = " + ".join(f"CAST({_param(d, [n])} AS INT)" for n in rules.SECRET_PARAMS)
    brand = " ".join(f"WHEN NOT {_official(dom)} AND {_brand_in(d, 'host', 'edged_host', t, more)}{' AND n_words > 0' if need else ''} THEN '{t}'" for t, dom, need, more in rules.BRANDS)
    brand_sub = " ".join(f"WHEN brand = '{t}' THEN {_brand_in(d, 'subdomains', 'edged_sub', t, more)}" for t, _, _, more in rules.BRANDS)
    in_path = " ".join(f"WHEN NOT {_official(dom)} AND NOT {_has('edged_host', t)} AND {_has('edged_path', t)} THEN '{t}'" for t, dom, need, _ in rules.BRANDS if not need)
    typo = " ".join(f"WHEN NOT {_official(dom)} AND NOT {_brand_in(d, 'host', 'edged_host', t, more)} AND {_looks_like(d, t)} THEN '{t}'" for t, dom, need, more in rules.BRANDS if not need)
    points = {
        "http_scheme": "CASE WHEN scheme = 'http' THEN 6 END",
        "unusual_scheme": "CASE WHEN scheme NOT IN ('', 'http', 'https') THEN 30 END",
        "ip_address_host": "CASE WHEN is_ip THEN 34 END",
        "punycode_domain": "CASE WHEN contains(host, 'xn--') THEN 12 END",
        "internationalized_host": f"CASE WHEN {d.match('host', '[^ -~]')} THEN 10 END",
        "mixed_script_host": f"CASE WHEN {scripts} >= 2 THEN 12 END",
        "embedded_credentials": "CASE WHEN username <> '' OR password <> '' THEN 55 END",
        "long_url": "CASE WHEN length(raw) > 2048 THEN 14 WHEN length(raw) > 500 THEN 8 WHEN length(raw) > 200 THEN 4 END",
        "long_hostname": "CASE WHEN length(host) > 50 THEN 4 END",
        "long_path": "CASE WHEN length(path) > 150 THEN 4 END",
        "many_query_parameters": f"CASE WHEN {d.size}({d.parts('query', '[^&]+')}) >= 6 THEN 4 END",
        "excessive_subdomains": f"CASE WHEN host = '' THEN NULL WHEN {dots} - 1 >= 5 THEN 12 WHEN {dots} - 1 >= 3 THEN 6 END",
        "unusual_port": "CASE WHEN port NOT IN (80, 443) THEN 14 END",
        "encoding_obfuscation": f"CASE WHEN {percents} >= 10 THEN 14 WHEN {percents} >= 4 THEN 8 END",
        "nested_url": f"CASE WHEN {_count('raw', '://')} > 1 THEN 10 END",
        "encoded_nested_url": f"CASE WHEN {_count('decoded', '://')} > {_count('raw', '://')} THEN 10 END",
        "hex_encoded_host": f"CASE WHEN {d.match('name', '^[0-9a-f]{8}$')} AND {d.match('name', '^(0a|7f|00|ac1|c0a8|a9fe)')} OR {d.match('name', '^[0-9a-f]{32}$')} AND {d.match('name', '^(fc|fd|fe[89ab]|0{31}1)')} THEN 10 END",
        "multiple_at": f"CASE WHEN {_count('raw', '@')} > 1 THEN 18 END",
        "confusing_userinfo": f"CASE WHEN {_count('raw', '@')} <= 1 AND contains(username, '.') THEN 18 END",
        "excessive_separators": f"CASE WHEN contains(path, '//') OR {slashes} >= 6 THEN 5 END",
        "excessive_hyphens": f"CASE WHEN {d.match('host', '-[^.]*-[^.]*-')} OR {d.match('host', '-.*[.].*-')} OR {_count('host', '-')} >= 4 THEN 6 END",
        "numeric_domain": f"CASE WHEN NOT is_ip AND length(name) >= 8 AND 2 * length({d.swap('name', '[^0-9]', '')}) >= length(name) THEN 6 END",
        "short_url_redirector": f"CASE WHEN last2 IN ({rules.listed(rules.SHORTENERS)}) THEN 12 END",
        "suspicious_keyword": "CASE WHEN n_words > 0 THEN 6 * least(n_words, 4) END",
        "keyword_cluster": "CASE WHEN n_words >= 3 THEN 10 END",
        "suspicious_redirect_parameter": f"CASE WHEN {_param(d, rules.REDIRECT_PARAMS)} THEN 12 END",
        "suspicious_query_param": "CASE WHEN n_secrets > 0 THEN 5 * least(n_secrets, 2) END",
        "unusual_tld": f"CASE WHEN tld IN ({rules.listed(rules.CHEAP_TLDS)}) THEN 4 END",
        "brand_impersonation": "CASE WHEN brand IS NULL THEN NULL WHEN n_words = 0 THEN 16 WHEN brand_in_sub THEN 24 ELSE 30 END",
        "brand_in_subdomain": "CASE WHEN brand_in_sub AND root <> '' THEN 8 END",
        "brand_in_path": f"CASE WHEN n_words > 0 THEN CASE {in_path} END IS NOT NULL THEN 6 END".replace("CASE WHEN n_words > 0 THEN CASE", "CASE WHEN n_words > 0 AND CASE"),
        "possible_brand_typosquatting": "CASE WHEN typo IS NOT NULL THEN 14 END",
    }
    return [
        [f"coalesce({d.decode('raw')}, raw) AS decoded", f"lower(coalesce({d.decode('query')}, query)) AS low_query", f"{label} AS name",
         f"{_edged(d, 'host')} AS edged_host", f"{_edged(d, 'subdomains')} AS edged_sub", f"{_edged(d, 'lower(path)')} AS edged_path"],
        [f"edged_host || '#' || {_edged(d, d.part('lower(decoded)', '([^@]*)$', 1))} AS hay"],
        [f"{words} AS n_words", f"{secrets} AS n_secrets"],
        [f"CASE WHEN host = '' THEN NULL {brand} END AS brand", f"CASE WHEN host = '' THEN NULL {typo} END AS typo"],
        [f"coalesce(CASE {brand_sub} END, 1 = 0) AS brand_in_sub"],
        [f"CAST({x} AS DOUBLE) AS p_{n}" for n, x in points.items()],
    ]


INDICATORS = [x.split(" AS p_")[1] for x in indicator_steps(Spark)[-1]]


def score_steps(d) -> list[list[str]]:
    size = " + ".join(f"coalesce(p_{x}, 0)" for x in rules.SIZE_FAMILY)
    capped = " + ".join(f"{d.even}(coalesce(p_{x}, 0) * 20 / size_points, 2)" for x in rules.SIZE_FAMILY)
    rest = " + ".join(f"coalesce(p_{x}, 0)" for x in INDICATORS if x not in rules.SIZE_FAMILY)
    pairs = " + ".join(f"CASE WHEN p_{a} IS NOT NULL AND p_{b} IS NOT NULL THEN {p} ELSE 0 END" for a, b, p in rules.URL_PAIRS)
    count = " + ".join(f"CAST(p_{x} IS NOT NULL AS INT)" for x in INDICATORS)
    return [
        [f"{size} AS size_points", f"{count} AS n_indicators"],
        [f"least(CAST(100 AS DOUBLE), {rest} + CASE WHEN size_points > 20 THEN {capped} ELSE size_points END + {pairs}) AS total"],
        [f"CAST({d.even}(total, 0) AS INT) AS risk_score"],
        [f"{level_sql('risk_score')} AS risk_level", "risk_score >= 50 AS is_suspicious",
         f"CASE WHEN n_indicators = 0 THEN 0 ELSE least(100, CAST({d.even}(40 + total * 6 / 10 + least(n_indicators, 8) * 25 / 10, 0) AS INT)) END AS confidence"],
    ]


def _through(df: DataFrame, steps) -> DataFrame:
    for items in steps:
        df = df.selectExpr("*", *items)
    return df


def url_parts(urls: DataFrame) -> DataFrame:
    """``url`` and its parts, for each row; null and blank links have empty parts."""
    return _through(urls, part_steps(Spark))


def url_indicators(urls: DataFrame) -> DataFrame:
    return _through(url_parts(urls), indicator_steps(Spark))


def distinct_urls(urls: DataFrame) -> DataFrame:
    """Each link once, with all that is known of it: join back on ``url``."""
    return _through(url_indicators(urls.select("url").where("url is not null").distinct()), score_steps(Spark))


def scored(indicators: DataFrame) -> DataFrame:
    """``url_indicators``' result with scores."""
    return _through(indicators, score_steps(Spark))


def url_scores(urls: DataFrame) -> DataFrame:
    return scored(url_indicators(urls))


def url_facts(indicators: DataFrame, key: str = "url_id") -> DataFrame:
    """Long form: ``key, indicator, points``."""
    facts = F.array(*(F.struct(F.lit(x).alias("indicator"), F.col(f"p_{x}").alias("points")) for x in INDICATORS))
    return indicators.select(key, F.explode(facts).alias("f")).select(key, "f.*").where("points is not null")


def identity(parts: DataFrame) -> DataFrame:
    """Adds ``url_key`` (host and path in lower case; null without a host) and ``domain_key`` (registrable root) to ``url_parts``.

    Links with equal keys are the same for matching, whatever their scheme, query or case.
    """
    seen = F.col("host") != ""
    return parts.withColumn("url_key", F.when(seen, F.concat("host", F.lower("path")))).withColumn("domain_key", F.when(seen, F.col("root")))


def brand_evidence(found: DataFrame, key: str = "url_id") -> DataFrame:
    """``key, brand, finding, expected`` for links that name or resemble a brand whose domain they are not.

    ``finding`` is ``named`` or ``lookalike``, ``expected`` the brand's own domains, sorted, comma-joined. ``found`` is ``url_indicators``' result.
    """
    expected = F.coalesce(*(F.when(F.col("brand") == t, F.lit(",".join(sorted(dom)))) for t, dom, _, _ in rules.BRANDS))
    plain = written(found.select(key, "brand", "typo"), "brands")  # the tests for brands are long expressions, used several times below
    hits = plain.select(key, F.coalesce("brand", "typo").alias("brand"), F.when(F.col("brand").isNotNull(), "named").otherwise("lookalike").alias("finding"))
    return hits.where("brand is not null").withColumn("expected", expected)


def combined_sql(d, message: str, url: str) -> str:
    """Message and best link together: the weaker takes up to seven tenths of what the stronger leaves."""
    high, low = f"greatest({message}, {url})", f"least({message}, {url})"
    return f"CASE WHEN {url} IS NULL THEN {message} ELSE CAST({d.even}({high} + (100 - {high}) * (CAST({low} AS DOUBLE) / 100) * CAST(0.7 AS DOUBLE), 0) AS INT) END"


def with_links(texts: DataFrame) -> DataFrame:
    """From ``msg_id, lang, text`` to ``msg_id, risk_score, category``, the best score ``url_score`` of a message's links (null: none) and their number ``n_urls``.

    A text is read once, for its own score and its links; each distinct link is scored once. What meets again holds no texts.
    """
    found = M.with_scores(M.indicators(texts.withColumn("urls", M.urls_in(F.col("text"))))).select("msg_id", "risk_score", "category", "urls")
    own = written(found, "message-scores")
    mentions = own.select("msg_id", F.explode("urls").alias("url"))
    links = written(distinct_urls(mentions).select("url", F.col("risk_score").alias("url_score")), "link-scores")
    best = mentions.join(links, "url").groupBy("msg_id").agg(F.max("url_score").alias("url_score"), F.count(F.lit(1)).alias("n_urls"))
    return own.drop("urls").join(best, "msg_id", "left").withColumn("n_urls", F.coalesce("n_urls", F.lit(0).cast("long")))


def nested_sql(source: str, steps) -> str:
    """The steps as nested selects of the checking engine."""
    sql = source
    for items in steps:
        sql = f"SELECT *, {', '.join(items)} FROM ({sql})"
    return sql


def oracle_parts(source: str) -> str:
    return nested_sql(source, part_steps(Duck))


def oracle_indicators(source: str) -> str:
    return nested_sql(source, part_steps(Duck) + indicator_steps(Duck))


def oracle_scores(source: str) -> str:
    return nested_sql(source, part_steps(Duck) + indicator_steps(Duck) + score_steps(Duck))
