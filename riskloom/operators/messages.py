"""Message risk: lexicon hits, indicators with severities, scores and categories.

The terms of a lexicon of moderate size are one expression, a tree of their characters, that finds the longest term at each word within the
row; so nothing is exploded or shuffled. A larger lexicon meets runs of a text's words in an equi-join; terms in Devanagari, which may stand
anywhere, are looked for in texts of that script. The work follows a text's length. Scores are kept in tenths, so sums are exact in any order.
"""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dialect import Duck, Spark

LISTS = [x for x in rules.TERMS if x not in rules.PARTS]
_BROADCAST_TERMS = 100_000  # rows of a lexicon that is sent to every task; a larger one is joined by shuffle
_TREE_TERMS = 10_000  # terms, and
_TREE_CHARS = 200_000  # their characters, that become one expression; more terms are joined
INDICATORS = list(rules.MESSAGE_WEIGHTS)

URL_PATTERN = r"(?i)(?:https?://|www[.])[^ \t\n\r<>()\[\]{}\x27\x22]+|(?:(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?[.])+[a-z]{2,}(?:/[^ \t\n\r]*)?)"
URL_TRAILER = r"[.,;:!?)\]}>\x27\x22]+$"
# The same matches as URL_PATTERN finds, in group 1: words that no full stop or scheme follows, so that no link begins in them, are passed over whole.
_URL_SKIPPING = rf"(?is)(?:[a-z0-9-]++(?![.]|://)|[^a-z0-9-]|(?!{URL_PATTERN[4:]}).)*+({URL_PATTERN[4:]})?"
BAD_URL = r"(?i)(?:bit[.]ly|tinyurl|goo[.]gl|t[.]co|rb[.]gy|cutt[.]ly|is[.]gd|shorturl|ow[.]ly|tiny[.]cc|lnkd[.]in|rebrandly)|^(?:[a-z]+://)?(?:[0-9]{1,3}[.]){3}[0-9]{1,3}(?:$|/)"


def normalized(text: Column) -> Column:
    """Trimmed, lower-cased, blanks collapsed; null reads as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\s&&[^ ]]\s*| \s+", " "))  # a single blank stays as it is


def urls_in(text: Column) -> Column:
    """Distinct links of a text in order, closing punctuation cut off."""
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_URL_SKIPPING), F.lit(1)), lambda u: u != "")
    return F.array_distinct(F.filter(F.transform(found, lambda u: F.regexp_replace(u, URL_TRAILER, "")), lambda u: u != ""))


def _pieces(text: Column) -> Column:
    """A text cut into its words and what stands between them."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))


def _once(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(pieces: Column, widths, begins=None) -> Column:
    """Distinct runs of pieces, so many pieces long, from every piece that ``begins`` allows."""
    def runs(p):
        places = F.sequence(F.lit(1), F.size(p))
        if begins is not None:
            places = F.filter(places, lambda i: begins(F.element_at(p, i)))
        found = F.flatten(F.transform(places, lambda i: F.array(*(F.array_join(F.slice(p, i, n), "") for n in widths))))
        return F.when(F.size(p) > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))

    return _once(pieces, runs)


_WORD, _BREAK = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
_AT_WORD = "(?<![\\p{L}\\p{N}_\U00010400])"  # the letter past the first 65,536 has Java look back by whole characters


def _is_word(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


def _tree(terms, end: str = "") -> str:
    """A pattern of the longest of ``terms`` at a place, each followed by ``end``: a tree of their characters."""
    root: dict = {}
    for term in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[None] = {}

    def plain(c: str) -> str:
        return "\\" + c if c.isascii() and not c.isalnum() and c != " " else c

    def pattern(node: dict) -> str:
        run = ""
        while len(node) == 1 and None not in node:
            ((c, node),) = node.items()
            run += plain(c)
        ways = [plain(c) + pattern(n) for c, n in node.items() if c is not None] + ([end] if None in node else [])
        return run + (ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})")

    return pattern(root)


def _longest(text: Column, terms, end: str = "", anywhere: bool = False) -> Column:
    """The distinct longest terms at the words of a text, or anywhere in it."""
    tree = _tree(terms, end)
    if anywhere:
        pattern = f"(?=({tree}))"
    elif all(_is_word(t[0]) for t in terms):
        pattern = f"(?:{_BREAK}|(?!{tree}){_WORD}++)*+(?:(?=({tree})){_WORD}++)?"  # words where no term begins are passed over whole
    else:
        pattern = f"{_AT_WORD}(?=({tree}))"
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda t: t != ""))


def _places(terms: list[str], edged: bool) -> dict[str, list[int]]:
    """By term, the places in ``terms`` of all that stand where it does: itself and what it begins with (``edged``: up to the end of a word)."""
    own: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        own.setdefault(t, []).append(i)
    begins = lambda t: (t[:n] for n in range(1, len(t) + 1) if not edged or n == len(t) or not _is_word(t[n]))
    return {t: [i for b in begins(t) for i in own.get(b, ())] for t in own}


def _met(found: Column, places: dict[str, list[int]], shift: list[int] | None = None) -> Column:
    """The places of all terms that stand where the longest ones were found."""
    at = {t: [shift[i] for i in own] if shift else own for t, own in places.items()}
    table = F.from_json(F.lit(json.dumps(at)), "map<string,array<int>>")
    return F.flatten(F.transform(found, lambda t: table[t]))


def _known_terms(lexicon: DataFrame) -> list | None:
    """The terms by list, or nothing if they are too many for one expression."""
    known = lexicon.select("list", "ord", "term", "deva").where("term <> ''").limit(_TREE_TERMS + 1).collect()
    if len(known) > _TREE_TERMS or sum(len(r["term"]) for r in known) > _TREE_CHARS or max((len(r["term"]) for r in known), default=0) > 200:
        return None
    return sorted(known, key=lambda r: (r["list"], r["ord"]))


def _terms_met(norm: Column, known: list) -> Column:
    """The places in ``known`` of the terms that a text has."""
    none, parts = F.array().cast("array<int>"), []
    for deva in (False, True):
        at = [i for i, r in enumerate(known) if r["deva"] == deva]
        if at:
            terms = [known[i]["term"] for i in at]
            met = _met(_longest(norm, list(dict.fromkeys(terms)), "" if deva else f"(?!{_WORD})", deva), _places(terms, not deva), at)
            parts.append(F.when(norm.rlike("[ऀ-ॿ]"), met).otherwise(none) if deva else met)
    return F.array_distinct(F.concat(*parts)) if parts else none


def lexicon_hits(messages: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """``msg_id, list, ord`` for each term of the lexicon that a message has.

    A lexicon that fits one expression is looked for within the row. Of a larger one, a term that begins and ends with a word character meets runs of a text's words, exactly as many as it has itself, by an equi-join;
    any other, and any in Devanagari, meets pieces of its greatest length at the places where its first two characters stand. A text is cut up once, in
    one pass, and never travels beside its pieces. What a lexicon of moderate size begins with is known in every task, so that only
    such places are joined; with a larger one all are.
    """
    lexicon = rules.lexicon(messages.sparkSession) if lexicon is None else lexicon
    listed = _known_terms(lexicon)
    if listed is not None:
        table = F.from_json(F.lit(json.dumps([{"list": r["list"], "ord": r["ord"]} for r in listed])), "array<struct<list:string,ord:bigint>>")
        met = messages.select("msg_id", normalized(F.col("text")).alias("norm")).select("msg_id", F.explode(_terms_met(F.col("norm"), listed)).alias("at"))
        return met.select("msg_id", F.get(table, F.col("at")).alias("t")).select("msg_id", "t.list", "t.ord")
    terms = lexicon.select("list", "ord", "term", "anchor", (F.col("deva") | ~F.col("term").rlike(r"^[\p{L}\p{N}_](?s:.*[\p{L}\p{N}_])?$")).alias("inside"), F.col("deva")).where("term <> ''")
    known = terms.limit(_BROADCAST_TERMS + 1).collect()
    small = len(known) <= _BROADCAST_TERMS
    sized = F.broadcast if small else (lambda table: table)
    longest = terms.agg(F.max(F.when(~F.col("inside"), F.size(_pieces(F.col("term"))))).alias("pieces"), F.max(F.when(F.col("inside"), F.length("term"))).alias("chars")).first()
    texts = messages.select("msg_id", normalized(F.col("text")).alias("norm"))
    hits = []
    if longest["pieces"]:
        anchors = sorted({r["anchor"] for r in known if not r["inside"]})
        widths = range(1, longest["pieces"] + 1, 2)
        begins = (lambda piece: piece.isin(anchors)) if small else None
        runs = texts.select("msg_id", F.explode(_windows(_pieces(F.col("norm")), widths, begins)).alias("term"))
        hits.append(runs.join(sized(terms.where("not inside").select("list", "ord", "term")), "term").select("msg_id", "list", "ord"))
    if longest["chars"]:
        inside = [r for r in known if r["inside"]]
        starts = sorted({r["term"][:2] for r in inside})
        rows = texts.where(F.col("norm").rlike(r"[ऀ-ॿ]")) if small and all(r["deva"] for r in inside) else texts
        most = longest["chars"]

        def cut(c):
            places = F.sequence(F.lit(1), F.size(c))
            if small:
                places = F.filter(places, lambda i: F.array_join(F.slice(c, i, 2), "").isin(starts) | F.element_at(c, i).isin(starts))
            before = lambda i: F.when(i > 1, F.element_at(c, F.greatest(i - 1, F.lit(1)))).otherwise("")
            return F.array_distinct(F.transform(places, lambda i: F.struct(before(i).alias("before"), F.array_join(F.slice(c, i, most + 1), "").alias("window"))))

        rows = rows.where("norm <> ''").select("msg_id", F.explode(_once(F.split("norm", ""), cut)).alias("p"))
        starting = terms.where("inside").select("list", "ord", "term", "deva", F.substring("term", 1, 2).alias("_start"))
        own = rows.select("msg_id", "p.*", F.explode(F.array_distinct(F.array(F.substring("p.window", 1, 2), F.substring("p.window", 1, 1)))).alias("_start"))
        word = r"^[\p{L}\p{N}_]$"
        after = F.substring(F.col("window"), F.length("term") + 1, F.lit(1))
        free = F.col("deva") | (~F.col("before").rlike(word) & ~after.rlike(word))
        hits.append(own.join(sized(starting), "_start").where(F.startswith("window", F.col("term")) & free).select("msg_id", "list", "ord").distinct())
    if not hits:
        return messages.select("msg_id", F.lit("").alias("list"), F.lit(0).cast("long").alias("ord")).limit(0)
    return hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])


def _any_part(d, text: str, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, '" + p.replace("'", "''") + "')" for p in parts) + ")"


def _verbs(d, verbs) -> str:
    before = r"(^|[^\p{L}\p{N}_])"
    return " + ".join(f"CAST({d.match('norm', before + v)} AS INT)" for v in verbs)


def _flags_sql(d, terms: dict) -> list[str]:
    return [
        f"{_verbs(d, terms['otp_verb'])} AS verbs", f"{_any_part(d, 'norm', terms['otp_phrase'])} AS otp_phrase",
        f"{_any_part(d, 'norm', terms['safe_marker'])} AS safe_part", f"{_any_part(d, 'norm', terms['transactional'])} AS transactional",
    ]


def _verbs_met(verbs) -> Column:
    """How many verbs begin at a word of ``norm``."""
    heard = [v for v in verbs if v]
    if not heard:
        return F.lit(len(verbs))
    return F.size(F.array_distinct(_met(_longest(F.col("norm"), list(dict.fromkeys(heard))), _places(heard, False)))) + (len(verbs) - len(heard))


def _parts_met(text: str, parts) -> Column:
    """Whether a text has one of the parts: those that have another in them are left out, and those that share a word are looked for where it occurs."""
    left = [p for p in dict.fromkeys(parts) if not any(q != p and q in p for q in parts)]
    has, tests = (lambda p: F.contains(F.col(text), F.lit(p))), [F.lit(False)]
    while left:
        words = sorted({w for p in left for w in p.split(" ") if len(w) > 2} | set(left))
        word = max(words, key=lambda w: (sum(w in p for p in left), len(w)))
        own = [p for p in left if word in p]
        anyone = F.lit(False)
        for p in own:
            anyone = anyone | has(p)
        tests.append(has(word) & anyone if len(own) > 1 else has(own[0]))
        left = [p for p in left if word not in p]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def _part_terms(lexicon: DataFrame | None) -> dict:
    """The lists that are looked for as parts: the lexicon's own, or the fixed ones where it has none of a list."""
    names, out = (*rules.PARTS, "safe_marker"), dict(rules.TERMS)
    if lexicon is not None:
        given: dict[str, list[str]] = {}
        for r in lexicon.where(F.col("list").isin(*names)).orderBy("ord").select("list", "term").collect():  # phrase lists that become one expression
            given.setdefault(r["list"], []).append(r["term"])
        out |= given
    return out


def severities() -> dict[str, str]:
    """Indicators and how their severity follows from counts and flags."""
    return {x.rsplit(" AS s_", 1)[1]: x.rsplit(" AS s_", 1)[0] for x in _severity_sql()}


def _severity_sql() -> list[str]:
    out = []
    for name, (high, medium, low) in rules.SEVERITIES.items():
        whens = [f"WHEN n_{name} >= {n} THEN '{s}'" for n, s in ((high, "high"), (medium, "medium")) if n] + [f"WHEN n_{name} >= 1 THEN '{low}'"]
        out.append(f"CASE {' '.join(whens)} END AS s_{name}")
    otp = "verbs + CASE WHEN otp_phrase THEN 2 ELSE 0 END"
    out.append(f"CASE WHEN n_safe_marker > 0 OR n_otp_word = 0 THEN NULL WHEN {otp} >= 2 THEN 'high' WHEN {otp} = 1 THEN 'medium' END AS s_otp_request")
    out.append("CASE WHEN bad_url OR n_link_hint > 0 THEN 'high' END AS s_suspicious_link")
    return out


def _tenths(name: str) -> str:
    cases = " ".join(f"WHEN '{s}' THEN {t * rules.MESSAGE_WEIGHTS[name]}" for s, t in rules.SEVERITY_TENTHS.items())
    return f"CASE s_{name} {cases} ELSE 0 END"


def _fires(name: str) -> str:
    return f"CAST(s_{name} IS NOT NULL AS INT)"


def bonus_sql() -> str:
    """Tenths added where an offer or a claimed identity comes with demands for money."""
    money, family = (" + ".join(_fires(x) for x in xs) for xs in (rules.MONEY, rules.FAMILY))
    return f"CASE WHEN ({family}) = 0 OR ({money}) = 0 THEN 0 WHEN ({money}) = 1 THEN 180 WHEN ({money}) = 2 THEN 260 ELSE 320 END"


def guard_sql() -> str:
    """Whether a text is an ordinary confirmation without pressure."""
    return "(transactional AND NOT (" + " OR ".join(f"s_{x} IS NOT NULL" for x in rules.PRESSURE) + "))"


def guarded_sql() -> str:
    """Tenths that such a text loses: its weak signs and some more."""
    return "400 + " + " + ".join(_tenths(x) for x in rules.WEAK)


def _score_sql(d, extra: dict[str, int] | None = None) -> list[str]:
    """``extra``: further indicators and their weights."""
    more = [f"CASE s_{n} " + " ".join(f"WHEN '{s}' THEN {t * w}" for s, t in rules.SEVERITY_TENTHS.items()) + " ELSE 0 END" for n, w in (extra or {}).items()]
    total = " + ".join([*(_tenths(x) for x in INDICATORS), *more])
    pairs = " + ".join(f"CASE WHEN s_{a} IS NOT NULL AND s_{b} IS NOT NULL THEN {10 * p} ELSE 0 END" for a, b, p in rules.MESSAGE_PAIRS)
    raw = f"{total} + {pairs} + {bonus_sql()} - CASE WHEN safe_part THEN 180 ELSE 0 END - CASE WHEN {guard_sql()} THEN {guarded_sql()} ELSE 0 END"
    fired = " + ".join(_fires(x) for x in (*INDICATORS, *(extra or {})))
    left = f"({fired}) - CASE WHEN {guard_sql()} THEN {' + '.join(_fires(x) for x in rules.WEAK)} ELSE 0 END"
    return [f"greatest(0, least(1000, {raw})) AS raw10", f"{left} AS n_fired", f"{guard_sql()} AS guarded"]


def level_sql(score: str) -> str:
    return f"CASE WHEN {score} < 25 THEN 'LOW' WHEN {score} < 50 THEN 'MEDIUM' WHEN {score} < 75 THEN 'HIGH' ELSE 'CRITICAL' END"


def _verdict_sql(d) -> list[str]:
    score = f"CAST({d.even}(CAST(raw10 AS DOUBLE) / 10, 0) AS INT)"
    category = " ".join(f"WHEN s_{i} IS NOT NULL THEN '{c}'" for c, i in rules.CATEGORIES)
    return [
        f"{score} AS risk_score", f"{level_sql(score)} AS risk_level", f"{score} >= 50 AS is_scam",
        "CASE WHEN n_fired = 0 THEN CAST(0 AS DOUBLE) ELSE round(least(CAST(100 AS DOUBLE), CAST(raw10 AS DOUBLE) * 60 / 1000 + least(CAST(n_fired AS DOUBLE), CAST(6 AS DOUBLE)) * 15 / 6 + 25), 1) END AS confidence",
        f"CASE WHEN {score} < 50 THEN 'safe' {category} ELSE 'other' END AS category",
    ]


def with_counts(rows: DataFrame, messages: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Adds to ``rows`` (one a message) the count ``n_<list>`` of each list's terms in ``messages`` (``msg_id, text``).

    Rows that have their ``text`` (or it as ``norm``) are counted by themselves and lose it, if the lexicon fits one expression. Others meet the hits once,
    in one shuffle, without texts; messages without hits stay.
    """
    kept = [c for c in rows.columns if c not in ("text", "norm")]
    listed = _known_terms(rules.lexicon(rows.sparkSession) if lexicon is None else lexicon) if len(kept) < len(rows.columns) else None
    if listed is not None:
        rows = rows if "norm" in rows.columns else rows.withColumn("norm", normalized(F.col("text")))
        names = [r["list"] for r in listed]

        def count(name):
            if name not in names:
                return F.lit(0).cast("long")
            first = names.index(name)
            return F.size(F.filter("_met", lambda i: (i >= first) & (i < first + names.count(name)))).cast("long")

        return rows.select(*kept, _terms_met(F.col("norm"), listed).alias("_met")).select(*kept, *(count(x).alias(f"n_{x}") for x in LISTS))
    hits = lexicon_hits(messages, lexicon)
    counts = hits.groupBy("msg_id").agg(*(F.count(F.when(F.col("list") == x, 1)).alias(f"n_{x}") for x in LISTS))
    return rows.drop("text", "norm").join(counts, "msg_id", "left").fillna(0, [f"n_{x}" for x in LISTS])


def _flagged(messages: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """``with_flags``, with the text as ``norm`` besides."""
    kept = [c for c in messages.columns if c != "norm"]
    links = F.col("urls") if "urls" in kept else urls_in(F.col("text"))
    own = messages.select(*kept, F.exists(links, lambda u: u.rlike(BAD_URL)).alias("bad_url"), normalized(F.col("text")).alias("norm"))
    parts = _part_terms(lexicon)
    flags = {"otp_phrase": "otp_phrase", "safe_part": "safe_marker", "transactional": "transactional"}
    return own.select(*kept, "norm", "bad_url", _verbs_met(parts["otp_verb"]).alias("verbs"), *(_parts_met("norm", parts[x]).alias(c) for c, x in flags.items()))


def with_flags(messages: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Adds what is seen of a text beside its terms: a link of a bad kind, verbs and phrases of a request, safe and ordinary phrases.

    Messages may have the links of their texts as ``urls``.
    """
    return _flagged(messages, lexicon).drop("norm")


def indicators(messages: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """One row for each message: counts by list, flags, and the severity ``s_<indicator>`` of each indicator (null: absent). ``urls``, if messages have it, stays."""
    own = messages.select("msg_id", "lang", "text", *(c for c in messages.columns if c == "urls"))
    return with_counts(_flagged(own, lexicon), own, lexicon).selectExpr("*", *_severity_sql())


def message_facts(found: DataFrame) -> DataFrame:
    """Long form: ``msg_id, indicator, severity, points`` of each indicator that fires."""
    facts = F.array(*(F.struct(F.lit(x).alias("indicator"), F.col(f"s_{x}").alias("severity"), F.expr(f"CAST({_tenths(x)} AS DOUBLE) / 10").alias("points")) for x in INDICATORS))
    return found.select("msg_id", F.explode(facts).alias("f")).select("msg_id", "f.*").where("severity is not null")


def message_scores(found: DataFrame, extra: dict[str, int] | None = None) -> DataFrame:
    """``msg_id, lang, raw_score, risk_score, risk_level, is_scam, confidence, category, guarded``."""
    scored = found.selectExpr("*", *_score_sql(Spark, extra))
    return scored.selectExpr("msg_id", "lang", "CAST(raw10 AS DOUBLE) / 10 AS raw_score", *_verdict_sql(Spark), "guarded", "n_fired")


def with_scores(found: DataFrame) -> DataFrame:
    """All columns of ``indicators`` beside the score and its verdict."""
    return found.selectExpr("*", *_score_sql(Spark)).selectExpr("*", *_verdict_sql(Spark))


# ---- the same in the checking engine, with a plain nested loop over the terms ----------------------

def oracle_ctes(messages: str) -> str:
    d = Duck
    terms = rules.values([(n, i, t, any("ऀ" <= c <= "ॿ" for c in t)) for n, ts in rules.TERMS.items() if n in LISTS for i, t in enumerate(ts)], "x(list, ord, term, deva)")
    urls = rf"len(list_filter(list_transform(regexp_extract_all(text, '{URL_PATTERN}'), lambda u: regexp_replace(u, '{URL_TRAILER}', '')), lambda u: regexp_matches(u, '{BAD_URL}'))) > 0"
    counts = ", ".join(f"count(CASE WHEN list = '{x}' THEN 1 END) AS n_{x}" for x in LISTS)
    return rf"""
messages AS ({messages}),
own AS (SELECT msg_id, lang, text, trim({d.swap('lower(text)', '[ \t\n\r]+', ' ')}) AS norm, {urls} AS bad_url FROM messages),
lexicon AS (SELECT * FROM {terms}),
marked AS (SELECT *, '|' || {d.swap('term', r'([^\p{L}\p{N}_])', r'|\1|')} || '|' AS edged FROM lexicon),
hits AS (SELECT msg_id, list, ord FROM (SELECT msg_id, norm, '|' || {d.swap('norm', r'([^\p{L}\p{N}_])', r'|\1|')} || '|' AS edges FROM own) m, marked
  WHERE CASE WHEN deva THEN contains(norm, term) ELSE contains(edges, edged) END),
counts AS (SELECT o.msg_id, {counts} FROM own o LEFT JOIN hits h ON o.msg_id = h.msg_id GROUP BY o.msg_id),
wide AS (SELECT o.msg_id, lang, bad_url, {', '.join(_flags_sql(d, rules.TERMS))}, c.* EXCLUDE (msg_id) FROM own o JOIN counts c ON o.msg_id = c.msg_id),
found AS (SELECT *, {', '.join(_severity_sql())} FROM wide),
scored AS (SELECT *, {', '.join(_score_sql(d))} FROM found),
message_scores AS (SELECT msg_id, lang, CAST(raw10 AS DOUBLE) / 10 AS raw_score, {', '.join(_verdict_sql(d))}, guarded, n_fired FROM scored)"""
