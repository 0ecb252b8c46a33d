"""Personal data by weak supervision, with DataFrame and SQL functions only.

Four base kinds are found by their patterns. Looser patterns and gazetteers of names and streets propose further spans; six
labelers vote on each of these (a strict regex, a gazetteer of cue words, and four on context and content). How often each pattern of
votes occurs is counted over all texts; expectation-maximisation on these counts (at most ``2 ** 6`` for each
family) estimates the labelers' reliabilities, and the posteriors weigh the training of a naive Bayes
classifier over the spans' shape. Spans that it accepts are added to the base ones.

Only the table of counts, whose size the labelers and shape features bound, reaches the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BASE_KINDS = ("email", "ip", "card", "phone")
#: In the order that breaks ties between spans with one start.
KINDS = (*BASE_KINDS, "mail_variant", "number", "secret", "person", "address")
FAMILIES = KINDS[len(BASE_KINDS):]

# Base patterns. A run of characters is entered at its start or where the last match ended, and never given back: the
# same leftmost matches as without, in time linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Given names, titles and words of streets that names and addresses are known by.
GIVEN_NAMES = (
    "James", "Mary", "Robert", "Patricia", "John", "Jennifer", "Michael", "Linda", "David", "Elizabeth", "William", "Barbara", "Richard", "Susan", "Joseph", "Jessica",
    "Thomas", "Sarah", "Charles", "Karen", "Daniel", "Lisa", "Matthew", "Nancy", "Anthony", "Emily", "Steven", "Laura", "Paul", "Anna", "Andrew", "Rachel", "Kevin", "Maria",
    "Hans", "Peter", "Klaus", "Jürgen", "Stefan", "Ursula", "Monika", "Petra", "Sabine", "Renate", "Wolfgang", "Katharina", "Jean", "Pierre", "Michel", "Philippe", "Nicolas",
    "Marie", "Nathalie", "Isabelle", "Sylvie", "Catherine", "François", "Émilie", "José", "Antonio", "Manuel", "Francisco", "Juan", "Carmen", "Josefa", "Isabel", "Ana", "Pilar",
    "Rahul", "Amit", "Priya", "Anita", "Sunil", "Sanjay", "Rajesh", "Deepak", "Pooja", "Neha", "Wei", "Li", "Yuki", "Hiroshi", "Mohammed", "Ahmed", "Fatima", "Aisha", "Olga", "Ivan",
)
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra", "Shri", "Smt")
STREETS = ("Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Ln", "Drive", "Boulevard", "Blvd", "Court", "Place", "Square", "Terrace", "Way", "Close", "Crescent")

# Proposals: bracketed mail addresses, groups of digits, long keys, names after a title or with a known given name, streets with a number.
MAIL_VARIANT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT|@)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?:dot|DOT|\.)[\])])\x20?[A-Za-z0-9-]++)++"
NUMBER = r"(?<![0-9A-Za-z.+-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![0-9A-Za-z])"
SECRET = r"(?<![0-9A-Za-z_+/-])[0-9A-Za-z_+/-]{20,}+(?![0-9A-Za-z_+/-])"
_CAPITAL = r"[\x20]\p{Lu}[\p{Ll}\x27-]++"
PERSON = rf"(?<![\p{{L}}\p{{N}}])(?:(?:{'|'.join(TITLES)})\.?(?:{_CAPITAL}){{1,3}}|(?:{'|'.join(GIVEN_NAMES)})(?:\x20\p{{Lu}}\.)?(?:{_CAPITAL}){{1,2}})(?![\p{{L}}\p{{N}}])"
ADDRESS = rf"(?<![\p{{L}}\p{{N}}.,])(?:[0-9]{{1,5}}[A-Za-z]?(?:{_CAPITAL}){{1,3}}\x20(?:{'|'.join(STREETS)})(?![\p{{L}}\p{{N}}])|\p{{Lu}}\p{{Ll}}+(?:straße|strasse|weg|platz|gasse|allee)\x20[0-9]{{1,4}}[a-z]?(?![\p{{L}}\p{{N}}])|[0-9]{{1,4}},?\x20(?:rue|avenue|boulevard|place)(?:\x20(?:de|du|des|la|le|l\x27))*+{_CAPITAL}|(?:Calle|Avenida|Plaza)(?:\x20(?:de|del|la|los|las))*+{_CAPITAL},?\x20[0-9]{{1,4}}(?![\p{{L}}\p{{N}}]))"
PATTERNS = {"mail_variant": MAIL_VARIANT, "number": NUMBER, "secret": SECRET, "person": PERSON, "address": ADDRESS}
#: A cheap test that a text can have a proposal at all.
GATES = {
    "mail_variant": r"[\[(](?:at|AT|@)[\])]", "number": r"[0-9](?:[\x20().-]{0,2}[0-9]){6}", "secret": r"[0-9A-Za-z_+/-]{20}",
    "person": rf"(?<!\p{{L}})(?:{'|'.join((*TITLES, *GIVEN_NAMES))})[.\x20]", "address": rf"[0-9][A-Za-z]?,?\x20(?:\p{{Lu}}|rue|av|bo|pl)|(?:straße|strasse|weg|platz|gasse|allee)\x20[0-9]|Calle|Avenida|Plaza",
}

#: Cue words before a span, by family.
GAZETTEER = {
    "mail_variant": "mail|contact|write|reach|kontakt|correo|courriel",
    "number": "phone|tel|mobile|cell|call|fax|ssn|social security|passport|account|iban|konto|cuenta|compte|handy|patient|licen[cs]e no",
    "secret": "token|secret|passw|pwd|key|auth|bearer|credential",
    "person": "name|dear|contact|signed|regards|by|from|patient|customer|attn|nombre|nom|herr|frau|with|am|is",
    "address": "address|lives? (?:at|in)|resid|street|ship(?:ped)? to|deliver(?:ed)? to|home|office|adresse|dirección|wohn|located|at",
}
STRICT = {
    "mail_variant": r"[A-Za-z]{2,10}$",
    "number": r"^(?:\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$",
    "secret": r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|(?:sk|pk|gh[pousr])[_-][0-9A-Za-z_-]{16,})$",
    "person": rf"^(?:{'|'.join(TITLES)})\.?\x20|^(?:{'|'.join(GIVEN_NAMES)})\x20",
    "address": r"^[0-9].*\p{L}{2,}$|[0-9][a-z]?$",
}
LABELERS = ("strict", "gazetteer", "assignment", "enclosed", "size", "variety")
_CONTEXT = 40
_BLOCK = 256


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


_CANDIDATE = "array<struct<start:int,end:int,family:string,votes:int,size:string,mix:string,before:string,after:string>>"
_SPAN = "array<struct<start:int,end:int,m:string>>"


def matches(text: Column, pattern: str) -> Column:
    """All leftmost matches as ``start, end`` (code points, end exclusive) and their text ``m``.

    The pieces between matches and the matches alternate; places are running sums of their lengths, summed by
    blocks, so that texts with very many matches stay cheap.
    """
    def placed(between: Column, found: Column) -> Column:
        lengths = F.transform(found, lambda m, i: F.length(F.get(between, i)) + F.length(m))

        def with_blocks(n: Column) -> Column:
            blocks = F.transform(
                F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _BLOCK).cast("int")),
                lambda b: F.aggregate(F.slice(n, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda acc, x: acc + x),
            )

            def with_starts(sums: Column) -> Column:
                total = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + x)

                def span(m: Column, i: Column) -> Column:
                    b = F.floor(i / _BLOCK).cast("int")
                    before = total(F.slice(sums, F.lit(1), b)) + total(F.slice(n, b * _BLOCK + 1, i - b * _BLOCK))
                    return _let(before + F.length(F.get(between, i)), lambda s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("m")))

                return F.transform(found, span)

            return _let(blocks, with_starts)

        return _let(lengths, with_blocks)

    both = _let(F.split(text, pattern, -1), lambda between: _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(between, found)).otherwise(_none(_SPAN))))
    return both


def _luhn(digits: Column) -> Column:
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    ordered = F.split(F.reverse(digits), "")
    values = F.transform(F.filter(ordered, lambda c: c != ""), lambda c, i: _let(c.cast("int"), lambda d: F.when(i % 2 == 1, doubled(d)).otherwise(d)))
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets_fit(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
        F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("double") <= 255, F.lit(False)))


def base_spans(text: Column) -> Column:
    """``array<struct<start, kind_no, end>>`` of the four base kinds, by start, then kind."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n_digits = lambda m: F.length(_digits(m))
    rules = [
        (EMAIL, F.contains(t, F.lit("@")), lambda m: F.lit(True)),
        (IP, t.rlike(r"[0-9]\.[0-9]"), _octets_fit),
        (CARD, t.rlike("[0-9]"), lambda m: F.when(n_digits(m).between(14, 19), _luhn(_digits(m))).otherwise(F.lit(False))),
        (PHONE, F.contains(t, F.lit("+")), lambda m: n_digits(m).between(10, 15)),
    ]
    def of_kind(k: int, pattern: str, gate: Column, ok) -> Column:
        kept = F.filter(matches(t, pattern), lambda s: ok(s["m"]))
        spans = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind_no"), s["end"].alias("end")))
        return F.when(gate, spans).otherwise(_none("array<struct<start:int,kind_no:int,end:int>>"))

    found = [of_kind(k, *rule) for k, rule in enumerate(rules)]
    return F.sort_array(F.concat(*found))


def candidates(text: Column) -> Column:
    """Proposed spans with their votes and shape: ``array<struct<start, end, family, votes, size, mix, before, after>>``."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    def judged(family: str):
        def one(s: Column) -> Column:
            m = s["m"]
            before = F.when(s["start"] > 0, F.substring(t, F.greatest(s["start"] - _CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(_CONTEXT)))).otherwise("")
            after = F.substring(t, s["end"] + 1, F.lit(1))

            def with_context(b: Column, a: Column) -> Column:
                n, n_digits = F.length(m), F.length(_digits(m))
                kinds = F.size(F.array_distinct(F.split(F.lower(m), "")))
                size = {"number": n_digits.between(9, 15), "secret": n.isin(32, 40, 64) | (n >= 48), "mail_variant": n.between(10, 80), "person": n.between(7, 40), "address": n.between(8, 50)}[family]
                variety = {"number": F.size(F.array_distinct(F.split(_digits(m), ""))) >= 5, "secret": kinds >= 12, "mail_variant": kinds >= 8, "person": kinds >= 6, "address": kinds >= 7}[family]
                votes = [
                    m.rlike(STRICT[family]), F.lower(b).rlike(rf"(?:{GAZETTEER[family]})[^.\n]{{0,24}}$"), b.rlike(r"[:=][\x20\"']*$"),
                    b.rlike("[\"'(<\\[]$") & a.rlike("^[\"')>\\]]"), size, variety,
                ]
                number = votes[0].cast("int")
                for k, v in enumerate(votes[1:], 1):
                    number = number + v.cast("int") * F.lit(1 << k)
                char = lambda c: F.when(c == "", "edge").when(c.rlike("[\"'(<\\[)>\\]]"), "quote").when(c.rlike(r"\s"), "blank").when(c.rlike("[.,;:!?]"), "mark").otherwise("other")
                return F.struct(
                    s["start"].alias("start"), s["end"].alias("end"), F.lit(family).alias("family"), number.alias("votes"),
                    F.concat(F.lit("size="), F.least(F.floor(n / 4), F.lit(20)).cast("string")).alias("size"),
                    F.concat(F.lit("mix="), F.floor(4 * n_digits / n).cast("string"), F.when(m.rlike(r"[\x20().-]"), "s").otherwise("")).alias("mix"),
                    F.concat(F.lit("before="), char(F.substring(b, -1, 1))).alias("before"), F.concat(F.lit("after="), char(a)).alias("after"),
                )

            return _let(before, lambda b: _let(after, lambda a: with_context(b, a)))

        return one

    found = []
    for family in FAMILIES:
        spans = matches(t, PATTERNS[family])
        if family == "secret":
            spans = F.filter(spans, lambda s: s["m"].rlike("[0-9]") & s["m"].rlike("[A-Za-z]"))
        found.append(F.when(t.rlike(GATES[family]), F.transform(spans, judged(family)).cast(_CANDIDATE)).otherwise(_none(_CANDIDATE)))
    return F.concat(*found)


# ---- what is learned ----------------------------------------------------------------------------

def reliabilities(counts: dict[int, int], rounds: int = 60) -> tuple[float, list[float], list[float]]:
    """EM over counted vote patterns of one family: prior, and each labeler's rate of votes on true and on false spans."""
    n = sum(counts.values())
    prior, yes, no = 0.5, [0.7] * len(LABELERS), [0.3] * len(LABELERS)
    for _ in range(rounds):
        post = {v: posterior(v, prior, yes, no) for v in counts}
        true = sum(c * post[v] for v, c in counts.items())
        hit = [sum(c * post[v] for v, c in counts.items() if v >> k & 1) for k in range(len(LABELERS))]
        all_hit = [sum(c for v, c in counts.items() if v >> k & 1) for k in range(len(LABELERS))]
        prior = (true + 1) / (n + 2)
        yes = [(h + 1.4) / (true + 2) for h in hit]
        no = [(a - h + 0.6) / (n - true + 2) for a, h in zip(all_hit, hit)]
    return prior, yes, no


def posterior(votes: int, prior: float, yes: list[float], no: list[float]) -> float:
    odds = math.log(prior) - math.log(1 - prior)
    for k in range(len(LABELERS)):
        odds += math.log(yes[k] / no[k]) if votes >> k & 1 else math.log((1 - yes[k]) / (1 - no[k]))
    return 1 / (1 + math.exp(-max(-500, min(500, odds))))


def train(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Log-odds weights of the span classifier, by ``family`` and ``family|feature``, from all texts of ``docs``."""
    return learn(docs.select(candidates(F.col(text_col)).alias("candidates")))


def learn(proposed: DataFrame) -> dict[str, float]:
    """The weights from ``candidates``, the proposals of all texts."""
    shape = ["size", "mix", "before", "after"]
    rows = (
        proposed.select(F.explode("candidates").alias("c")).select("c.family", "c.votes", *(f"c.{x}" for x in shape))
        .groupBy("family", "votes", *shape).count().collect()
    )
    patterns: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for r in rows:
        patterns[r["family"]][r["votes"]] += r["count"]
    learned = {family: reliabilities(counts) for family, counts in patterns.items()}
    true: dict[str, float] = defaultdict(float)
    false: dict[str, float] = defaultdict(float)
    for r in rows:
        p = posterior(r["votes"], *learned[r["family"]])
        for key in (r["family"], *(f"{r['family']}|{r[x]}" for x in shape)):
            true[key] += p * r["count"]
            false[key] += (1 - p) * r["count"]
    weights = {}
    for key in true:
        family = key.split("|")[0]
        if key == family:
            weights[key] = math.log((true[key] + 0.5) / (false[key] + 0.5))
        else:
            weights[key] = math.log((true[key] + 0.5) / (true[family] + 1)) - math.log((false[key] + 0.5) / (false[family] + 1))
    return weights


def _accepted(base: Column, proposed: Column, weights: dict[str, float]) -> Column:
    """The base spans and those proposals that the classifier accepts and that no base span overlaps."""
    if not weights:
        return base
    table = F.create_map(*(x for key, w in sorted(weights.items()) for x in (F.lit(key), F.lit(float(w)))))
    weight = lambda key: F.coalesce(F.get(F.map_values(F.map_filter(table, lambda k, v: k == key)), F.lit(0)), F.lit(0.0))

    def kind_no(c: Column) -> Column:
        no = F.lit(KINDS.index(FAMILIES[-1]))
        for f in FAMILIES[:-1]:
            no = F.when(c["family"] == f, F.lit(KINDS.index(f))).otherwise(no)
        return no

    def odds(c: Column) -> Column:
        total = weight(c["family"])
        for x in ("size", "mix", "before", "after"):
            total = total + weight(F.concat(c["family"], F.lit("|"), c[x]))
        return total

    more = F.filter(proposed, lambda c: ~F.exists(base, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])) & (odds(c) > 0))
    added = F.transform(more, lambda c: F.struct(c["start"].alias("start"), kind_no(c).alias("kind_no"), c["end"].alias("end")))
    return F.sort_array(F.concat(base, added))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``id, base, spans`` for each row (arrays of ``start, kind_no, end`` in code points, by start, then kind); ``keep``
    names further columns to pass on. Without ``weights`` they are learnt from the proposals of all rows, which are written once
    beside the columns that are passed on.

    Null texts count as empty and have no spans. Null ids and repeated rows stay as they are; clashing names of other
    columns do not matter, as only the named ones are read. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    proposals = candidates(text) if weights is None or weights else _none(_CANDIDATE)
    found = docs.select(F.col(id_col).alias("id"), *(keep or []), F.struct(base_spans(text).alias("base"), proposals.alias("candidates")).alias("_found"))
    if weights is None:
        found = stored(found, "pii-candidates")
        weights = learn(found.select("_found.candidates"))
    return found.select("id", *(keep or []), F.col("_found.base"), _accepted(F.col("_found.base"), F.col("_found.candidates"), weights).alias("spans"))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every stretch that spans cover replaced by the kind, in angle brackets, of the first of them."""
    names = F.array(*(F.lit(k) for k in KINDS))

    def cut(t: Column) -> Column:
        built = F.aggregate(
            spans, F.struct(F.lit(0).alias("end"), F.lit("").alias("out")),
            lambda acc, s: F.when(
                s["start"] >= acc["end"],
                F.struct(s["end"].alias("end"), F.concat(acc["out"], F.substring(t, acc["end"] + 1, s["start"] - acc["end"]), F.lit("<"), F.get(names, s["kind_no"]), F.lit(">")).alias("out")),
            ).otherwise(F.struct(F.greatest(acc["end"], s["end"]).alias("end"), acc["out"].alias("out"))),
        )
        return _let(built, lambda b: F.concat(b["out"], F.substring(t, b["end"] + 1, F.length(t))))

    return F.when(F.size(spans) > 0, _let(text, cut)).otherwise(text)


def op10(docs: DataFrame) -> DataFrame:
    """Contract digest of ``find``; the counts and ``base_sha256`` are of the base spans."""
    got = find(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind_no"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return got.select(
        F.col("id").alias("doc_id"), *(count(k) for k in BASE_KINDS),
        F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"),
    )
