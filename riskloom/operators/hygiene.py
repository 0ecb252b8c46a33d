"""Data-set work: dedupe, splits, leakage, profiles, redaction."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

LABELS = ("scam", "safe")


def _latin_folds() -> tuple[str, str, list[tuple[str, str]]]:
    """Accented Latin letters and the plain ones they fold to, and by combining mark the letters that it accents: by rule."""
    ranges = (range(0xAA, 0x250), range(0x1E00, 0x1F00))
    folds = {}
    for c in (chr(k) for r in ranges for k in r):
        plain = unicodedata.normalize("NFKD", c.lower()).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            folds[c] = plain
    marks = []
    for mark in (chr(k) for k in range(0x300, 0x370)):
        letters = "".join(x for x in map(chr, range(97, 123)) if len(unicodedata.normalize("NFC", x + mark)) == 1)
        if letters:
            marks.append((mark, letters))
    return "".join(folds), "".join(folds.values()), marks


_ACCENTED, _PLAIN, _MARKS = _latin_folds()


def folded(text: Column) -> Column:
    """Lower case, Latin letters without their accents (composed or not), other scripts as they are."""
    low = F.lower(F.coalesce(text, F.lit("")))
    bare = low
    for mark, letters in _MARKS:
        bare = F.regexp_replace(bare, f"([{letters}]){mark}", "$1")
    return F.translate(F.when(low.rlike("[\u0300-\u036F]"), bare).otherwise(low), _ACCENTED, _PLAIN)


def text_key(text: Column) -> Column:
    """What dedupe and leakage compare: folded text, links as one mark, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(text), r"https?://[^ \t\n\r]+", "<URL>"), r"[ \t\n\r]+", " "))


TEXT_KEY_SQL = r"trim(regexp_replace(regexp_replace(strip_accents(lower(nfc_normalize(coalesce(text, '')))), 'https?://[^ \t\n\r]+', '<URL>', 'g'), '[ \t\n\r]+', ' ', 'g'))"


def keep_first(rows: DataFrame, *keys: Column, order: str = "id") -> DataFrame:
    """The first row by ``order`` of each key: the least row of each key, so that every task sends on one row a key.

    Null keys are one key; rows without an order come last; of rows equal in both, the least by its other columns stays.
    """
    least = F.min(F.struct(F.col(order).isNull().alias("_last"), F.col(order).alias("_order"), F.struct(*rows.columns).alias("_row")))
    return rows.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(keys))).agg(least.alias("_f")).select("_f._row.*")


def validate(rows: DataFrame, required: list[str], label: str = "label") -> DataFrame:
    """Unexpected labels with their counts; raises if a required column is missing."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows.where(~F.coalesce(F.col(label).isin(*LABELS), F.lit(False))).groupBy(label).count()


def stratified_split(rows: DataFrame, strata: list[str], seed: str = "42") -> DataFrame:
    """Adds ``split``: 70/15/15 in each stratum, by a hash of the id; one row trains, two train and test, three go one each way.

    A stratum may hold most rows, so none is sorted in one place: ids are ranked within slices of a stratum by the first
    byte of their hash (two bytes where a stratum is large), and a slice's rank starts after the counts of the slices before. Ids are unique.
    """
    digest = F.md5(F.concat(F.lit(seed), F.col("id").cast("string")))
    keyed = rows.select("id", *strata, digest.alias("_h"))
    sizes = keyed.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    digits = F.when(F.col("_n") > 1_000_000, 4).otherwise(2)
    k, z = keyed.alias("k"), sizes.alias("z")
    sliced = k.join(z, [F.col(f"k.{c}").eqNullSafe(F.col(f"z.{c}")) for c in strata]).select("k.*", "z._n").withColumn("_slice", F.substring("_h", F.lit(1), digits))
    counts = sliced.groupBy(*strata, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*strata).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 65,536 slices at most
    starts = counts.withColumn("_before", before).drop("_c")
    within = F.row_number().over(Window.partitionBy(*strata, "_slice").orderBy("_h", "id"))
    s, b = sliced.withColumn("_w", within).alias("s"), starts.alias("b")
    met = s.join(b, [F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*strata, "_slice"]])
    split = met.select("s.id", "s._n", (F.col("s._w") + F.col("b._before")).alias("_r")).select("id", F.expr(SPLIT_SQL).alias("split"))
    return rows.join(split, "id")


SPLIT_SQL = """CASE WHEN _n = 1 THEN 'train' WHEN _n = 2 THEN CASE WHEN _r = 1 THEN 'train' ELSE 'test' END
  WHEN _n = 3 THEN CASE WHEN _r = 1 THEN 'train' WHEN _r = 2 THEN 'validation' ELSE 'test' END
  WHEN _r <= floor(_n * 70 / 100) THEN 'train' WHEN _r <= floor(_n * 70 / 100) + greatest(floor(_n * 15 / 100), 1) THEN 'validation' ELSE 'test' END"""


def overlaps(rows: DataFrame, key: Column) -> DataFrame:
    """``splits, n_texts``: how many distinct texts stand in which splits, for those in two or more."""
    sets = rows.select(key.alias("key"), "split").distinct().groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("split")), "+").alias("splits"), F.count(F.lit(1)).alias("n"))
    return sets.where("n > 1").groupBy("splits").agg(F.count(F.lit(1)).alias("n_texts"))


def leakage_clean(rows: DataFrame) -> DataFrame:
    """Test rows whose text is in no other split."""
    keyed = rows.withColumn("key", text_key(F.col("text")))
    return keyed.where("split = 'test'").join(keyed.where("split <> 'test'").select("key").distinct(), "key", "left_anti").drop("key")


def profile(rows: DataFrame) -> DataFrame:
    """Counts by split, and by split with label, category, language and source, in one pass."""
    sets = [["split"], ["split", "label"], ["split", "scam_type"], ["split", "language"], ["split", "source"]]
    names = ["split", "label", "scam_type", "language", "source"]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.count(F.lit(1)).alias("n"))


#: Ordered replacements: pattern and label. Word edges are written out, so that every engine reads them alike.
_E = r"(^|[^A-Za-z0-9_])"
REDACTIONS = [
    (r"(?i)" + _E + r"((?:otp|one[ \t-]?time[ \t-]?password|pin)[^0-9]{0,20})[0-9]{4,8}($|[^A-Za-z0-9_])", "{1}{2}[OTP]{3}"),
    (_E + r"(?:[0-9]{4}[ -]?){3}[0-9]{4}($|[^A-Za-z0-9_])", "{1}[CARD]{2}"),
    (r"(?i)https?://[^ \t\n\r]+", "[URL]"),
    (_E + r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}($|[^A-Za-z0-9_])", "{1}[EMAIL]{2}"),
    (r"(?i)" + _E + r"[a-z][a-z0-9._-]{2,30}@[a-z]{2,}($|[^A-Za-z0-9_])", "{1}[UPI_ID]{2}"),
    (r"(?i)" + _E + r"(?:a/c|acct|account|acc[.]?)[ \t]*[.:#/ -]*[ \t]*[0-9]{4,}", "{1}[ACCOUNT]"),
    (r"(^|[^0-9])[6-9][0-9]{9}($|[^0-9])", "{1}[PHONE]{2}"),
    (r"(^|[^0-9])[0-9]{9,18}($|[^0-9])", "{1}[ACCOUNT]{2}"),
    (_E + r"(?:[0-9]{1,3}[.]){3}[0-9]{1,3}($|[^A-Za-z0-9_])", "{1}[IP]{2}"),
    (r"(?i)" + _E + r"(ref(?:erence)?|ref[ \t-]?no[.]?)[^0-9]{0,12}[0-9]{4,10}($|[^A-Za-z0-9_])", "{1}[REF]{3}"),
]


# What a text must have for a replacement to find anything, in the order of REDACTIONS: cheap to look for, so that only such texts go through the pattern.
_NEEDS = (
    "rlike({x}, r'[0-9]{4}')", "rlike({x}, r'[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}')", "rlike({x}, r'(?i)https?://')", "contains({x}, '@')", "contains({x}, '@')", "rlike({x}, r'[0-9]{4}')",
    "rlike({x}, r'[0-9]{10}')", "rlike({x}, r'[0-9]{9}')", "rlike({x}, r'[0-9][.][0-9]{1,3}[.][0-9]')", "rlike({x}, r'[0-9]{4}')",
)


def redacted(rows: DataFrame, text: str = "text", to: str = "clean") -> DataFrame:
    """Adds ``to``: ``text`` with personal data replaced by labels and blanks collapsed, as ``redaction_sql`` says.

    Each replacement is a step of its own, taken by the texts that have what it needs. Case is ignored by all patterns: those
    that do not say so name both cases of each letter, and ignoring it makes them several times faster.
    """
    kept = [c for c in rows.columns if c != to]
    rows = rows.selectExpr(*kept, f"coalesce({text}, '') AS _r")
    for (pattern, by), need in zip(REDACTIONS, _NEEDS, strict=True):
        for i in (1, 2, 3):
            by = by.replace("{%d}" % i, f"${i}")
        pattern = pattern if pattern.startswith("(?i)") else "(?i)" + pattern
        rows = rows.selectExpr(*kept, f"CASE WHEN {need.replace('{x}', '_r')} THEN regexp_replace(_r, r'{pattern}', r'{by}') ELSE _r END AS _r")
    return rows.selectExpr(*kept, f"trim(regexp_replace(_r, r'[\t\n\r][ \t\n\r]*| [ \t\n\r]+', ' ')) AS {to}")


def redaction_sql(duck: bool, text: str = "text") -> str:
    sql = f"coalesce({text}, '')"
    for pattern, by in REDACTIONS:
        for i in (1, 2, 3):
            by = by.replace("{%d}" % i, f"\\{i}" if duck else f"${i}")
        sql = f"regexp_replace({sql}, '{pattern}', '{by}', 'g')" if duck else f"regexp_replace({sql}, r'{pattern}', r'{by}')"
    blanks = f"regexp_replace({sql}, '[ \\t\\n\\r]+', ' ', 'g')" if duck else f"regexp_replace({sql}, r'[ \\t\\n\\r]+', ' ')"
    return f"trim({blanks})"


def shortened_sql(text: str, most: int = 160) -> str:
    return f"CASE WHEN length({text}) > {most} THEN substr({text}, 1, {most - 3}) || '...' ELSE {text} END"


WEAK_CATEGORY = """CASE WHEN label <> 'scam' THEN 'safe' WHEN contains(lower(text), 'kyc') OR contains(lower(text), 'केवाईसी') THEN 'kyc'
  WHEN contains(lower(text), 'loan') OR contains(lower(text), 'लोन') THEN 'loan' WHEN contains(lower(text), 'parcel') OR contains(lower(text), 'customs') OR contains(lower(text), 'पार्सल') THEN 'delivery'
  WHEN contains(lower(text), 'atm') OR contains(lower(text), 'खाता') OR contains(lower(text), 'bank') THEN 'bank_impersonation' ELSE 'other' END"""


# Marks of a labelled text by parts of it, in order.
WEAK_INDICATORS = (
    ("urgency", ("urgent", "immediately", "jaldi", "तुरंत", "turant")), ("kyc_language", ("kyc", "केवाईसी")), ("suspicious_url", ("http", "click")), ("otp_request", ("otp", "pin")),
)


def weak_indicators_sql(text: str = "text", category: str = "category") -> str:
    """Marks of a text joined by bars, its category last where it is no mark; ``none`` for a safe one. Null texts have no parts."""
    def one(name: str, parts) -> str:
        return f"CASE WHEN {' OR '.join(f'contains(lower({text}), {chr(39)}{p}{chr(39)})' for p in parts)} THEN '{name}' END"

    marks = ", ".join(f"'{n}'" for n, _ in WEAK_INDICATORS)
    own = f"CASE WHEN NOT {category} IN ({marks}) THEN {category} END"
    return f"CASE WHEN {category} = 'safe' THEN 'none' ELSE concat_ws('|', {', '.join(one(n, p) for n, p in WEAK_INDICATORS)}, {own}) END"


def placeholders(text: Column) -> Column:
    """Texts as data sets keep them: phone numbers, account numbers and codes after the word OTP replaced; null stays null."""
    out = F.regexp_replace(text, r"(?<![0-9])(?:\+91[\s-]?)?[6-9][0-9]{9}(?![0-9])", "[PHONE]")
    out = F.regexp_replace(out, r"(?<![0-9])[0-9]{9,18}(?![0-9])", "[ACCOUNT]")
    return F.trim(F.regexp_replace(out, r"(?i)(\bOTP\b[:\s]*)[0-9]{4,8}", "$1[OTP]"))


def leakage_totals(rows: DataFrame) -> DataFrame:
    """One row: ``n_exact, n_normalized`` distinct texts that stand in two splits or more, ``n_either`` texts in either sense, ``pairs`` of splits met."""
    keyed = rows.select("split", F.coalesce("text", F.lit("")).alias("text"), text_key(F.col("text")).alias("key")).distinct()
    exact = keyed.groupBy("key", "text").agg(F.collect_set("split").alias("s"))  # a set of three names at most
    folded_ = exact.groupBy("key").agg(
        F.count_if(F.size("s") > 1).alias("n_exact"), F.array_distinct(F.flatten(F.collect_set("s"))).alias("splits"))
    met = folded_.where("size(splits) > 1 OR n_exact > 0")
    couples = F.array_join(F.sort_array(F.collect_set(F.array_join(F.sort_array("splits"), "+"))), ",")
    return met.agg(
        F.coalesce(F.sum("n_exact"), F.lit(0)).alias("n_exact"), F.count_if(F.size("splits") > 1).alias("n_normalized"), F.count(F.lit(1)).alias("n_either"), couples.alias("pairs"))


def value_counts(rows: DataFrame, key: str) -> DataFrame:
    """``key, n``, most frequent first, names deciding ties."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first(key))


def numbered(rows: DataFrame, *order: str, prefix: str = "row-", digits: int = 6) -> DataFrame:
    """Adds ``row_id``, the padded place in ``order`` from one.

    Rows are sorted by ranges, so no task sees them all: a row's place is its place in its range and the counts of the
    ranges before. The ranges are written first, so that they are drawn once.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    starts = sizes.select("_range", before.alias("_before"))
    placed = ranged.withColumn("_w", F.row_number().over(Window.partitionBy("_range").orderBy(*order))).join(F.broadcast(starts), "_range")
    place = (F.col("_w") + F.col("_before")).cast("string")
    return placed.withColumn("row_id", F.concat(F.lit(prefix), F.when(F.length(place) < digits, F.lpad(place, digits, "0")).otherwise(place))).drop("_range", "_w", "_before")
