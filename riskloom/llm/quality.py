"""Quality rules as a ledger of failure bits, with DataFrame and SQL functions only.

Each rule is evaluated once for each text; the ledger stores its measurements and one bit for each rule
that the text fails. A policy is a version and a mask of the rules in force: applying one, or comparing many,
only reads the bits. Ablations group the ledger by its bits first, so they work on at most ``2 ** rules`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks that separate words: x20 and x09-x0D.
BLANKS = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"

#: name, measurement that says a text fails. The order gives each rule its bit; new rules go to the end.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("all_capitals", "all_capitals"),
    ("exclamations", "5 * n_exclamations > n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
]


def bit(rule: str) -> int:
    return 1 << [name for name, _ in RULES].index(rule)


#: Versioned policies: the rules in force.
POLICIES: dict[str, int] = {
    "base-1": bit("few_words") | bit("repeated_words"),
    "full-1": sum(bit(name) for name, _ in RULES),
}

_POS_BITS = 24  # of a packed window: its place; the other 40 are of its hash


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with_equal_neighbour(sorted_windows: Column, same) -> Column:
    return _let(
        sorted_windows,
        lambda s: F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False))),
    )


def _repeated(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more.

    Windows are packed as hash and place and sorted as plain numbers; only those whose hashes meet are then
    compared by their words.
    """
    places = F.sequence(F.lit(0), F.size(words) - 3)
    place = F.lit((1 << _POS_BITS) - 1).cast("long")
    packed = F.transform(
        places,
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(-(1 << _POS_BITS)).cast("long")).bitwiseOR(i.cast("long")),
    )
    meeting = _with_equal_neighbour(F.sort_array(packed), lambda a, b: F.shiftrightunsigned(a.bitwiseXOR(b), _POS_BITS) == 0)
    candidates = F.when(F.size(words) < (1 << _POS_BITS), F.transform(meeting, lambda x: x.bitwiseAND(place).cast("int"))).otherwise(places)
    spelled = F.transform(
        candidates,
        lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")),
    )
    found = _with_equal_neighbour(F.sort_array(spelled), lambda a, b: a["w"] == b["w"])
    covered = F.aggregate(
        F.sort_array(F.transform(found, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(acc["end"], i)).alias("n"), (i + 3).alias("end")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(covered)


def measurements(text: Column) -> Column:
    """A struct of all measurements of one text (null: empty)."""
    t = F.coalesce(text.cast("string"), F.lit(""))

    def measured(w: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CHAR))
        return _let(lines, lambda ln: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            _repeated(w).cast("long").alias("n_repeat_words"),
            F.size(ln).cast("long").alias("n_lines"),
            (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
            ((t == F.upper(t)) & (t != F.lower(t))).alias("all_capitals"),
        ))

    return _let(F.array_remove(F.split(t, BLANKS), ""), measured)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the measurements and ``fail_bits`` of each row.

    Null and empty texts have no words and so fail ``few_words``; rows with a null id and repeated rows are
    measured like any other; other columns of ``docs`` are ignored.
    """
    measured = docs.select(F.col(id_col).alias("id"), measurements(F.col(text_col)).alias("m")).select("id", "m.*")
    fails = [F.when(F.expr(test), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, test) in enumerate(RULES)]
    bits = fails[0]
    for f in fails[1:]:
        bits = bits.bitwiseOR(f)
    return measured.withColumn("fail_bits", bits.cast("long"))


def apply_policy(entries: DataFrame, version: str) -> DataFrame:
    """Adds ``kept``: no rule that the policy has in force fails."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0)


def ablations(entries: DataFrame) -> DataFrame:
    """For each policy and each of its rules: texts dropped, those failing the rule, and those that only it drops
    (kept if the rule were left out)."""
    spark = entries.sparkSession
    grouped = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rows = [(version, mask, name, 1 << k) for version, mask in POLICIES.items() for k, (name, _) in enumerate(RULES) if mask >> k & 1]
    cases = spark.createDataFrame(rows, "policy string, mask long, rule string, rule_bit long")
    bits = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias
    return (
        F.broadcast(cases).join(grouped, F.lit(True), "left").groupBy("policy", "rule")  # a fixed list of cases, times 2 ** rules groups at most
        .agg(total(bits != 0)("dropped"), total(bits.bitwiseAND(F.col("rule_bit")) != 0)("failing"), total(bits == F.col("rule_bit"))("only_this"))
    )


def op9(docs: DataFrame) -> DataFrame:
    """Contract columns, then the ledger's bits; ``kept`` is the verdict of the policy ``full-1``."""
    got = apply_policy(ledger(docs), "full-1")
    base = F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base-1"]).cast("long")) != 0
    return got.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "fail_bits",
    )


_TESTS = " + ".join(f"CASE WHEN {test} THEN {1 << k} ELSE 0 END" for k, (_, test) in enumerate(RULES))

OP9_SQL = rf"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i,
         unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
  FROM words WHERE len(w) >= 3
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), measured AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclamations, t = upper(t) AND t <> lower(t) AS all_capitals
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM words) w
  LEFT JOIN repeated r ON w.doc_id = r.doc_id
), judged AS (
  SELECT *, CAST({_TESTS} AS BIGINT) AS fail_bits FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {POLICIES["base-1"]}) <> 0 AS base_failed, (fail_bits & {POLICIES["full-1"]}) = 0 AS kept, fail_bits
FROM judged
"""
