"""Lookalikes of brands among the labels of hosts, with brands as a table of any size.

Two words within k edits have a spelling in common that each gives by leaving out k characters at most. So brands and labels
are written with all such spellings as keys and joined on them, and each pair that meets is checked exactly. A label is looked up once, however many
hosts have it, and a label longer than any brand allows has no keys at all.

A label looks like a brand when both read alike once folded (digits and signs for letters, ``rn`` for ``m``), when it is one edit away and
the brand has five characters or more, or when it has the brand's length, six or more, and is two edits away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.tables import written
from . import urls as U

ONE_EDIT, TWO_EDITS = 5, 6  # fixed values: characters that a brand needs for them


def brands(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``token, ord, official, spellings``: the fixed brands that need no security word, or those of a CSV file (domains and spellings joined by ``|``)."""
    if path:
        given = spark.read.csv(path, header=True, schema="token string, ord long, official string, spellings string")
        cut = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: x != "")
        return given.select(F.lower("token").alias("token"), "ord", cut("official").alias("official"), cut("spellings").alias("spellings"))
    rows = [(t, i, list(own), list(more)) for i, (t, own, need, more) in enumerate(rules.BRANDS) if not need]
    return spark.createDataFrame(rows, "token string, ord long, official array<string>, spellings array<string>")


def folded(text: Column) -> Column:
    return F.translate(F.replace(F.lower(text), F.lit("rn"), F.lit("m")), "0134578|!@$", "oleastblias")


def _without_one(text: Column) -> Column:
    """The text and all that leaving out one character gives."""
    cut = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    return F.when(F.length(text) == 0, F.array(text)).otherwise(F.array_distinct(F.concat(F.array(text), cut)))


def _keys(text: Column, one: Column, two: Column) -> Column:
    """Marked keys of a word: its folded form, and what one or two omissions give where they are wanted."""
    single = _without_one(text)
    double = F.array_distinct(F.flatten(F.transform(single, _without_one)))
    spelled = F.when(two, double).when(one, single).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))
    return F.concat(F.array(F.concat(F.lit("="), folded(text))), F.transform(spelled, lambda x: F.concat(F.lit("-"), x)))


def pairs(labels: DataFrame, tokens: DataFrame) -> DataFrame:
    """Distinct ``label, token`` that look alike, of the distinct words of ``labels`` (``label``) and ``tokens`` (``token``).

    Null and empty words, and a word beside itself, are no pairs.
    """
    known = tokens.select("token").where("token <> ''").distinct()
    longest = known.agg(F.max(F.length("token"))).first()[0] or 0
    n = F.length("label")
    own = labels.select("label").where("label <> ''").distinct()
    keyed = own.withColumn("_key", F.explode(_keys(F.col("label"), (n >= ONE_EDIT - 1) & (n <= longest + 1), (n >= TWO_EDITS) & (n <= longest))))
    m = F.length("token")
    by = known.withColumn("_key", F.explode(_keys(F.col("token"), m >= ONE_EDIT, m >= TWO_EDITS)))
    met = keyed.join(by, "_key").select("label", "token").where("label <> token").distinct()
    near = F.levenshtein("label", "token")
    alike = (folded(F.col("label")) == folded(F.col("token"))) | ((m >= ONE_EDIT) & (near <= 1)) | ((m >= TWO_EDITS) & (n == m) & (near <= 2))
    return met.where(alike)


def _spelled_in(host: Column, edged: Column, word: Column) -> Column:
    """Whether a host has a word of its own, or begins or ends a label with it as ``urls`` has it."""
    marked = F.regexp_replace(word, r"([^\p{L}\p{N}_])", "|$1|")
    glued = F.exists(F.split(host, r"[.]"), lambda x: F.startswith(F.regexp_replace(x, "^[-_]+", ""), word) & F.rlike(F.regexp_replace(F.substring(F.regexp_replace(x, "^[-_]+", ""), F.length(word) + 1, F.length(x)), "[-_]+$", ""), F.lit("^[a-z]+$")))
    return F.contains(edged, F.concat(F.lit("|"), marked, F.lit("|"))) | glued


def found(hosts: DataFrame, table: DataFrame, key: str = "url_id") -> DataFrame:
    """``key, token, label`` for hosts (``key, host``) with a label that looks like a brand whose domain they are not and which they do not name.

    Of several brands the first of the table counts, and of its labels the first in the host.
    """
    hosts = written(hosts.select(key, "host"), "hosts")  # read twice, and what gives them is long
    each = hosts.where("host <> ''").select("host").distinct()
    placed = each.select("host", F.posexplode(F.split("host", "[.]")).alias("place", "label"))
    met = placed.join(pairs(placed, table), "label").join(table, "token")
    edged = F.concat(F.lit("|"), F.regexp_replace("host", r"([^\p{L}\p{N}_])", "|$1|"), F.lit("|"))
    owned = F.exists("official", lambda x: (F.col("host") == x) | F.endswith(F.col("host"), F.concat(F.lit("."), x)))
    spelled = F.exists(F.concat(F.array("token"), "spellings"), lambda w: _spelled_in(F.col("host"), edged, w))
    best = met.where(~owned & ~spelled).groupBy("host").agg(F.min(F.struct("ord", "place", "token", "label")).alias("b"))
    return hosts.select(key, "host").join(best, "host").select(key, F.col("b.token").alias("token"), F.col("b.label").alias("label"))


def with_brands(urls: DataFrame, table: DataFrame, key: str = "url_id") -> DataFrame:
    """``urls.url_scores`` with a table of brands in the place of the fixed ones for lookalikes; ``key`` is unique."""
    parts = written(U.url_indicators(urls), "link-indicators")
    hits = found(parts.select(key, "host"), table, key).select(key, F.col("token").alias("_token"))
    own = parts.drop("typo", "p_possible_brand_typosquatting").join(hits, key, "left").withColumnRenamed("_token", "typo")
    own = own.withColumn("p_possible_brand_typosquatting", F.when(F.col("typo").isNotNull(), F.lit(14.0)))
    return U.scored(own)


def oracle(hosts: str, key: str = "url_id") -> str:
    """The same by plain edit distance between every label and every brand, with the tests of hosts that ``urls`` has."""
    rows = ", ".join(f"('{t}', {i})" for i, (t, _, need, _) in enumerate(rules.BRANDS) if not need)
    fold = lambda x: f"translate(replace(lower({x}), 'rn', 'm'), '0134578|!@$', 'oleastblias')"
    free = " OR ".join(f"token = '{t}' AND NOT {U._official(own)} AND NOT {U._brand_in(U.Duck, 'host', 'edged', t, more)}" for t, own, need, more in rules.BRANDS if not need)
    return f"""SELECT {key}, token, label FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ord, place) AS r FROM (
      SELECT {key}, host, {U._edged(U.Duck, 'host')} AS edged, unnest(range(len(l))) AS place, unnest(l) AS label FROM (SELECT *, string_split(host, '.') AS l FROM ({hosts}) WHERE host <> '')) h, (VALUES {rows}) AS b(token, ord)
      WHERE label <> '' AND label <> token AND ({fold('label')} = {fold('token')} OR length(token) >= 5 AND levenshtein(label, token) <= 1 OR length(token) >= 6 AND length(label) = length(token) AND levenshtein(label, token) <= 2)
        AND ({free})) WHERE r = 1"""
