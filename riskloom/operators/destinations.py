"""Destinations hidden in links: candidates, their status, and a choice for each link."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dialect import Spark
from . import urls as U

LAYERS, MOST, CHARS = 5, 5, 2048
_WEB = r"(?i)https?://[^ \t\n\r<>\x27\x22`]*"  # an address that ends with its marks is malformed, and told rather than dropped
# Indicators that settle a destination as suspicious.
DECISIVE = (
    "brand_impersonation", "brand_in_subdomain", "brand_in_path", "possible_brand_typosquatting", "ip_address_host", "punycode_domain", "mixed_script_host", "hex_encoded_host",
    "embedded_credentials", "multiple_at", "confusing_userinfo", "unusual_scheme", "suspicious_redirect_parameter", "short_url_redirector", "nested_url", "encoded_nested_url", "suspicious_query_param",
)


def _decoded(df: DataFrame, column: str) -> DataFrame:
    """Adds ``decoded`` and ``layers``: at most five rounds of decoding, until nothing changes or the text grows too long."""
    def once(t):
        escaped = F.regexp_replace(F.replace(t, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f][0-9A-Fa-f])", "%25")
        return F.coalesce(F.try_url_decode(escaped), t)

    def step(acc, _):
        t = acc["t"]
        further = F.when(F.length(t) <= CHARS, once(t)).otherwise(t)
        return F.get(F.transform(F.array(further), lambda n: F.struct(n.alias("t"), (acc["n"] + (n != t).cast("int")).alias("n"))), F.lit(0))

    rounds = F.sequence(F.lit(1), F.lit(LAYERS))
    found = F.aggregate(rounds, F.struct(F.trim(F.col(column)).alias("t"), F.lit(0).alias("n")), step)
    return df.withColumn("_found", found).withColumn("decoded", F.col("_found.t")).withColumn("layers", F.col("_found.n")).drop("_found")


def _webs(text) -> "F.Column":
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(_WEB), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?)\]}>]+$", "")), lambda u: F.length(u) <= CHARS)


def candidates(links: DataFrame) -> DataFrame:
    """``url_id, rank, destination, source, parameter, layers``: values of redirect parameters first, then of others, then what
    the whole link nests; each destination once, the first five (the rule's bound) with ``truncated`` for the rest."""
    parts = U.url_parts(links)
    items = parts.select("url_id", F.posexplode(F.split("query", "&")).alias("pos", "item")).where("item <> ''").selectExpr(
        "url_id", "pos", f"lower({Spark.form(Spark.part('item', '^([^=]*)', 1))}) AS parameter", f"{Spark.form(Spark.part('item', '^[^=]*=(.*)$', 1))} AS value")
    redirect = F.col("parameter").isin(*rules.REDIRECT_PARAMS)
    by_param = _decoded(items.where("value <> ''"), "value").where(F.length("decoded") <= CHARS).select(
        "url_id", F.when(redirect, 0).otherwise(1).alias("kind"), "pos", "parameter", "layers",
        F.when(redirect, "redirect_parameter").when(F.col("layers") > 0, "encoded_url").otherwise("nested_url").alias("source"), F.posexplode(_webs(F.col("decoded"))).alias("at", "destination"))
    nested = parts.where("(length(raw) - length(replace(raw, '://', ''))) > 3 or contains(lower(raw), '%3a%2f%2f')")
    whole = _decoded(nested, "raw").select("url_id", F.lit(2).alias("kind"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("parameter"), "layers", "raw", F.posexplode(_webs(F.col("decoded"))).alias("at", "destination")).where("at > 0")
    whole = whole.withColumn("source", F.when(F.contains("raw", "destination"), "nested_url").otherwise("encoded_url")).drop("raw")
    every = by_param.unionByName(whole).withColumn("order", F.struct("kind", "pos", "at"))
    first = every.groupBy("url_id", "destination").agg(F.min(F.struct("order", "source", "parameter", "layers")).alias("f"))
    w = Window.partitionBy("url_id").orderBy("f.order")
    ranked = first.withColumn("rank", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("url_id")))
    return ranked.where(F.col("rank") <= MOST).select("url_id", "rank", "destination", "f.source", "f.parameter", "f.layers", (F.col("n") > MOST).alias("truncated"))


def statuses(found: DataFrame) -> DataFrame:
    """Adds ``status``: each distinct destination is scored once, as a link of its own."""
    official = sorted({d for _, ds, _, _ in rules.BRANDS for d in ds})
    known = U.distinct_urls(found.select(F.col("destination").alias("url")))
    decisive = F.lit(False)
    for x in DECISIVE:
        decisive = decisive | F.col(f"p_{x}").isNotNull()
    host = F.regexp_replace("host", "^www[.]", "")
    status = F.when(F.col("is_suspicious") | decisive, "suspicious").when(host.isin(*official) & (F.col("risk_score") <= 24) & (F.col("n_indicators") == 0), "verified").otherwise("unknown")
    return found.join(known.select(F.col("url").alias("destination"), status.alias("status")), "destination")


def choices(judged: DataFrame) -> DataFrame:
    """For each link: the first verified destination, else unsafe, else unknown."""
    ok = lambda s: F.min_by(F.when(F.col("status") == s, F.col("destination")), F.when(F.col("status") == s, F.col("rank")))
    per = judged.groupBy("url_id").agg(F.count(F.lit(1)).alias("n_destinations"), ok("verified").alias("safe_destination"), F.max((F.col("status") == "suspicious").cast("int")).alias("_bad"))
    choice = F.when(F.col("safe_destination").isNotNull(), "verified").when(F.col("_bad") == 1, "unsafe").otherwise("unknown")
    return per.select("url_id", "n_destinations", "safe_destination", choice.alias("choice"))


def normalized(links: DataFrame) -> DataFrame:
    """``url_id, normalized``: lower-case host, no default port, sorted parameters; other than web links stay as they are."""
    parts = U.url_parts(links)
    pairs = F.array_sort(F.transform(F.filter(F.split("query", "&"), lambda x: x != ""), lambda x: F.concat_ws("=", F.url_encode(F.coalesce(F.try_url_decode(F.regexp_extract(x, "^([^=]*)", 1)), F.regexp_extract(x, "^([^=]*)", 1))), F.url_encode(F.coalesce(F.try_url_decode(F.regexp_extract(x, "^[^=]*=(.*)$", 1)), F.regexp_extract(x, "^[^=]*=(.*)$", 1))))))
    query = F.array_join(pairs, "&")
    web = F.concat(F.col("scheme"), F.lit("://"), F.col("host"), F.when(F.col("port").isNotNull() & ~F.col("port").isin(80, 443), F.concat(F.lit(":"), F.col("port").cast("string"))).otherwise(""), F.col("path"),
                   F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(F.col("fragment") != "", F.concat(F.lit("#"), F.col("fragment"))).otherwise(""))
    return parts.select("url_id", F.when(F.col("scheme").isin("http", "https") & (F.col("host") != ""), web).otherwise(F.col("raw")).alias("normalized"))
