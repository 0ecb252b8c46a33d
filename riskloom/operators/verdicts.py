"""One table of verdicts for mixed artefacts, verdicts of containers with several payloads, and stages of chains.

Items are ``item_id, type, content``; ``item_id`` is unique and may be a struct. Each kind goes through its own job and
the results meet again by ``unionByName``; nothing is gathered but an item's own indicators, whose names are a fixed list.
Unknown types, blank contents and types that need more than one content (chains, link changes) become rows with
``status`` ERROR. Extra columns of the items are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dialect import Spark
from ..sources.files import intake
from ..sources.tables import written
from . import chains as C
from . import messages as M
from . import payments as P
from . import urls as U

SINGLE = ("message", "url", "upi", "qr")  # kinds that one content decides
# The indicator, without points, that says what a code decodes to.
CONTEXT = {"url": "embedded_url_in_qr", "upi": "upi_payment_uri", "text": "embedded_text_in_qr"}
UNKNOWN_CONFIDENCE = 25.0  # fixed value
VERDICT = ["item_id", "kind", "status", "content_type", "risk_score", "risk_level", "is_suspicious", "scam_type", "confidence", "indicators"]
_SCORED = ["item_id", "kind", "content_type", "risk_score", "risk_level", "is_suspicious", "confidence", "category", "indicators", "url", "payee", "words"]


def _fired(prefix: str, names, unless: Column | None = None, spared=()) -> Column:
    """The names whose column is set, in their fixed order."""
    def one(name):
        fires = F.col(f"{prefix}{name}").isNotNull()
        return F.when(fires & ~unless if unless is not None and name in spared else fires, F.lit(name))

    return F.array_compact(F.array(*map(one, names)))


def routed(items: DataFrame) -> DataFrame:
    """``item_id, kind, content, content_type``; ``content_type`` says which job takes the row (null: none)."""
    known = intake(items.select("item_id", "type", F.col("content").cast("string").alias("content")))
    kind = F.when(F.col("kind").isin(*SINGLE), F.col("kind")).otherwise("error")
    own = known.select("item_id", kind.alias("kind"), F.trim("content").alias("payload"), "content")
    job = f"CASE kind WHEN 'message' THEN 'text' WHEN 'url' THEN 'url' WHEN 'error' THEN NULL ELSE {P.content_type_sql(Spark)} END"
    return own.selectExpr("item_id", "kind", "CASE WHEN kind = 'message' THEN content ELSE payload END AS content", f"{job} AS content_type")


def scored(rows: DataFrame) -> DataFrame:
    """Every row of ``routed`` but the errors with its score, indicators in order, first link, payee and words.

    The rows are written once and each job reads its own; its result is written too, so that what follows starts from
    plain columns, not from the jobs' long expressions.
    """
    rows = written(rows, "routed")
    texts = rows.where("content_type = 'text'")
    carried = F.struct("kind", F.col("content").alias("words"))  # goes unread through the message job
    found = M.with_scores(M.indicators(texts.select(F.col("item_id").alias("msg_id"), carried.alias("lang"), F.col("content").alias("text"), M.urls_in(F.col("content")).alias("urls"))))
    none = F.lit(None).cast("string")
    message = found.select(
        F.col("msg_id").alias("item_id"), F.col("lang.kind").alias("kind"), F.lit("text").alias("content_type"), "risk_score", "risk_level", F.col("is_scam").alias("is_suspicious"),
        F.col("confidence").cast("double").alias("confidence"), "category", _fired("s_", M.INDICATORS, F.col("guarded"), rules.WEAK).alias("indicators"),
        F.get("urls", F.lit(0)).alias("url"), none.alias("payee"), F.col("lang.words").alias("words"))
    links = U.url_scores(rows.where("content_type = 'url'").withColumnRenamed("content", "url")).withColumn("indicators", _fired("p_", U.INDICATORS))
    pays = P.payment_scores(rows.where("content_type = 'upi'").withColumnRenamed("content", "uri")).withColumn("indicators", _fired("p_", P.INDICATORS))
    url = links.select(*_SCORED[:6], F.col("confidence").cast("double").alias("confidence"), none.alias("category"), "indicators", "url", none.alias("payee"), none.alias("words"))
    upi = pays.select(*_SCORED[:6], F.col("confidence").cast("double").alias("confidence"), none.alias("category"), "indicators", none.alias("url"), F.col("payee_address").alias("payee"), none.alias("words"))
    unknown = rows.where("content_type = 'unknown'").selectExpr(
        "item_id", "kind", "content_type", "0 AS risk_score", "'LOW' AS risk_level", "false AS is_suspicious", f"CAST({UNKNOWN_CONFIDENCE} AS DOUBLE) AS confidence",
        "CAST(NULL AS STRING) AS category", "CAST(array() AS ARRAY<STRING>) AS indicators", "CAST(NULL AS STRING) AS url", "CAST(NULL AS STRING) AS payee", "CAST(NULL AS STRING) AS words")
    return written(message.select(*_SCORED), "texts").unionByName(written(url, "links")).unionByName(written(upi, "payments")).unionByName(unknown)


def with_context(found: DataFrame) -> DataFrame:
    """Codes and payment links name first what they decode to."""
    names = F.coalesce(*(F.when(F.col("content_type") == t, F.lit(n)) for t, n in CONTEXT.items()))
    decoded = F.col("kind").isin("qr", "upi") & names.isNotNull()
    return found.withColumn("indicators", F.when(decoded, F.concat(F.array(names), "indicators")).otherwise(F.col("indicators")))


def _scam_type() -> Column:
    bad = F.col("is_suspicious")
    return (
        F.when(F.col("kind") == "upi", F.when(bad, "upi_payment").otherwise("safe"))
        .when(F.col("content_type") == "text", F.col("category"))
        .when(~bad, "safe").when(F.col("content_type") == "url", "phishing").when(F.col("content_type") == "upi", "upi_payment").otherwise("other"))


def verdicts(items: DataFrame) -> DataFrame:
    """One row for each item (``VERDICT``): status ANALYSED, DECODED (payloads of codes and payment links) or ERROR.

    Scores are 0-100; errors have score 0, level LOW, confidence 0, no category and no indicators.
    """
    rows = routed(items)
    status = F.when(F.col("kind").isin("qr", "upi"), "DECODED").otherwise("ANALYSED")
    good = with_context(scored(rows)).withColumn("scam_type", _scam_type()).withColumn("status", status)
    bad = rows.where("kind = 'error'").selectExpr(
        "item_id", "kind", "'ERROR' AS status", "content_type", "0 AS risk_score", "'LOW' AS risk_level", "false AS is_suspicious", "CAST(NULL AS STRING) AS scam_type",
        "CAST(0 AS DOUBLE) AS confidence", "CAST(array() AS ARRAY<STRING>) AS indicators")
    return good.select(*VERDICT).unionByName(bad)


def merged_indicators(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``key, indicators``: the distinct names of a group, case ignored, in the order in which they first occur.

    Repeats are dropped before names are listed, so a list holds no more than the fixed names.
    """
    each = rows.select(key, F.col(order).alias("_o"), F.posexplode("indicators").alias("_i", "_name"))
    first = each.groupBy(key, F.lower("_name").alias("_low")).agg(F.min(F.struct("_o", "_i", "_name")).alias("_f"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("_f")), lambda f: f["_name"]).alias("indicators"))


def container_verdicts(payloads: DataFrame) -> DataFrame:
    """From ``container, pos, payload`` to one verdict for each container.

    The strongest score counts in full, each other one takes up to seven tenths of what is left; confidence is the
    highest, the first payload is the primary one, indicators are all payloads' in order. Blank payloads count as unknown.
    The scored payloads meet by container in one shuffle; equal lists of names of a container are one row before they are gathered.
    """
    items = payloads.select(F.struct("container", "pos").alias("item_id"), F.lit("qr").alias("kind"), F.coalesce(F.trim("payload"), F.lit("")).alias("payload"))
    rows = items.selectExpr("item_id", "kind", "payload AS content", f"{P.content_type_sql(Spark)} AS content_type")
    found = with_context(scored(rows)).select("item_id.*", "content_type", "risk_score", "confidence", "indicators").repartition("container")
    left = F.log(1 - 0.7 * F.col("risk_score") / 100)  # never zero: scores end at 100
    alike = found.groupBy("container", "indicators").agg(
        F.count(F.lit(1)).alias("_n"), F.max("risk_score").alias("_top"), F.sum(left).alias("_left"), F.max("confidence").alias("confidence"), F.min(F.struct("pos", "content_type")).alias("_first"))
    sums = alike.groupBy("container").agg(
        F.sum("_n").alias("n_payloads"), F.max("_top").alias("_top"), F.sum("_left").alias("_left"), F.max("confidence").alias("confidence"),
        F.min("_first").alias("_first"), F.array_sort(F.collect_list(F.struct("_first.pos", "indicators"))).alias("_lists"))
    total = 100 - (100 - F.col("_top")) * F.exp(F.col("_left") - F.log(1 - 0.7 * F.col("_top") / 100))
    folded = sums.withColumn("score", F.bround(total, 6)).withColumn("_names", F.flatten("_lists.indicators")).withColumn("_low", F.transform("_names", F.lower))
    first = F.transform(F.array_distinct("_low"), lambda x: F.get("_names", (F.array_position("_low", x) - 1).cast("int")))
    return folded.selectExpr(
        "container", "n_payloads", "_first.content_type AS primary_type", "score", "CAST(bround(score, 0) AS INT) AS risk_score", f"{M.level_sql('score')} AS risk_level",
        "score >= 50 AS is_suspicious", "confidence", "_names", "_low").withColumn("indicators", first).drop("_names", "_low")


def stages(artefacts: DataFrame) -> DataFrame:
    """From ``chain_id, idx, type, content`` to the stages that ``chains`` takes, scored by their own jobs; errors are left to ``verdicts``."""
    items = artefacts.select(F.struct("chain_id", "idx").alias("item_id"), "type", "content")
    found = scored(routed(items))
    return found.select(
        "item_id.*", F.col("kind").alias("type"), "risk_score", "is_suspicious", F.col("category").alias("scam_type"), F.array_join("indicators", " ").alias("indicators"),
        F.col("url"), "payee", F.col("words").alias("content"))


def chain_indicators(staged: DataFrame) -> DataFrame:
    """``chain_id, n_stages, n_flagged, indicators`` (distinct, first seen first) of each chain."""
    listed = staged.withColumn("indicators", F.filter(F.split("indicators", " "), lambda x: x != ""))
    counts = staged.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_stages"), F.count_if("is_suspicious").alias("n_flagged"))
    names = merged_indicators(listed, "chain_id", "idx")
    return counts.join(names, "chain_id", "left").withColumn("indicators", F.coalesce("indicators", F.expr("CAST(array() AS ARRAY<STRING>)")))


def chain_verdicts(artefacts: DataFrame) -> DataFrame:
    """From ``chain_id, idx, type, content`` to one verdict for each chain: pattern, score, class and all its indicators in order."""
    staged = written(stages(artefacts), "stages")
    signalled = C.with_signals(staged)
    scores = C.chain_scores(signalled, C.edges(signalled))
    return scores.join(chain_indicators(staged).select("chain_id", "indicators"), "chain_id")
