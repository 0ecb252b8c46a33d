"""Reading and writing of labelled data sets, artefacts and evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELLED = "id string, text string, language string, scam_or_safe string, scam_type string, source string, indicators string, split string"
RAW = "message string, label string, reason string, domain string, language string"
# Names of input types.
ALIASES = {
    "message": "message", "msg": "message", "text": "message", "url": "url", "link": "url", "qr": "qr", "qrcode": "qr", "qr_image": "qr", "image": "qr",
    "upi": "upi", "upi_uri": "upi", "chain": "chain", "chain_analysis": "chain", "multistage": "chain", "link_change": "link_change", "link-change": "link_change",
    "linkchange": "link_change", "purify": "link_change", "purifier": "link_change", "link_purifier": "link_change", "link_safety": "link_change",
    "link_monitor": "link_change", "compare": "link_change",
}


def read_labelled(spark: SparkSession, *paths: str, split: str | None = None) -> DataFrame:
    """CSV with header, quoted line breaks and an optional byte-order mark; all columns are text."""
    rows = spark.read.csv(list(paths), header=True, multiLine=True, escape='"', schema=LABELLED, enforceSchema=True)
    rows = rows.withColumn("indicators", F.split(F.coalesce("indicators", F.lit("")), r"\|"))
    return rows.withColumn("split", F.lit(split)) if split else rows


def read_splits(spark: SparkSession, root: str) -> DataFrame:
    """The three splits under ``root``, tagged."""
    parts = [read_labelled(spark, f"{root}/{s}/messages.csv", split=s) for s in ("train", "validation", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Public rows: label mapped, language as a code, blank texts and urgent-sounding safe texts dropped."""
    filler = ("jaldi kare", "please act now", "immediately", "abhi kare")  # fixed values
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', schema=RAW).withColumn("text", F.trim(F.coalesce("message", F.lit("")))).where("text <> ''")
    rows = rows.withColumn("label", F.when(F.lower(F.trim("label")) == "scam", "scam").otherwise("safe"))
    urgent = F.lit(False)
    for part in filler:
        urgent = urgent | F.lower("text").contains(part)
    code = F.when(F.lower("language").startswith("hindi"), "hi").when(F.lower("language").startswith("marathi"), "mr").when(F.lower("language").startswith("hinglish"), "hinglish").otherwise("en")
    return rows.where((F.col("label") == "scam") | ~urgent).select("text", "label", "domain", code.alias("language"))


def write_splits(rows: DataFrame, path: str) -> None:
    """One folder for each split."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_tables(tables: dict[str, DataFrame], root: str, kind: str = "json") -> None:
    """Evaluation tables, one folder each."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        writer.json(f"{root}/{name}") if kind == "json" else writer.option("header", True).csv(f"{root}/{name}")


def intake(items: DataFrame) -> DataFrame:
    """``item_id, type, content``: missing types are detected, aliases resolved, others marked ``error``."""
    from ..functions.dialect import Spark
    from ..operators.payments import input_type_sql

    table = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    known = F.get(F.map_values(F.map_filter(table, lambda k, v: k == F.lower(F.trim("type")))), F.lit(0))
    return items.withColumn("kind", F.when(F.coalesce(F.trim("content"), F.lit("")) == "", "error").when(F.coalesce(F.trim("type"), F.lit("")) == "", F.expr(input_type_sql(Spark))).otherwise(F.coalesce(known, F.lit("error"))))


def concatenated(*sources: DataFrame) -> DataFrame:
    """Labelled sources as one table; a column that a source lacks is null in its rows."""
    out = sources[0]
    for rows in sources[1:]:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def training_records(rows: DataFrame) -> DataFrame:
    """``text, label, category`` as classifiers take them; nulls read as empty, a missing category as ``other`` (``safe`` for safe texts)."""
    label = F.lower(F.trim(F.coalesce("scam_or_safe", F.lit(""))))
    kind = F.trim(F.coalesce("scam_type", F.lit("")))
    return rows.select(F.coalesce("text", F.lit("")).alias("text"), label.alias("label"), F.when(kind != "", kind).when(label == "safe", "safe").otherwise("other").alias("category"))


def expanded(templates: DataFrame, **values: list[str]) -> DataFrame:
    """Each template with each combination of the values of the marks ``{name}`` that it has, in column ``text``.

    A template is multiplied only by the marks that stand in it, and without marks stays as it is.
    """
    for name, options in values.items():
        mark = "{" + name + "}"
        listed = F.array(*map(F.lit, options)) if options else F.array().cast("array<string>")
        filled = F.transform(listed, lambda v: F.replace(F.col("text"), F.lit(mark), v))
        templates = templates.withColumn("text", F.explode(F.when(F.contains("text", F.lit(mark)), filled).otherwise(F.array("text"))))
    return templates
