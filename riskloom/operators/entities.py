"""Entities that an artefact may impersonate: named in its evidence, and only where an indicator says that somebody is impersonated.

Entities are a table of any size. One that has to stand alone meets the words of the evidence; any other meets its runs of three
characters by the first three of its key, and the whole key is then looked for in place. Both are equi-joins; only
suspicious artefacts with an indicator of impersonation are spread out. An entity is named, never accused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.phrases import ENTITIES, IMPERSONATION

GRAM = 3


def entities(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``entity, brand, category, alone``: the fixed ones, or those of a CSV file."""
    schema = "entity string, brand string, category string, alone boolean"
    return spark.read.csv(path, header=True, schema=schema) if path else spark.createDataFrame(ENTITIES, schema)


def _edged(text):
    """The text with its words set off by bars, so that one search checks both edges."""
    return F.concat(F.lit("|"), F.regexp_replace(text, "([^a-z0-9])", "|$1|"), F.lit("|"))


def named(artefacts: DataFrame, table: DataFrame, key: str = "artifact_id") -> DataFrame:
    """``key, entity, brand, category, assessment`` for artefacts (``key, is_suspicious, tokens, texts``).

    Null tokens and texts count as none. Keys shorter than three characters have to stand alone. Repeated entities and artefacts give one
    row each; null and empty keys of entities name nothing.
    """
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    text = F.lower(F.array_join(F.concat(F.coalesce("tokens", none), F.coalesce("texts", none)), " "))
    claimed = F.lit(False)
    for name in IMPERSONATION:
        claimed = claimed | F.contains(F.col("_text"), F.lit(name))
    rows = artefacts.where("is_suspicious").select(key, text.alias("_text")).where(claimed).distinct()
    keys = table.where("entity <> ''").select(F.lower("entity").alias("_key"), "entity", "brand", "category", (F.col("alone") | (F.length("entity") < GRAM)).alias("_alone")).distinct()
    words = rows.withColumn("_anchor", F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit("[a-z0-9]+"), F.lit(0)))))
    alone = keys.where("_alone").withColumn("_anchor", F.regexp_extract("_key", "[a-z0-9]+", 0))
    by_word = words.join(alone, "_anchor").where((F.col("_key") == F.col("_anchor")) | F.contains(_edged(F.col("_text")), _edged(F.col("_key"))))
    letters = rows.withColumn("_c", F.split("_text", ""))  # cut once: positions of a text are not cheap to find
    grams = F.transform(F.sequence(F.lit(1), F.size("_c") - (GRAM - 1)), lambda i: F.array_join(F.slice("_c", i, GRAM), ""))
    runs = letters.where(F.size("_c") >= GRAM).select(key, "_text", F.explode(F.array_distinct(grams)).alias("_anchor"))
    inside = keys.where("not _alone").withColumn("_anchor", F.substring("_key", 1, GRAM))
    by_run = runs.join(inside, "_anchor").where(F.contains("_text", F.col("_key")))
    columns = [key, "entity", "brand", "category"]
    said = F.concat(F.lit("Possible impersonation of "), F.col("brand"), F.lit(": the organisation itself is only named by the suspicious content"))
    return by_word.select(*columns).unionByName(by_run.select(*columns)).withColumn("assessment", said)


def oracle(artefacts: str, key: str = "artifact_id") -> str:
    """The same by a plain loop, for ``key, is_suspicious, text``."""
    rows = ", ".join(f"('{e}', '{b}', '{c}', {str(a).lower()})" for e, b, c, a in ENTITIES)
    claimed = " OR ".join(f"contains(text, '{x}')" for x in IMPERSONATION)
    return f"""SELECT {key}, entity, brand, category, 'Possible impersonation of ' || brand || ': the organisation itself is only named by the suspicious content' AS assessment
      FROM ({artefacts}) a, (VALUES {rows}) AS e(entity, brand, category, alone)
      WHERE is_suspicious AND ({claimed}) AND CASE WHEN alone THEN regexp_matches(text, '(^|[^a-z0-9])' || entity || '($|[^a-z0-9])') ELSE contains(text, entity) END"""
