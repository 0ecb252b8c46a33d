"""A corpus pipeline of five operators: each stage works on all that the one before it kept.

Toxic documents go, one document of each group of near-duplicates stays, personal data is replaced in the texts,
documents are drawn at rates that meet target weights of domains, and the rest is encoded to pieces.

Every stage reads whole texts, of any length, ignores columns other than ``COLUMNS`` whatever their names, and gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import mixing, pii, piece_dropout, simhash, toxicity
from riskloom.llm.common import documents, labels, stored

#: Every stage but the last returns these.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the classifier learns from all labelled ones.

    Null and empty texts score as the intercept does. Rows with a null id and repeated rows are scored like any other.
    """
    model = toxicity.train(docs, labels(spark, sf_dir), held_out=None)
    return toxicity.score(docs, model, keep=COLUMNS).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word Jaccard of 0.8 or more), the one with the smallest id.

    Components of SimHash near-duplicates and min-hash bands propose, the texts' shingle sets decide.
    Null, empty and blank texts are alike, so one of them stays. Repeated rows stay once; a null id counts as the highest.
    """
    return simhash.one_of_each(docs.select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind in the place of each span of personal data; ``n_chars`` follows the text.

    Rows with null or empty texts, null ids and repeated rows stay.
    """
    found = pii.find(docs, keep=COLUMNS)
    text = pii.redacted(F.col("text"), F.col("spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that meet the target weights of domains.

    The draw depends on id and text, so repeated rows share their fate; null texts count as empty, with no tokens.
    """
    return mixing.sampled(docs, labels(spark, sf_dir), COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces under seeded merge-dropout, without its text.

    Null and empty texts have no pieces; repeated rows have equal ones; a null id draws as the empty id does.
    """
    return piece_dropout.encode(docs, keep=["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact),
    ("mixing", mix),
    ("pieces", encode),
]

#: No stage but the redaction is expressible in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's result written before the next reads it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
