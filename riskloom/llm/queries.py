"""Registered queries of the corpus operators, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from .common import documents, labels
from .hard_negatives import OP11_SQL, op11
from .licenses import op1
from .lm_scoring import op7
from .manifest import OP12_SQL, op12
from .mixing import op4
from .pii import op10
from .piece_dropout import op6
from .quality import OP9_SQL, op9
from .quality_classifier import op13
from .simhash import op5
from .sketches import op8
from .token_counts import op2
from .toxicity import op3


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": _pipeline,
        "op1_license_scan": lambda spark, sf_dir: op1(documents(spark, sf_dir)),
        "op2_token_counts": lambda spark, sf_dir: op2(documents(spark, sf_dir)),
        "op3_toxicity": lambda spark, sf_dir: op3(documents(spark, sf_dir), labels(spark, sf_dir)),
        "op4_mixing": lambda spark, sf_dir: op4(documents(spark, sf_dir), labels(spark, sf_dir)),
        "op5_simhash_near_dedup": lambda spark, sf_dir: op5(documents(spark, sf_dir)),
        "op7_lm_scoring": lambda spark, sf_dir: op7(documents(spark, sf_dir)),
        "op8_document_fingerprints": lambda spark, sf_dir: op8(documents(spark, sf_dir)),
        "op6_piece_dropout": lambda spark, sf_dir: op6(documents(spark, sf_dir)),
        "op10_pii": lambda spark, sf_dir: op10(documents(spark, sf_dir)),
        "op9_quality_rules": lambda spark, sf_dir: op9(documents(spark, sf_dir)),
        "op11_hard_negatives": lambda spark, sf_dir: op11(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
        "op13_quality_classifier": lambda spark, sf_dir: op13(documents(spark, sf_dir), labels(spark, sf_dir)),
        "op12_merkle_manifest": lambda spark, sf_dir: op12(documents(spark, sf_dir)),
    }


def oracle_sql() -> dict:
    return {
        "op9_quality_rules": OP9_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op12_merkle_manifest": OP12_SQL,
    }
