"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams (4 to 6 code points, lower case) that a text has, hashed to ``2 ** HASH_BITS`` buckets.
Over the labelled rows Spark counts, for each bucket, the toxic and the other texts that have it. Its log-count
ratio scales the feature; buckets whose share of toxic texts is no more than chance would give are left out, as
they only add noise to long texts, and all others stay. A logistic regression on the scaled features, fitted by Spark on sparse
vectors, then weighs them; the driver holds one weight a bucket.

Bounds, both parameters: labelled rows that are counted (``max_count_rows``) and rows that the regression is fitted on
(``max_fit_rows``), of distinct ids. Every text is scored, whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, small_batches, stored

HASH_BITS = 20
SIZES = (4, 5, 6)
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    """Bucket numbers and their weights (regression weight times log-count ratio), and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def ngram_buckets(text: str) -> np.ndarray:
    """Bucket of every n-gram occurrence of ``text``; a text below four code points counts as one n-gram."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        return np.zeros(0, dtype=np.uint32)
    mix = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - HASH_BITS)
    rolling, out = points + np.uint32(1), []
    for n in range(2, max(SIZES) + 1):
        if len(rolling) < 2:
            break
        rolling = rolling[:-1] * np.uint32(0x9E3779B1) + points[n - 1:]
        if n in SIZES:
            out.append(mix(rolling ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)))
    return np.concatenate(out) if out else mix(rolling[:1])


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _count(training: DataFrame) -> DataFrame:
    """``bucket, pos, neg``: toxic and other texts that have it."""

    def run(batches):
        size = 1 << HASH_BITS
        last, counts = np.zeros(size, dtype=np.int32), np.zeros((2, size), dtype=np.int32)
        for b in batches:
            for text, toxic in zip(_texts(b.column(0)), b.column(1).to_pylist()):
                h = ngram_buckets(text)
                at = np.arange(len(h), dtype=np.int32)
                last[h] = at
                counts[toxic][h[last[h] == at]] += 1  # each bucket once
        found = np.flatnonzero(counts.any(axis=0))
        for some in np.array_split(found, len(found) // 65536 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(counts[k][some].astype(np.int64)) for k in (1, 0))], ["bucket", "pos", "neg"])

    return training.mapInArrow(run, "bucket int, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _vectors(training: DataFrame, buckets: np.ndarray, ratios: np.ndarray) -> DataFrame:
    """``features`` (a sparse vector of the log-count ratios of the buckets that a text has) and ``y``."""
    shared = training.sparkSession.sparkContext.broadcast((buckets, ratios))
    out = T.StructType([T.StructField("features", VectorUDT()), T.StructField("y", T.DoubleType())])

    def run(batches):
        own, scale = shared.value
        at = np.full(1 << HASH_BITS, -1, dtype=np.int32)
        at[own] = np.arange(len(own), dtype=np.int32)
        for b in batches:
            found = []
            for t in _texts(b.column(0)):
                h = at[ngram_buckets(t)]
                found.append(np.unique(h[h >= 0]))
            flat = np.concatenate([np.zeros(0, np.int32), *found])
            edges = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            vectors = pa.StructArray.from_arrays(
                [pa.array(np.zeros(len(found), np.int8)), pa.array(np.full(len(found), len(own), np.int32)), pa.ListArray.from_arrays(edges, pa.array(flat)),
                 pa.ListArray.from_arrays(edges, pa.array(scale[flat]))], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([vectors, b.column(1).cast(pa.float64())], out.names)

    return training.select("text", "toxic").mapInArrow(run, out)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          held_out: tuple[int, int] | None = (3, 1), max_count_rows: int = 200_000, max_fit_rows: int = 20_000,
          least_z: float = 4.0, least_texts: int = 5, rounds: int = 60, decay: float = 1e-4, fit_tasks: int = 12) -> Model:
    """Learns from the rows of ``docs`` that ``labels`` marks 0 or 1.

    ``held_out`` (modulus, remainder) keeps rows out by the crc32 of the id's text. Other labels and null ids are
    skipped; of several labels for one id the highest counts. Where more rows are labelled than a bound allows, an even
    share by hash of the id is taken, and of rows with one id the fit and the counts take all. With one class only, or no
    labelled row, the model has no features and its intercept says so (score 0 without toxic rows, else near 1); without any
    telling feature the intercept is the classes' log odds.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    if held_out:
        known = known.where(crc_mod("id", held_out[0]) != held_out[1])
    known = stored(known.groupBy("id").agg(F.max("toxic").alias("toxic")), "labels")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(sizes.values())
    if not sizes.get(1) or not sizes.get(0):
        return Model(np.zeros(0, np.int32), np.zeros(0), 6.0 if sizes.get(1) else -np.inf)
    share = lambda most: F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / total))
    counted = F.broadcast(known.where(share(max_count_rows)))  # bounded by max_count_rows
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    training = stored(text.join(counted, "id").select("text", "toxic", "id"), "labelled-texts")  # the table is scanned once, by as many tasks as it has
    counts = stored(_count(training.select("text", "toxic")), "ngram-counts")
    n = training.groupBy("toxic").count().collect()
    n_of = {r["toxic"]: r["count"] for r in n}
    pos, neg = n_of.get(1, 0), n_of.get(0, 0)
    if not pos or not neg:
        return Model(np.zeros(0, np.int32), np.zeros(0), 6.0 if pos else -np.inf)
    rate = pos / (pos + neg)
    both = F.col("pos") + F.col("neg")
    z = (F.col("pos") - both * rate) / F.sqrt(both * rate * (1 - rate) * (1.0 - both / (pos + neg) * 0.999))
    ratio = F.log((F.col("pos") + 1.0) / (pos + 2.0)) - F.log((F.col("neg") + 1.0) / (neg + 2.0))
    chosen = counts.where(both >= least_texts).where(F.abs(z) >= least_z).select("bucket", ratio.alias("ratio")).toArrow()  # 2 ** HASH_BITS rows at most
    order = np.argsort(chosen.column("bucket").to_numpy())
    buckets, ratios = chosen.column("bucket").to_numpy()[order].astype(np.int32), chosen.column("ratio").to_numpy()[order].astype(float)
    if not len(buckets):
        return Model(buckets, np.zeros(0), float(np.log(pos / neg)))
    rows = stored(_vectors(training.where(share(max_fit_rows)).coalesce(fit_tasks), buckets, ratios), "toxicity-vectors")
    if len(rows.select("y").distinct().limit(2).collect()) < 2:  # so few rows that a class is missing among those of the fit
        rows = stored(_vectors(training.coalesce(fit_tasks), buckets, ratios), "toxicity-vectors")
    fitted = LogisticRegression(labelCol="y", maxIter=rounds, regParam=decay, standardization=False).fit(rows)
    return Model(buckets, fitted.coefficients.toArray() * ratios, float(fitted.intercept))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1) of every row; null texts count as empty, which get the intercept's score."""
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(text_col).cast("string").alias("_text"), *(keep or []))
    out = T.StructType([*chosen.schema.fields[1:], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        table = np.zeros(1 << HASH_BITS, dtype=np.float32)
        table[own.buckets] = own.weights
        for b in batches:
            s = np.full(b.num_rows, own.bias)
            for k, t in enumerate(_texts(b.column(0))):
                h = ngram_buckets(t)
                h = h[table[h] != 0]
                if len(h):
                    s[k] += table[np.unique(h)].sum(dtype=np.float64)
            p = np.exp(-np.logaddexp(0, -np.clip(s, -700, 700)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(p)], [*b.schema.names[1:], "score"])

    return chosen.mapInArrow(run, out)


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns: doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
