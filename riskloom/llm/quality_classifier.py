"""Quality: supervised subword embeddings, a text's mean vector and a softmax, trained by stochastic gradient descent in numpy.

A text's features are its words, its pairs of neighbouring words (a word after itself is one feature, whichever word it is) and its
character n-grams of 3 to 5 code points, in lower case, each hashed to a bucket that has a learned vector. The vector of a text is the mean over all
occurrences; two outputs on it pass a softmax. As the outputs are linear, a fitted model scores by one number a bucket.

Training runs on Spark in rounds. The labelled rows are dealt to shards by the hash of their id; in a round every shard descends
from the shared vectors, one row at a time and over its rows several times, and hands back what it moved; a bucket's moves are averaged over the
shards that moved it, in whole numbers, so the model does not depend on partitions or the order of sums. The driver holds the vectors
(a few megabytes, whatever the table) and never a text.

Bound, a parameter: ``max_fit_rows`` labelled rows are learned from, an eighth of them in each task, which holds their features (three megabytes for a
text that has them all). Every text is scored, whole.

Defined cases. A null text counts as empty, and an empty one gets the score of the outputs' offsets. Labels other than 0 and 1 and null ids
teach nothing; of several labels of an id the highest counts; of several texts of one id one is learned from (the one of the least
hash). Without labelled rows every score is 0.5. Texts above ``PIECE`` code points are read in pieces that end after white space where
there is any. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, small_batches, stored

WORD_BITS, GRAM_BITS = 17, 18
BUCKETS = (1 << WORD_BITS) + (1 << GRAM_BITS)
SIZES = (3, 4, 5)
DIM = 8
PIECE = 1 << 20
THRESHOLD = 0.3
#: A move of one is so many in the whole numbers that shards hand back.
UNIT = float(1 << 24)
#: Buckets whose moves stand in one row.
BLOCK = 4096
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base ** 0`` to ``base ** (n - 1)`` modulo ``2 ** 64``."""
    if len(_powers.get(base, ())) < n:
        p = np.full(max(n, 4096), _U(base))
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return (h >> _U(64 - bits)).astype(np.int64)


def _pieces(points: np.ndarray):
    at = 0
    while at < len(points):
        end = min(at + PIECE, len(points))
        if end < len(points):
            blank = np.flatnonzero(_blank(points[at:end]))
            end = at + int(blank[-1]) + 1 if len(blank) else end
        yield points[at:end]
        at = end


def _blank(points: np.ndarray) -> np.ndarray:
    return (points == 32) | ((points >= 9) & (points <= 13))


def features(text: str):
    """Buckets of all feature occurrences of ``text``, an array for each piece of it."""
    for points in _pieces(np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)):
        n = len(points)
        up, down = _power(_BASE, n), _power(pow(_BASE, -1, 1 << 64), n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((points.astype(np.uint64) + _U(1)) * up, out=sums[1:])
        edges = np.diff((~_blank(points)).astype(np.int8), prepend=0, append=0)
        first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        words = (sums[end] - sums[first]) * down[first]
        out = [_bucket(words, WORD_BITS)]
        if len(words) > 1:
            pairs = np.where(words[1:] == words[:-1], _U(1), (words[:-1] * _U(0x94D049BB133111EB)) ^ words[1:])
            out.append(_bucket(pairs, WORD_BITS))
        out += [_bucket((sums[k:] - sums[:n - k + 1]) * down[:n - k + 1] + _U(k), GRAM_BITS) + (1 << WORD_BITS) for k in SIZES if n >= k]
        yield np.concatenate(out)


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of ``text`` and the share of its feature occurrences that each has."""
    found, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for f in features(text):
        own, n = np.unique(f, return_counts=True)
        found, at = np.unique(np.concatenate([found, own]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n])).astype(np.int64)
    return found.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Vectors of the buckets, two output vectors and their offsets."""

    vectors: np.ndarray
    outputs: np.ndarray
    offsets: np.ndarray

    def weights(self) -> tuple[np.ndarray, float]:
        """What each occurrence adds to the log odds, before the mean, and the log odds of an empty text."""
        return self.vectors @ (self.outputs[1] - self.outputs[0]), float(self.offsets[1] - self.offsets[0])


def start(seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    return Model(((rng.random((BUCKETS, DIM)) - 0.5) * 2 / DIM).astype(np.float32), np.zeros((2, DIM), np.float32), np.zeros(2, np.float32))


def descend(model: Model, rows, rates) -> tuple[Model, np.ndarray]:
    """The model after one step a row (``buckets, shares, label``), each at its rate, and which buckets moved."""
    vectors, outputs, offsets, moved = model.vectors.copy(), model.outputs.copy(), model.offsets.copy(), np.zeros(BUCKETS, dtype=bool)
    for (own, share, label), rate in zip(rows, rates):
        held = vectors[own]
        mean = share @ held
        p = outputs @ mean + offsets
        p = np.exp(p - p.max())
        slope = p / p.sum()
        slope[label] -= 1
        back = slope @ outputs
        outputs -= rate * np.outer(slope, mean).astype(np.float32)
        offsets -= np.float32(rate) * slope
        vectors[own] = held - (np.float32(rate) * share)[:, None] * back
        moved[own] = True
    return Model(vectors, outputs, offsets), moved


_MOVES = "block int, n binary, moves binary"


def _packed(model: Model) -> np.ndarray:
    """Vectors, outputs and offsets as one table of rows of ``DIM``, filled up to whole blocks."""
    rows = np.concatenate([model.vectors, model.outputs, np.pad(model.offsets, (0, DIM - 2))[None]]).astype(np.float64)
    return np.pad(rows, ((0, -len(rows) % BLOCK), (0, 0)))


def _unpacked(rows: np.ndarray) -> Model:
    rows = rows.astype(np.float32)
    return Model(rows[:BUCKETS], rows[BUCKETS:BUCKETS + 2], rows[BUCKETS + 2, :2])


def _round(rows: DataFrame, model: Model, number: int, rounds: int, passes: int, rate: float) -> Model:
    """The shared model after every shard's passes over its rows."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def shard(found: list):
        steps = passes * len(found)
        rates = (rate * (1 - (number + i / max(1, steps)) / (rounds + 0.5)) for i in range(steps))
        after, moved = descend(shared.value, (r for _ in range(passes) for r in found), rates)
        moves = np.clip(np.rint((_packed(after) - _packed(shared.value)) * UNIT), -(2**31) + 1, 2**31 - 1).astype(np.int32)
        moved = np.pad(np.concatenate([moved, np.ones(3, dtype=bool)]), (0, len(moves) - BUCKETS - 3))
        for k in range(0, len(moves), BLOCK):
            own = moves[k:k + BLOCK].view(np.uint8).reshape(-1, 4).T  # the bytes of one place together, so that they shrink
            yield k // BLOCK, moved[k:k + BLOCK].tobytes(), zlib.compress(own.tobytes(), 1)

    def run(batches):
        at, held = None, []

        def done():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*shard(held)), (pa.int32(), pa.binary(), pa.binary()))], ["block", "n", "moves"])

        for b in batches:
            for s, y, text in zip(*(c.to_pylist() for c in b.columns)):
                if s != at and held:
                    yield done()
                    held = []
                at = s
                held.append((*shares(text), y))
        if held:
            yield done()

    def mean(table: pa.Table) -> pa.Table:
        moves, n = np.zeros((BLOCK, DIM), dtype=np.int64), np.zeros(BLOCK, dtype=np.int64)
        for own, packed in zip(table.column("n").to_pylist(), table.column("moves").to_pylist()):
            moves += np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view(np.int32).reshape(BLOCK, DIM)
            n += np.frombuffer(own, dtype=bool)
        step = moves / UNIT / np.maximum(n, 1)[:, None]
        return pa.table({"block": pa.array(table.column("block").to_pylist()[:1], pa.int32()), "step": pa.array([step.astype(np.float32).tobytes()], pa.binary())})

    dealt = rows.repartition("shard").sortWithinPartitions("shard", F.xxhash64("id", F.lit(number)), "id").select("shard", "y", "text")
    steps = dealt.mapInArrow(run, _MOVES).groupBy("block").applyInArrow(mean, "block int, step binary").toArrow()  # the size of the model
    whole = _packed(model)
    for k, step in zip(steps.column("block").to_pylist(), steps.column("step").to_pylist()):
        whole[k * BLOCK:(k + 1) * BLOCK] += np.frombuffer(step, dtype=np.float32).reshape(BLOCK, DIM)
    return _unpacked(whole)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: tuple[int, int] | None = (5, 0),
          max_fit_rows: int = 20_000, shards: int = 8, rounds: int = 2, least_steps: int = 12_000, rate: float = 0.5) -> Model:
    """Learns from the rows of ``docs`` that ``labels`` marks 0 or 1; ``held_out`` (modulus, remainder) keeps ids out by their crc32.

    Where more ids are labelled than ``max_fit_rows``, an even share of them by hash is taken. Few rows are gone over more often, until
    each shard has made ``least_steps`` steps, and on fewer shards.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    if held_out:
        known = known.where(crc_mod("id", held_out[0]) != held_out[1])
    known = stored(known.groupBy("id").agg(F.max("y").alias("y")), "quality-labels")
    total = known.count()
    if not total:
        return start()
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, max_fit_rows / total)))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")  # max_fit_rows ids
    one = texts.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    shards = max(1, min(shards, total // 500))

    rows = stored(one.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards))), "quality-texts")
    n = rows.count()
    passes = max(1, -(-least_steps * shards // (max(1, n) * rounds)))
    model = start()
    for r in range(rounds if n else 0):
        model = _round(rows, model, r, rounds, passes, rate)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``score``, the probability of label 1, of every row."""
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(text_col).cast("string").alias("_text"), *(keep or []))
    out = T.StructType([*chosen.schema.fields[1:], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model.weights())

    def run(batches):
        table, bias = shared.value
        for b in batches:
            odds = np.full(b.num_rows, bias)
            for k, t in enumerate(b.column(0).to_pylist()):
                total = n = 0
                for f in features(t or ""):
                    total, n = total + float(table[f].sum(dtype=np.float64)), n + len(f)
                odds[k] += total / max(1, n)
            p = np.exp(-np.logaddexp(0, -odds))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(p)], out.names)

    return chosen.mapInArrow(run, out)


def op13(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns: doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
