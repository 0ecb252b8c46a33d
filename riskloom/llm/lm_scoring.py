"""Language-model scoring with a log-bilinear neural model trained by noise-contrastive estimation.

Tokens are words (A-Z lower-cased) and one end for each text. The model's classes are the most frequent words and
the end; all other words fall to ``BUCKETS`` classes by their last two bytes, within which a word has its add-one
unigram share. So the probabilities of all words, unseen ones included, sum to one.

The class after two others has logit ``(P1[w1] + P2[w2]) . Q[w] + b[w]``. Exponentials of a sum factor, so the
normalisers of all pairs of contexts are one matrix product: ``(E1 * exp(b)) @ E2.T`` with ``Ek = exp(Pk @ Q.T)``.

Counts cover every training text. A pilot model is trained on a bounded share of the texts; then each shard of
``SHARD_BYTES`` or so goes on from it over all of its own training texts, and the models are averaged by tokens. Shards are
dealt and ordered by hashes, and averages summed as whole numbers, so a table gives the same model however it is partitioned. Only the
tables of the model (bounded by ``CLASSES``), the end and the ``HEAD`` most frequent words reach the driver; counts of all
rarer words meet the texts that have them in a join.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, small_batches, stored, text_bytes

END = b""  # no word is empty
CLASSES, BUCKETS, DIM = 2048, 256, 32
WORDS = CLASSES - BUCKETS
HEAD = 131_072
NOISE, STEP = 48, 2048
RATE, EPOCHS = 0.1, 3
SHARD_BYTES = 16_000_000
_FIXED = 65536.0  # summed values are whole multiples of one over this


@dataclass
class Params:
    """Context vectors for the two places, target vectors, biases; and Adagrad's sums of squares."""

    p1: np.ndarray
    p2: np.ndarray
    q: np.ndarray
    b: np.ndarray
    squares: list[np.ndarray] = field(default_factory=list)


@dataclass
class Model:
    """What scoring needs. ``shares``: log10 of each bucket's add-one denominator, by class."""

    params: Params | None
    head: list[bytes]
    counts: np.ndarray
    log_total: float
    train_tokens: int
    shares: np.ndarray
    key: str = ""


def bucket_class(word: bytes) -> int:
    return WORDS + zlib.crc32(word[-2:]) % BUCKETS


_BUCKET_SQL = f"cast({WORDS} + crc32(substring(cast(word as binary), greatest(length(cast(word as binary)) - 1, 1), 2)) % {BUCKETS} as int)"


# ---- counts -----------------------------------------------------------------------------------

def word_counts(texts: DataFrame, most: int = 200_000) -> DataFrame:
    """``word, c`` over the one text column of ``texts``; the end is the empty word."""

    def run(batches):
        def out(counts):
            words, n = zip(*counts.items())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["word", "c"])

        counts: Counter = Counter()
        for b in batches:
            for t in text_bytes(b.column(0)):
                counts.update(t.lower().split())
                counts[END] += 1
                if len(counts) > most:  # bounded memory: what it has goes on to the shuffle
                    yield out(counts)
                    counts.clear()
        if counts:
            yield out(counts)

    return texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


# ---- training ---------------------------------------------------------------------------------

def start(log_share: np.ndarray, seed: int = 1) -> Params:
    rng = np.random.default_rng(seed)
    small = lambda: rng.normal(0, 0.05, (CLASSES, DIM)).astype(np.float32)
    p = Params(small(), small(), small(), log_share.astype(np.float32))
    p.squares = [np.full(x.shape, 0.02, dtype=np.float32) for x in (p.p1, p.p2, p.q, p.b)]
    return p


def _summed(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of ``rows`` by class."""
    columns = np.ascontiguousarray(rows.T)
    return np.stack([np.bincount(at, c, CLASSES) for c in columns], axis=1).astype(np.float32)


def nce_step(p: Params, w1: np.ndarray, w2: np.ndarray, w: np.ndarray, noise: np.ndarray, log_share: np.ndarray, rate: float = 0.08) -> None:
    """One step of noise-contrastive estimation on tokens ``w`` after ``w2, w1``, with noise shared by the batch."""
    less = np.float32(np.log(len(noise))) + log_share
    ctx, q_true, q_noise = p.p1[w1] + p.p2[w2], p.q[w], p.q[noise]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    true = sigmoid((ctx * q_true).sum(axis=1) + (p.b - less)[w]) - 1
    false = sigmoid(ctx @ q_noise.T + (p.b - less)[noise])
    g_ctx = true[:, None] * q_true + false @ q_noise
    g_q, g_b = _summed(w, true[:, None] * ctx), np.bincount(w, true, CLASSES).astype(np.float32)
    np.add.at(g_q, noise, false.T @ ctx)
    np.add.at(g_b, noise, false.sum(axis=0))
    for table, squares, g in zip((p.p1, p.p2, p.q, p.b), p.squares, (_summed(w1, g_ctx), _summed(w2, g_ctx), g_q, g_b)):
        squares += g * g
        table -= rate * g / np.sqrt(squares)


def class_ids(text: bytes, at: dict[bytes, int]) -> np.ndarray:
    """Classes of the text's tokens, after two ends that stand before it; ``at`` has those of frequent words."""
    get, words = at.get, text.lower().split()
    ids = [get(w, -1) for w in words]
    if -1 in ids:
        ids = [bucket_class(w) if i < 0 else i for i, w in zip(ids, words)]
    end = at[END]
    return np.array([end, end, *ids, end], dtype=np.int32)


def _sharded(texts: DataFrame, shards: int) -> DataFrame:
    """``text, shard`` of ``text, h``: dealt and ordered by the hash, so that neither depends on the partitions of the table."""
    dealt = texts.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    return dealt.repartition("shard").sortWithinPartitions("shard", "h", "text").select("text", "shard")


def _trained(sharded: DataFrame, shared, log_share: np.ndarray, init: Params, rate: float, epochs: int = 1) -> DataFrame:
    """Each shard's model after all its texts, as rows ``r, n, v`` weighted by its tokens."""
    size = 2 * (CLASSES * 3 + CLASSES // DIM)
    names = ["r", "n", *(f"v{k}" for k in range(DIM))]

    def run(batches):
        at = {w: i if i < WORDS else bucket_class(w) for i, w in enumerate(shared.value)}
        cumulative = np.cumsum(np.exp(log_share.astype(np.float64)))
        rows = ((k, t) for b in batches for k, t in zip(b.column(1).to_pylist(), text_bytes(b.column(0))))
        for _, own in itertools.groupby(rows, key=lambda row: row[0]):
            p = Params(init.p1.copy(), init.p2.copy(), init.q.copy(), init.b.copy(), [s.copy() for s in init.squares])
            rng = np.random.default_rng(7)
            waiting, have, tokens = [], 0, 0

            def learn(ids_of_texts):
                w1 = np.concatenate([i[1:-1] for i in ids_of_texts])
                w2 = np.concatenate([i[:-2] for i in ids_of_texts])
                w = np.concatenate([i[2:] for i in ids_of_texts])
                order = rng.permutation(len(w))
                for s in range(0, len(w), STEP):
                    o = order[s:s + STEP]
                    noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), CLASSES - 1)
                    nce_step(p, w1[o], w2[o], w[o], noise, log_share, rate)
                return len(w)

            if epochs > 1:
                own = list(own)  # only of bounded texts
            for _, t in itertools.chain.from_iterable(itertools.repeat(own, epochs)):
                waiting.append(class_ids(t, at))
                have += len(waiting[-1])
                if have > 262144:
                    tokens += learn(waiting)
                    waiting, have = [], 0
            if waiting:
                tokens += learn(waiting)
            if tokens:
                flat = np.concatenate([x.reshape(-1, DIM) for x in (p.p1, p.p2, p.q, p.b, *p.squares)]).astype(np.float64)
                fixed = np.rint(flat * (tokens * _FIXED)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, tokens, dtype=np.int64)), *(pa.array(np.ascontiguousarray(fixed[:, k])) for k in range(DIM))], names)

    return sharded.mapInArrow(run, "r int, n long, " + ", ".join(f"v{k} long" for k in range(DIM)))


def _averaged(rows: DataFrame, init: Params) -> Params:
    mean = lambda k: (F.sum(F.col(f"v{k}").cast("decimal(19,0)")).cast("double") / F.sum("n")).alias(f"v{k}")
    got = rows.groupBy("r").agg(*(mean(k) for k in range(DIM))).orderBy("r").collect()
    if not got:
        return init
    flat = np.array([[r[f"v{k}"] / _FIXED for k in range(DIM)] for r in got], dtype=np.float32)
    c, end = CLASSES, CLASSES * 3 + CLASSES // DIM
    tables = lambda x: [x[:c], x[c:2 * c], x[2 * c:3 * c], x[3 * c:].reshape(-1)]
    return Params(*tables(flat[:end]), tables(flat[end:]))


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", pilot_bytes: int = 6_000_000, head: int = HEAD,
          shard_bytes: int = SHARD_BYTES) -> tuple[Model, DataFrame]:
    """The model learnt from all texts of ``docs``, and the stored counts of all words (``word, c``).

    ``pilot_bytes`` bounds the texts that the pilot is trained on (an even share by hash of id and text). The end is a class of
    its own however rare it is. Null texts are empty ones; ids only spread equal texts over the shards.
    """
    small_batches(docs.sparkSession)
    own_text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = docs.select(own_text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), own_text).alias("h"))
    texts = hashed.select("text")
    vocabulary = stored(word_counts(texts), "word-counts")
    known = vocabulary.orderBy(F.desc("c"), "word").limit(head).collect()
    known.sort(key=lambda r: (-r["c"], r["word"]))
    words, counts = [r["word"].encode() for r in known], np.array([r["c"] for r in known], dtype=np.int64)
    ends = vocabulary.where("word = ''").first()
    if ends is not None:  # the end is always a class of its own, even where more words than the head holds are more frequent
        others = [i for i, w in enumerate(words) if w != END]
        words, counts = [END, *(words[i] for i in others)], np.concatenate([[ends["c"]], counts[others]])
    own = words[:WORDS]
    classed = vocabulary.withColumn("k", F.expr(_BUCKET_SQL)).where(~F.col("word").isin([w.decode() for w in own[:1]]))
    listed = docs.sparkSession.createDataFrame([(w.decode(),) for w in own[1:]], "word string")
    rest = classed.join(F.broadcast(listed), "word", "left_anti")  # fewer than CLASSES words
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rest.groupBy("k").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    totals = vocabulary.agg(F.sum("c"), F.count(F.lit(1))).first()
    total, distinct = totals[0] or 0, totals[1]
    model = Model(None, words, counts, float(np.log10(total + distinct + 1)), total, np.log10(n + v + 1), uuid4().hex)
    if not total:
        return model, vocabulary
    freq = n.copy()
    freq[:len(own)] = counts[:len(own)]
    log_share = np.log((freq + 0.5) / (freq + 0.5).sum()).astype(np.float32)
    total_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    share = max(int(1_000_000 * min(1.0, pilot_bytes / total_bytes)), 1)
    pilot_texts = _sharded(hashed.where(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < share), 1)  # bounded by pilot_bytes
    shared = docs.sparkSession.sparkContext.broadcast(words)
    pilot = start(log_share)
    pilot = _averaged(_trained(pilot_texts, shared, log_share, pilot, RATE, EPOCHS), pilot)
    shards = -(-total_bytes // shard_bytes)
    model.params = _averaged(_trained(_sharded(hashed, shards), shared, log_share, pilot, RATE), pilot)
    return model, vocabulary


# ---- scoring ----------------------------------------------------------------------------------

_TABLES: dict[str, tuple] = {}  # in a worker: the tables of the last model


def tables(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Logit tables of the two contexts, biases, and the log normalisers of all pairs of contexts."""
    if model.key not in _TABLES:
        _TABLES.clear()
        p = model.params
        a1, a2 = p.p1 @ p.q.T, p.p2 @ p.q.T
        e1, e2 = np.exp(np.clip(a1, -60, 60).astype(np.float64)), np.exp(np.clip(a2, -60, 60).astype(np.float64))
        z = np.log((e1 * np.exp(p.b.astype(np.float64))) @ e2.T)
        _TABLES[model.key] = (np.clip(a1, -60, 60), np.clip(a2, -60, 60), p.b, z.astype(np.float32))
    return _TABLES[model.key]


def log10_classes(ids: np.ndarray, model: Model) -> float:
    """Log10 probability of a text's classes (as ``class_ids`` gives them), normalised."""
    a1, a2, b, z = tables(model)
    w2, w1, w = ids[:-2], ids[1:-1], ids[2:]
    logs = a1[w1, w].astype(np.float64) + a2[w2, w] + b[w] - z[w1, w2]
    return float(logs.sum() / np.log(10))


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``n_tokens, n_known, base_score, score`` for each row of ``docs``.

    Null and empty texts are one end. Repeated rows each have their own result. With nothing to learn from, the
    scores are those of the base.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = keep or []
    chosen = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)
    shared = spark.sparkContext.broadcast(model)
    names = [*keep, "_key", "_n", "_known", "_logs", "_neural", "_denominators", "_word", "_times"]
    fields = [*chosen.schema.fields[1:], T.StructField("_key", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_known", T.LongType()), T.StructField("_logs", T.DoubleType()), T.StructField("_neural", T.DoubleType()), T.StructField("_denominators", T.DoubleType()), T.StructField("_word", T.StringType()), T.StructField("_times", T.LongType())]

    def run(batches):
        m = shared.value
        number = {w: i for i, w in enumerate(m.head)}
        log_count = np.log10(m.counts + 1.0)
        own, end = min(WORDS, len(m.head)), number.get(END, -1)
        class_of = np.array([i if i < own else bucket_class(w) for i, w in enumerate(m.head)], dtype=np.int32)
        task = TaskContext.get()
        keys = itertools.count((task.partitionId() if task else 0) << 33)
        get = number.get
        for b in batches:
            rows, tails = [], []
            for t in text_bytes(b.column(0)):
                words = t.lower().split()
                ids = np.array([*(get(w, -1) for w in words), end], dtype=np.int64)
                rare = ids < 0
                known = ids[~rare]
                logs, key = float(log_count[known].sum()), next(keys)
                tail = Counter(words[i] for i in np.flatnonzero(rare[:-1]))
                neural = denominators = 0.0
                if m.params is not None:
                    classes = class_of[ids]
                    for i in np.flatnonzero(rare):
                        classes[i] = bucket_class(words[i])
                    neural = log10_classes(np.concatenate([[end, end], classes]), m)
                    outside = classes >= WORDS
                    denominators = float(m.shares[classes[outside]].sum())
                    neural += float(log_count[ids[outside & ~rare]].sum())
                rows.append((key, len(ids), len(known), logs, neural, denominators))
                tails.extend((key, w, n) for w, n in tail.items())
            main = [pa.array(x) for x in zip(*rows)]
            nulls = lambda n, kind: pa.nulls(n, kind)
            types = [f.type for f in b.schema][1:]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *main, nulls(len(rows), pa.string()), nulls(len(rows), pa.int64())], names)
            if tails:
                k, w, n = zip(*tails)
                none = [nulls(len(k), kind) for kind in types]
                yield pa.RecordBatch.from_arrays(
                    [*none, pa.array(k), *(nulls(len(k), pa.int64()) for _ in range(2)), *(nulls(len(k), pa.float64()) for _ in range(3)),
                     pa.array(w, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names)

    both = stored(chosen.mapInArrow(run, T.StructType(fields)), "lm-parts")
    rare = both.where("_word is not null").select("_key", F.col("_word").alias("word"), "_times")
    tail = (
        rare.join(vocabulary, "word").groupBy("_key")
        .agg(F.sum(F.col("_times") * F.log10(F.col("c") + 1.0)).alias("_tail_logs"), F.sum("_times").alias("_tail_known"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = both.where("_word is null").join(tail, "_key", "left")
    base = F.col("_logs") + zero("_tail_logs") - F.col("_n") * F.lit(model.log_total)
    neural = F.col("_neural") + zero("_tail_logs") - F.col("_denominators") if model.params is not None else base
    return joined.select(
        *keep, F.col("_n").alias("n_tokens"), (F.col("_known") + zero("_tail_known")).cast("long").alias("n_known"),
        base.alias("base_score"), neural.alias("score"),
    )


def op7(docs: DataFrame) -> DataFrame:
    """Contract columns; learns from the rows whose crc32 of the id leaves a remainder other than 2."""
    held_out = crc_mod("doc_id", 7) == 2
    model, vocabulary = train(docs.where(~held_out))
    got = score(docs, model, vocabulary, keep=["doc_id"])
    return got.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
