"""Mixing documents to target weights of domains with soft membership.

A classifier learnt from a labelled table gives each document posteriors over the domains: naive Bayes over hashed
byte 4-grams, its per-byte scores calibrated by a softmax regression on labelled rows that naive Bayes has not seen. Then
rates from zero to one are fitted, one for each document, so that the expected domain totals of tokens
``sum(rate * tokens * posterior)`` meet targets, by projected-gradient least squares: each round Spark sums the
totals at the current rates, and every rate takes a step down the gradient of the squared residuals (a document's part of the
gradient is divided by its tokens) and is cut off at zero and one, with Nesterov's momentum between the rounds. So the
rates depend on the posteriors and a few numbers a round only; they are computed where the documents are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored, text_bytes

BUCKET_BITS = 14


@dataclass(frozen=True)
class Domains:
    """Names of the domains, log share of each bucket in each, and the softmax regression over their scores."""

    names: list[str]
    logs: np.ndarray  # buckets x domains
    weights: np.ndarray  # domains + 1 x domains


def gram_counts(text: bytes) -> np.ndarray:
    """Counts of hashed byte 4-grams (bytes A-Z lower-cased)."""
    b = np.frombuffer(text.lower(), dtype=np.uint8).astype(np.uint32)
    if len(b) < 4:
        b = np.concatenate([b, np.zeros(4 - len(b), dtype=np.uint32)])
    h = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    h = ((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS)
    return np.bincount(h, minlength=1 << BUCKET_BITS)


def _scores(text: bytes, logs: np.ndarray) -> np.ndarray:
    """Mean log share a gram, above the mean of the domains, and one for the intercept."""
    n = gram_counts(text)
    s = n @ logs / max(1, n.sum())
    return np.append((s - s.mean()) * 10, 1.0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _calibrate(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 300, decay: float = 1e-3) -> np.ndarray:
    w = np.zeros((x.shape[1], k))
    squares = np.full_like(w, 1e-6)
    for _ in range(rounds):
        g = x.T @ (_softmax(x @ w) - np.eye(k)[y]) / len(y) + decay * w
        squares += g * g
        w -= 0.5 * g / np.sqrt(squares)
    return w


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", max_rows: int = 60_000) -> Domains:
    """Learns from rows of ``docs`` whose id ``labelled`` (``id, domain``) gives one of ``domains``.

    Other domains and null ids are skipped; of several domains for one id the first by name counts. Of more than
    ``max_rows`` labelled rows an even share by hash is taken. Half of them train naive Bayes, half calibrate it. Without
    labelled rows all posteriors are equal.
    """
    spark, k = docs.sparkSession, len(domains)
    small_batches(spark)
    number = F.array_position(F.array(*(F.lit(d) for d in domains)), F.col("domain")).cast("int") - 1
    known = stored(labelled.where(F.col("id").isNotNull() & F.col("domain").isin(domains)).groupBy("id").agg(F.min("domain").alias("domain")).select("id", number.alias("y")), "domain-labels")
    total = known.count()
    flat = Domains(domains, np.zeros((1 << BUCKET_BITS, k)), np.zeros((k + 1, k)))
    if not total:
        return flat
    hashed = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000))
    some = F.broadcast(known.where(hashed < int(1_000_000 * min(1.0, max_rows / total))))  # bounded by max_rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(some, "id")
    half = F.pmod(F.xxhash64("id", F.lit(4)), F.lit(2)) == 0

    def count(batches):
        n = np.zeros((k, 1 << BUCKET_BITS), dtype=np.int64)
        for b in batches:
            for t, y in zip(text_bytes(b.column(0)), b.column(1).to_pylist()):
                n[y] += gram_counts(t)
        y, bucket = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n[y, bucket])], ["y", "bucket", "n"])

    counts = np.full((1 << BUCKET_BITS, k), 0.5)
    for r in rows.where(half).select("text", "y").mapInArrow(count, "y int, bucket int, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"], r["y"]] += r["n"]
    logs = np.log(counts / counts.sum(axis=0))

    def scored(batches):
        for b in batches:
            s = [_scores(t, logs).tobytes() for t in text_bytes(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.binary()), b.column(1)], ["s", "y"])

    seen = rows.where(~half).select("text", "y").mapInArrow(scored, "s binary, y int").collect()
    if not seen:
        return flat
    x, y = np.array([np.frombuffer(r["s"]) for r in seen]), np.array([r["y"] for r in seen])
    return Domains(domains, logs, _calibrate(x, y, k))


def posteriors(docs: DataFrame, model: Domains, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``tokens`` (words) and ``p`` (array of posteriors) of each row; null texts count as empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col(text_col).cast("string").alias("_text"), *(keep or []))
    out = T.StructType([*chosen.schema.fields[1:], T.StructField("tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))])

    def run(batches):
        m = shared.value
        for b in batches:
            texts = text_bytes(b.column(0))
            p = _softmax(np.array([_scores(t, m.logs) for t in texts]).reshape(len(texts), -1) @ m.weights)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array([len(t.split()) for t in texts], pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], out.names)

    return chosen.mapInArrow(run, out)


def _rates(start: float, steps: list[list[float]]) -> Column:
    """A struct of the rate after the steps, ``r``, and the point ``y`` from which the next one goes.

    A step has a number for each domain and, last, how far the next point goes on in the direction of the move.
    """
    state = lambda r, y: F.struct(r.alias("r"), y.alias("y"))
    begin = state(F.lit(float(start)), F.lit(float(start)))
    if not steps:
        return begin

    def step(at: Column, v: Column) -> Column:
        k = len(steps[0]) - 1
        down = sum((F.get("p", F.lit(i)) * F.get(v, F.lit(i)) for i in range(k)), F.lit(0.0))
        cut = F.greatest(F.lit(0.0), F.least(F.lit(1.0), at["y"] - down))
        return F.get(F.transform(F.array(cut), lambda r: state(r, r + F.get(v, F.lit(k)) * (r - at["r"]))), F.lit(0))

    return F.aggregate(F.array(*(F.array(*(F.lit(float(x)) for x in v)) for v in steps)), begin, step)


def fit_rates(members: DataFrame, targets: list[float], rounds: int = 80, tolerance: float = 1e-3, patience: int = 6) -> tuple[Column, list[float]]:
    """The rate as an expression over ``p``, and the relative residuals that are left.

    ``members`` has ``tokens`` and ``p`` (a posterior for each target); ``targets`` are the wanted totals of tokens by domain. Minimised is the sum of squared
    residuals, each over its target. The best rates of all rounds are returned; the fit ends within the tolerance, or when
    ``patience`` rounds gain less than a hundredth. Targets out of reach (for rates of one at most, or of a domain that no
    document has any share of) leave a residual.
    """
    k = len(targets)
    wanted = np.array(targets, dtype=float)
    weight = 1.0 / np.maximum(wanted, 1.0)
    p = lambda i: F.get("p", F.lit(i))
    live = members.where("tokens > 0")
    pairs = [(i, j) for i in range(k) for j in range(k)]
    row = live.agg(*(F.sum(F.col("tokens") * p(i)).alias(f"t{i}") for i in range(k)), *(F.sum(F.col("tokens") * p(i) * p(j)).alias(f"m{i}_{j}") for i, j in pairs)).first()
    whole = np.array([row[f"t{i}"] or 0.0 for i in range(k)])
    if not whole.sum():
        return F.lit(0.0), [1.0 if w else 0.0 for w in targets]
    moments = np.array([row[f"m{i}_{j}"] or 0.0 for i, j in pairs]).reshape(k, k) * np.sqrt(weight)[:, None] * np.sqrt(weight)
    steepest = float(np.linalg.eigvalsh(moments).max())  # the curvature: steps of one over it never overshoot

    names = [f"{x}{i}" for x in "ry" for i in range(k)]

    def residuals(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Of the totals at the rates and at the points, summed over each partition in numpy and then by Spark."""
        def run(batches):
            sums = np.zeros(2 * k)
            for b in batches:
                share = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                r = y = np.full(len(share), start)
                for *v, on in steps:
                    cut = np.clip(y - share @ np.array(v), 0.0, 1.0)
                    r, y = cut, cut + on * (cut - r)
                tokens = b.column(0).to_numpy(zero_copy_only=False)
                sums += np.concatenate([(x * tokens) @ share for x in (r, y)])
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], names)

        got = live.select(F.col("tokens").cast("double"), "p").mapInArrow(run, ", ".join(f"{n} double" for n in names)).agg(*(F.sum(n).alias(n) for n in names)).first()
        return tuple(np.array([got[f"{x}{i}"] for i in range(k)]) - wanted for x in "ry")

    start, momentum, waited = float(min(1.0, wanted.sum() / whole.sum())), 1.0, 0
    steps: list[list[float]] = []
    at_rate, at_point = residuals(steps)
    cost = lambda e: float((e * e * weight).sum())
    best = (cost(at_rate), [], at_rate)
    for _ in range(rounds):
        if np.abs(best[2] * weight).max() <= tolerance or waited >= patience:
            break
        following = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        steps = [*steps, [*(weight * at_point / steepest), (momentum - 1) / following]]
        momentum, before = following, cost(at_rate)
        at_rate, at_point = residuals(steps)
        now = cost(at_rate)
        waited = 0 if now < 0.99 * best[0] else waited + 1
        if now < best[0]:
            best = (now, list(steps), at_rate)
        if now > before:  # uphill: the next point is the rate itself, without momentum
            momentum, steps[-1][-1], at_point = 1.0, 0.0, at_rate
    return _rates(start, best[1])["r"], [float(x) for x in np.abs(best[2]) * weight]


def target_totals(members: DataFrame, shares: list[float], part: float = 1.0) -> list[float]:
    """Targets with the given shares, as large as the domain with the first share allows at rate one, times ``part``."""
    got = members.agg(F.sum(F.col("tokens") * F.get("p", F.lit(0))).alias("t")).first()["t"] or 0.0
    return [part * got * s / shares[0] for s in shares]


#: The domains of the labelled table by quality, and the shares of tokens wanted.
QUALITY_DOMAINS = ["high", "low"]
QUALITY_SHARES = [0.95, 0.05]


def quality_domain(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("domain"))


def fit(docs: DataFrame, labels: DataFrame, shares: list[float] | None = None, keep: list[str] | None = None,
        parts: tuple[float, ...] = (1.0, 0.99, 0.97, 0.94, 0.9, 0.8, 0.6, 0.4), most_left: float = 1e-3) -> tuple[Domains, DataFrame, Column, list[float]]:
    """The classifier, the stored members (``keep`` columns, ``tokens``, ``p``), the rate over ``p``, and the residuals left.

    Wanted are the largest totals, of ``parts`` of what the first domain has, that rates of one at most can meet; if
    none can be met, the residuals of the last part say how far off the rates are.
    """
    model = train(docs, quality_domain(labels), QUALITY_DOMAINS)
    members = stored(posteriors(docs, model, keep=keep), "domain-members")
    before = None
    for part in parts:
        rate, left = fit_rates(members, target_totals(members, shares or QUALITY_SHARES, part))
        if max(left) <= most_left or before is not None and max(left) > 0.95 * before:
            break  # met, or no nearer with smaller totals: the shares themselves are out of reach
        before = max(left)
    return model, members, rate, left


def sampled(docs: DataFrame, labels: DataFrame, keep: list[str], shares: list[float] | None = None) -> DataFrame:
    """``keep`` columns of the rows of ``docs`` that a draw at their rates takes, each once at most.

    The draw is a hash of id and text, so it is the same at every run and repeated rows share their fate; rows with a rate
    of one are always taken. As no rate exceeds one, the expected totals of what is taken are those that the rates meet.
    """
    model, _, rate, _ = fit(docs, labels, shares)
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1_000_000)) / 1_000_000
    return posteriors(docs, model, keep=keep).where(draw < rate).select(*keep)


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, the posteriors of the two domains of quality, the fitted rate of each document, and (the same in
    every row) the largest relative residual of a domain's total that the fit leaves."""
    _, members, rate, left = fit(docs, labels, keep=["doc_id"])
    return members.select(
        "doc_id", F.col("tokens").alias("n_tokens"), F.get("p", F.lit(0)).alias("p_high"), F.get("p", F.lit(1)).alias("p_low"), rate.alias("rate"), F.lit(float(max(left))).alias("residual"))
