"""Hard negatives: for an anchor and each of its positives, the best rows of other labels whose score lies in a window.

Scores are integer inner products, computed exactly in a residue number system: the components, ``floor(scale * x)``, are
reduced modulo a few small odd primes to centred residues, one float32 matrix product for each prime multiplies a block of
anchors with a block of rows (no partial sum passes 2 ** 24, so float32 holds it exactly), and the Chinese remainder theorem, in
mixed radix with signed digits, gives the signed scores back. The number of primes follows the largest squared norm of the table.

Anchors are dealt to waves of bounded size. Each wave is broadcast and meets every row twice: first for its positives,
then, with their scores as windows, for the negatives. A task keeps a few rows for each anchor and hands them over at its end,
so what is shuffled is a few rows an anchor and task; no row of the table is shuffled, and no group of rows is gathered.

Defined cases. Rows with a null id, label or vector, or with a null or non-finite component, take no part; neither do rows whose
squared norm passes 2 ** 60, as their scores would leave 64 bits. Vectors of different lengths never meet; empty ones
score zero. Rows that agree in id, label and vector count once; an anchor and rows with its id never meet. An empty table, and one
without anchors, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Residues of these are at most 254, so 260 products of two sum up below 2 ** 24. Their product passes 2 ** 70.
PRIMES = (509, 503, 499, 491, 487, 479, 467, 463)
FLOAT_EXACT = 1 << 24
MOST_NORM = float(1 << 60)
#: Rows and anchors of one matrix product.
ROWS, ANCHORS = 4096, 256
NONE = np.iinfo(np.int64).min


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p-1)/2 to (p-1)/2 of whole float64 numbers below 2 ** 45."""
    return x - p * np.rint(x / p)


def primes_for(largest: float) -> tuple[int, ...]:
    """As many primes as tell scores from ``-largest`` to ``largest`` apart."""
    n, product = 1, PRIMES[0]
    while product <= 2 * int(largest) + 1:
        product *= PRIMES[n]
        n += 1
    return PRIMES[:n]


def residues(whole: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    return [_centred(whole, p).astype(np.float32) for p in primes]


def products(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Exact int64 inner products of the rows of two matrices given by their residues."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        step = FLOAT_EXACT // ((p - 1) // 2) ** 2
        got = np.zeros((a[i].shape[0], b[i].shape[0]))
        for k in range(0, a[i].shape[1], step):
            got = _centred(got + a[i][:, k:k + step] @ b[i][:, k:k + step].T, p)
        before, radix = 0.0, 1
        for d, q in zip(reversed(digits), reversed(primes[:i])):
            before = _centred(before * q + d, p)
            radix *= q
        inverse = pow(radix, -1, p) if i else 1
        digits.append(_centred((got - before) * inverse, p))
    out = digits[-1].astype(np.int64)
    for d, q in zip(reversed(digits[:-1]), reversed(primes[:len(digits) - 1])):
        out = out * q + d.astype(np.int64)
    return out


def _by_length(batch: pa.RecordBatch, scale: float):
    """For each vector length of a batch of ``id, label, vector``: ids, labels and whole components of the rows that take part."""
    vectors = batch.column(2)
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == n)
        flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), n)
        with np.errstate(all="ignore"):
            whole = np.floor(scale * flat)
            norms = (whole * whole).sum(axis=1)
        good = norms <= MOST_NORM  # false for NaN
        if good.any():
            yield int(n), batch.column(0).to_numpy(zero_copy_only=False)[rows][good], batch.column(1).to_numpy(zero_copy_only=False)[rows][good], whole[good], norms[good]


def _fewer(ids: np.ndarray, labels: np.ndarray, whole: np.ndarray, most: int):
    """The rows in order of id, without those that agree in all with another, and of equal vectors and labels ``most`` only.

    Such rows have one score with any anchor, so those of larger ids can't be chosen; one is spared for the anchor's own id.
    """
    keys = (whole.astype(np.int64) * np.random.default_rng(7).integers(1, 1 << 62, whole.shape[1])).sum(axis=1)
    order = np.lexsort((ids, labels, keys))
    ids, labels, whole, keys = ids[order], labels[order], whole[order], keys[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (labels[1:] != labels[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    if (whole == whole[first]).all():  # else two vectors share a key
        fresh = new.copy()
        fresh[1:] |= ids[1:] != ids[:-1]
        place = np.cumsum(fresh) - np.cumsum(fresh)[first]
        kept = fresh & (place < most)
        ids, labels, whole = ids[kept], labels[kept], whole[kept]
    return ids, labels, whole


class Best:
    """The ``k`` best (score, id) of each of ``n`` groups so far: higher scores, then smaller ids; repeats count once."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((n, k), NONE), np.zeros((n, k), dtype=np.int64)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """``scores`` of groups ``first``, ``first + 1`` and so on (rows) with ``ids`` (columns), where ``allowed``."""
        k, n = self.k, len(scores)
        least = self.scores[first:first + n, -1]
        found = allowed & (scores >= least[:, None])
        if np.count_nonzero(found) > 4 * k * n and scores.shape[1] > k:
            top = np.partition(np.where(found, scores, NONE), scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            found &= scores >= top[:, None]
        at, column = np.nonzero(found)
        if not len(at):
            return
        own = np.unique(at)
        filler = np.repeat(own, k)
        g = np.concatenate([filler, filler, at])
        s = np.concatenate([self.scores[first + own].ravel(), np.full(len(filler), NONE), scores[at, column]])
        i = np.concatenate([self.ids[first + own].ravel(), np.zeros(len(filler), np.int64), ids[column]])
        order = np.lexsort((i, ~s, g))
        g, s, i = g[order], s[order], i[order]
        fresh = np.ones(len(g), dtype=bool)
        fresh[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1]) | (s[1:] == NONE)
        g, s, i = g[fresh], s[fresh], i[fresh]
        place = np.arange(len(g)) - np.searchsorted(g, g)
        self.scores[first + own], self.ids[first + own] = s[place < k].reshape(-1, k), i[place < k].reshape(-1, k)


@dataclass(frozen=True)
class Anchors:
    """Anchors of one wave and one vector length; ``windows``: positives' scores, descending, ``NONE`` where there are fewer."""

    numbers: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    parts: list[np.ndarray]
    windows: np.ndarray | None = None


def _blocks(batches, scale: float, most: int):
    """Rows of one vector length, up to ``ROWS`` at once: ``length, ids, labels, whole``."""
    held: dict[int, list] = {}
    for b in batches:
        for n, ids, labels, whole, _ in _by_length(b, scale):
            own = held.setdefault(n, [])
            own.append((ids, labels, whole))
            if sum(len(x[0]) for x in own) >= ROWS:
                yield n, *_fewer(*(np.concatenate(c) for c in zip(*held.pop(n))), most)
    for n, own in held.items():
        yield n, *_fewer(*(np.concatenate(c) for c in zip(*own)), most)


def _positives(batches, waves: dict[int, Anchors], primes, scale: float, k: int):
    best = {n: Best(len(a.ids), k) for n, a in waves.items()}
    for n, ids, labels, whole in _blocks(batches, scale, k + 1):
        if n not in waves:
            continue
        a, rows = waves[n], residues(whole, primes)
        for at in range(0, len(a.ids), ANCHORS):
            some = slice(at, at + ANCHORS)
            s = products([p[some] for p in a.parts], rows, primes)
            best[n].add(at, s, ids, (a.labels[some, None] == labels) & (a.ids[some, None] != ids))
    for n, found in best.items():
        at, j = np.nonzero(found.scores != NONE)
        yield pa.RecordBatch.from_arrays([pa.array(waves[n].numbers[at]), pa.array(found.ids[at, j]), pa.array(found.scores[at, j])], ["anchor", "id", "score"])


def _negatives(batches, waves: dict[int, Anchors], primes, scale: float, k: int, low: tuple[int, int]):
    width = next(iter(waves.values())).windows.shape[1]
    best = {n: [Best(len(a.ids), k) for _ in range(width)] for n, a in waves.items()}
    for n, ids, labels, whole in _blocks(batches, scale, k + 1):
        if n not in waves:
            continue
        a, rows = waves[n], residues(whole, primes)
        for at in range(0, len(a.ids), ANCHORS):
            some = slice(at, at + ANCHORS)
            s = products([p[some] for p in a.parts], rows, primes)
            other = (a.labels[some, None] != labels) & (a.ids[some, None] != ids)
            for j in range(width):
                high = a.windows[some, j, None]
                least = -((-low[0] * high) // low[1])
                best[n][j].add(at, s, ids, other & (high != NONE) & (s >= least) & (s <= high))
    for n, found in best.items():
        for j, own in enumerate(found):
            at, m = np.nonzero(own.scores != NONE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(waves[n].numbers[at]), pa.array(np.full(len(at), j, np.int32)), pa.array(own.ids[at, m]), pa.array(own.scores[at, m])], ["anchor", "place", "id", "score"])


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` best of each group, with their place from 1 as ``rank``."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.repartition(*by).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0,
         positives: int = 5, negatives: int = 5, low: tuple[int, int] = (4, 5), wave_components: int = 4_000_000) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are the best ``positives`` other rows of its label. For each of them come the best ``negatives`` rows of other
    labels whose score is at most the positive's and at least ``low[0] / low[1]`` of it. ``is_anchor`` is a condition on
    ``id``. ``wave_components``: components of the anchors that are broadcast at once.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector")).where("id is not null and label is not null and vector is not null")

    def lengths(batches):
        for b in batches:
            for n, ids, _, _, norms in _by_length(b, scale):
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([float(norms.max())])], ["length", "norm"])

    of_length = rows.mapInArrow(lengths, "length int, norm double").agg(F.max("length").alias("length"), F.max("norm").alias("norm")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if of_length["length"] is None:
        return spark.createDataFrame([], out)
    primes = primes_for(of_length["norm"] * 1.000001)
    size = max(1, wave_components // max(1, of_length["length"]))
    anchors = stored(rows.where(is_anchor).distinct().withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    waves = -(-anchors.count() // size)  # numbers of one partition follow each other, so waves differ by a row a partition at most
    parts = []
    for w in range(waves):
        own: dict[int, Anchors] = {}
        held = anchors.where(F.pmod("anchor", F.lit(waves)) == w).orderBy("anchor").select("id", "label", "vector", "anchor").toArrow().combine_chunks()
        for b in held.to_batches():
            numbers = b.column(3)
            for n, ids, labels, whole, _ in _by_length(pa.RecordBatch.from_arrays([numbers, b.column(1), b.column(2)], ["id", "label", "vector"]), scale):
                true = b.column(0).to_numpy()[np.searchsorted(numbers.to_numpy(), ids)]
                own[n] = Anchors(ids, true, labels, residues(whole, primes))
        if not own:
            continue
        shared = spark.sparkContext.broadcast(own)
        near = rows.mapInArrow(lambda batches, s=shared: _positives(batches, s.value, primes, scale, positives), "anchor long, id long, score long")
        chosen = stored(_first(near, ["anchor"], positives), "positives")
        got = chosen.select("anchor", "rank", "score").toArrow()  # so many for each anchor of the wave
        number, rank, score = (got.column(c).to_numpy() for c in ("anchor", "rank", "score"))
        windowed = {}
        for n, a in own.items():
            windows = np.full((len(a.ids), positives), NONE)
            at = np.minimum(np.searchsorted(a.numbers, number), len(a.numbers) - 1)
            mine_too = a.numbers[at] == number
            windows[at[mine_too], rank[mine_too] - 1] = score[mine_too]
            windowed[n] = Anchors(a.numbers, a.ids, a.labels, a.parts, windows)
        shared = spark.sparkContext.broadcast(windowed)
        far = rows.mapInArrow(lambda batches, s=shared: _negatives(batches, s.value, primes, scale, negatives, low), "anchor long, place int, id long, score long")
        best = _first(far, ["anchor", "place"], negatives).select("anchor", (F.col("place") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        named = chosen.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        parts.append(stored(best.join(named, ["anchor", "place"]), "negatives") if waves > 1 else best.join(named, ["anchor", "place"]))
    if not parts:
        return spark.createDataFrame([], out)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11(embeddings: DataFrame) -> DataFrame:
    """Contract columns; every row whose id is divisible by 7 has the next label, every row whose id is divisible by 100 is an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(embeddings.select("vec_id", "embedding", label.alias("label")), F.col("id") % 100 == 0)


OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as c
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, v.vec_id as id, a.label = v.label as same, list_dot_product(a.c, v.c)::bigint as score
  from v a join v on a.vec_id <> v.vec_id where a.vec_id % 100 = 0),
p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (
  select p.*, id as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, id) as rank
  from p join s on p.anchor_id = s.anchor_id and not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""
