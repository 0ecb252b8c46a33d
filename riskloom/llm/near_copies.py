"""Near-copies: texts whose sets of word shingles have a Jaccard similarity of at least a threshold.

Bands of min-hashes only propose: texts that share the min-hashes of one band share a cell. Within a cell the
shingle sets of the texts themselves are compared, so every link is exact. Of two texts at similarity ``s``, all
``BANDS`` bands miss with probability ``(1 - s ** ROWS) ** BANDS``: 3e-6 at 0.8, less above.

Equal texts fall together before. Cells with the same texts (by number and sums of hashes) are compared once; within a cell only
a spanning set of links is kept, and cells above ``cell_rows`` are dealt out as pairs of blocks, losing no link. No cell is
gathered in one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, small_batches, stored, text_bytes

BANDS, ROWS = 32, 5
_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the text's ``words``-word shingles; a shorter text is one shingle, no words none."""
    parts = text.lower().split()  # as simhash.fingerprint()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    n = max(1, len(parts) - words + 1)
    stops = ends[min(words, len(parts)) - 1:].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], seed) for s, e in zip(starts, stops)], dtype=np.uint64))


def cells(found: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """Cell numbers of one shingle set, one for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for s in range(0, len(found), chunk):
        least = np.minimum(least, (found[s:s + chunk] * _FACTORS[:, None]).min(axis=1))
    least ^= least >> np.uint64(31)
    key = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return key.view(np.int64)


def spanning_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between places in ``sets`` that join what pairs at Jaccard ``least`` or more join; two empty sets are alike."""
    sizes = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(values) + 1, dtype=bool)
    out, rest = [], np.arange(len(sets))
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            k = front.pop()
            own = flat[edges[k]:edges[k + 1]]
            mark[own] = True
            near = np.zeros(len(rest), dtype=bool)
            for x in np.flatnonzero(np.minimum(sizes[rest], sizes[k]) >= least * np.maximum(sizes[rest], sizes[k]) - 1e-9):
                i = rest[x]
                both = int(np.count_nonzero(mark[flat[edges[i]:edges[i + 1]]]))
                union = len(own) + int(sizes[i]) - both
                near[x] = not union or both / union >= least
            mark[own] = False
            new = rest[near].tolist()
            out.extend((k, i) for i in new)
            front.extend(new)
            rest = rest[~near]
    return out


def links(texts: DataFrame, words: int = 5, least: float = 0.8, cell_rows: int = 2048, proposed: DataFrame | None = None, bands: int = BANDS) -> DataFrame:
    """From ``id, text`` (distinct texts) to links ``a, b`` that connect all texts at Jaccard ``least`` or more.

    ``proposed`` (``cell, id``) gives further cells, whose texts are compared like those of the first ``bands`` bands; its numbers are its own.
    """
    small_batches(texts.sparkSession)

    def deal(batches):
        for b in batches:
            found = [cells(shingles(t, words))[:bands] for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(0, np.int64), *found])), pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), bands))], ["cell", "id"])

    dealt_bands = texts.select("id", "text").mapInArrow(deal, "cell long, id long")
    if proposed is not None:
        dealt_bands = dealt_bands.unionByName(proposed.select(F.xxhash64(F.lit("proposed"), "cell").alias("cell"), "id"))
    every = stored(dealt_bands, "cells")
    summed = every.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(19,0)")).alias("s"))
    kept = stored(summed.where("n > 1").groupBy("n", "x", "s").agg(F.min("cell").alias("cell")).select("cell", "n"), "kept-cells")
    parts = F.when(F.col("n") > cell_rows, F.ceil(F.col("n") / F.lit(cell_rows / 2))).otherwise(1).cast("int")
    dealt = stored(join_hot(every, kept.withColumn("parts", parts), "cell", every.count()).select("cell", F.col("parts").alias("n"), "id"), "cell-members")
    blocks = (
        dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id")
    )
    compared = stored(texts.join(dealt.select("id").distinct(), "id", "left_semi").select("id", "text"), "compared")

    def link(batches):
        key, ids, sets = None, [], []

        def out():
            pairs = spanning_links(sets, least)
            return pa.RecordBatch.from_arrays([pa.array([ids[p[x]] for p in pairs], pa.int64()) for x in (0, 1)], ["a", "b"])

        for b in batches:
            for *at, i, t in zip(*(b.column(c).to_pylist() for c in range(4)), text_bytes(b.column(4))):
                if at != key:
                    if len(ids) > 1:
                        yield out()
                    key, ids, sets = at, [], []
                ids.append(i)
                sets.append(shingles(t, words))
        if len(ids) > 1:
            yield out()

    met = blocks.join(compared, "id").select("cell", "i", "j", "id", "text")
    return met.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(link, "a long, b long").distinct()
