"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the vector of the segments' bit counts is its
embedding. The Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints. For a range join under Manhattan distance ``r`` the coordinates are dealt to ``g`` groups:
at most ``r`` groups can differ, so two embeddings in range agree on ``g - r`` groups at least, and share
a cell of one of the sub-grids over ``g - r`` groups. Pairs in a cell are first held against the Manhattan
bound and then verified by exact Hamming distance. The more fingerprints, the more groups (``spare_groups``): cells stay small, so
that the pairs compared do not grow with the square of the table.

Exact copies fall together before the join. Within a cell only a spanning set of links is kept, never all
pairs; cells above ``cell_rows`` are dealt out as pairs of blocks, so that no task holds more than two
blocks, and no link is lost.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near_copies
from .common import join_hot, small_batches, stored, text_bytes
from .components import connected_components

_ODD = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)


# ---- fingerprints -----------------------------------------------------------------------------

def fingerprint(text: bytes, words: int = 4, seed: int = 42, chunk: int = 65536) -> int:
    """SimHash of one UTF-8 text over ``words``-word shingles, repeats included; no words: zero."""
    parts = text.lower().split()  # of bytes: A-Z only, and exactly the blanks x20 and x09-x0D
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    n = max(1, len(parts) - words + 1)
    stops = ends[min(words, len(parts)) - 1:].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, chunk):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at:at + chunk], stops[at:at + chunk])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """One row for each row of ``docs``: its id and ``fp`` (the fingerprint as a signed long)."""
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, words, seed) for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    out = T.StructType([chosen.schema["id"], T.StructField("fp", T.LongType())])
    return chosen.mapInArrow(run, out)


# ---- embedding and cells ----------------------------------------------------------------------

def embed(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each in its own two bits of a word."""
    return (fps & _ODD) + ((fps >> _ONE) & _ODD)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of two embeddings (counts 0, 1 and 2: of the XOR, 01 and 11 stand for 1, 10 for 2)."""
    x = a ^ b
    low, high = x & _ODD, (x >> _ONE) & _ODD
    return np.bitwise_count(low) + 2 * np.bitwise_count(high & ~low)


def groups(max_bits: int, spare: int = 3) -> list[tuple[int, int]]:
    """(shift, width) in bits of ``max_bits + spare`` groups of whole segments."""
    g = max_bits + spare
    edges = [2 * round(i * 32 / g) for i in range(g + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def spare_groups(distinct: int, max_bits: int = 4) -> int:
    """Groups of a sub-grid that make the least work for so many fingerprints: rows dealt to sub-grids, plus pairs compared.

    Two random two-bit segments agree with a chance of 3 in 8. To deal and sort a row costs as much as some 200 comparisons.
    """
    def work(spare: int) -> float:
        partners = distinct * 0.375 ** (32 * spare / (max_bits + spare))
        return math.comb(max_bits + spare, spare) * (1 + partners / 200)

    return min(range(3, 9), key=work)


def cells(fps: np.ndarray, max_bits: int, spare: int = 3) -> np.ndarray:
    """A row of cell numbers for each fingerprint, one for each sub-grid over ``spare`` groups."""
    v, parts = embed(fps), groups(max_bits, spare)
    coords = [(v >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in parts]
    out = []
    for k, chosen in enumerate(combinations(range(len(parts)), spare)):
        key = np.full(len(fps), k, dtype=np.uint64)
        for i in chosen:
            key = (key << np.uint64(parts[i][1])) | coords[i]
        out.append(key)
    return np.stack(out, axis=1).astype(np.int64)


def _near(a, b, max_bits):
    """Which pairs link: the Manhattan bound first, the exact distance for what it leaves."""
    near = manhattan(embed(a), embed(b)) <= max_bits
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= max_bits
    return near


def spanning_links(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what pairs of distinct ``fps`` within ``max_bits`` join: fewer than the fingerprints."""
    left, right = [], []
    rest = fps
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            near = _near(np.broadcast_to(front[0], rest.shape), rest, max_bits)
            new = rest[near]
            left.append(np.full(len(new), front[0], dtype=np.uint64))
            right.append(new)
            front, rest = np.concatenate([front[1:], new]), rest[~near]
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _links_of_runs(keys: np.ndarray, fps: np.ndarray, max_bits: int, large: int = 24):
    """Links within runs of equal keys: small runs by offsets over all rows at once, large ones singly."""
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(keys)])
    out = [spanning_links(fps[s:s + n], max_bits) for s, n in zip(starts[sizes > large], sizes[sizes > large])]
    size_of = np.repeat(sizes, sizes)
    room = np.repeat(starts + sizes, sizes) - np.arange(len(keys))  # rows of the run from here on
    for offset in range(1, int(min(large, sizes.max(initial=0)))):
        i = np.flatnonzero((room > offset) & (size_of <= large))
        if not len(i):
            break
        near = _near(fps[i], fps[i + offset], max_bits)
        out.append((fps[i][near], fps[i + offset][near]))
    return out


def links(distinct: DataFrame, max_bits: int = 4, cell_rows: int = 8192) -> DataFrame:
    """From distinct fingerprints (``fp``) to links ``a, b`` that connect all that differ in ``max_bits`` or fewer."""
    spare = spare_groups(distinct.count(), max_bits)

    def deal(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            key = cells(fps, max_bits, spare)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel()), pa.array(np.repeat(fps.view(np.int64), key.shape[1]))], ["cell", "fp"])

    dealt = distinct.select("fp").mapInArrow(deal, "cell long, fp long")
    hot = stored(dealt.groupBy("cell").count().where(F.col("count") > cell_rows), "hot-cells")
    if hot.isEmpty():
        blocks = dealt.select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    else:
        n = F.ceil(F.col("count") / F.lit(cell_rows / 2)).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        blocks = (
            dealt.join(hot.withColumn("n", n), "cell", "left").withColumn("n", F.coalesce("n", F.lit(1)))
            .withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            .select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
        )

    def link(batches):
        keys, fps = np.zeros((0, 3), dtype=np.int64), np.zeros(0, dtype=np.uint64)

        def out(k, f):
            found = _links_of_runs(k, f, max_bits)
            a = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in found)]).view(np.int64)
            b = np.concatenate([np.zeros(0, np.uint64), *(y for _, y in found)]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            more = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            keys = np.concatenate([keys, more])
            fps = np.concatenate([fps, b.column(3).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
            if len(keys) < 4096:
                continue
            cut = len(keys) - int(np.argmax((keys[::-1] != keys[-1]).any(axis=1))) if (keys != keys[-1]).any() else 0
            if cut:  # the last run may go on in the next batch
                yield out(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield out(keys, fps)

    sorted_cells = blocks.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = sorted_cells.mapInArrow(link, "a long, b long").distinct()
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4,
                    seed: int = 42) -> DataFrame:
    """``id, fp, component_id`` for each row of ``docs``.

    ``component_id`` is the smallest id that links of ``max_bits`` or fewer differing bits reach, the row's
    own included. Null texts count as empty; empty texts have fingerprint zero and link like any other.
    Rows with a null id take part and are skipped as component ids (null if there is no other). Repeated
    rows stay, in one component. Other columns of ``docs`` are ignored.
    """
    own = stored(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")), "distinct-fingerprints")
    found = connected_components(links(distinct, max_bits))
    linked = stored(distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "linked")
    first = stored(linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")), "first-ids")
    classes = join_hot(linked.select("fp", "root", "rows"), first, "root", linked.count())
    classes = stored(classes.select("fp", "component_id", F.col("rows").alias("n")), "components")
    return join_hot(own, classes, "fp", own.count()).select("id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, cell_rows: int = 2048,
                bands: int = near_copies.BANDS) -> DataFrame:
    """The rows of ``docs`` without near-copies: of each component the row with the smallest id stays (of equal
    ids, the smallest hash of the text; null ids count as highest), and repeated rows stay once. Null texts count as
    empty; texts without words are alike.

    ``near_duplicates`` gives the components of distinct texts; within each the texts' shingle sets are compared, as a link of fingerprints
    says nothing sure of the texts. Bands of min-hashes propose near-copies whose fingerprints lie further apart to the same comparison."""
    own = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.struct(F.col(id_col).isNull().alias("last"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(own).alias("text"))
    keyed = docs.withColumn("_key", key)
    firsts = stored(keyed.groupBy(F.col("_key.text").alias("node")).agg(F.min("_key").alias("_key")), "distinct-texts")
    texts = stored(keyed.select(F.col("_key.text").alias("id"), own.alias("text")).dropDuplicates(["id"]), "texts")
    proposed = near_duplicates(texts, "id", "text").select(F.col("component_id").alias("cell"), "id")
    found = connected_components(near_copies.links(texts, words, least, cell_rows, proposed, bands))
    linked = firsts.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stays = stored(linked.groupBy("root").agg(F.min("_key").alias("_key")).select("_key"), "stays")
    return keyed.join(stays, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")


def op5(docs: DataFrame) -> DataFrame:
    """Contract digest of ``near_duplicates``: doc_id, fingerprint (16 hex digits), component_id."""
    got = near_duplicates(docs)
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
