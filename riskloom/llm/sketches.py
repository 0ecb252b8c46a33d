"""Document fingerprints as threshold-scaled sketches.

A sketch holds every distinct shingle hash below a fixed fraction of the hash range, so sketches of very unequal
texts share one scale: the sketch of a union is the union of sketches, and the share of one sketch that another
holds estimates containment without bias. A text always keeps its smallest hash too, so that no text with a
character has an empty sketch.

Shingles are windows of 12 code points (a shorter text is one shingle); hashes have 52 bits, those below ``2 ** 48`` (one in
16) are kept. As a string a sketch is its sorted hashes, six big-endian bytes each (seven, marked by a dot, for a
lone one above the threshold), in base64.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

SHINGLE = 12
HASH_BITS, KEPT_BITS = 52, 48
_U = np.uint64


_BASE = 0x9E3779B97F4A7C15
_POWERS = {n: _U(pow(_BASE, n, 1 << 64)) for n in (1, 2, 4)}


def _windows(points: np.ndarray) -> np.ndarray:
    """Polynomial hash of each window of 12, by doubling; of the whole if it is shorter."""
    if len(points) < SHINGLE:
        h = _U(0)
        with np.errstate(over="ignore"):
            for p in points:
                h = h * _U(_BASE) + p
        return np.array([h ^ _U(len(points))])
    two = points[:-1] * _POWERS[1] + points[1:]
    four = two[:-2] * _POWERS[2] + two[2:]
    eight = four[:-4] * _POWERS[4] + four[4:]
    return eight[:-4] * _POWERS[4] + four[8:]


def sketch(text: str) -> np.ndarray:
    """Sorted distinct kept hashes of one text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if not len(points):
        return np.zeros(0, dtype=np.uint64)
    h = _windows(points + _U(1))
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h >>= _U(64 - HASH_BITS)
    kept = np.unique(h[h < _U(1 << KEPT_BITS)])
    return kept if len(kept) else h.min(keepdims=True)


def merged(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of all texts together."""
    both = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *sketches]))
    below = both[both < _U(1 << KEPT_BITS)]
    return below if len(below) else both[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has (two empty ones: 1)."""
    if not len(a):
        return 1.0 if not len(b) else 0.0
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment of the smaller sketch in the larger one: 0 to 1, the same in either order."""
    return max(containment(a, b), containment(b, a)) if len(a) == len(b) else containment(*sorted((a, b), key=len))


def spelled(kept: np.ndarray) -> str:
    if len(kept) == 1 and kept[0] >= _U(1 << KEPT_BITS):
        return "." + base64.b64encode(int(kept[0]).to_bytes(7, "big")).decode()
    return base64.b64encode(kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    """The sketch that ``spelled`` wrote."""
    if fingerprint.startswith("."):
        return np.array([int.from_bytes(base64.b64decode(fingerprint[1:]), "big")], dtype=np.uint64)
    six = np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(six), 2), np.uint8), six], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``fingerprint`` of each row. Null texts count as empty, with an empty fingerprint."""
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(text_col).cast("string").alias("_text"), *(keep or []))
    out = T.StructType([*chosen.schema.fields[1:], T.StructField("fingerprint", T.StringType())])

    def run(batches):
        for b in batches:
            prints = [spelled(sketch(t or "")) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(prints, pa.string())], out.names)

    return chosen.mapInArrow(run, out)


# ---- each row beside the next one -------------------------------------------------------------

#: Ranges of ids at most; so many bounds (8 bytes each) go to every task. A larger table has longer ranges instead.
MOST_RANGES = 1 << 20


def _cuts(ids: DataFrame, rows: int, tasks: int = 4096) -> np.ndarray:
    """Ids that end ranges of about ``rows`` rows: every ``rows``-th of the sorted ids, and the highest one. Only ids are sorted."""
    n = ids.count()
    rows = max(rows, n // MOST_RANGES)
    known = ids.where("id is not null")

    def pick(batches):
        seen, last = 0, None
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(own):
                continue
            yield pa.RecordBatch.from_arrays([pa.array(own[(rows - 1 - seen) % rows::rows])], ["id"])
            seen, last = seen + len(own), own[-1]
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64())], ["id"])

    sorted_ids = known.repartitionByRange(max(1, min(tasks, n // (16 * rows))), "id").sortWithinPartitions("id")
    return np.unique(sorted_ids.mapInArrow(pick, "id long").toArrow().column("id").to_numpy().astype(np.int64))


def _dealt(docs: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """The rows dealt to ranges of descending id, as ``range, helper, id, text``.

    Every bound is an id of the table, the highest of its range. The rows with it come once more, as helpers that end the
    range before (of the first range: the last one); null ids are the last range.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bounds = _cuts(chosen.select("id"), rows)
    nulls = chosen.where("id is null").limit(1).count()
    shared = docs.sparkSession.sparkContext.broadcast(bounds)
    last = len(bounds) if nulls else max(0, len(bounds) - 1)  # the number of the last range

    def deal(batches):
        cuts = shared.value
        top = len(cuts) - 1  # bounds rise, ranges fall
        for b in batches:
            missing = b.column(0).is_null().to_numpy(zero_copy_only=False)
            known = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.minimum(np.searchsorted(cuts, known, side="left"), max(top, 0))
            own = np.where(missing, last, top - place)
            ends = cuts[place] == known if len(cuts) else np.zeros(len(known), dtype=bool)
            again = np.flatnonzero(missing | ends)  # rows that may be the first of their range
            before = np.where(own[again] == 0, last, own[again] - 1)
            take = pa.array(np.concatenate([np.arange(len(known)), again]))
            ranges = np.concatenate([own, before]).astype(np.int32)
            helper = np.arange(len(ranges)) >= len(known)
            yield pa.RecordBatch.from_arrays([pa.array(ranges), pa.array(helper), b.column(0).take(take), b.column(1).take(take)], ["range", "helper", "id", "text"])

    dealt = chosen.mapInArrow(deal, "range int, helper boolean, id long, text string")
    return dealt.repartition("range").sortWithinPartitions("range", "helper", F.desc_nulls_last("id"), "text")


def beside_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 2048) -> DataFrame:
    """Each row's sketch beside that of its edited text and of the next row's.

    The next row is that of the next lower id (of equal ids, by text; null ids last; after the last the first; a lone
    row is its own next). The edited text has its last third of code points replaced by as many first ones of the next
    text, or all it has. Null texts count as empty. Other columns are ignored; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        def out(found):
            columns = zip(*found)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _BESIDE)

        def one(own, following):
            i, text, s = own
            _, other, s_other = following
            cut = len(text) // 3
            edited = text[: len(text) - cut] + other[:cut] if cut else text
            s_edited = sketch(edited) if edited != text else s
            return (i, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), spelled(s), spelled(s_edited), likeness(s, s_edited), likeness(s, s_other))

        last, found, at, done = None, [], None, False
        for b in batches:
            for r, helper, i, text in zip(*(c.to_pylist() for c in b.columns)):
                if r != at:
                    last, at, done = None, r, False
                if done:
                    continue  # a further helper of this range
                row = (i, text, sketch(text))
                if last is not None:
                    found.append(one(last, row))
                last, done = row, helper
            if found:
                yield out(found)
                found = []

    return _dealt(docs, id_col, text_col, rows).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(_BESIDE, ("long", "long", "string", "string", "string", "double", "double"))))


_BESIDE = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def op8(docs: DataFrame) -> DataFrame:
    """Contract columns of ``beside_edited``."""
    return beside_edited(docs).withColumnRenamed("id", "doc_id")
