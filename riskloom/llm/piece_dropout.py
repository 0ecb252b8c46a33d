"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Merges of a BPE piece model are taken from an agenda, best score first, then leftmost. Each candidate that comes up is
skipped for good with the chance of the dropout, by a hash keyed by the seed, the variant, the document's id, the chunk's
place and the candidate's number. So one seed gives a document one segmentation, and the same word another one in
every place.

A worker handles a batch of texts at once: every chunk's candidates without skips are counted once for each
distinct chunk; a place none of whose candidates is skipped takes that result, and all other places go through the agenda
side by side, as rows of numpy arrays of one chunk length.

Every character has pieces or bytes to stand for it: a literal U+2581 is spelled in bytes, as pieces use it for the
blank. Decoding therefore returns the text exactly.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "\u2581"
_REMEMBERED = 400_000  # chunks whose result without skips a worker remembers before it starts anew
_SHORT = 48  # characters of a chunk that goes through the agenda as a row
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
_NONE = np.int32(np.iinfo(np.int32).max)


def _mixed(z: int) -> int:
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    z = (z ^ z >> 27) * 0x94D049BB133111EB & _MASK
    return z ^ z >> 31


def _mixed_all(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places ``start, start + 1, ...`` of each run, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class PairTable:
    """Which symbol two symbols merge to, looked up for many pairs at once."""

    def __init__(self, pairs: dict[tuple[int, int], int], symbols: int):
        self.symbols = symbols + 1  # symbols count from -1: one that no piece has
        keys = np.array([(a + 1) * self.symbols + b + 1 for a, b in pairs], dtype=np.int64)
        values = np.array(list(pairs.values()), dtype=np.int32)
        bits = max(10, int(len(keys)).bit_length() + 3)
        self.tables = []
        factor = _STEP
        while len(keys) or not self.tables:
            at = self._slots(keys, np.uint64(factor), bits)
            first = np.zeros(len(keys), dtype=bool)
            first[np.unique(at, return_index=True)[1]] = True
            slot_keys, slot_values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
            slot_keys[at[first]], slot_values[at[first]] = keys[first], values[first]
            self.tables.append((np.uint64(factor), bits, slot_keys, slot_values))
            keys, values = keys[~first], values[~first]
            factor, bits = _mixed(factor) | 1, max(10, bits - 2)

    @staticmethod
    def _slots(keys: np.ndarray, factor: np.uint64, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * factor) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merged symbol of each pair, or -1."""
        keys = (a.astype(np.int64) + 1) * self.symbols + b + 1
        out, left = np.full(len(keys), -1, dtype=np.int32), None
        for factor, bits, slot_keys, slot_values in self.tables:
            k = keys if left is None else keys[left]
            at = self._slots(k, factor, bits)
            held = slot_keys[at]
            hit = held == k
            where = np.flatnonzero(hit) if left is None else left[hit]
            out[where] = slot_values[at[hit]]
            other = np.flatnonzero(~hit & (held >= 0))  # the slot is another pair's
            left = other if left is None else left[other]
            if not len(left):
                break
        return out


class Pieces:
    """The piece model's tables, and one seed's segmentations."""

    def __init__(self, proto: bytes, dropout: float, seed: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.bytes_of = [b""] * size
        self.byte_ids = [0] * 256
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        for i, name in enumerate(names):
            if model.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.bytes_of[i] = name.replace(BLANK, " ").encode()
                self.ids[name], self.rank[name] = i, -model.get_score(i)
        # Chunks that no piece crosses: runs of letters and of other characters, each with the blanks before it.
        # For a vocabulary whose pieces mix the two, words; for one that crosses blanks, the whole text.
        for pattern in (r" *[^\W\d_¹²³]+| *(?:[^\w\s]|[\d_¹²³]|(?! )\s)+| +", r" *[^ ]+| +", r".+"):
            self.chunks = re.compile(pattern, re.DOTALL)
            if all(self.chunks.fullmatch(p.replace(BLANK, " ")) and len(self.chunks.findall(p.replace(BLANK, " "))) == 1 for p in self.ids):
                break
        self.seed = seed
        self.below = max(0, min(1 << 64, int(dropout * 2.0 ** 64)))  # hashes below it skip
        self._symbols()
        self._forget()

    # ---- tables ------------------------------------------------------------------------------

    def _symbols(self) -> None:
        """Numbers for pieces and the characters in them, and the table of pairs."""
        names = [*self.ids, *sorted({c for p in self.ids for c in p} - self.ids.keys())]
        number = {s: k for k, s in enumerate(names)}
        order = {r: k for k, r in enumerate(sorted(set(self.rank.values())))}
        self.symbol_rank = np.array([order[self.rank[s]] if s in self.rank else _NONE for s in names], dtype=np.int32)
        self.symbol_piece = np.array([self.ids.get(s, -1) for s in names] + [-1], dtype=np.int32)  # the last: no symbol
        self.symbol_of = np.full(0x110000, -1, dtype=np.int32)
        for c in (s for s in names if len(s) == 1):
            self.symbol_of[ord(" " if c == BLANK else c)] = number[c]
        pairs = {(number[p[:k]], number[p[k:]]): number[p] for p in self.ids for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        self.pairs = PairTable(pairs, len(names))
        lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.byte_lengths, self.byte_starts = lengths, np.cumsum(lengths) - lengths
        self.byte_pool = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.known_candidates = np.zeros(0, dtype=np.int32)  # -1: a chunk that is no row
        self.known_lengths = np.zeros(0, dtype=np.int64)
        self.known_ids = np.zeros(0, dtype=np.int32)

    # ---- one chunk ---------------------------------------------------------------------------

    def _skipped(self, key: int, number: int) -> bool:
        return _mixed(key + (number + 1) * _STEP & _MASK) < self.below

    def _ids(self, chunk: str, starts: list[int]) -> tuple[int, ...]:
        out: list[int] = []
        for s, e in zip(starts, [*starts[1:], len(chunk)]):
            piece = chunk[s:e]
            k = self.ids.get(piece)
            if k is None:
                out.extend(self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))
            else:
                out.append(k)
        return tuple(out)

    def segment(self, chunk: str, key: int) -> tuple[int, ...]:
        """Piece ids of one chunk of any length, whose blanks are already written as pieces write them."""
        rank, n, number = self.rank, len(chunk), 0
        ends = list(range(1, n + 1))  # by start: the end of the symbol that starts there; 0: merged away
        before = list(range(-1, n - 1))  # by start: the start of the symbol before
        agenda = [(rank[chunk[i:i + 2]], i, i + 1, i + 2) for i in range(n - 1) if chunk[i:i + 2] in rank]
        heapq.heapify(agenda)
        while agenda:
            _, i, mid, end = heapq.heappop(agenda)
            if ends[i] != mid or ends[mid] != end:
                continue  # one of the two has since merged
            number += 1
            if self._skipped(key, number - 1):
                continue
            ends[i], ends[mid] = end, 0
            if end < n:
                before[end] = i
                if (r := rank.get(chunk[i:ends[end]])) is not None:
                    heapq.heappush(agenda, (r, i, end, ends[end]))
            p = before[i]
            if p >= 0 and (r := rank.get(chunk[p:end])) is not None:
                heapq.heappush(agenda, (r, p, i, end))
        return self._ids(chunk, [i for i in range(n) if ends[i]])

    def _spelled(self, chunk: str, key: int) -> tuple[int, ...]:
        """A chunk with a literal U+2581: that in bytes, what is between as chunks of their own."""
        out: list[int] = []
        for k, part in enumerate(chunk.split(BLANK)):
            if k:
                out.extend(self.byte_ids[b] for b in BLANK.encode())
            if part:
                out.extend(self.segment(part.replace(" ", BLANK), _mixed(key ^ k)))
        return tuple(out)

    # ---- many chunks -------------------------------------------------------------------------

    def _merged(self, chunks: list[str], keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks that are rows, one after the other, their numbers, and how many candidates came up. Without keys none is skipped."""
        sizes = np.array([len(c) for c in chunks], dtype=np.int64)
        candidates, lengths = np.zeros(len(chunks), dtype=np.int32), np.zeros(len(chunks), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            texts = [chunks[i] for i in rows.tolist()]
            points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            symbols, alive, candidates[rows] = self._agenda(self.symbol_of[points].reshape(-1, size), None if keys is None else keys[rows])
            ids = self.symbol_piece[symbols]
            odd = (alive & (ids < 0)).any(axis=1)  # characters that are no pieces
            plain = ~odd
            lengths[rows] = alive.sum(axis=1)
            parts.append((rows[plain], ids[plain][alive[plain]]))
            spelled = [np.array(self._ids(texts[k].replace(" ", BLANK), np.flatnonzero(alive[k]).tolist()), dtype=np.int32) for k in np.flatnonzero(odd).tolist()]
            if spelled:
                lengths[rows[odd]] = [len(x) for x in spelled]
                parts.append((rows[odd], np.concatenate(spelled)))
        ends = np.cumsum(lengths)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        for rows, flat in parts:
            out[_ragged(ends[rows] - lengths[rows], lengths[rows])] = flat
        return out, lengths, candidates

    def _agenda(self, symbols: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols by the place where they start, which places are starts still, and candidates, of rows of equal length."""
        n, size = symbols.shape
        wide = size + 2  # a place without a symbol on either side
        now = np.full((n, wide), -1, dtype=np.int32)
        now[:, 1:-1] = symbols
        best = np.full((n, wide), _NONE, dtype=np.int32)  # by place: the rank of the pair that starts there
        found = self.pairs.find(now[:, 1:-2].ravel(), now[:, 2:-1].ravel())
        best[:, 1:-2] = np.where(found >= 0, self.symbol_rank[found], _NONE).reshape(n, -1)
        after, before = np.tile(np.arange(1, wide + 1), (n, 1)), np.tile(np.arange(-1, wide - 1), (n, 1))
        alive = np.zeros((n, wide), dtype=bool)
        alive[:, 1:-1] = True
        candidates = np.zeros(n, dtype=np.int32)
        rows = np.arange(n)
        flat_now, flat_best, flat_after, flat_before, flat_alive = now.ravel(), best.ravel(), after.ravel(), before.ravel(), alive.ravel()
        below = np.uint64(min(self.below, _MASK))
        while len(rows):
            at = best[rows].argmin(axis=1)  # of equal ranks the leftmost
            place = rows * wide + at
            some = flat_best[place] != _NONE
            rows, at, place = rows[some], at[some], place[some]
            number = candidates[rows]
            candidates[rows] = number + 1
            if keys is not None:
                drop = _mixed_all(keys[rows] + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP)) < below
                flat_best[place[drop]] = _NONE
                keep = ~drop
                row, at, place = rows[keep], at[keep], place[keep]
            else:
                row = rows
            edge = row * wide
            second = flat_after[place]
            third = flat_after[edge + second]
            merged = self.pairs.find(flat_now[place], flat_now[edge + second])
            flat_now[place], flat_after[place] = merged, third
            flat_before[edge + third] = at
            flat_best[edge + second], flat_alive[edge + second] = _NONE, False
            first = edge + flat_before[place]
            for left, right in ((first, place), (place, edge + third)):
                found = self.pairs.find(flat_now[left], flat_now[right])
                flat_best[left] = np.where(found >= 0, self.symbol_rank[found], _NONE)
        return now[:, 1:-1], alive[:, 1:-1], candidates

    def _learn(self, chunks: list[str]) -> None:
        """Results without skips of chunks not known yet."""
        new = list(dict.fromkeys(c for c in chunks if c not in self.known))
        if not new:
            return
        rows = [len(c) <= _SHORT and BLANK not in c for c in new]
        ids, lengths, candidates = self._merged([c for c, ok in zip(new, rows) if ok], None)
        ok = np.array(rows)
        all_lengths, all_candidates = np.zeros(len(new), dtype=np.int64), np.full(len(new), -1, dtype=np.int32)
        all_lengths[ok], all_candidates[ok] = lengths, candidates
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.known_ids = np.concatenate([self.known_ids, ids])
        self.known_lengths = np.concatenate([self.known_lengths, all_lengths])
        self.known_candidates = np.concatenate([self.known_candidates, all_candidates])

    def encode_all(self, texts: list[str], docs: list[str], variants: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, one after the other, and how many each has; an empty one has none."""
        if len(self.known) > _REMEMBERED:
            self._forget()
        of_text = [self.chunks.findall(" " + t) if t else [] for t in texts]
        chunks = [c for found in of_text for c in found]
        self._learn(chunks)
        per_text = np.array([len(found) for found in of_text], dtype=np.int64)
        seeds = np.array([xxhash.xxh64_intdigest(d.encode("utf-8", "surrogatepass"), self.seed * 1_000_003 + v & _MASK) for d, v in zip(docs, variants)], dtype=np.uint64)
        place = np.arange(len(chunks)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        keys = _mixed_all(np.repeat(seeds, per_text) + place.astype(np.uint64) * np.uint64(_STEP))
        number = np.fromiter(map(self.known.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        candidates = self.known_candidates[number]
        skips = np.zeros(len(chunks), dtype=bool)
        if self.below:
            drawn = np.maximum(candidates, 0)
            each = _ragged(np.ones(len(chunks), dtype=np.int64), drawn).astype(np.uint64)
            hit = _mixed_all(np.repeat(keys, drawn) + each * np.uint64(_STEP)) < np.uint64(min(self.below, _MASK))
            skips[np.repeat(np.arange(len(chunks)), drawn)[hit]] = True
        again = np.flatnonzero(skips)
        ids, lengths, _ = self._merged([chunks[i] for i in again.tolist()], keys[again])
        single = np.flatnonzero(candidates < 0)
        singles = [np.array(self._spelled(c, k) if BLANK in c else self.segment(c.replace(" ", BLANK), k), dtype=np.int32) for c, k in ((chunks[i], int(keys[i])) for i in single.tolist())]
        pool = np.concatenate([self.known_ids, ids, *singles])
        count = self.known_lengths[number]
        start = (np.cumsum(self.known_lengths) - self.known_lengths)[number]
        count[again], start[again] = lengths, len(self.known_ids) + np.cumsum(lengths) - lengths
        own = np.array([len(s) for s in singles], dtype=np.int64)
        count[single], start[single] = own, len(self.known_ids) + len(ids) + np.cumsum(own) - own
        edges = np.concatenate([[0], np.cumsum(count)])
        text_ends = edges[np.cumsum(per_text)]
        return pool[_ragged(start, count)], np.diff(np.concatenate([[0], text_ends]))

    def encode(self, text: str, variant: int = 0, doc: str = "") -> list[int]:
        """Piece ids of a whole text of document ``doc``; an empty one has none."""
        return self.encode_all([text], [doc], [variant])[0].tolist()

    def decode_all(self, flat: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of runs of piece ids; the blank that stands before each text is cut off."""
        starts, lengths = self.byte_starts[flat].copy(), self.byte_lengths[flat].copy()
        begin = np.cumsum(counts) - counts
        some = begin[counts > 0]
        starts[some] += 1
        lengths[some] -= 1
        data = self.byte_pool[_ragged(starts, lengths)]
        edges = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
        return pa.StringArray.from_buffers(len(counts), pa.py_buffer(edges.tobytes()), pa.py_buffer(data.tobytes()))

    def decode(self, ids) -> str:
        return self.decode_all(np.array(ids, dtype=np.int64), np.array([len(ids)]))[0].as_py()


_LOADED: dict[tuple, Pieces] = {}  # in a worker: the last tables


def _pieces(proto: bytes, dropout: float, seed: int) -> Pieces:
    key = (xxhash.xxh64_intdigest(proto), dropout, seed)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(proto, dropout, seed)
    return _LOADED[key]


def _proto(path: str) -> bytes:
    with open(path, "rb") as f:  # on the driver: executors get the model with the task
        return f.read()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, dropout: float = 0.1,
           seed: int = 42, variants: int = 4, model_path: str = MODEL) -> DataFrame:
    """``keep`` columns, ``variant`` and ``pieces`` (array of ids) for each row.

    Null and empty texts have no pieces; a null id counts as variant 0 and as the empty id; repeated rows have equal pieces.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_proto(model_path))
    variant = F.coalesce(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(variants)), F.lit(0)).cast("int")
    doc = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_doc")
    chosen = docs.select(F.col(text_col).cast("string").alias("_text"), doc, *(keep or []), F.when(F.col(id_col).isNull(), 0).otherwise(variant).alias("variant"))
    out = T.StructType([*chosen.schema.fields[2:], T.StructField("pieces", T.ArrayType(T.IntegerType()))])

    def run(batches):
        pieces = _pieces(shared.value, dropout, seed)
        for b in batches:
            flat, counts = pieces.encode_all([t or "" for t in b.column(0).to_pylist()], b.column(1).to_pylist(), b.column(b.num_columns - 1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], lists], out.names)

    return chosen.mapInArrow(run, out)


def decode(encoded: DataFrame, pieces_col: str = "pieces", keep: list[str] | None = None, model_path: str = MODEL) -> DataFrame:
    """``keep`` columns and ``decoded`` for each row; null pieces decode to null, none to the empty text."""
    small_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(_proto(model_path))
    chosen = encoded.select(F.col(pieces_col).alias("_pieces"), *(keep or []))
    out = T.StructType([*chosen.schema.fields[1:], T.StructField("decoded", T.StringType())])

    def run(batches):
        pieces = _pieces(shared.value, 0.0, 0)
        for b in batches:
            column = b.column(0)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = pc.if_else(column.is_valid(), pieces.decode_all(flat, counts), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], texts], out.names)

    return chosen.mapInArrow(run, out)


def op6(docs: DataFrame) -> DataFrame:
    """doc_id, variant, n_pieces, pieces_sha256 (of the ids, comma-joined) and whether decoding returns the text."""
    encoded = encode(docs, keep=["doc_id", "text"])
    digest = F.sha2(F.array_join(F.col("pieces").cast("array<string>"), ",").cast("binary"), 256)
    back = decode(
        encoded.select("doc_id", "text", "variant", "pieces", F.size("pieces").cast("long").alias("n_pieces"), digest.alias("pieces_sha256")),
        keep=["doc_id", "text", "variant", "n_pieces", "pieces_sha256"],
    )
    return back.select("doc_id", "variant", "n_pieces", "pieces_sha256", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))
