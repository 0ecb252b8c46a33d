"""Merge-dropout against a plain agenda, over random chunks, seeds and places."""

import random
from collections import Counter

import pytest
import xxhash

from riskloom.llm import piece_dropout

MASK = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15
MIXED = (
    "Hello  world\nfoo x \t y", "thereon inerting 12,5 (a) é — “q”", "日本 \U0001F389\U0001F600 áb \x00\x01", "a▁b ▁▁ c", "   leading and trailing   ",
    "x" * 200 + " " + "lalala" * 40, "", " ", "¹² 3³ don't e-mail_me@x.y", "internationalization " * 30,
)


def _hash(z):
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & MASK
    z = (z ^ z >> 27) * 0x94D049BB133111EB & MASK
    return z ^ z >> 31


def _plain(pieces, chunk, skips):
    """Symbols after the agenda: always the best and leftmost pair that is not skipped."""
    symbols, dead, number = list(chunk), [False] * len(chunk), 0  # dead: the pair that starts there is skipped
    while True:
        open_ = [(pieces.rank[symbols[i] + symbols[i + 1]], i) for i in range(len(symbols) - 1) if not dead[i] and symbols[i] + symbols[i + 1] in pieces.rank]
        if not open_:
            return symbols
        i = min(open_)[1]
        number += 1
        if skips(number - 1):
            dead[i] = True
            continue
        symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
        dead[i:i + 2] = [False]
        if i:
            dead[i - 1] = False


def _want(pieces, text, variant, doc, seed, below):
    """Ids of a text by the plain agenda."""
    out = []

    def spell(part, key):
        for s in _plain(pieces, part.replace(" ", piece_dropout.BLANK), lambda k: _hash(key + (k + 1) * STEP & MASK) < below):
            out.extend([pieces.ids[s]] if s in pieces.ids else [pieces.byte_ids[b] for b in s.encode()])

    start = xxhash.xxh64_intdigest(doc.encode(), seed * 1_000_003 + variant)
    for place, chunk in enumerate(pieces.chunks.findall(" " + text) if text else ()):
        key = _hash(start + place * STEP & MASK)
        if piece_dropout.BLANK not in chunk:
            spell(chunk, key)
            continue
        for k, part in enumerate(chunk.split(piece_dropout.BLANK)):
            if k:
                out.extend(pieces.byte_ids[b] for b in piece_dropout.BLANK.encode())
            spell(part, _hash(key ^ k))
    return out


@pytest.mark.parametrize("dropout, seed", [(0.0, 1), (0.1, 42), (0.5, 7), (1.0, 3)])
def test_equals_a_plain_agenda(sf_dir, dropout, seed):
    import pyarrow.parquet as pq

    pieces = piece_dropout.Pieces(piece_dropout._proto(piece_dropout.MODEL), dropout, seed)
    rng = random.Random(seed)
    letters = "abcdefghinorstuéß 1,▁\n"
    texts = [*MIXED, *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 80))) for _ in range(60))]
    texts += [t[:3000] for t in pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()[:12]]  # the slow side is the plain agenda
    docs, variants = [str(k) for k in range(len(texts))], [k % 4 for k in range(len(texts))]
    flat, counts = pieces.encode_all(texts, docs, variants)
    at, below = 0, int(dropout * 2 ** 64)
    for text, doc, variant, n in zip(texts, docs, variants, counts.tolist()):
        got = flat[at:at + n].tolist()
        at += n
        assert got == _want(pieces, text, variant, doc, seed, below) and pieces.decode(got) == text
        assert got == pieces.encode(text, variant, doc)  # the same alone and among others


def test_places_are_segmented_independently():
    pieces = piece_dropout.Pieces(piece_dropout._proto(piece_dropout.MODEL), 0.1, 42)
    word = "internationalization"
    written = piece_dropout.BLANK + word
    found = []
    for doc in range(40):
        ids = pieces.encode(" ".join([word] * 50), 0, str(doc))
        own, now = [], []
        for i in ids:
            if pieces.bytes_of[i].startswith(b" ") and now:
                own.append(tuple(now))
                now = []
            now.append(i)
        found += [*own, tuple(now)]
    counts = Counter(found)
    assert len(found) == 2000 and len(counts) > 4 and len(set(found[:50])) > 4
    rng = random.Random(5)
    flips = [tuple(pieces.ids[s] for s in _plain(pieces, written, lambda k: rng.random() < 0.1)) for _ in found]
    want = Counter(flips)  # a coin for every candidate
    assert all(abs(counts[x] - want[x]) < 0.05 * len(found) for x in want | counts)


def test_workers_forget_without_effect(monkeypatch):
    proto = piece_dropout._proto(piece_dropout.MODEL)
    kept, small = piece_dropout.Pieces(proto, 0.2, 9), piece_dropout.Pieces(proto, 0.2, 9)
    monkeypatch.setattr(piece_dropout, "_REMEMBERED", 3)
    for k, text in enumerate(MIXED * 2):
        ids = small.encode(text, 0, str(k))
        assert len(small.known) <= 3 + len(set(small.chunks.findall(" " + text)))
        assert ids == kept.encode(text, 0, str(k))
