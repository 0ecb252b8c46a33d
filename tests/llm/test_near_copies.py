"""The pipeline's near-duplicate stage against five-word Jaccard similarity by brute force."""

import random

import corpus_pipeline as P

from riskloom.llm import simhash


def _sets(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _kept(rows):
    """Ids that stay: the least of each component of pairs at 0.8 or more."""
    ids, root = sorted(rows), {i: i for i in rows}
    sets = {i: _sets(rows[i]) for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a == b or min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) / len(a | b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in ids}


def _made():
    """Texts of 200 words; copies with words changed at one place (similar) or at many (not similar enough)."""
    rng, rows = random.Random(7), {}
    for g in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for copy in range(5):
            own = list(words)
            for _ in range(copy * 2):
                own[rng.randrange(200)] = f"x{rng.randrange(5000)}"
            rows[g * 5 + copy] = " ".join(own)
    return rows | {900: "", 901: " \n", 902: "a b c", 903: "A  b c", 904: "a b d"}


def test_near_copies_match_brute_force(spark):
    rows = _made()
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want = _kept(rows)
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == want
    assert {r["doc_id"] for r in simhash.one_of_each(docs, cell_rows=2).collect()} == want


def test_stage_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"] for r in P.drop_near_duplicates(spark, docs, sf_dir).collect()}
    assert got == _kept({r["doc_id"]: r["text"] for r in docs.collect()})


def test_simhash_components_propose_and_texts_decide(spark):
    """Without any band: one text with a last word changed is found by its fingerprint; texts alike in neither stay."""
    rng = random.Random(11)
    rows = {}
    for g in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(2000)]
        rows[2 * g], rows[2 * g + 1] = " ".join(words), " ".join([*words[:-1], "changed"])
    fps = {i: simhash.fingerprint(t.encode()) for i, t in rows.items()}
    near = {i for i in rows if i % 2 and ((fps[i] ^ fps[i - 1]) & (2 ** 64 - 1)).bit_count() <= 4}
    assert near
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.one_of_each(docs, bands=0).collect()} == set(rows) - near
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == _kept(rows)
