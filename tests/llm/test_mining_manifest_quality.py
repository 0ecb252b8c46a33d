"""Hard negatives, the Merkle manifest and the quality classifier against plain versions, on small tables with odd rows."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from riskloom.llm import hard_negatives as hn
from riskloom.llm import manifest as mf
from riskloom.llm import quality_classifier as qc

# ---- hard negatives --------------------------------------------------------------------------------


def _plain_mine(rows):
    """The contract as written, over ``(vec_id, vector, label)``; rows that agree in all count once."""
    seen = []
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        c = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        y = math.fmod(y + 1, 10) if i % 7 == 0 else y
        if sum(x * x for x in c) <= 1 << 60 and (i, y, c) not in seen:
            seen.append((i, y, c))
    out = []
    for i, y, c in seen:
        if i % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(c, d)), j, z) for j, z, d in seen if j != i and len(d) == len(c)))
        for p, j, z in [s for s in scored if s[2] == y][:5]:
            window = [s for s in scored if s[2] != y and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(i, j, k, m, -p, -n) for k, (n, m, _) in enumerate(window, 1)]
    return sorted(out)


def _mined(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "vec_id long, embedding array<float>, label int, anchor string, id double")


def test_products_are_exact_in_any_range():
    rng = np.random.default_rng(1)
    for top, width in ((3, 5), (300, 64), (300, 1000), (1 << 28, 6)):
        a, b = rng.integers(-top, top + 1, (7, width)), rng.integers(-top, top + 1, (9, width))
        want = np.array([[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a], dtype=object)
        primes = hn.primes_for(width * float(top) ** 2)
        got = hn.products(hn.residues(a.astype(float), primes), hn.residues(b.astype(float), primes), primes)
        assert (got.astype(object) == want).all()
    assert hn.primes_for(65600.0) == (509, 503) and len(hn.primes_for(2.0**60)) == 7


def test_mining_equals_the_plain_version(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    assert _mined(hn.op11(table)) == _plain_mine(rows)


ODD_VECTORS = [
    (0, [0.5, 0.25], 1), (100, [0.5, -0.5], 2), (200, None, 1), (300, [0.1, float("nan")], 1), (400, [float("inf"), 1.0], 2), (500, [], 3), (501, [], 3), (502, [], 4), (600, [1.0], None), (None, [0.5, 0.5], 1),
    (0, [0.5, 0.25], 1), (700, [0.5, 0.25], 9), (800, [3e38, 1.0], 1), (801, [1.0, None], 1), (802, [-0.5, -0.25], 1), (803, [1.0, 2.0, 3.0], 1), (900, [1.0, 2.0, 3.5], 5), (901, [-1.0, 2.0, 3.0], 6),
    *[(1000 + k, [0.5, 0.25], 1) for k in range(1, 14)], *[(2001 + k, [0.5, 0.2], 2) for k in range(13)], *[(3001 + k, [0.45, 0.25], k % 4) for k in range(30)], (1101, [0.5, 0.25], 1), (1101, [0.5, 0.25], 1),
]


def test_mining_of_odd_rows_and_waves(spark):
    df = _frame(spark, ODD_VECTORS)
    want = _plain_mine(ODD_VECTORS)
    assert want and _mined(hn.op11(df)) == want == _mined(hn.op11(df.repartition(7)))
    label = "case when vec_id % 7 = 0 then (label + 1) % 10 else label end"
    waves = hn.mine(df.selectExpr("vec_id", "embedding", f"{label} as label"), hn.F.col("id") % 100 == 0, wave_components=6)
    assert _mined(waves) == want
    assert hn.op11(df.limit(0)).count() == 0 and hn.op11(df.where("vec_id % 100 <> 0")).count() == 0
    assert hn.op11(df.where("vec_id = 0")).count() == 0


def test_best_keeps_ties_of_the_smallest_ids():
    rng = np.random.default_rng(4)
    best, seen = hn.Best(3, 5), []
    for _ in range(6):
        ids, scores = rng.integers(0, 60, 50), rng.integers(0, 4, (3, 50))
        seen.append((ids, scores))
        best.add(0, scores, ids, np.ones((3, 50), dtype=bool))
    for g in range(3):
        want = sorted({(-int(s), int(i)) for ids, scores in seen for i, s in zip(ids, scores[g])})[:5]
        assert [(-int(s), int(i)) for s, i in zip(best.scores[g], best.ids[g])] == want


# ---- manifest --------------------------------------------------------------------------------------


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _plain_tree(nodes):
    """Root and, for each node, the siblings by level as (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(paths):
            run = nodes[at[k] // 3 * 3:at[k] // 3 * 3 + 3]
            p.append(("".join(run[:at[k] % 3]), "".join(run[at[k] % 3 + 1:])))
            at[k] //= 3
        nodes = [_h(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def _plain_manifest(rows):
    """Rows ``(doc_id, source, lang, n_chars, text)``."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sources, out = {}, []
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
        sources.setdefault(r[1], []).append((r[0], _h(*map(field, r)), _h(*map(field, (*r[:4], r[4].replace("\n", "") if bad else r[4])))))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = _plain_tree([x[1] for x in sources[s]])
    root, above = _plain_tree([trees[s][0] for s in order]) if order else (None, [])
    for s, up in zip(order, above):
        for (i, leaf, other), path in zip(sources[s], trees[s][1]):
            h = other
            for a, b in path + up:
                h = _h(a, h, b)
            out.append((i, leaf, trees[s][0], root, _h("".join(a + b for a, b in path + up)), h, h == root))
    return sorted(out, key=str)


def _listed(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [[1], [2, 1], [3, 4, 1], [244, 9, 1, 1], [800, 243]])
def test_manifest_equals_the_plain_version(spark, sizes):
    rows = [(1000 * s + k, f"s{s}", "en", k, f"line {k}\nend {s}") for s, n in enumerate(sizes) for k in range(n)]
    got = _listed(mf.op12(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert got == _plain_manifest(rows)
    assert {r[-1] for r in got} <= {True, False} and any(r[-1] for r in got)


ODD_ROWS = [
    (1, "b", "en", 3, "a\nb"), (1, "b", "en", 3, "a\nb"), (1, "b", None, None, None), (None, "b", "en", 1, "x\n"), (None, None, None, None, None), (2, None, "de", 5, ""), (4, "", "de", 5, "\n\n"),
    (5, "é▁", "en", 70000, "long\n" * 70000), (6, "Z", "en", 1, "\U0001F389"), (-7, "b", "en", 1, "minus"), (3, "b", "en", 3, "a\nb"),
]


def test_manifest_of_odd_rows(spark):
    df = spark.createDataFrame([(*r, "clash", "x") for r in ODD_ROWS], SCHEMA + ", leaf string, digest string")
    assert _listed(mf.op12(df)) == _plain_manifest(ODD_ROWS)
    assert mf.op12(df.limit(0)).count() == 0


def test_manifest_of_many_sources(spark):
    rows = [(k, f"source {k % 700}", "en", k, "t\n") for k in range(900)]
    assert _listed(mf.op12(spark.createDataFrame(rows, SCHEMA))) == _plain_manifest(rows)


def test_any_change_is_noticed(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for r in mf.op12(table).collect():
        text = None
        assert r["verified"] == (r["folded_root"] == r["root"]), text
    assert mf.manifest(table.select("doc_id", "source", "lang", "n_chars", "text"), ["doc_id", "source", "lang", "n_chars", "text"]).where("not verified").count() == 0


# ---- quality classifier ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def _plain_counts(text):
    """How many features of each kind a text has, and how many distinct ones, by strings instead of hashes."""
    text = text.lower()
    words = [w for w in qc_split(text) if w]
    pairs = ["same" if a == b else (a, b) for a, b in zip(words, words[1:])]
    grams = [(n, text[i:i + n]) for n in qc.SIZES for i in range(len(text) - n + 1)]
    return [("w", w) for w in words] + [("p", p) for p in pairs] + [("g", g) for g in grams]


def qc_split(text):
    import re

    return re.split(r"[\x20\x09-\x0D]+", text)


@pytest.mark.parametrize("text", ["", " ", "a", "Ab ab\tAB c", "x y x y x", "é▁ü 日本 \U0001F389 \x00\x01 z", "one\ntwo  two\n\nthree " * 30])
def test_features_are_words_pairs_and_character_runs(text):
    want = _plain_counts(text)
    got = np.concatenate([np.zeros(0, np.int64), *qc.features(text)])
    assert len(got) == len(want)
    names = {}
    for name in want:
        names[name] = names.get(name, 0) + 1
    buckets, share = qc.shares(text)
    assert len(buckets) <= len(names) <= len(buckets) + 3  # buckets may be shared
    assert not want or abs(float(share.sum()) - 1) < 1e-5
    if len(buckets) == len(names):
        assert sorted(np.rint(share * len(want)).astype(int).tolist()) == sorted(names.values())


def test_long_texts_are_read_whole_in_pieces(monkeypatch):
    text = "word and other words " * 200
    whole = np.sort(np.concatenate(list(qc.features(text))))
    monkeypatch.setattr(qc, "PIECE", 64)
    pieces = list(qc.features(text))
    assert len(pieces) > 50
    words = lambda x: x[x < (1 << qc.WORD_BITS)]
    cut = np.concatenate(pieces)
    assert len(words(cut)) == len(words(whole)) - (len(pieces) - 1)  # one pair less at each end
    assert len(np.concatenate(list(qc.features("x" * 300)))) > 0


def test_a_step_follows_the_slope():
    """The move of one step equals the numeric slope of the loss."""
    rng = np.random.default_rng(2)
    own, share = np.array([5, 9, qc.BUCKETS - 1], np.int32), np.array([0.5, 0.25, 0.25], np.float32)
    model = qc.Model(rng.normal(0, 1, (qc.BUCKETS, qc.DIM)).astype(np.float32), rng.normal(0, 1, (2, qc.DIM)).astype(np.float32), rng.normal(0, 1, 2).astype(np.float32))

    def loss(vectors, outputs, offsets):
        z = outputs.astype(float) @ (share.astype(float) @ vectors[own].astype(float)) + offsets
        return float(np.log(np.exp(z - z.max()).sum()) + z.max() - z[1])

    after, moved = qc.descend(model, [(own, share, 1)], [1e-2])
    assert set(np.flatnonzero(moved)) == set(own.tolist())
    eps = 1e-3
    for k, place in ((0, (5, 2)), (1, (1, 3))):
        parts = [model.vectors.copy(), model.outputs.copy(), model.offsets.copy()]
        parts[k][place] += eps
        up = loss(*parts)
        parts[k][place] -= 2 * eps
        slope = (up - loss(*parts)) / (2 * eps)
        step = ([after.vectors, after.outputs][k][place] - [model.vectors, model.outputs][k][place]) / -1e-2
        assert abs(slope - step) < 2e-3


def _made(spark, n=60):
    good = [(k, f"the quiet river runs past house {k} and field {k % 7}") for k in range(n)]
    bad = [(1000 + k, f"win$$$ buy### {k} now%%% win$$$ " * (1 + k % 3)) for k in range(n // 3)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad], "doc_id long, quality int")


def test_one_shard_is_plain_descent(spark):
    docs, labels = _made(spark, 12)
    got = qc.train(docs, labels, held_out=None, rounds=1, least_steps=30, rate=0.2)
    rows = sorted(((r["h"], r["doc_id"], r["text"], r["quality"]) for r in docs.join(labels, "doc_id").selectExpr("*", "xxhash64(doc_id, 0) as h").collect()))
    passes = -(-30 // len(rows))
    steps = passes * len(rows)
    found = [(*qc.shares(t), y) for _, _, t, y in rows] * passes
    want, _ = qc.descend(qc.start(), found, [0.2 * (1 - (i / steps) / 1.5) for i in range(steps)])
    assert np.abs(got.vectors - want.vectors).max() < 1e-5 and np.abs(got.outputs - want.outputs).max() < 1e-4


def test_training_does_not_depend_on_partitions(spark):
    docs, labels = _made(spark)
    options = dict(held_out=None, rounds=2, least_steps=200)
    a, b = qc.train(docs, labels, **options), qc.train(docs.repartition(5), labels.repartition(3), **options)
    assert (a.vectors == b.vectors).all() and (a.outputs == b.outputs).all()
    scores = {r["doc_id"]: r["score"] for r in qc.score(docs, a, keep=["doc_id"]).collect()}
    for r in docs.limit(5).collect():
        own, share = qc.shares(r["text"])
        z = a.outputs @ (share @ a.vectors[own]) + a.offsets
        assert abs(scores[r["doc_id"]] - 1 / (1 + math.exp(z[0] - z[1]))) < 1e-4
    assert min(s for i, s in scores.items() if i < 1000) > max(s for i, s in scores.items() if i >= 1000)


def test_quality_of_held_out_documents(table):
    docs, labels = table
    got = {r["doc_id"]: r for r in qc.op13(docs, labels).collect()}
    assert len(got) == docs.count() and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in got.items())
    marked = [(got[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    good, bad = [s for s, y in marked if y], [s for s, y in marked if not y]
    assert sum(a > b for a in good for b in bad) >= 0.95 * len(good) * len(bad) and sum(s >= 0.3 for s in good) == len(good)


def test_quality_of_odd_rows(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (3, ""), (3, "other"), (None, "x y"), (7, "é▁ü 日本 \U0001F389 \x00 z"), (8, "long " * 60000), (9, "q" * 50000)]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, score double, y int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (8, 7), (9, None), (55, 1)], "doc_id long, quality int")
    got = qc.op13(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 2} | {r["score"] for r in qc.score(docs.where("text = ''"), qc.start()).collect()}) <= 2
    assert {r["score"] for r in qc.op13(docs, labels.limit(0)).collect()} == {0.5}
    assert qc.op13(docs.limit(0), labels).count() == 0
