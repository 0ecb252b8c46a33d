"""Corpus operators against brute force, round trips and held-out accuracy, on small fixtures with odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from riskloom.llm import components, licenses, lm_scoring, mixing, pii, piece_dropout, quality, queries, simhash, sketches, token_counts, toxicity
from riskloom.llm.common import shared_dir

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, "a b c d e f g", "en", "s0"), (2, None, None, None), (3, "", "en", "s0"), (4, "a b c d e f g", "en", "s0"), (4, "a b c d e f g", "en", "s0"),
    (None, "x y", "fr", "s1"), (6, "  \t\n ", "en", "s1"), (7, "é▁ü 日本 \U0001F389 \x00\x01 z", "de", "s1"), (8, "long " * 60000, "en", "s0"), (9, "A B C D E F G", "en", "s0"),
    (10, "q" * 50000, "en", "s2"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, len(r[1] or ""), "clash", 0.5) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, fp double")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(sf_dir):
    d = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    return dict(zip(d["doc_id"], d["text"]))


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _fp(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(ids, fps, bits):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(ids))]


def test_every_query_is_registered():
    names = queries.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names


def test_simhash_matches_brute_force(docs, texts):
    got = {r["doc_id"]: r for r in simhash.op5(docs).collect()}
    ids = sorted(texts)
    fps = [_fp(texts[i]) for i in ids]
    assert [got[i]["fingerprint"] for i in ids] == [f"{x:016x}" for x in fps]
    assert [got[i]["component_id"] for i in ids] == _components(ids, fps, 4)


def test_simhash_odd_rows(spark, odd):
    got = simhash.op5(odd).collect()
    assert len(got) == len(ODD)
    ids, fps = [r["doc_id"] for r in got], [int(r["fingerprint"], 16) for r in got]
    assert sorted(fps) == sorted(_fp(r[1]) for r in ODD)
    assert [r["component_id"] for r in got] == _components(ids, fps, 4)
    assert simhash.op5(odd.limit(0)).count() == 0
    kept = simhash.one_of_each(odd).collect()
    assert len([r for r in kept if r["doc_id"] in (1, 4, 9)]) == 1 and len(kept) < len(ODD)


def test_cells_lose_no_pair():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(a), dtype=np.uint64)
    assert (np.bitwise_count(a ^ b) >= simhash.manhattan(simhash.embed(a), simhash.embed(b))).all()
    assert (simhash.cells(a, 4) == simhash.cells(b, 4)).any(axis=1).all()


def test_hot_cells_are_dealt_as_blocks(spark):
    rng = np.random.default_rng(5)
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(300)} | {int(x) for x in rng.integers(0, 1 << 62, 50)})
    frame = spark.createDataFrame([(x if x < 1 << 63 else x - (1 << 64),) for x in fps], "fp long")
    found = components.connected_components(simhash.links(frame, 4, cell_rows=16))
    roots = {r["node"]: r["root"] for r in found.collect()}
    want = _components(list(range(len(fps))), fps, 4)
    mine = [roots.get(x if x < 1 << 63 else x - (1 << 64), x) for x in fps]
    assert len({(a, b) for a, b in zip(want, mine)}) == len(set(want)) == len(set(mine))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (3, 2)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[200 + i] for i in range(30)} == {100} == {got[100]}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _brute_quality(text):
    w = WORDS.findall(text or "")
    seen, places = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    for found in seen.values():
        if len(found) > 1:
            places |= {i + k for i in found for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(places)


def test_quality_matches_brute_force(docs, texts, odd):
    for r in quality.op9(docs).collect():
        n = _brute_quality(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r["base_failed"] and r["kept"])
    got = quality.op9(odd).collect()
    assert sorted(r["n_words"] for r in got) == sorted(_brute_quality(r[1])[0] for r in ODD)
    assert sorted(r["n_repeat_words"] for r in got) == sorted(_brute_quality(r[1])[4] for r in ODD)
    assert quality.op9(odd.limit(0)).count() == 0


def test_ablations_follow_the_ledger(docs):
    ledger = quality.ledger(docs).cache()
    rows = ledger.select("fail_bits").collect()
    for r in quality.ablations(ledger).collect():
        mask, rule = quality.POLICIES[r["policy"]], quality.bit(r["rule"])
        bits = [x["fail_bits"] & mask for x in rows]
        assert (r["dropped"], r["failing"], r["only_this"]) == (sum(b != 0 for b in bits), sum(b & rule != 0 for b in bits), sum(b == rule for b in bits))


_PII = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def _brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    ok = [lambda m: True, lambda m: all(int(p) <= 255 for p in m.split(".")), lambda m: 14 <= len(digits(m)) <= 19 and _luhn(digits(m)), lambda m: 10 <= len(digits(m)) <= 15]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(_PII) for m in p.finditer(text or "") if ok[k](m.group()))


TRICKY = [
    "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.0003.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 1", "+1 (017) 555-7713 +44 20 +12345678901234567",
    "é🎉 me@mail.example.com, +49 30 1234567", "a@b.c" * 300, "1.1.1.1 " * 600, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "x.y@z.w-v.u@t.s", "", "@@@ ... +++",
    "5" * 4000, "a" * 20000 + "@", "call 555-123-4567 now",
]


def test_pii_base_spans_match_brute_force(spark, docs, texts, odd):
    tricky = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for frame, source in ((docs, texts), (tricky, dict(enumerate(TRICKY)))):
        for r in pii.op10(frame).collect():
            want = ",".join(f"{pii.BASE_KINDS[k]}:{a}:{b}" for a, k, b in _brute_spans(source[r["doc_id"]]))
            assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), source[r["doc_id"]][:80]
            assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
    assert pii.op10(odd).count() == len(ODD) and pii.op10(odd.limit(0)).count() == 0


def test_pii_added_spans_are_found(spark):
    """Planted spans of every added kind, keys of hundreds of characters included, among clean texts: recall and precision."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    key = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    name = lambda: str(rng.choice(pii.GIVEN_NAMES)) + " " + word().capitalize()
    made = {
        "secret": lambda: f'token = "{key(int(rng.choice([32, 40, 64, 240, 900])))}"', "number": lambda: f"phone: {rng.integers(200, 999)}-{rng.integers(200, 999)}-{rng.integers(1000, 9999)}",
        "mail_variant": lambda: f"contact {word()}.{word()} [at] {word()} [dot] com", "person": lambda: f"Dear {name()}", "address": lambda: f"address: {rng.integers(1, 999)} {word().capitalize()} Street",
    }
    rows, want = [], {}
    for i in range(400):
        text = " ".join(word() for _ in range(30))
        kind = [*made, None][i % 6]
        if kind:
            text += " " + made[kind]() + " " + " ".join(word() for _ in range(20))
        rows.append((i, text))
        want[i] = kind
    got = {r["doc_id"]: {x.split(":")[0] for x in r["spans"].split(",") if x} for r in pii.op10(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in made:
        own = [i for i in want if want[i] == kind]
        assert np.mean([kind in got[i] for i in own]) > 0.9, kind
    assert all(not got[i] for i in want if want[i] is None)


def test_redaction_leaves_the_rest(spark):
    frame = spark.createDataFrame([(1, "é🎉 me@mail.example.com and 10.0.0.1!"), (2, "clean"), (3, None)], "doc_id long, text string")
    got = pii.find(frame, keep=["text"]).withColumn("out", pii.redacted(F.col("text"), F.col("spans")))
    assert {r["id"]: r["out"] for r in got.collect()} == {1: "é🎉 <email> and <ip>!", 2: "clean", 3: None}


def test_em_tells_good_labelers_apart():
    rng = np.random.default_rng(1)
    counts = {}
    for _ in range(4000):
        true = rng.random() < 0.3
        v = sum(1 << k for k in range(6) if rng.random() < ((0.9 if true else 0.05) if k < 4 else 0.5))
        counts[v] = counts.get(v, 0) + 1
    prior, yes, no = pii.reliabilities(counts)
    assert abs(prior - 0.3) < 0.05 and yes[0] > 0.8 and no[0] < 0.15 and abs(yes[5] - no[5]) < 0.15
    assert pii.reliabilities({0b111111: 50})[0] > 0.9


def test_toxicity_learns_and_handles_odd_rows(spark, odd, labels):
    rows = [(i, ("you are an idiot and stupid moron " if i % 3 == 0 else "the weather is fine today and calm ") + f"word{i} " * (i % 7), i % 3 == 0) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.op3(docs, known).collect()}
    held = [(i, y) for i, _, y in rows if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert len(held) > 50 and np.mean([(got[i]["predicted"] == 1) == y for i, y in held]) > 0.97
    scored = toxicity.op3(odd, known).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["score"] < 1e-9 for r in toxicity.op3(odd, known.limit(0)).collect())
    assert toxicity.op3(odd.limit(0), known).count() == 0


def test_lm_base_and_normalisation(spark, docs, texts):
    model, counts = lm_scoring.train(docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7, F.lit(0)) != 2), pilot_bytes=200_000)
    a1, a2, b, z = lm_scoring.tables(model)
    for i, j in ((0, 0), (5, 9), (1800, 2000)):
        assert abs(np.exp(a1[i].astype(float) + a2[j] + b - z[i, j]).sum() - 1) < 1e-3
    c = {}
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w in [*t.encode().lower().split(), b""]:
                c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, model, counts, keep=["doc_id"]).collect()}
    for i, t in texts.items():
        w = [*t.encode().lower().split(), b""]
        assert abs(got[i]["base_score"] - sum(np.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w) + 1e-6
        assert got[i]["n_tokens"] == len(w) and got[i]["n_known"] == sum(x in c for x in w)
    share = lambda k: sum(1 for w in c if w not in model.head[:lm_scoring.WORDS] and lm_scoring.bucket_class(w) == k)
    assert abs(10 ** model.shares[1900] - (share(1900) + 1 + sum(n for w, n in c.items() if w not in model.head[:lm_scoring.WORDS] and lm_scoring.bucket_class(w) == 1900))) < 1e-6


def test_lm_is_the_same_however_partitioned(spark, docs):
    frame = docs.withColumn("doc_id", F.col("doc_id") + 1)
    totals = []
    for n in (2, 16):
        model, counts = lm_scoring.train(frame.repartition(n), pilot_bytes=50_000, shard_bytes=100_000)
        got = lm_scoring.score(frame, model, counts, keep=["doc_id"]).collect()
        totals.append({r["doc_id"]: r["score"] for r in got})
    assert max(abs(totals[0][i] - totals[1][i]) for i in totals[0]) < 1e-6


def test_lm_end_is_kept_below_a_short_head(spark):
    frame = spark.createDataFrame([(1, "a a a a b b b b c c c c d d d"), (2, "a b c a b c e")], "doc_id long, text string")
    model, counts = lm_scoring.train(frame, head=3)
    assert model.head[0] == b"" and model.counts[0] == 2
    got = {r["doc_id"]: r for r in lm_scoring.score(frame, model, counts, keep=["doc_id"]).collect()}
    c = {"a": 6, "b": 6, "c": 6, "d": 3, "e": 1, "": 2}
    n, v = sum(c.values()), len(c)
    want = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ["a", "b", "c", "a", "b", "c", "e", ""])
    assert abs(got[2]["base_score"] - want) < 1e-9 and got[2]["n_known"] == 8 and np.isfinite(got[2]["score"])


def test_lm_odd_rows(odd):
    got = lm_scoring.op7(odd).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(WORDS.findall(r[1] or "")) + 1 for r in ODD)
    assert all(np.isfinite(r["score"]) for r in got) and lm_scoring.op7(odd.limit(0)).count() == 0


def test_sketches(spark, docs, texts, odd):
    got = {r["doc_id"]: r for r in sketches.op8(docs).collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        cut = len(t) // 3
        edited = t[:len(t) - cut] + nxt[:cut] if cut else t
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["fingerprint"] == sketches.spelled(sketches.sketch(t)) and got[i]["edited_fingerprint"] == sketches.spelled(sketches.sketch(edited))
        mine, other, own = set(sketches.sketch(t).tolist()), set(sketches.sketch(nxt).tolist()), set(sketches.sketch(edited).tolist())
        like = lambda a, b: len(a & b) / min(len(a), len(b)) if a and b else float(not a and not b)
        assert abs(got[i]["near_edited"] - like(mine, own)) < 1e-12 and abs(got[i]["near_next"] - like(mine, other)) < 1e-12
    small = sketches.beside_edited(docs, rows=16).withColumnRenamed("id", "doc_id")
    assert small.exceptAll(sketches.op8(docs)).count() == 0
    a, b = sorted(texts.values(), key=len)[-2:]
    assert (sketches.merged(sketches.sketch(a), sketches.sketch(b)) == np.unique(np.concatenate([sketches.sketch(a), sketches.sketch(b)]))).all()
    assert sketches.op8(odd).count() == len(ODD) and sketches.op8(odd.limit(0)).count() == 0
    ordered = sorted([(r[0] is None, -(r[0] or 0), (r[1] or "")) for r in ODD])
    nexts = [(t, ordered[(k + 1) % len(ordered)][2]) for k, (_, _, t) in enumerate(ordered)]
    edits = [t[:len(t) - len(t) // 3] + n[:len(t) // 3] for t, n in nexts]
    for rows in (1, 2, 2048):  # null ids come last, equal ids by text, whatever the ranges
        assert sorted(r["edited_sha256"] for r in sketches.beside_edited(odd, rows=rows).collect()) == sorted(hashlib.sha256(e.encode()).hexdigest() for e in edits)


def test_pieces_round_trip(odd, docs):
    assert all(r["lossless"] for r in piece_dropout.op6(odd).collect()) and all(r["lossless"] for r in piece_dropout.op6(docs).collect())
    proto = piece_dropout._proto(piece_dropout.MODEL)
    import sentencepiece

    plain, drops = piece_dropout.Pieces(proto, 0.0, 1), piece_dropout.Pieces(proto, 0.3, 1)
    model = sentencepiece.SentencePieceProcessor(model_proto=proto)
    for t in ("Hello  world\nfoo x \t y", "thereon inerting 12,5 (a) é", ""):
        assert plain.encode(t) == model.encode(t)
        assert drops.encode(t, 2) == piece_dropout.Pieces(proto, 0.3, 1).encode(t, 2)
    word = "internationalization"
    assert len({tuple(drops.encode(word, v)) for v in range(8)}) > 3
    assert piece_dropout.op6(odd.limit(0)).count() == 0


def test_licenses(spark, odd):
    lines = ["This work is licensed under the GNU General Public License, version 3.", "RELEASED UNDER THE MIT LICENSE.", "permission to speak was never asked", "Licensed under CC BY-NC 4.0.", "plain", "All rights reserved."]
    frame = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "doc_id long, text string")
    got = {(r["line"], r["license"]) for r in licenses.op1(frame).collect()}
    assert got == {(0, "GPL-3.0"), (1, "MIT"), (3, "CC-BY-NC-4.0"), (5, "Proprietary")}
    assert licenses.wording_differences("released under the old MIT license", licenses.TEMPLATES["MIT"]) == 1
    assert licenses.op1(odd).count() == 0 and licenses.op1(odd.limit(0)).count() == 0


def test_token_rollup(spark, odd, docs, texts):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    first = {}
    for r in sorted(docs.select("doc_id", "text", "source", "lang").collect()):
        first.setdefault(r["text"], r)
    want = {}
    for t, r in first.items():
        n, m = want.get((r["source"], r["lang"]), (0, 0))
        want[r["source"], r["lang"]] = (n + 1, m + len(enc.encode_ordinary(t)) + 1)
    assert {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in token_counts.op2(docs).collect()} == want
    assert sum(r["n_docs"] for r in token_counts.op2(odd).collect()) == len({r[1] or "" for r in ODD})
    assert token_counts.op2(odd.limit(0)).count() == 0
    ledger = token_counts.Ledger(spark, f"{shared_dir(spark)}/ledger-test")
    rows = spark.createDataFrame([("s", "en", "v1", 5), ("s", None, "v1", 7)], "source string, lang string, tokenizer string, n_tokens long")
    assert ledger.commit("a", token_counts.inserts(rows)) and not ledger.commit("a", token_counts.inserts(rows))
    ledger.commit("b", token_counts.deletes(rows.limit(1)))
    assert [tuple(r) for r in ledger.rollup(["a", "b", "never"]).collect()] == [("s", None, "v1", 1, 7)]


def test_mixing_meets_targets(spark, odd, docs, labels):
    _, members, rate, left = mixing.fit(docs, labels, keep=["doc_id"])
    assert max(left) <= 1e-3
    row = members.withColumn("r", rate).agg(F.sum(F.col("r") * F.col("tokens") * F.get("p", F.lit(0))).alias("a"), F.sum(F.col("r") * F.col("tokens") * F.get("p", F.lit(1))).alias("b"), F.min("r").alias("m")).first()
    assert row["m"] >= 0 and members.where(rate > 1).count() == 0 and abs(row["b"] / (row["a"] + row["b"]) - 0.05) < 1e-3
    assert mixing.op4(odd, labels).count() == len(ODD) and mixing.op4(odd.limit(0), labels).count() == 0
    assert all(r["p_high"] == 0.5 for r in mixing.op4(odd, labels.limit(0)).collect())
    kept = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], 10) for i in range(100)], "i int, p array<double>, tokens long")
    expr, left = mixing.fit_rates(kept, [500.0, 50.0], tolerance=1e-6)
    assert max(left) < 1e-4 and {round(r["r"], 3) for r in kept.select(expr.alias("r")).collect()} == {1.0, 0.1}
    assert mixing.fit_rates(kept, [600.0, 50.0])[1][0] > 0.1  # out of reach for rates of one


def test_rates_match_brute_force(spark):
    """The least squared residual over all rates from zero to one, by plain projected gradient in numpy."""
    rng = np.random.default_rng(8)
    n = rng.integers(1, 400, 300)
    p = rng.dirichlet([0.4, 0.4, 0.4], 300)
    frame = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "tokens long, p array<double>")
    mass = (n[:, None] * p).sum(axis=0)
    for part in ([0.9, 0.5, 0.3], [1.2, 0.2, 0.6]):  # within reach, and not
        wanted = mass * part
        expr, left = mixing.fit_rates(frame, wanted.tolist(), tolerance=1e-4)
        r = np.full(300, 0.5)
        for _ in range(20000):
            e = (r[:, None] * n[:, None] * p).sum(axis=0) - wanted
            r = np.clip(r - (p @ (e / wanted)) / (mass / wanted).sum(), 0, 1)
        best = ((r[:, None] * n[:, None] * p).sum(axis=0) - wanted) ** 2 / wanted
        mine = (np.array(left) * wanted) ** 2 / wanted
        assert mine.sum() <= best.sum() * 1.05 + (1e-4 * mass.max()) ** 2 / wanted.min()
