"""Lookalikes by shared spellings equal plain edit distance over all pairs."""

import random

from riskloom.operators import lookalikes, urls


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _fold(x):
    return x.lower().replace("rn", "m").translate(str.maketrans("0134578|!@$", "oleastblias"))


def _alike(label, token):
    if label == token or not label or not token:
        return False
    d = _distance(label, token) if abs(len(label) - len(token)) <= 2 else 9
    return _fold(label) == _fold(token) or len(token) >= 5 and d <= 1 or len(token) >= 6 and len(label) == len(token) and d <= 2


def _spoiled(rng, word):
    word = list(word)
    for _ in range(rng.randrange(1, 4)):
        at, how = rng.randrange(len(word) + 1), rng.randrange(4)
        if how == 0:
            word.insert(at, rng.choice("abcde01"))
        elif word and how == 1:
            word.pop(min(at, len(word) - 1))
        elif word:
            word[min(at, len(word) - 1)] = rng.choice("abcde01l")
    return "".join(word)


def test_pairs_equal_plain_edit_distance(spark):
    rng = random.Random(3)
    tokens = ["".join(rng.choice("abcdelo") for _ in range(rng.randrange(1, 9))) for _ in range(150)] + ["paypal", "google", "amazon", "modern", ""]
    labels = [_spoiled(rng, rng.choice(tokens) or "x") for _ in range(400)] + tokens[:20] + ["paypa1", "gooogle", "amaz0n", "rnodern", "x" * 5000, "", None, "é▁ü"]
    got = {(r["label"], r["token"]) for r in lookalikes.pairs(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([(x,) for x in tokens + [None]], "token string")).collect()}
    want = {(x, t) for x in set(labels) - {None} for t in set(tokens) if _alike(x, t)}
    assert got == want and {("paypa1", "paypal"), ("gooogle", "google"), ("amaz0n", "amazon"), ("rnodern", "modern")} <= got


def test_ten_thousand_brands(spark):
    rng = random.Random(8)
    tokens = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(5, 10))) for _ in range(10_000)})
    labels = [_spoiled(rng, rng.choice(tokens)) for _ in range(60)]
    got = {(r["label"], r["token"]) for r in lookalikes.pairs(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([(x,) for x in tokens], "token string")).collect()}
    assert got == {(x, t) for x in labels for t in tokens if _alike(x, t)} and got


def test_brands_from_a_file_change_the_score(spark, tmp_path):
    (tmp_path / "b.csv").write_text("token,ord,official,spellings\nzenbank,1,zenbank.example|zen.example,zen-bank\n", encoding="utf-8")
    table = lookalikes.brands(spark, str(tmp_path / "b.csv"))
    links = spark.createDataFrame([(1, "https://zenbamk.example/"), (2, "https://zenbamk.zen.example/"), (3, "https://zen-bank.example/"), (4, "https://paypa1.example/"), (5, ""), (6, None)], "url_id long, url string")
    got = {r["url_id"]: r["typo"] for r in lookalikes.with_brands(links, table).collect()}
    assert got == {1: "zenbank", 2: None, 3: None, 4: None, 5: None, 6: None}
    assert {r["url_id"] for r in urls.url_scores(links).where("typo is not null").collect()} == {4}
    assert lookalikes.with_brands(links, table.limit(0)).where("typo is not null").count() == 0
