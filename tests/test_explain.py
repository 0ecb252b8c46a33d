"""Explanations, phrases, evidence and named entities."""

from pyspark.sql import functions as F

from riskloom.operators import entities, explain, messages, payments, urls

TEXTS = [
    "Please share OTP and enter PIN, your bank account will be blocked", "Rs 500 credited to your account", "Never share your OTP", "See you tonight", None,
    "You have won a lottery, pay the processing fee by UPI", "SBI KYC verification is required immediately. Your Aadhaar and account will be suspended; click: http://sbi.example.com/kyc-verify",
]
LINKS = [
    "http://user:pw@192.168.1.1:8080/login?redirect=https://x.example", "https://www.google.com/", "https://" + "a" * 60 + ".example/" + "b" * 2100 + "?a=1&b=2&c=3&d=4&e=5&f=6", "http://paypal.secure-login.tk/verify/account/otp", "", None,
]
PAYS = ["upi://pay?pa=a@upi&am=150000&tn=urgent refund kyc otp", "upi://pay?pa=a@upi&pn=Shop&am=20&tn=lunch", "upi://pay", "upi://mandate?pa=x@y&am=12000&tn=claim your prize now"]


def _scored(spark):
    m = messages.with_scores(messages.indicators(spark.createDataFrame([(i, "en", t) for i, t in enumerate(TEXTS)], "msg_id long, lang string, text string")))
    u = urls.url_scores(spark.createDataFrame(list(enumerate(LINKS)), "url_id long, url string"))
    p = payments.payment_scores(spark.createDataFrame(list(enumerate(PAYS)), "pay_id long, uri string"))
    return {"message": (m, "msg_id"), "url": (u, "url_id"), "upi": (p, "pay_id")}


def _explained(spark):
    found = [explain.entries(rows, kind, key) for kind, (rows, key) in _scored(spark).items()]
    return explain.explained(found[0].unionByName(found[1]).unionByName(found[2]))


def test_points_add_up_to_the_score(spark):
    sums = {(r["kind"], r["key"]): r["s"] for r in _explained(spark).groupBy("kind", "key").agg(F.sum("points").alias("s")).collect()}
    checked = 0
    for kind, (rows, key) in _scored(spark).items():
        for r in rows.collect():
            shown = max(0.0, min(100.0, sums.get((kind, r[key]), 0.0)))
            assert abs(shown - (r["raw10"] / 10 if kind == "message" else r["total"])) < 0.02, (kind, r[key])
            checked += 1
    assert checked == len(TEXTS) + len(LINKS) + len(PAYS)


def test_every_part_has_a_phrase(spark):
    rows = _explained(spark).collect()
    phrases = {r["name"]: r["phrase"] for r in rows}
    assert phrases["otp_request"] == "OTP harvesting attempt detected" and phrases["ip_address_host"] == "Raw IP address used instead of a real domain"
    assert {p for n, p in phrases.items() if n.startswith("combination(")} == {"Combined evidence of multiple detected patterns"}
    assert phrases["bank_impersonation"] == "Detected indicator: Bank impersonation" and all(phrases.values())
    ranked = explain.listed(_explained(spark)).where("kind = 'url' and key = 0").orderBy("rank").collect()
    assert [r["points"] for r in ranked] == sorted((r["points"] for r in ranked), reverse=True)
    top = explain.top_phrases(_explained(spark)).where("kind = 'url' and key = 0").first()["reasons"]
    assert len(top) == len(set(top)) <= 10 and set(top) <= {r["phrase"] for r in ranked}


def test_the_largest_contained_set_gives_the_phrase(spark, tmp_path):
    parts = {"x": explain._parts([("a", ("a",), "true", "1"), ("ab", ("a", "b"), "true", "1"), ("abc", ("c", "b", "a"), "true", "1"), ("combination(q+r)", ("q", "r"), "true", "1"), ("none", (), "true", "1")])}
    (tmp_path / "r.csv").write_text("indicators,phrase\na,one\nb+a,two\na+b+c,three\nz,never\n", encoding="utf-8")
    got = {r["name"]: r["phrase"] for r in explain.phrased(explain.definitions(spark, parts), explain.reasons(spark, str(tmp_path / "r.csv"))).collect()}
    assert got == {"a": "one", "ab": "two", "abc": "three", "combination(q+r)": "Combined evidence of multiple detected patterns", "none": "Detected indicator: None"}
    fewer = explain.reasons(spark, str(tmp_path / "r.csv")).where("size(indicators) < 3")
    assert {r["name"]: r["phrase"] for r in explain.phrased(explain.definitions(spark, parts), fewer).collect()}["abc"] == "two"


def test_evidence_lists_words_and_texts_once(spark):
    rows = explain.evidence(_explained(spark)).where("kind = 'message' and key = 0").first()
    assert rows["tokens"][:2] == ["urgency", "threat"] and "combination" in rows["tokens"] and len(rows["tokens"]) == len(set(rows["tokens"]))
    assert "otp harvesting attempt detected" in rows["texts"]


def _named(spark, *rows):
    df = spark.createDataFrame([(i, bad, tokens, texts, "x") for i, (bad, tokens, texts) in enumerate(rows)], "artifact_id long, is_suspicious boolean, tokens array<string>, texts array<string>, entity string")
    return {(r["artifact_id"], r["entity"]) for r in entities.named(df, entities.entities(spark)).collect()}


def test_entities_are_named_only_with_an_impersonation(spark):
    got = _named(
        spark, (True, ["bank_impersonation"], ["an SBI page of hdfcbank"]), (True, ["otp_request"], ["sbi"]), (False, ["bank_impersonation"], ["sbi"]), (True, ["brand_in_path"], ["the sbin and axiom, upi-now"]),
        (True, None, ["brand_impersonation of income_tax and vi"]), (True, ["brand_impersonation"], None), (None, ["brand_impersonation"], ["jio"]), (True, [], []), (True, ["social_impersonation"], [None, "AADHAAR india_post"]),
    )
    assert got == {(0, "sbi"), (0, "hdfc"), (3, "upi"), (4, "income_tax"), (4, "vi"), (8, "aadhaar"), (8, "india_post")}
    assert entities.named(spark.createDataFrame([], "artifact_id long, is_suspicious boolean, tokens array<string>, texts array<string>"), entities.entities(spark)).count() == 0


def test_entities_are_a_table_of_any_size(spark):
    names = spark.range(5000).selectExpr("concat('brand', id, 'x') as entity", "concat('Brand ', id) as brand", "'made' as category", "id % 2 = 0 as alone").unionByName(
        spark.createDataFrame([("", "none", "c", False), (None, "none", "c", False), ("ab", "Ab", "c", False), ("a b", "A B", "c", True)], "entity string, brand string, category string, alone boolean"))
    rows = spark.createDataFrame([(1, True, ["brand_impersonation"], ["brand7x brand70x xbrand8x xbrand9xx ab a b"])], "artifact_id long, is_suspicious boolean, tokens array<string>, texts array<string>")
    assert {r["entity"] for r in entities.named(rows, names).collect()} == {"brand7x", "brand70x", "brand9x", "ab", "a b"}


def test_parts_told_within_the_row_equal_those_gathered_from_entries(spark):
    uris = [(i, f"upi://pay?pa=a@upi&am={a}&tn={n}") for i, (a, n) in enumerate([(5, "rent"), (200000, "urgent refund kyc otp claim"), (60000, "won lottery prize act now"), (20000, "")])] + [(9, None), (10, "http://x.example")]
    scored = payments.payment_scores(spark.createDataFrame(uris, "pay_id long, uri string"))
    rows = explain.told(scored, "upi", "pay_id")
    long = explain.explained(explain.entries(scored, "upi", "pay_id"))
    for within, gathered in ((explain.top_phrases_told(rows), explain.top_phrases(long)), (explain.top_phrases_told(rows, 2), explain.top_phrases(long, 2)), (explain.evidence_told(rows), explain.evidence(long))):
        assert sorted(map(tuple, within.collect())) == sorted(map(tuple, gathered.collect())) != []
        assert "Exchange" not in within._jdf.queryExecution().executedPlan().toString()
