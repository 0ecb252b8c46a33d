"""Risk operators on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import chains, evaluation, hygiene, links, messages, payments, presentation, urls
from riskloom.sources import files
from riskloom.streaming import risk


def _messages(spark, *texts):
    return spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "msg_id long, lang string, text string")


def _scores(spark, *texts):
    return {r["msg_id"]: r for r in messages.message_scores(messages.indicators(_messages(spark, *texts))).collect()}


def test_message_scores(spark):
    got = _scores(
        spark, "Please share OTP and enter PIN, your bank account will be blocked", "See you tonight", None, "",
        "Rs 500 credited to your account", "Never share your OTP", "You have won a lottery, pay the processing fee by UPI",
    )
    assert got[0]["is_scam"] and got[0]["category"] == "bank_impersonation"
    assert got[1]["risk_score"] == got[2]["risk_score"] == got[3]["risk_score"] == 0 and got[1]["category"] == "safe"
    assert got[4]["guarded"] and got[4]["risk_score"] == 0
    assert got[5]["risk_score"] < 25
    assert got[6]["is_scam"] and got[6]["category"] == "lottery_prize"


def test_lexicon_is_a_parameter(spark, tmp_path):
    (tmp_path / "terms.csv").write_text("list,term\nurgency,drop everything\nkyc_request,केवाईसी\n", encoding="utf-8")
    from riskloom.functions import rules

    hits = messages.lexicon_hits(_messages(spark, "Drop everything!", "drop everythings", "abc केवाईसी"), rules.lexicon(spark, str(tmp_path / "terms.csv")))
    assert {(r["msg_id"], r["list"]) for r in hits.collect()} == {(0, "urgency"), (2, "kyc_request")}


def test_duplicate_terms_count_twice(spark):
    found = messages.indicators(_messages(spark, "helpline")).first()
    assert found["n_customer_care"] == 2 and found["s_customer_care"] == "high"


def _urls(spark, *values):
    return spark.createDataFrame([(i, u) for i, u in enumerate(values)], "url_id long, url string")


@pytest.mark.parametrize("url,host,root,sub,port", [
    ("https://www.SBI.co.in:8443/a?b=c#d", "www.sbi.co.in", "sbi.co.in", "www", 8443), ("example.com/login", "example.com", "example.com", "", None),
    ("localhost:8080/x", "localhost", "localhost", "", 8080), ("http://10.0.0.1/", "10.0.0.1", "10.0.0.1", "", None), ("http://host:99999/", "host", "host", "", None), ("", "", "", "", None), (None, "", "", "", None),
])
def test_url_parts(spark, url, host, root, sub, port):
    r = urls.url_parts(_urls(spark, url)).first()
    assert (r["host"], r["root"], r["subdomains"], r["port"]) == (host, root, sub, port)


def _fires(spark, url):
    return {r["indicator"] for r in urls.url_facts(urls.url_indicators(_urls(spark, url))).collect()}


@pytest.mark.parametrize("url,want", [
    ("http://user:pw@evil.example", "embedded_credentials"), ("https://paypa1.com/x", "possible_brand_typosquatting"), ("https://gooogle.com", "possible_brand_typosquatting"),
    ("https://paypal.account-verify.com", "brand_in_subdomain"), ("http://7f000001.example", "hex_encoded_host"), ("https://a.example/?next=b", "suspicious_redirect_parameter"),
    ("javascript:alert(1)", "unusual_scheme"), ("bit.ly/x", "short_url_redirector"), ("https://xn--abc.example", "punycode_domain"), ("https://pаypal.com", "mixed_script_host"),
    ("https://a.example/?u=http%3A%2F%2Fb.example", "encoded_nested_url"), ("https://x.example/kyc/sbi", "brand_in_path"),
])
def test_url_indicators(spark, url, want):
    assert want in _fires(spark, url)


@pytest.mark.parametrize("url", ["https://www.google.com/", "https://onlinesbi.com/", "https://example.org/about", ""])
def test_ordinary_links_score_low(spark, url):
    assert urls.url_scores(_urls(spark, url)).first()["risk_score"] < 25


def test_payments(spark):
    frame = spark.createDataFrame([(1, "upi://pay?pa=m@upi&pn=Shop&am=100,000.00&tn=urgent%20refund"), (2, "upi:pay?pa=m@upi"), (3, "http://x"), (4, None), (5, "upi://pay?am=-5"), (6, "upi://mandate?pa=a@b")], "pay_id long, uri string")
    got = {r["pay_id"]: r for r in payments.payment_scores(frame).collect()}
    assert got[1]["amount"] == 100000.0 and got[1]["note"] == "urgent refund" and got[1]["risk_score"] == 8 + 10 + 22 + 34 + 4 + 6 + 6
    assert got[2]["valid_upi"] and got[2]["risk_score"] == 14
    assert got[3]["malformed"] and got[4]["malformed"] and got[5]["amount"] is None and got[5]["malformed"]
    assert got[6]["action"] == "mandate" and not got[6]["valid_upi"]


def test_payload_fold_never_falls_below_the_strongest(spark):
    frame = spark.createDataFrame([(1, 0, "url", 80), (1, 1, "text", 25), (2, 0, "upi", 40)], "container long, pos long, content_type string, risk_score int")
    got = {r["container"]: r for r in payments.combined_scores(frame).collect()}
    assert got[1]["score"] == 83.5 and got[1]["primary_type"] == "url" and got[2]["score"] == 40


def test_link_changes(spark):
    frame = spark.createDataFrame([(1, "https://a.example/x", "http://a.example/x?redirect=http://b.example&utm_source=m"), (2, None, "https://a.example"), (3, "https://a.example/?p=1", "https://a.example/?p=2")], "link_id long, baseline_url string, current_url string")
    sides = links.both_sides(frame)
    assert {(r["link_id"], r["category"]) for r in links.field_changes(sides).collect()} == {(1, "scheme_changed")}
    assert {(r["link_id"], r["name"], r["category"]) for r in links.param_changes(sides).collect()} == {(1, "redirect", "redirect_parameter_added"), (1, "utm_source", "tracking_parameter_added"), (3, "p", "query_parameter_value_changed")}
    assert {r["link_id"] for r in links.change_impact(sides).where("impact_points > 0").collect()} == {1}


def _stage(chain, idx, kind, score, scam=None, signs="", url=None, payee=None, content=""):
    return (chain, idx, kind, score, score >= 50, scam, signs, url, payee, content)


def test_chains(spark):
    rows = [_stage(1, 0, "message", 80, "fake_kyc", "kyc_request urgency", "https://evil.example/kyc"), _stage(1, 1, "url", 70, "phishing", "", "https://evil.example/kyc"), _stage(2, 0, "message", 5), _stage(3, 0, "url", 90)]
    stages = chains.with_signals(spark.createDataFrame(rows, "chain_id long, idx long, type string, risk_score int, is_suspicious boolean, scam_type string, indicators string, url string, payee string, content string"))
    edges = chains.edges(stages)
    edge = edges.collect()
    assert len(edge) == 1 and edge[0]["match_type"] == "exact" and edge[0]["strength_pct"] == 100
    got = {r["chain_id"]: r for r in chains.chain_scores(stages, edges).collect()}
    assert got[1]["pattern"] == "kyc_phishing" and got[1]["classification"] == "multi_stage_scam" and got[1]["risk_score"] == 100
    assert got[2]["classification"] == got[3]["classification"] == "none"


def test_split_and_leakage(spark):
    rows = spark.createDataFrame([(i, f"text {i % 37}", "scam" if i % 2 else "safe", "en") for i in range(200)], "id long, text string, label string, language string")
    split = hygiene.stratified_split(rows, ["label"]).cache()
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 140, "validation": 30, "test": 30}
    assert hygiene.overlaps(split, hygiene.text_key(F.col("text"))).count() > 0
    clean = hygiene.leakage_clean(split)
    assert clean.join(split.where("split <> 'test'"), "text", "left_semi").count() == 0
    assert hygiene.keep_first(rows, hygiene.text_key(F.col("text"))).count() == 37
    with pytest.raises(ValueError):
        hygiene.validate(rows, ["missing"])


@pytest.mark.parametrize("text,want", [
    ("your OTP is 123456 now", "your OTP is [OTP] now"), ("card 4111 1111 1111 1111.", "card [CARD]."), ("see https://a.example/x ok", "see [URL] ok"), ("mail a@b.example now", "mail [EMAIL] now"),
    ("pay shop@okaxis today", "pay [UPI_ID] today"), ("call 9876543210", "call [PHONE]"), ("at 10.1.2.3", "at [IP]"), (None, ""),
])
def test_redaction(spark, text, want):
    frame = spark.createDataFrame([(text,)], "text string")
    assert frame.selectExpr(f"{hygiene.redaction_sql(False)} AS t").first()["t"] == want


def test_metrics(spark):
    rows = [("s", i, "scam" if i < 6 else "safe", "scam" if i in (0, 1, 2, 7) else "safe", "en", "x" if i < 6 else "safe") for i in range(10)]
    frame = spark.createDataFrame(rows, "system string, id long, label string, prediction string, language string, scam_type string")
    r = evaluation.confusion(frame, "system").first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"]) == (3, 3, 1, 3) and r["accuracy"] == 0.6 and r["precision_"] == 0.75 and r["recall_"] == 0.5 and r["f1"] == 0.6
    assert evaluation.by_category(frame).first()["fp"] == 1 and evaluation.examples(frame, 1).count() == 2


def test_zones(spark):
    got = presentation.zones(spark.createDataFrame([(x,) for x in (0, 24, 25, 59, 60, 100)], "risk_score int"))
    assert [r["zone"] for r in got.collect()] == ["green", "green", "yellow", "yellow", "red", "red"]


def test_files(spark, tmp_path):
    (tmp_path / "raw.csv").write_text('﻿message,label,reason,domain,language\n"two\nlines",scam,r,d,Hindi\nplease act now,legit,r,d,English\n,scam,r,d,English\nfine,legit,r,d,English\n', encoding="utf-8")
    assert {(r["text"], r["label"], r["language"]) for r in files.read_raw(spark, str(tmp_path / "raw.csv")).collect()} == {("two\nlines", "scam", "hi"), ("fine", "safe", "en")}
    items = spark.createDataFrame([(1, None, "https://a.example"), (2, " MSG ", "hi"), (3, "odd", "x"), (4, None, None), (5, "", "upi://pay"), (6, "sms", "x"), (7, "Link-Change", "https://a.example")], "item_id long, type string, content string")
    assert [r["kind"] for r in files.intake(items).orderBy("item_id").collect()] == ["url", "message", "error", "error", "upi", "error", "link_change"]


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").limit(200).selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id", "event_id AS msg_id", "'en' AS lang", "CASE WHEN event_id % 2 = 0 THEN 'share OTP and PIN' ELSE 'hello' END AS text")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    risk.score_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
    q = risk.deduplicated(stream, "1000 days").writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dedup").count() == 2
    levels = risk.level_counts(events.withColumn("risk_level", F.lit("LOW")), "1 day")
    assert levels.agg(F.sum("n")).first()[0] == 200 and risk.sessions(events, "1 hour").select(F.explode("messages")).count() == 200
