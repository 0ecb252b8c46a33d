"""Verdicts of mixed artefacts, containers, promoted chains and evaluation tables on small inputs with known results."""

from pyspark.sql import functions as F

from riskloom.operators import classifier, evaluation, hygiene, verdicts
from riskloom.sources import files


def test_verdicts_route_every_item(spark):
    items = spark.createDataFrame([
        (1, None, "https://www.google.com/"), (2, " MSG ", "Please share OTP and enter PIN, your bank account will be blocked"), (3, None, "upi://pay?pa=a@upi&am=150000&tn=urgent refund"),
        (4, "image", "mailto:a@b.c"), (5, "nothing", "x"), (6, "url", None), (7, "chain", "x"), (8, None, "  "), (None, "text", "See you tonight"),
    ], "item_id long, type string, content string").withColumn("kind", F.lit("own"))
    got = {r["item_id"]: r for r in verdicts.verdicts(items).collect()}
    assert len(got) == 9
    assert (got[1]["kind"], got[1]["status"], got[1]["scam_type"]) == ("url", "ANALYSED", "safe")
    assert got[2]["is_suspicious"] and got[2]["scam_type"] == "bank_impersonation" and "otp_request" in got[2]["indicators"]
    assert got[3]["status"] == "DECODED" and got[3]["indicators"][0] == "upi_payment_uri" and got[3]["risk_score"] > 25
    assert (got[4]["content_type"], got[4]["risk_score"], got[4]["confidence"], got[4]["scam_type"]) == ("unknown", 0, 25.0, "safe")
    assert all(got[k]["status"] == "ERROR" and got[k]["scam_type"] is None for k in (5, 6, 7, 8))
    assert got[None]["scam_type"] == "safe"


def test_container_of_one_and_two_payloads(spark):
    rows = spark.createDataFrame([(1, 0, "See you"), (1, 1, "https://user:pw@192.168.1.1/login"), (2, 0, "https://user:pw@192.168.1.1/login"), (3, 5, None)], "container long, pos long, payload string")
    got = {r["container"]: r for r in verdicts.container_verdicts(rows).collect()}
    assert got[1]["n_payloads"] == 2 and got[1]["primary_type"] == "text" and got[1]["score"] == got[2]["score"] and got[1]["is_suspicious"]
    assert got[1]["indicators"][:2] == ["embedded_text_in_qr", "embedded_url_in_qr"]
    assert got[3]["primary_type"] == "unknown" and got[3]["score"] == 0 and got[3]["indicators"] == []


def test_merged_indicators_ignore_case(spark):
    rows = spark.createDataFrame([(1, 1, ["OTP", "kyc"]), (1, 0, ["otp"]), (2, 0, [])], "chain_id long, idx long, indicators array<string>")
    assert [(r["chain_id"], r["indicators"]) for r in verdicts.merged_indicators(rows, "chain_id", "idx").collect()] == [(1, ["otp", "kyc"])]


def test_evaluation_tables(spark):
    labelled = spark.createDataFrame([(1, "scam", "en", "kyc"), (2, "safe", "en", "safe"), (3, "scam", "hi", "loan")], "id long, label string, language string, scam_type string")
    answers = spark.createDataFrame([(1, "scam", "kyc"), (2, "scam", "loan")], "id long, prediction string, predicted_type string")
    met = evaluation.predictions(labelled, rules=answers)
    out = evaluation.outcomes(met).first()
    assert (out["total"], out["available"], out["failures"], out["scam"], out["safe"]) == (3, 2, 1, 2, 0)
    loan = evaluation.category_confusion(met).where("category = 'loan'").first()
    assert (loan["tp"], loan["fn"], loan["fp"], loan["tn"], loan["n"]) == (0, 1, 1, 1, 3)
    table = {r["system"]: r for r in evaluation.comparison(met, ["rules", "model"]).collect()}
    assert table["rules"]["n"] == 2 and table["rules"]["accuracy"] == 0.5 and table["model"]["accuracy"] is None and table["model"]["note"]


def test_data_set_helpers(spark):
    texts = spark.createDataFrame([("Call +91 9876543210 now",), ("a/c 123456789012",), ("Your OTP: 123456",), ("Rs 5000 in 2024",), (None,)], "text string")
    assert [r[0] for r in texts.select(hygiene.placeholders(F.col("text"))).collect()] == ["Call [PHONE] now", "a/c [ACCOUNT]", "Your OTP: [OTP]", "Rs 5000 in 2024", None]
    made = files.expanded(spark.createDataFrame([("{bank}: {app}!",), ("plain",)], "text string"), bank=["A", "B"], app=["x", "y", "z"])
    assert made.count() == 7 and made.where("text like '%{%'").count() == 0
    places = hygiene.numbered(spark.range(50).select((F.lit(50) - F.col("id")).alias("id")), "id", prefix="r", digits=3).collect()
    assert {r["row_id"]: r["id"] for r in places} == {f"r{k:03d}": k for k in range(1, 51)}
    records = files.training_records(spark.createDataFrame([(None, " SAFE", None), ("t", "scam", " kyc ")], "text string, scam_or_safe string, scam_type string"))
    assert [tuple(r) for r in records.collect()] == [("", "safe", "safe"), ("t", "scam", "kyc")]


def test_character_terms_stay_inside_words(spark):
    rows = spark.createDataFrame([(1, "Ab  c"), (2, None), (3, "")], "id long, text string")
    assert sorted(r["term"] for r in classifier.char_terms(rows).collect()) == sorted([" ab", "ab ", " ab ", " c "])


def test_payloads_of_containers_meet_in_one_shuffle(spark):
    texts = ["upi://pay?pa=a@upi&am=60000&tn=otp", "share OTP and enter PIN, your bank account will be blocked", "http://user:pw@evil.example/login", "", "upi://pay?pa=a@upi&am=60000&tn=otp"]
    rows = spark.createDataFrame([(c, p, t) for c in (1, 2) for p, t in enumerate(texts[:: 1 if c == 1 else -1])], "container long, pos long, payload string")
    found = verdicts.container_verdicts(rows)
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Generate" not in plan and "Join" not in plan
    got = {r["container"]: r for r in found.collect()}
    each = verdicts.with_context(verdicts.scored(rows.selectExpr("struct(container, pos) AS item_id", "'qr' AS kind", "trim(payload) AS content", "CASE WHEN payload = '' THEN 'unknown' WHEN payload LIKE 'upi%' THEN 'upi' WHEN payload LIKE 'http%' THEN 'url' ELSE 'text' END AS content_type")))
    names = {}
    for r in sorted(each.select("item_id.*", "indicators").collect(), key=lambda r: (r["container"], r["pos"])):
        own = names.setdefault(r["container"], [])
        own += [x for x in r["indicators"] if x not in own]
    assert {c: r["indicators"] for c, r in got.items()} == names and {r["n_payloads"] for r in got.values()} == {5} and got[1]["score"] == got[2]["score"]
