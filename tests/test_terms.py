"""Terms found within the row against the join of a larger lexicon."""

from pyspark.sql import functions as F

from riskloom.operators import messages as M
from riskloom.functions import rules

ODD = [
    None, "", " ", "KYC", "e-kyc!", "kycs", "xkyc", "𐐀kyc", "kyc𐐀", "_kyc kyc_", "account will be blocked today", "account  will be\tblocked", "Your SBI aćcount blocked", "share otp and enter pin, verify",
    "one-time password", "do not share otp. ignore", "ओटीपी दें", "abcओटीपीxyz खाता बंद हो जाएगा", "helpline support helpline", "received rs 25 lakh", "xhttp://bit.ly/a www.x.y t.co", "a.b-.c.com9z.y 10.20.30.40/x", "shared sharepin", "İSTANBUL kyc",
]


def _rows(spark, texts=ODD):
    return spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "msg_id long, lang string, text string")


def test_terms_within_the_row_equal_the_join(spark, monkeypatch):
    own = {r["msg_id"]: r for r in M.indicators(_rows(spark)).collect()}
    hits = {tuple(r) for r in M.lexicon_hits(_rows(spark)).collect()}
    monkeypatch.setattr(M, "_TREE_TERMS", 0)
    joined = {r["msg_id"]: r for r in M.indicators(_rows(spark)).collect()}
    assert {k: r.asDict() for k, r in own.items()} == {k: r.asDict() for k, r in joined.items()} and len(own) == len(ODD)
    assert hits == {tuple(r) for r in M.lexicon_hits(_rows(spark)).collect()}


def test_scores_of_messages_need_no_shuffle(spark):
    plan = M.message_scores(M.indicators(_rows(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_terms_of_any_form(spark):
    terms = [("urgency", "$100 off"), ("urgency", "off"), ("threat", "c++"), ("threat", "a.b"), ("otp_verb", "se"), ("otp_verb", "send"), ("otp_verb", "$x")]
    lexicon = spark.createDataFrame([(a, i, t, False, t) for i, (a, t) in enumerate(terms)], "list string, ord long, term string, deva boolean, anchor string")
    found = {r["msg_id"]: r for r in M.indicators(_rows(spark, ["only $100 off", "x$100 off", "c++ axb", "c++x a.b", "sends", "see $xy", "c++, (a.b)"]), lexicon).collect()}
    assert [(found[i]["n_urgency"], found[i]["n_threat"], found[i]["verbs"]) for i in range(7)] == [(2, 0, 0), (1, 0, 0), (0, 1, 0), (0, 1, 0), (0, 0, 2), (0, 0, 2), (0, 2, 0)]


def test_links_and_parts_equal_the_plain_patterns(spark):
    texts = [*ODD, "See http://a.b/c, (www.d.e)! x.y.zz/p?q f@g.hh", "https://x https://y.z.", "-a.com a-.com ab--c.de", "HTTP://X.Y WwW.z", "aहttp://q 𐐀bit.ly/x", "word. Next word.next"]
    plain = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(M.URL_PATTERN), F.lit(0))
    plain = F.array_distinct(F.filter(F.transform(plain, lambda u: F.regexp_replace(u, M.URL_TRAILER, "")), lambda u: u != ""))
    rows = _rows(spark, texts).select(plain.alias("plain"), M.urls_in(F.col("text")).alias("own")).collect()
    assert [r["own"] for r in rows] == [r["plain"] for r in rows] and any(r["own"] for r in rows)
    parts = [*rules.TERMS["safe_marker"], *rules.TERMS["transactional"]]
    norm = _rows(spark, [*texts, *parts, *(p[1:] + "x" for p in parts)]).select(M.normalized(F.col("text")).alias("norm"))
    both = norm.select(M._parts_met("norm", parts).alias("own"), F.expr(M._any_part(M.Spark, "norm", [p.replace("'", "\\'") if "'" in p else p for p in parts]).replace("\\''", "\\'")).alias("plain")).collect()
    assert [r["own"] for r in both] == [r["plain"] for r in both] and any(r["own"] for r in both)


def test_a_text_is_read_once_for_its_score_and_its_links(spark, monkeypatch):
    from riskloom.operators import urls as U

    texts, seen = ["share OTP at bit.ly/x and http://sbi-verify.example.tk/login", "hello", None, "see bit.ly/x, bit.ly/x"], []
    monkeypatch.setattr(M, "urls_in", lambda text, own=M.urls_in: seen.append(1) or own(text))
    found = {r["msg_id"]: r for r in U.with_links(_rows(spark, texts)).collect()}
    assert len(seen) == 1 and [found[i]["n_urls"] for i in range(4)] == [2, 0, 0, 1] and found[1]["url_score"] is None and found[0]["url_score"] > found[3]["url_score"]


def test_redaction_by_steps_equals_the_plain_patterns(spark):
    from riskloom.operators import hygiene as H

    texts = [
        None, "", "OTP is 123456, pin: 9999.", "Card 1234 5678 9012 3456 and 1234-5678-9012-3456x", "Mail A.B@C.Example.ORG now, me@upi too", "a/c no 12345, acct: 998877", "call 9876543210 or 123456789012",
        "from 10.20.30.40 to 1.2.3.4.5", "Ref no. 123456\t\t next\n\nline  two", "HTTPS://X.y/z?a=1111 2222", "1.2.3 1234", "x" * 300 + " 9876543210",
    ]
    rows = H.redacted(_rows(spark, texts)).withColumn("plain", F.expr(H.redaction_sql(False)))
    got = rows.collect()
    assert [r["clean"] for r in got] == [r["plain"] for r in got] and len(H._NEEDS) == len(H.REDACTIONS)
    assert "rlike" in H.redacted(_rows(spark, texts))._jdf.queryExecution().optimizedPlan().toString().lower()
