"""Destinations inside links by a table of expectations: source, parameter, layers of decoding, status and choice; marks of labelled texts."""

import pytest

from riskloom.operators import destinations as D
from riskloom.operators import hygiene as H

R = "https://example.com/r?url="
FOUND = [
    ("https://example.com/support?status=ok", []), ("https://example.com/r?url=", []), ("", []), (None, []),
    ("https://example.com/redirect?url=https%3A%2F%2Fexample.org%2Flogin", [("https://example.org/login", "redirect_parameter", "url", 0)]),
    ("https://example.com/redirect?next=https%253A%252F%252Fexample.org%252Flogin", [("https://example.org/login", "redirect_parameter", "next", 1)]),
    ("https://example.com/out?note=see-https://example.org/info", [("https://example.org/info", "nested_url", "note", 0)]),
    ("https://example.com/redirect?url=https%3A%2F%2Fa.example%2Fx&next=https%3A%2F%2Fb.example%2Fy", [("https://a.example/x", "redirect_parameter", "url", 0), ("https://b.example/y", "redirect_parameter", "next", 0)]),
    ("https://example.com/redirect?url=https%2525253A%2525252F%2525252Fexample.org%2525252Flogin", [("https://example.org/login", "redirect_parameter", "url", 3)]),
    ("https://example.com/r?q=https%253A%252F%252Fc.example&url=https%3A%2F%2Fa.example", [("https://a.example", "redirect_parameter", "url", 0), ("https://c.example", "encoded_url", "q", 1)]),
    ("https://example.com/r?url=https%3A%2F%2Fa.example&next=https%3A%2F%2Fa.example", [("https://a.example", "redirect_parameter", "url", 0)]),
    (R + "https%3A%2F%2F", [("https://", "redirect_parameter", "url", 0)]),
]


def _links(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "url_id long, url string")


def test_candidates_are_found_as_listed(spark):
    got = {}
    for r in D.candidates(_links(spark, [u for u, _ in FOUND])).orderBy("url_id", "rank").collect():
        got.setdefault(r["url_id"], []).append((r["destination"], r["source"], r["parameter"], r["layers"]))
    for k, (url, want) in enumerate(FOUND):
        assert got.get(k, []) == want, url


def test_five_destinations_and_a_mark_for_the_rest(spark):
    url = "https://example.com/r?" + "&".join(f"p{k}=https%3A%2F%2Fd{k}.example" for k in range(8))
    rows = D.candidates(_links(spark, [url, R + "https%3A%2F%2Fa.example"])).orderBy("url_id", "rank").collect()
    assert [r["destination"] for r in rows if r["url_id"] == 0] == [f"https://d{k}.example" for k in range(5)]
    assert {r["truncated"] for r in rows if r["url_id"] == 0} == {True} and {r["truncated"] for r in rows if r["url_id"] == 1} == {False}


@pytest.mark.parametrize("inner,status,choice", [
    ("https%3A%2F%2Fexample.org%2Finfo", "unknown", "unknown"), ("http%3A%2F%2F203.0.113.7%2Flogin", "suspicious", "unsafe"), ("https%3A%2F%2Fhdfcbank.com", "verified", "verified"),
    ("https%3A%2F%2Fsecure-sbi-verify.example%2Flogin", "suspicious", "unsafe"), ("https%3A%2F%2Fpaypa1.com%2Flogin", "suspicious", "unsafe"), ("https%3A%2F%2F", "unknown", "unknown"),
    ("https%3A%2F%2Fa.example&next=https%3A%2F%2Fwww.hdfcbank.com%2F", None, "verified"), ("https%3A%2F%2Fa.example&next=https%3A%2F%2Fpaypa1.com", None, "unsafe"),
])
def test_status_and_choice(spark, inner, status, choice):
    judged = D.statuses(D.candidates(_links(spark, [R + inner])))
    if status:
        assert judged.first()["status"] == status
    row = D.choices(judged).first()
    assert row["choice"] == choice and (row["safe_destination"] is not None) == (choice == "verified")


def test_display_forms(spark):
    cases = {
        "HTTP://WWW.Example.com:80/A/b?z=1&a=2#Frag": "http://www.example.com/A/b?a=2&z=1#Frag", "https://a.example:8443/": "https://a.example:8443/", "https://a.example?b=%20&a": "https://a.example?a=&b=+",
        "javascript:alert(1)": "javascript:alert(1)", "": "", "not a link": "http://not a link",
    }
    got = [r["normalized"] for r in D.normalized(_links(spark, cases)).orderBy("url_id").collect()]
    assert got[:5] == list(cases.values())[:5]


def test_marks_of_labelled_texts(spark):
    rows = spark.createDataFrame([("URGENT: click, share OTP", "kyc"), ("केवाईसी turant", "other"), ("hello", "safe"), ("spin", "loan"), (None, "loan"), ("x", "urgency"), ("urgent", "urgency")], "text string, category string")
    got = [r[0] for r in rows.selectExpr(H.weak_indicators_sql()).collect()]
    assert got == ["urgency|suspicious_url|otp_request|kyc", "urgency|kyc_language|other", "none", "otp_request|loan", "loan", "", "urgency"]
