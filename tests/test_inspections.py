"""Requests about links, and small helpers of files, chains and evaluation tables."""

import json

from riskloom.operators import chains, evaluation, inspections
from riskloom.sources import files

DEEP = "http://bank.example/go?next=https%3A%2F%2Fevil.example%2Fpay&a=1&b="


def _got(spark, *rows):
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "request_id long, url string, baseline_url string, current_url string, mode string")
    return {r["request_id"]: r for r in inspections.inspected(df).collect()}


def test_requests_go_where_they_belong(spark):
    got = _got(
        spark, ("https://www.google.com/", None, None), ("https://a.example/x", "https://a.example/", None), (None, "https://a.example/", "http://a.example/?redirect=https://b.example"),
        (None, None, None), (None, "https://a.example/", None), (" ", None, None), ("", "https://a.example", None), ("https://a.example", " ", None), (None, "", "https://a.example"), ("https://a.example", None, "https://ignored.example"),
    )
    assert [got[i]["mode"] for i in range(10)] == ["inspect", "compare", "compare", "error", "error", "error", "error", "error", "error", "inspect"]
    assert got[3]["error"].startswith("Provide") and got[5]["error"].startswith("The URL to inspect") and got[6]["error"].startswith("The current") and got[7]["error"] == got[8]["error"] == inspections.ERRORS["baseline"]
    assert all((got[i]["risk_score"], got[i]["risk_level"], got[i]["n_changes"], got[i]["normalized"]) == (0, "LOW", 0, None) for i in range(3, 9))
    assert got[1]["n_changes"] >= 1 and got[2]["risk_increased"] and got[2]["redirect"] and got[2]["n_risky"] >= 2
    assert (got[0]["n_changes"], got[0]["risk_delta"], got[0]["risk_increased"], got[0]["hidden"]) == (0, 0, False, [])
    assert inspections.inspected(spark.createDataFrame([], "request_id long, url string, baseline_url string, current_url string")).count() == 0


def test_decoded_values_and_hidden_parts(spark):
    got = _got(spark, (DEEP, None, None), ("https://a.example/%61%62?x+y=c%2520d&flag&=v", None, None), ("https://a.example/https://b.example", None, None), (DEEP, None, None), ("HTTP://A.example:80/P?b=2&a=1", None, None), ("javascript:alert(1)", None, None))
    assert [tuple(v) for v in got[0]["decoded_values"]] == [("next", "https://evil.example/pay"), ("a", "1"), ("b", "")]
    assert got[0]["hidden"] == ["parameter 'next' hides a complete web address in its (decoded) value", inspections.NESTED] and got[0]["encoded_destination"] and got[0]["obfuscated"]
    assert got[1]["decoded_path"] == "/ab" and [tuple(v) for v in got[1]["decoded_values"]] == [("x y", "c d"), ("flag", ""), ("", "v")] and got[1]["hidden"] == []
    assert got[2]["hidden"] == [inspections.NESTED] and got[3]["hidden"] == got[0]["hidden"]
    assert got[4]["normalized"] == "http://a.example/P?a=1&b=2" and got[5]["normalized"] == "javascript:alert(1)"


def test_edges_in_the_order_of_a_report(spark):
    rows = [("c", 0, 2, "x", 90, "none", None), ("c", 0, 1, "x", 50, "none", None), ("c", 1, 2, "x", 60, "none", None), ("c", 0, 3, "x", 90, "none", None), ("b", 0, 1, "x", 1, "none", None)]
    found = spark.createDataFrame(rows, "chain_id string, from_stage long, to_stage long, relation string, strength_pct int, match_type string, shared_domain string")
    assert [(r["chain_id"], r["from_stage"], r["to_stage"]) for r in chains.ordered(found).collect()] == [("b", 0, 1), ("c", 1, 2), ("c", 0, 1), ("c", 0, 2), ("c", 0, 3)]


def test_sources_together_and_results_as_json(spark):
    a, b = spark.createDataFrame([("1", "x")], "id string, text string"), spark.createDataFrame([("2", "y", "made")], "id string, text string, source string")
    assert sorted(map(tuple, files.concatenated(a, b).collect()), key=str) == [("1", "x", None), ("2", "y", "made")]
    row = evaluation.as_json(spark.createDataFrame([("rules", 3, 0.5, None)], "system string, n int, f1 double, note string"), "system").first()
    assert row["system"] == "rules" and json.loads(row["result"]) == {"n": 3, "f1": 0.5}
