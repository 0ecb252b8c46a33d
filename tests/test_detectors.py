"""A detector that is added shows in facts and scores, and costs only the inputs it declares."""

import pytest

from riskloom.operators import messages
from riskloom.operators.detectors import Detector, Input, Registry, message_registry


def _messages(spark):
    return spark.createDataFrame([
        (1, "en", "Please share OTP and enter PIN, your bank account will be blocked"), (2, "en", "GIFT CARD code wanted, buy a gift card!!!"), (3, "en", None), (4, "en", "See you tonight"), (5, "hi", "खाता बंद हो जाएगा, तुरंत केवाईसी अपडेट करें"),
    ], "msg_id long, lang string, text string")


def _gift(registry):
    registry.add_input(Input("low_text", (), column="lower(coalesce(text, ''))"))
    registry.add_input(Input("gifts", ("low_text",), column="size(regexp_extract_all(low_text, 'gift card', 0))"))
    registry.add_input(Input("shouts", ("low_text",), column="length(low_text) - length(replace(low_text, '!', ''))"))
    return registry.add(Detector("gift_card", ("gifts", "shouts"), "CASE WHEN gifts >= 2 AND shouts > 0 THEN 'high' WHEN gifts >= 1 THEN 'low' END", 9))


def test_the_fixed_detectors_give_the_fixed_facts_and_scores(spark):
    rows = _messages(spark)
    found = messages.indicators(rows)
    assert sorted(map(tuple, message_registry().facts(rows).collect())) == sorted(map(tuple, messages.message_facts(found).collect()))
    assert sorted(map(tuple, message_registry().scores(rows).collect())) == sorted(map(tuple, messages.message_scores(found).collect()))


def test_an_added_detector_shows(spark):
    rows, registry = _messages(spark), _gift(message_registry())
    facts = {(r["msg_id"], r["indicator"]): (r["severity"], r["points"]) for r in registry.facts(rows).collect()}
    assert facts[2, "gift_card"] == ("high", 19.8) and not any(n == "gift_card" for i, n in facts if i != 2)
    before = {r["msg_id"]: r for r in messages.message_scores(messages.indicators(rows)).collect()}
    after = {r["msg_id"]: r for r in registry.scores(rows).collect()}
    assert after[2]["raw_score"] == before[2]["raw_score"] + 19.8 and after[2]["n_fired"] == before[2]["n_fired"] + 1
    assert all(after[i] == before[i] for i in (1, 3, 4, 5))


def test_the_plan_has_only_what_is_needed(spark):
    registry = _gift(message_registry())
    assert [[i.name for i in p] for p in registry.plan(["gift_card"])] == [["low_text"], ["gifts", "shouts"]]
    assert [[i.name for i in p] for p in registry.plan(["urgency"])] == [["flags"], ["counts"]]
    plan = registry.facts(_messages(spark), ["gift_card"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert registry.facts(_messages(spark), []).count() == 0


def test_wrong_declarations_are_refused():
    registry = Registry().add_input(Input("a", ("b",), column="b")).add_input(Input("b", ("a",), column="a")).add(Detector("x", ("a",), "a", 1)).add(Detector("y", ("none",), "a", 1))
    for names, message in ((["x"], "need each other"), (["y"], "nothing is known"), (["z"], "nothing is known")):
        with pytest.raises(ValueError, match=message):
            registry.plan(names)
    with pytest.raises(ValueError, match="already"):
        registry.add(Detector("x", (), "a", 1))
    with pytest.raises(ValueError, match="either"):
        registry.add_input(Input("c"))
    with pytest.raises(ValueError, match="the scores need"):
        Registry().scores(None)
