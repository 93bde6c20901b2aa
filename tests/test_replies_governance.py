import hashlib

import pytest

from pyspark.sql import functions as F

from quillstone.operators import governance, replies

MESSAGES = "message_id string, body string, delivery_id long"


def results(df):
    return {r.message_id: (r.ok, [tuple(b)[1:] for b in r.blocks or []], r.reason) for r in df.collect()}


def test_digest_replies_resolve_or_fail_whole(spark):
    items = spark.createDataFrame([(1, 10, "AB", "Foo, Inc."), (1, 11, "CD", "Bar"), (2, 12, None, "Solo Co"), (3, 13, "X", "Same"),
        (3, 14, "X", "same.")], "delivery_id long, source_id long, ticker string, company string")
    rows = [("a", "$ab - LIKE\nfine\nbar: pass", 1), ("b", "AB - LIKE\nZZ - pass", 1), ("c", "Maybe\nhm\n> old", 2), ("d", "X - like", 3),
        ("e", "same - like", 3), ("f", "LIKE", 9), ("g", " ", 1), ("h", "solo co: STRONG PASS", 2)]
    got = results(replies.digest_replies(spark.createDataFrame(rows, MESSAGES), items))
    assert got["a"] == (True, [(10, "LIKE", "fine"), (11, "PASS", "")], None) and got["b"] == (False, [], "UNKNOWN_LABEL")
    assert got["c"] == (True, [(12, "MAYBE", "hm")], None) and got["h"] == (True, [(12, "STRONG_PASS", "")], None)
    assert got["d"][2] == got["e"][2] == "AMBIGUOUS_LABEL" and got["f"][2] == "NO_DELIVERED_ITEMS" and got["g"][2] == "EMPTY_BODY"
    events = replies.as_feedback(replies.digest_replies(spark.createDataFrame(rows[:1], MESSAGES), items), "DIGEST_REPLY", False).collect()
    assert [(e.event_index, e.source_id, e.verdict) for e in events] == [(0, 10, "LIKE"), (1, 11, "PASS")]


def test_blind_reviews_are_final(spark):
    assignments = spark.createDataFrame([(1, 10, None), (2, 20, "t"), (3, 30, "t"), (4, 40, None)],
        "assignment_id long, source_id long, judged_at string")
    judgments = spark.createDataFrame([(2,), (4,), (None,)], "assignment_id long")
    rows = [("a", "BR-1 — LIKE\nwhy", None), ("b", "BR-1: like\nBR-2: like", None), ("c", "BR-3: like", None), ("d", "BR-4: like", None),
        ("e", "br-9: pass", None), ("f", "LIKE", None)]
    got = results(replies.blind_reviews(spark.createDataFrame(rows, MESSAGES), assignments, judgments))
    assert got["a"] == (True, [(1, 10, "LIKE", "why")], None) and got["b"] == (False, [], "DUPLICATE_BLIND_REVIEW")
    assert got["c"][2] == got["d"][2] == "INCONSISTENT_BLIND_REVIEW_STATE" and got["e"][2] == "UNKNOWN_REFERENCE" and got["f"][2] == "VERDICT_WITHOUT_REFERENCE"


def test_screen_reviews_respect_exclusion(spark):
    screenings = spark.createDataFrame([(1, 10), (2, 20)], "screening_id long, source_id long")
    f = spark.createDataFrame([(1, "SCREEN_REVIEW", True), (2, "SCREEN_REVIEW", False)],
        "screening_id long, feedback_origin string, excluded_from_learning boolean")
    got = results(replies.screen_reviews(spark.createDataFrame([("a", "SR-1: like", None), ("b", "SR-2: like", None),
        ("c", "SR-3: like", None)], MESSAGES), screenings, f))
    assert got["a"] == (True, [(1, 10, "LIKE", "")],
        None) and got["b"][2] == "DUPLICATE_SCREEN_REVIEW" and got["c"][2] == "UNKNOWN_REFERENCE"


def frames(spark, n=20, bad=0):
    summary = spark.createDataFrame([(n, 0, n, n, bad)],
        "n_official int, n_candidates int, n_unique int, n_valid_unique int, n_problem_rows int")
    members = spark.createDataFrame([(i, "LIKE", "INVESTIGATE_NOW", "WATCH", 100 + i, 1, 1) for i in range(n)],
        "feedback_id long, verdict string, actual string, overall_prediction string, screening_id long, screening_prompt_version int, n_prompt_versions int")
    return summary, members


def test_gate(spark):
    v = governance.Version(3, 50, hashlib.sha256(b"x").hexdigest())
    summary, members = frames(spark)
    assert all(ok for _, ok in governance.gate_checks(v, 3, b"x", summary, 0, members))
    failed = lambda *a: [name for name, ok in governance.gate_checks(*a) if not ok]
    assert failed(v, 2, b"y", summary, 1, members) == ["version is the latest", "artifact is intact", "no duplicate groups"]
    assert failed(v, 3, b"x", *(lambda s, m: (s, 0, m))(*frames(spark, 19))) == ["hold-out is complete", "members are valid and unique"]


def test_fingerprint_covers_the_evaluation_only(spark):
    v, (_, members) = governance.Version(3, 50, "h"), frames(spark)
    m = spark.createDataFrame([(20, 0, 20, 0, 0, 0, 1.0, None, 0, 20)],
        "n int, exact_correct int, tp int, fp int, tn int, fn int, recall double, balanced_accuracy double, hc_hit int, hc_actual int")
    make = lambda rules, decision, reason: governance.decision_record(v, members, m, rules, decision, reason,
        "now")["evaluation_fingerprint"]
    assert make("r", "RETRAIN", "a") == make("r", "ACCEPT", "b") != make("q", "RETRAIN", "a")
    with pytest.raises(ValueError):
        make("r", "MAYBE", "")
    with pytest.raises(ValueError, match="more than 200 members"):  # the fingerprint covers all of them or none is made
        governance.decision_record(v, frames(spark, 201)[1], m, "r", "ACCEPT", "x", "now")


def test_when_a_version_may_be_built():
    v = governance.Version(1, 1, "h", True)
    assert governance.may_build(14, 99, None, False) == "TOO_FEW_RECORDS" and governance.may_build(15, 0, None, False) is None
    assert governance.may_build(15, 19, v, True) == "HOLDOUT_INCOMPLETE" and governance.may_build(15, 20, v,
        False) == "NOT_AUTHORISED" and governance.may_build(15, 20, v, True) is None


def test_labels_are_normalised_before_they_meet_items(spark):
    """Each message is joined once with its digest's items, and the plan above that join has no pattern to match."""
    items = spark.createDataFrame([(1, 10, "AB", "Acme"), (1, 11, "CD", "Beta, Inc.")], "delivery_id long, source_id long, ticker string, company string")
    sent = spark.createDataFrame([("m1", "$ab - LIKE\nwell", 1), ("m2", "beta inc: strong  pass.\nno", 1), ("m3", "like\n", 1)],
        "message_id string, body string, delivery_id long")
    found = replies.digest_replies(sent, items)
    got = {r.message_id: [(b.source_id, b.verdict, b.comment) for b in r.blocks] if r.ok else r.reason for r in found.collect()}
    assert got == {"m1": [(10, "LIKE", "well")], "m2": [(11, "STRONG_PASS", "no")], "m3": "NO_LABELLED_HEADER"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2 and not any("regexp" in line for line in plan.splitlines() if "Aggregate [message_id" in line)


def test_heads_of_lines(spark):
    from quillstone.functions import text

    lines = ["like", " Strong\u00a0 Like !", "AB - pass", "A: B -- maybe.", "like it", "", "- like", ": pass", "likely", "x — LIKE:"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, line string")
    got = [tuple(r.h)[1:] for r in df.select("n", text._head(F.col("line"), F.col("n")).alias("h")).orderBy("n").collect()]
    none = (None, None, None)
    assert got[:6] == [("bare", None, "LIKE"), ("bare", None, "STRONG_LIKE"), ("labelled", "AB", "PASS"), ("labelled", "A: B", "MAYBE"), none, none]
    assert got[8] == none and got[9] == ("labelled", "x", "LIKE")
