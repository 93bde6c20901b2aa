from pyspark.sql import functions as F

from quillstone.operators import feedback as fb

MESSAGES = "message_id string, feedback_parse_status string"
FEEDBACK = "feedback_id long, message_id string, verdict string, excluded_from_learning boolean, holdout_eligible boolean, feedback_origin string"


def frames(spark):
    messages = spark.createDataFrame([("a", "PARSED"), ("b", "NEEDS_REVIEW"), ("c", "NO_FEEDBACK"), ("d", "UNPARSED"), ("e", "PARSED"),
        ("f", "ERROR")], MESSAGES)
    feedback = spark.createDataFrame([
        (1, "a", "LIKE", False, True, "DIRECT"), (2, "a", None, True, True, "DIRECT"), (3, "b", "PASS", False, True, "DIRECT"),
        (4, "c", "MAYBE", False, True, "DIRECT"), (5, "a", "PASS", False, False, "SCREEN_REVIEW")], FEEDBACK)
    return feedback, messages


def ids(df, c="feedback_id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_eligible_needs_parsed_and_not_excluded(spark):
    assert ids(fb.eligible_feedback(*frames(spark))) == [1, 5]


def test_holdout_pool_adds_checkpoint_and_eligibility(spark):
    feedback, messages = frames(spark)
    assert ids(fb.holdout_pool(feedback, messages, 0)) == [1]
    assert ids(fb.holdout_pool(feedback, messages, 1)) == []


def test_invariant_violations_both_ways(spark):
    rows = {(r.message_id, r.violation) for r in fb.invariant_violations(*frames(spark)).collect()}
    assert rows == {("e", "NO_EVENTS"), ("c", "UNEXPECTED_EVENTS")}


def test_label_distribution_and_empty_share(spark):
    feedback, messages = frames(spark)
    r = fb.label_distribution(fb.eligible_feedback(feedback, messages)).first()
    assert (r.n_like, r.n_pass, r.n_other, r.total, r.positive_share) == (1, 1, 0, 2, 0.5)
    assert fb.label_distribution(feedback.limit(0)).first().positive_share is None


def test_status_counts_single_row(spark):
    r = fb.status_counts(frames(spark)[1]).first()
    assert (r.n_messages, r.n_parsed, r.n_unparsed, r.n_retryable_error) == (6, 2, 1, 0)


def test_requeue(spark):
    feedback, messages = frames(spark)
    r = {x.message_id: (x.may_requeue, x.reason, x.drops_events) for x in fb.requeue_decision(messages, feedback).collect()}
    assert r["b"] == (True, None, True) and r["f"] == (True, None, False)
    assert r["a"][1] == "ALREADY_PARSED" and r["c"][1] == "HAS_NO_FEEDBACK" and r["d"][1] == "ALREADY_PENDING"


def test_empty_id_list_selects_nothing(spark):
    feedback, _ = frames(spark)
    assert fb.feedback_with_ids(feedback, spark.createDataFrame([], "feedback_id long")).count() == 0


def test_routing_order(spark):
    rows = [
        ("k", "Joe <JOE@x.org>", "hello", "t1", "AUTHENTICATED"), ("l", "eve@x.org", "hello", "t1", "AUTHENTICATED"),
        ("m", "joe@x.org", "hello", "t1", None),
        ("n", "joe@x.org", "Re: Quillstone Screen Review", "t1", "AUTHENTICATED"),
        ("o", "joe@x.org", "fwd: quillstone blind review ", "t1", "AUTHENTICATED"),
        ("p", "joe@x.org", "whatever", "t1", "AUTHENTICATED"), ("q", "joe@x.org", "Re: Quillstone — New ideas worth attention", "t2",
        "AUTHENTICATED"), ("r", "joe@x.org", None, "t2", "AUTHENTICATED")]
    messages = spark.createDataFrame(rows,
        "message_id string, sender string, subject string, thread_id string, sender_authenticated string")
    events = spark.createDataFrame([("k",)], "message_id string")
    deliveries = spark.createDataFrame([("t1",), ("",), (None,)], "provider_thread_id string")
    got = {r.message_id: r.route for r in fb.route_messages(messages, events, deliveries, ["Joe@x.org"]).collect()}
    assert got == {"k": "RESYNC", "l": "SKIPPED_SENDER", "m": "SKIPPED_UNAUTHENTICATED", "n": "SCREEN_REVIEW", "o": "BLIND_REVIEW",
        "p": "DIGEST_REPLY", "q": "NEEDS_REVIEW", "r": "MODEL"}


def test_feedback_about_ignores_case(spark):
    f = spark.createDataFrame([(1, "abc", None), (2, None, "ABC"), (3, "x", "y")], "feedback_id long, ticker string, company string")
    assert ids(fb.feedback_about(f, "Abc")) == [1, 2]
    assert f.filter(F.lit(False)).count() == 0
