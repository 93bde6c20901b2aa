"""States as events, idea records, narratives, training records and labels, on small tables."""

import json

from pyspark.sql import functions as F

from quillstone.functions.text import NARRATIVE
from quillstone.operators import ideas, labels, models, narratives, state, training

MESSAGES = "message_id string, feedback_parse_status string"
FEEDBACK = "feedback_id long, message_id string, ticker string, company string, verdict string, excluded_from_learning int"


def events(spark, schema, *rows):
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "seq long, " + schema)


def test_messages_follow_their_events(spark):
    m = spark.createDataFrame([("a", "UNPARSED"), ("b", "UNPARSED"), ("c", "PARSED")], MESSAGES)
    e = events(spark, state.MESSAGE_EVENT, ("a", "ATTEMPT", None, None, "t1"), ("a", "STATUS", "ERROR", "boom", "t1"),
        ("a", "ATTEMPT", None, None, "t2"), ("a", "STATUS", "PARSED", None, "t2"), ("b", "ATTEMPT", None, None, "t0"))
    got = {r.message_id: (r.feedback_parse_status, r.error, r.attempt_count, r.last_attempt_at) for r in state.current_messages(m,
        e).collect()}
    assert got == {"a": ("PARSED", None, 2, "t2"), "b": ("UNPARSED", None, 1, "t0"), "c": ("PARSED", None, 0, None)}


def test_feedback_is_excluded_included_and_deleted(spark):
    f = spark.createDataFrame([(1, "a", "XX", None, "LIKE", 0), (2, "a", "yy", None, "PASS", 1), (3, "b", None, "xx", None, 0),
        (4, "b", "ZZ", None, None, 0)], FEEDBACK)
    out = state.exclusions(f, "t", about="xx")
    assert {r.feedback_id for r in out.collect()} == {1, 3} and state.exclusions(f, "t", ids=[2]).count() == 0
    assert [r.kind for r in state.exclusions(f, "t", ids=[2], excluded=False).collect()] == ["INCLUDE"]
    e = events(spark, state.FEEDBACK_EVENT, (1, "EXCLUDE", None, "t"), (1, "INCLUDE", None, "t"), (2, "INCLUDE", None, "t"),
        (3, "EXCLUDE", None, "t"), (4, "DELETE", None, "t"))
    assert {r.feedback_id: r.excluded_from_learning for r in state.current_feedback(f, e).collect()} == {1: False, 2: False, 3: True}


def test_requeue_and_approval(spark):
    m = spark.createDataFrame([("a", "ERROR"), ("b", "NEEDS_REVIEW"), ("c", "PARSED"), ("d", "NEEDS_REVIEW")], MESSAGES)
    f = spark.createDataFrame([(1, "b", None, None, None, 0), (2, "c", None, None, None, 0)], FEEDBACK)
    changes, gone = state.requeued(m, f, "t")
    assert {(r.message_id, r.status) for r in changes.collect()} == {(x,
        "UNPARSED") for x in "abd"} and [r.feedback_id for r in gone.collect()] == [1]
    assert [(r.message_id, r.status) for r in state.approved(m, f, "t").collect()] == [("b", "PARSED")]


def test_sources_follow_their_events(spark):
    s = spark.createDataFrame([(1, "COLLECTED", "PENDING"), (2, "COLLECTED", "EXTRACTED"), (3, "INCOMPLETE_CONTENT", "PENDING")],
        "source_id long, collection_status string, extraction_status string")
    e = events(spark, state.SOURCE_EVENT, (1, "EXTRACTED", None, None, "t1"), (1, "OBSERVED", None, None, "t2"),
        (2, "INVALID", "INCOMPLETE_CONTENT", "PAGE_NOT_FOUND", "t3"), (3, "STATUS", "COLLECTED", None, "t1"))
    got = {r.source_id: tuple(r)[1:] for r in state.current_source_state(s, e).collect()}
    assert got == {1: ("COLLECTED", "EXTRACTED", None, "t2"), 2: ("INCOMPLETE_CONTENT", "EXTRACTED", "PAGE_NOT_FOUND", None),
        3: ("COLLECTED", "PENDING", None, None)}
    pages = spark.createDataFrame([(1, "Page not found"), (2, "<p>" + "fine words " * 20), (3, "")], "source_id long, html string")
    assert [(r.source_id, r.reason) for r in state.content_repairs(s, pages, "t").collect()] == [(1, "PAGE_NOT_FOUND")]


def test_a_duplicate_is_taken_out_only_if_all_facts_hold(spark):
    rows = spark.createDataFrame([(1, "official", "BLIND_REVIEW", 0, "LIKE", 11, "$xx", "X, Inc."),
        (2, "official", "BLIND_REVIEW", 0, "PASS", 12, "XX", "x inc"), (3, "candidate", "BLIND_REVIEW", 0, None, None, None, None)],
                                 "feedback_id long, role string, feedback_origin string, excluded_from_learning int, verdict string, assignment_id long, ticker string, company string")
    facts = {"ref": "br-11", "ticker": "xx", "company": "X Inc", "verdict": "like", "retain_ref": "BR-12"}
    failures, event = state.duplicate_repair(rows, 1, 2, facts, "same idea", "t")
    assert failures == [] and [(r.feedback_id, r.kind) for r in event.collect()] == [(1,
        "EXCLUDE")] and state.repaired_duplicates(event).count() == 1
    assert state.duplicate_repair(rows, 1, 2, facts | {"ref": "BR-9", "verdict": "PASS"}, "r",
        "t") == (["REF_DIFFERS", "LABEL_DIFFERS"], None)
    assert "RETAINED_ROW_NOT_OFFICIAL" in state.duplicate_repair(rows, 1, 3, facts, "r", "t")[0] and state.duplicate_repair(rows, 1, 1,
        facts, "r", "t")[0][0] == "SAME_ROW"
    assert state.duplicate_repair(rows, 1, 2, facts, " ",
        "t")[0] == ["REASON_IS_EMPTY"] and "EXCLUDED_ROW_UNKNOWN" in state.duplicate_repair(rows, 9, 2, facts, "r", "t")[0]
    done = rows.withColumn("role", F.when(F.col("feedback_id") == 1,
        "superseded").otherwise(F.col("role"))).withColumn("excluded_from_learning", F.when(F.col("feedback_id") == 1, 1).otherwise(0))
    assert state.duplicate_repair(done, 1, 2, facts, "r", "t") == ([], None)


SOURCE = "The quick brown fox jumps over the lazy dog near the river bank today."
IDEAS = "idea_id long, message_id string, source_status string, extraction_status string, source_text string, source_hash string, ticker string, company string"
PREDICTIONS = "prediction_id long, idea_id long, taste_version int, screen_rules_sha256 string, overall_prediction string"


def test_sources_are_isolated_once(spark):
    m = spark.createDataFrame([(x, f"hm\n> {SOURCE}" if x in "ac" else "no source") for x in "abcde"], "message_id string, body_raw string")
    pool = spark.createDataFrame([(i, x, "c") for i, x in enumerate("aabcd")], "feedback_id long, message_id string, user_comment string")
    known = spark.createDataFrame([("c", ideas.UNSCORABLE), ("d", ideas.UNSCORABLE)], "message_id string, source_status string")
    got = {r.message_id: (r.source_status, r.source_type, r.unscorable_reason) for r in ideas.isolated(m, pool, known).collect()}
    assert got == {"a": ("ISOLATED", "quoted_original", None), "b": (ideas.UNSCORABLE, None, "NO_BOUNDARY"),
        "c": ("ISOLATED", "quoted_original", None)}


def predictor():
    full = {f: t[0] for f, t in models.PREDICTION.items() if isinstance(t, tuple)} | {"key_reasons": ["r"]}

    def call(prompt, budget):
        return json.dumps(full) if prompt == "good" else "{}"
    return call


def test_predictions_are_made_once_and_shown_late(spark):
    i = spark.createDataFrame([(k, f"m{k}", "ISOLATED", "EXTRACTED" if k < 4 else "PENDING", "good" if k != 2 else "bad", "h", "T",
        None) for k in range(1, 5)], IDEAS)
    p = spark.createDataFrame([(1, 1, 2, "r", "WATCH"), (2, 1, 1, "r", "PASS"), (3, 3, 2, "other", "PASS")], PREDICTIONS)
    assert {r.idea_id for r in ideas.without_prediction(i, p, 2, "r").collect()} == {2,
        3} and [r.idea_id for r in ideas.pending_extraction(i).collect()] == [4]
    made = ideas.screening(i, p, "source_text", predictor, 2, "r")
    assert [(r.idea_id, r.overall_prediction, r.key_reasons, r.key_concerns) for r in ideas.new_predictions(made.unionByName(made),
        p).collect()] == [(3, "INVESTIGATE_NOW", ["r"], [])]
    m = spark.createDataFrame([("m1", "PARSED"), ("m3", "NEEDS_REVIEW")], MESSAGES)
    f = spark.createDataFrame([(1, "m1", None, None, "LIKE", 0), (2, "m1", None, None, "PASS", 1), (3, "m3", None, None, "LIKE", 0)],
        FEEDBACK).withColumn("holdout_eligible", F.lit(1))
    assert [(r.idea_id, r.overall_prediction, r.verdict) for r in ideas.revealed(i, p, f, m).collect()] == [(1, "PASS", "LIKE")]
    assert tuple(ideas.sweep_counters(i, p, f, m, 0, 2).first()) == (1, 4, 0, 2)


def extractor():
    return lambda prompt, budget: json.dumps(dict.fromkeys(models.EXTRACTED_IDEA, "x")) if prompt == "good" else "nothing"


def test_extraction_leaves_failures_pending(spark):
    i = spark.createDataFrame([(1, "m", "ISOLATED", "PENDING", "good", "h", None, None),
        (2, "n", "ISOLATED", "PENDING", "bad", "h", None, None)], IDEAS)
    got = {r.idea_id: (r.status, r.idea and r.idea.company) for r in ideas.extraction(i, extractor).collect()}
    assert got == {1: ("OK", "x"), 2: ("RESPONSE_PARSE_ERROR", None)}


LISTS = ", ".join(f"{c} array<string>" for c in NARRATIVE)


def test_narratives_are_completed_by_one_repair(spark):
    s = spark.createDataFrame([(1, 10, "WATCH", ["r"], ["n/a"], []), (2, 11, "PASS", [], [], []), (3, 12, "WATCH", [], [], []),
        (4, 13, "WATCH", ["a"], ["b"], ["c"])], f"screening_id long, source_id long, overall_prediction string, {LISTS}")
    r = spark.createDataFrame([(1, 1, "FAILED", [], ["old"], ["old"], "raw text of a provider"),
        (2, 1, "REPAIRED", ["ignored"], ["c"], ["q"], None), (3, 3, "STILL_INCOMPLETE", ["r"], [], [], "STILL_INCOMPLETE: key_concerns")],
        f"repair_id long, screening_id long, status string, {LISTS}, reason string")
    now = {x.screening_id: (x.key_reasons, x.key_concerns, x.critical_questions) for x in narratives.effective(s, r).collect()}
    assert now[1] == (["r"], ["c"], ["q"]) and now[3] == ([], [], [])
    assert narratives.repairable(s, r).count() == 0 and {x.screening_id for x in narratives.repairable(s,
        r.filter("screening_id = 1")).collect()} == {3}
    listing = {x.repair_id: (x.returned, x.reason, x.complete) for x in narratives.repair_listing(s, r).collect()}
    assert listing == {1: (["key_concerns", "critical_questions"], "LEGACY", True), 2: (list(NARRATIVE), None, True),
        3: (["key_reasons"], "STILL_INCOMPLETE: key_concerns", False)}
    assert {x.overall_prediction: (x.n, x.n_own_gap, x.n_gap) for x in narratives.audit(s, r).collect()} == {"WATCH": (3, 2, 1),
        "PASS": (1, 0, 0)}
    answers = narratives.with_gaps(s).filter("gap").withColumn("answer",
        F.when(F.col("screening_id") == 1, F.struct(F.array(F.lit("x")).alias("key_reasons"), F.array(F.lit("c")).alias("key_concerns"),
        F.array(F.lit("q")).alias("critical_questions"))))
    got = {x.screening_id: (x.status, x.key_reasons, x.key_concerns,
        x.reason) for x in narratives.judged_repairs(answers.withColumn("code", F.lit("PROVIDER_ERROR")).withColumn("detail",
        F.lit("Timeout"))).collect()}
    assert got == {1: ("REPAIRED", [], ["c"], None), 3: ("FAILED", [], [], "PROVIDER_ERROR: Timeout")}


def test_training_records_and_documents(spark):
    f = spark.createDataFrame([(2, "FEEDBACK", "LIKE", "XX", None, "good", '{"positive_reasons": ["a", "b"], "concerns": null}'),
        (1, "NEW_IDEA", None, "", "Co", None, "no json")],
                              "feedback_id long, event_type string, verdict string, ticker string, company string, user_comment string, parsed_json string")
    r = training.training_records(f)
    assert {x.feedback_id: (x.positive_reasons, x.concerns) for x in r.collect()} == {1: ([], []), 2: (["a", "b"], [])}
    assert training.corpus(r, 5) == "[1]\nidea = Co\nkind = NEW_IDEA\nverdict = none\n\n[2]\nidea = XX\nkind = FEEDBACK\nverdict = LIKE\ncomment = good\npositive_reasons = a | b"
    rules = spark.createDataFrame([("low", "e", "w", "LOW"), ("high", "e", "w", "HIGH"), ("odd", "e", "w", "?"), (" ", "e", "w", "HIGH")],
        "rule string, evidence string, reusability string, confidence string")
    assert [x.rule for x in training.valid_rules(rules).collect()] == ["high", "low"] and "1. high" in training.rules_document("v2", "d",
        rules) and "None." in training.rules_document("v2", "d", rules.limit(0))
    assert "3 judgments" in training.preference_document("v1", "d", 3, " body ")


def test_labels(spark):
    df = spark.createDataFrame([(1, 7, None, "XX", "", "Title", "e1", "FEEDBACK", "LIKE", "why", 0.5, "src", None, "2026", "thesis", "u"),
        (2, None, 3, None, None, None, "e2", None, None, None, None, "src", "Jan", None, None, "u")],
                               "feedback_id long, assignment_id long, screening_id long, ticker string, company string, source_title string, external_id string, event_type string, verdict string, user_comment string, confidence double, source_name string, source_date string, discovered_at string, core_thesis string, canonical_url string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in labels.REVIEW_FIELDS if c != "core_thesis"})
    a, b = df.select(labels.idea_pair().alias("p"), labels.source_label().alias("s"), labels.feedback_label(True).alias("f"),
        labels.holdout_name().alias("h"), F.struct(*labels.holdout_refs()).alias("r"), labels.review_item().alias("i")).collect()
    assert (a.p, a.s, a.f, a.h, tuple(a.r)) == ("XX / -", "XX", "FB 1 | XX | FEEDBACK | LIKE | 0.50 | why", "BR-7", ("BR-7", "-"))
    assert (b.p, b.s, b.h, tuple(b.r)) == ("- / -", "e2", "FB 2", ("-",
        "SR-3")) and a.i == "BR-7\nXX / -\nsrc\n2026\ncore thesis: thesis\nu"
