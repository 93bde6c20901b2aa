"""The whole workflow on one small store: pages, screenings, a digest, replies, reviews, predictions, a version."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillstone.functions.text import PRODUCT
from quillstone.operators import log as event_log
from quillstone.operators import models
from quillstone.operators.log import EventLog
from quillstone.plans.workspace import TABLES, Refused, Tampered, Unavailable, Workspace

MAIL = "message_id string, thread_id string, received_at string, sender string, subject string, body_raw string, body_format string, sender_authenticated string"
SOURCE = "The quick brown fox jumps over the lazy dog near the river bank today."


def page(i, words="content"):
    return (str(i), f"http://x/sp/{i}", f"<title>Idea {i}</title><p>{' '.join(f'{words}{i}' for _ in range(30))}</p>")


def extractor():
    def call(prompt, budget):
        i = next((c for c in prompt if c.isdigit()), "0")
        return json.dumps(dict.fromkeys(models.EXTRACTED_IDEA, "x") | {"ticker": f"T{i}", "company": f"Firm {i}"})
    return call


def screener():
    full = {f: t[0] for f, t in models.PREDICTION.items() if isinstance(t, tuple)}
    return lambda prompt, budget: json.dumps(full | ({"key_reasons": ["r"], "key_concerns": ["c"],
        "critical_questions": ["q"]} if "1" in prompt else {"key_reasons": ["r"]}))


def repairer():
    return lambda prompt, budget: json.dumps({"key_concerns": ["c"], "critical_questions": ["q"]})


def reader():
    return lambda prompt, budget: json.dumps({"events": [{"event_type": "FEEDBACK", "verdict": "LIKE", "ticker": "ZZ",
        "confidence": 0.2 if "unsure" in prompt else 0.9}]})


def adopt(w, document="likes cheap stocks", sha=None):
    """Version 1 of a document, and frozen rules; returns the rules' hash."""
    row = (1, "2026-01-01", 15, 0, document, sha or hashlib.sha256(document.encode()).hexdigest(), "", "")
    w.log.commit(versions=w.spark.createDataFrame([row], TABLES["versions"]))
    return w.freeze("rules", "upside above 100%")


def test_the_whole_workflow(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/w")
    w.store.create()

    def mail(*rows):
        return w.check_mail(spark.createDataFrame([(i, t, "2026-02-01", "Joe <joe@x.org>" if i != "m9" else "eve@x.org", s, b, "text",
            "AUTHENTICATED") for i, t, s, b in rows], MAIL))

    pages = spark.createDataFrame([page(1), page(2), page(3), ("4", "http://x/sp/4", "<p>Page not found</p>")],
        "external_id string, canonical_url string, html string")
    assert {r.external_id: r.action for r in w.collect(pages, "web", "2026-01-01").collect()} == {str(i): "insert" for i in range(1, 5)}
    assert {r.external_id: (r.collection_status, r.invalid_reason) for r in w.sources().collect()}["4"] == ("INCOMPLETE_CONTENT",
        "PAGE_NOT_FOUND")
    assert w.extract("web", extractor, "2026-01-03").filter("status = 'OK'").count() == 3
    rules = adopt(w)
    assert w.screen(1, rules, F.col("external_id"), screener, "2026-01-04").count() == 3
    assert {r.external_id: r.ticker for r in w.sources().collect()} == {"1": "T1", "2": "T2", "3": "T3", "4": None}
    assert [r.status for r in w.repair_narratives(repairer, "2026-01-05").collect()] == ["REPAIRED", "REPAIRED"]  # two narratives have gaps

    sent = []
    thread = w.send_digest(1, "2026-01-06T00:00", lambda subject, body, key: sent.append((subject, body, key)) or "thread")
    assert thread == "thread" and all(f"Firm {i}" in sent[0][1] for i in (1, 2, 3)) and w.send_digest(1, "2026-01-07", None) is None

    assert mail(("m1", "thread", f"Re: {PRODUCT} — new ideas worth attention", "T1 - LIKE\ngood\nFirm 2 - PASS\nno"),
        ("m2", "t2", "thoughts", "buy ZZ"), ("m3", "t3", "thoughts", "unsure of ZZ"),
                ("m4", "t4", f"Re: {PRODUCT} - new ideas worth attention", "LIKE"),
                ("m9", "t9", "x", "x")) == 5 and mail(("m1", "thread", "x", "x")) == 0
    got = {r.message_id: (r.route, r.status) for r in w.parse_mail(["joe@x.org"], "2026-02-02", reader).collect()}
    assert got == {"m1": ("DIGEST_REPLY", "PARSED"), "m2": ("MODEL", "PARSED"), "m3": ("MODEL", "NEEDS_REVIEW"),
        "m4": ("NEEDS_REVIEW", "NEEDS_REVIEW"), "m9": ("SKIPPED_SENDER", "SKIPPED_SENDER")}
    f = {(r.message_id, r.event_index): r for r in w.feedback().collect()}
    assert f["m1", 0].ticker == "T1" and f["m1", 1].verdict == "PASS" and f["m1", 1].source_id != f["m1",
        0].source_id and len({r.feedback_id for r in f.values()}) == 4
    assert w.status().first().n_violations == 1  # m4 is in review without events
    assert w.approve("m3", "2026-02-03") and not w.approve("m4", "2026-02-03") and w.requeue("2026-02-03", ["m4"]) == 1
    assert w.exclude("2026-02-04", about="zz") == 2 and w.exclude("2026-02-04", about="ZZ", excluded=False) == 2

    w.collect(spark.createDataFrame([page(5), page(6)], pages.schema), "web", "2026-02-05")
    w.extract("web", extractor, "2026-02-05")
    assigned = w.assign_reviews(5, "2026-02-06").collect()
    assert len(assigned) == 2
    mail(("m8", "t8", "thoughts", f"hm\n> {SOURCE}"), ("m5", "t5", f"Re: {PRODUCT} Blind Review",
        f"BR-{assigned[0].assignment_id} — MAYBE\nhm"), ("m6", "t6", f"{PRODUCT} screen review", "SR-1: pass\nno"))
    assert {r.message_id: r.status for r in w.parse_mail(["joe@x.org"], "2026-02-07", reader).collect()} == {"m5": "PARSED", "m6": "PARSED",
        "m4": "NEEDS_REVIEW", "m8": "PARSED"}
    last = {r.message_id: r for r in w.feedback().collect()}
    assert last["m5"].assignment_id == assigned[0].assignment_id and last["m6"].screening_id == 1 and not last["m6"].holdout_eligible
    assert [r.judged_at for r in w.assignments().orderBy("assignment_id").collect()] == ["2026-02-07", None]

    s = w.audit(0).first()
    assert (s.n_official, s.n_candidates, s.clean) == (6, 0, False)
    assert tuple(w.shadow_score(1, 0, rules, "2026-02-10", extractor, screener).first())[1:] == (1, 4, 1)
    assert [(r.message_id, r.verdict) for r in w.shadow_results().collect()] == [("m8", "LIKE")]

    with pytest.raises(PermissionError, match="TOO_FEW_RECORDS"):
        w.build_version("2026-02-11", lambda p, b: "x", propose(), "rules")


RULE = {"rule": "Buy low", "evidence": "e", "reusability": "r", "confidence": "HIGH"}


def propose(*rules):
    return lambda prompt, budget: json.dumps({"rules": list(rules)})


def judged(spark, tmp_path, monkeypatch, n=2):
    """A store with n parsed judgments, of which one is enough for a build and for a hold-out."""
    from quillstone.operators import governance

    monkeypatch.setattr(governance, "LEAST_TRAINING_RECORDS", 1)
    monkeypatch.setattr(governance, "HOLDOUT_SIZE", 1)
    w = Workspace(spark, f"file://{tmp_path}/w")
    w.store.create()
    w.check_mail(spark.createDataFrame([(f"m{i}", "t", "d", "joe@x.org", "x", "buy", "text", "AUTHENTICATED") for i in range(n)], MAIL))
    w.parse_mail(["joe@x.org"], "2026-01-01", reader)
    return w


def test_drafts_are_asked_again_and_held_against_the_rules(spark, tmp_path, monkeypatch):
    w, asked, heard = judged(spark, tmp_path, monkeypatch), [], []

    def answers(*each):
        left = list(each)

        def call(prompt, budget):
            asked.append(prompt)
            a = left.pop(0)
            if isinstance(a, Exception):
                raise a
            return a
        return call

    good, rules = json.dumps({"rules": [RULE] * 7}), "Upside above 100% is asked for."
    # Truncated and empty texts, and JSON that is broken or of another form, are asked for again, with the same corpus and a reminder.
    with pytest.raises(models.ModelFailure, match="TRUNCATED.*3 attempts"):
        w.build_version("d", answers(*[models.Truncated()] * 3), propose(), rules)
    assert len(asked) == 3 and asked[1] == asked[2] == asked[0] + models.REMINDER and asked[0].startswith("PERMANENT RULES") and rules in asked[0]
    with pytest.raises(models.ModelFailure, match="RESPONSE_PARSE_ERROR: malformed JSON"):
        w.build_version("d", lambda p, b: "text", answers('{"rules": [', "```json", '{"rules": [}'), rules)
    asked.clear()
    with pytest.raises(models.ModelFailure, match="PROVIDER_ERROR: ValueError"):  # a failed call isn't repeated, nor is its text told
        w.build_version("d", answers(ValueError("key 123")), propose(), rules)
    assert len(asked) == 1 and w.latest_version() is None and w.log.table("rejected").count() == 0
    # A threshold that the rules don't have is refused and kept aside, in the document or in a rule.
    for write, made, part in ((lambda p, b: "fine\nIt must reach 3x.", good, "document"),
            (lambda p, b: "fine", json.dumps({"rules": [RULE | {"evidence": "a hard 2x floor"}]}), "rule 1")):
        with pytest.raises(Refused, match=part):
            w.build_version("d", write, answers(made), rules)
    kept = w.log.table("rejected").orderBy("__seq").collect()
    assert [(r.part, r.line, r.reason) for r in kept][0] == ("document", 2, "MULTIPLE_REQUIRED") and {r.part for r in kept} == {"document", "rule 1"}
    assert w.latest_version() is None
    with pytest.raises(PermissionError, match="NO_PERMANENT_RULES"):
        w.build_version("d", lambda p, b: "x", propose(), " ")
    # One that they have may be restated; the second attempt succeeds, and at most five rules are taken.
    write = answers(models.Truncated(), "We require at least 100% upside; 3x isn't required.")
    assert w.build_version("2026-01-02", write, answers("{", good), rules, tried=lambda i, code: heard.append((i, code))) == 1
    v = w.latest_version()
    assert heard == [(1, "TRUNCATED"), (1, "RESPONSE_PARSE_ERROR")] and v.rules_document.count("Buy low") == 5
    assert w.log.table("version_training").count() == 2 and v.permanent_rules_sha256 == hashlib.sha256(rules.encode()).hexdigest()


def test_screening_refuses_inputs_that_changed(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/w")
    w.store.create()
    screen = lambda sha: w.screen(1, sha, F.col("external_id"), screener, "d")
    with pytest.raises(Unavailable, match="version 1"):
        screen("none")
    rules = adopt(w)
    assert w.freeze("rules", "upside above 100%") == rules and w.log.table("artifacts").count() == 1
    assert w.frozen(1, rules) == ("likes cheap stocks", "upside above 100%") and screen(rules).count() == 0
    with pytest.raises(Unavailable, match="artifact none"):
        screen("none")
    w.log.commit(artifacts=spark.createDataFrame([("f" * 64, "rules", "other")], TABLES["artifacts"]))
    for f in (screen, lambda sha: w.shadow_score(1, 0, sha, "d", extractor, screener)):
        with pytest.raises(Tampered, match="fff"):
            f("f" * 64)
    other = Workspace(spark, f"file://{tmp_path}/v")
    other.store.create()
    sha = adopt(other, sha="0" * 64)
    with pytest.raises(Tampered, match="version 1"):
        other.screen(1, sha, F.col("external_id"), screener, "d")


def test_training_ids_of_old_versions_become_rows(spark, tmp_path):
    old = TABLES["versions"].replace(", permanent_rules_sha256 string", ", training_feedback_ids array<long>")
    root = f"file://{tmp_path}/w"
    w = Workspace(spark, root)
    w.store.version = w.log.version = 1
    w.log.schemas = TABLES | {"versions": old}
    w.store.create()
    w.log.commit(versions=spark.createDataFrame([(1, "d", 2, 9, "doc", "sha", "", [4, 9])], old))
    now = Workspace(spark, root)
    now.store.open()
    now.store.open()
    assert sorted(tuple(r)[:2] for r in now.log.table("version_training").collect()) == [(1, 4), (1, 9)]
    assert now.latest_version().permanent_rules_sha256 is None and now.latest_version().artifact == "doc"


def test_versions_need_a_decision(spark, tmp_path, monkeypatch):
    w = judged(spark, tmp_path, monkeypatch)
    build = lambda at: w.build_version(at, lambda prompt, budget: f"{prompt.count('idea = ZZ')} ideas", propose(RULE), "rules")
    assert build("2026-01-02") == 1
    v = w.latest_version()
    assert "2 ideas" in v.artifact and "Buy low" in v.rules_document and v.checkpoint_feedback_id == 2
    assert sorted(r.feedback_id for r in w.log.table("version_training").collect()) == [1, 2]
    with pytest.raises(PermissionError, match="HOLDOUT_INCOMPLETE"):
        build("2026-01-03")
    w.check_mail(spark.createDataFrame([("m3", "t", "d", "joe@x.org", "x", "buy", "text", "AUTHENTICATED")], MAIL))
    w.parse_mail(["joe@x.org"], "2026-01-04", reader)
    with pytest.raises(PermissionError, match="NOT_AUTHORISED"):
        build("2026-01-05")
    record = {"taste_version": 1, "decision": "RETRAIN", "reason": "r", "recorded_at": "d", "evaluation_fingerprint": "f"}
    w.record_decision(record)
    with pytest.raises(PermissionError, match="has a decision"):
        w.record_decision(record)
    assert build("2026-01-06") == 2 and w.decision(1) == ("RETRAIN", True)
    with pytest.raises(PermissionError):
        build("2026-01-07")


def test_manifests_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(event_log, "COMPACT", 3)
    log = EventLog(spark, f"file://{tmp_path}/log", {"t": "x long"})
    for i in range(8):
        assert log.commit(t=spark.range(i, i + 1).toDF("x")) == i + 1
    assert sorted(r.x for r in log.table("t").collect()) == list(range(8)) and [m["seq"] for m in log.batches()] == list(range(1,
        9)) and log.seen() == 8
    assert len(list((tmp_path / "log/_manifests").glob("*.json"))) < 8
    with pytest.raises(RuntimeError):
        log.commit(expect=3, t=spark.range(1).toDF("x"))


def held_out(spark, tmp_path, monkeypatch):
    """A store whose version 1 has a clean hold-out of three: one right, one missed and one false alarm."""
    from quillstone.operators import audit, governance

    monkeypatch.setattr(governance, "HOLDOUT_SIZE", 3)
    monkeypatch.setattr(audit, "HOLDOUT_SIZE", 3)
    w = Workspace(spark, f"file://{tmp_path}/w")
    w.store.create()
    rules = adopt(w)
    rows = [(1, "AB", "LIKE", "INVESTIGATE_NOW", ["cheap"]), (2, "CD", "MAYBE", "PASS", ["no edge here", "needs 3x"]), (3, "EF", "PASS", "WATCH", ["cyclical"])]
    frame = lambda name, schema, made: w._formed(name, spark.createDataFrame(made, schema))
    w.log.commit(
        messages=frame("messages", "message_id string, feedback_parse_status string", [(f"m{i}", "PARSED") for i, *_ in rows]),
        sources=frame("sources", "source_id long, source_name string, external_id string, ticker string, collection_status string", [(i, "web", str(i), t, "COLLECTED") for i, t, *_ in rows]),
        screenings=frame("screenings", "screening_id long, source_id long, created_at string, taste_version int, screening_prompt_version int, overall_prediction string, upside string, key_reasons array<string>",
            [(10 + i, i, "2026-01-05", 1, 7, p, "Unknown", why) for i, _, _, p, why in rows]),
        assignments=frame("assignments", "assignment_id long, source_id long, assigned_at string", [(20 + i, i, "2026-01-06") for i, *_ in rows]),
        feedback=frame("feedback", "feedback_id long, message_id string, event_index int, event_type string, verdict string, ticker string, user_comment string, created_at string, excluded_from_learning boolean, feedback_origin string, holdout_eligible boolean, source_id long, assignment_id long",
            [(i, f"m{i}", 0, "FEEDBACK", v, t, f"said {t}", "2026-01-07", False, "BLIND_REVIEW", True, i, 20 + i) for i, t, v, *_ in rows]))
    return w, rules


def test_an_evaluation_counts_only_if_its_checks_hold(spark, tmp_path, monkeypatch):
    w, rules = held_out(spark, tmp_path, monkeypatch)
    e = w.evaluation(1)
    assert e.passed, e.checks
    text = w.evaluation_report(1, "upside above 100% please")
    assert "exact: 1 of 3" in text and "tp 1, fp 1, tn 0, fn 1" in text and "> upside above 100% please" in text
    assert "false negative: 1\n  FB 2 | - (CD) | SR-12, prompt 7 | said PASS | judged MAYBE = WATCH | false_negative\n    comment: said CD\n    ratings: " in text
    assert "For: no edge here | needs 3x" in text and '3x-style multiple in key_reasons: "needs 3x"' in text and "no edge: 1 (FB 2)" in text and "cyclical:" not in text
    status = w.version_status()
    assert (status["holdout"], status["holdout_complete"], status["building"], status["awaiting_evaluation"], status["intact"]) == (3, True, "LOCKED", True, True)
    assert status["labels_of_next"]["pass_family"] == 1 and status["by_origin"] == {"BLIND_REVIEW": 3}
    record = w.decide(1, "RETRAIN", " misses ", rules, "2026-01-09")
    assert record["reason"] == "misses" and record["screening_prompt_version"] == 7 and record["holdout_count"] == 3
    assert w.version_status()["building"] == "ONE_BUILD_AUTHORISED" and "before-decision-1" in {s["label"] for s in w.log.snapshots()}
    with pytest.raises(PermissionError, match="has a decision"):
        w.decide(1, "ACCEPT", "no", rules, "2026-01-10")
    with pytest.raises(Unavailable):
        w.decide(1, "ACCEPT", "no", "unknown", "2026-01-10")
    # A second screening before a judgment, by another prompt, makes the prediction doubtful; a duplicate spoils the hold-out.
    more = spark.createDataFrame([(19, 1, "2026-01-06", 1, 8, "WATCH")], "screening_id long, source_id long, created_at string, taste_version int, screening_prompt_version int, overall_prediction string")
    w.log.commit(screenings=w._formed("screenings", more))
    failed = lambda: [name for name, ok in w.evaluation(1).checks if not ok]
    assert failed() == ["every member has a label and one earlier prediction", "one prompt version"]
    assert "exact" not in w.evaluation_report(1, "rules")
    w.log.commit(sources=w._formed("sources", spark.createDataFrame([(4, "web", "1", "AB")], "source_id long, source_name string, external_id string, ticker string")),
        messages=w._formed("messages", spark.createDataFrame([("m4", "PARSED")], "message_id string, feedback_parse_status string")),
        feedback=w._formed("feedback", spark.createDataFrame([(4, "m4", "PASS", "AB", False, "BLIND_REVIEW", True, 4, "2026-01-09")],
            "feedback_id long, message_id string, verdict string, ticker string, excluded_from_learning boolean, feedback_origin string, holdout_eligible boolean, source_id long, created_at string")))
    assert {"hold-out is complete", "no duplicate groups", "no problems"} <= set(failed())
    lines = w.remediation(0)
    assert any("keep FB 1, exclude the other 1" in x for x in lines) and any(x.startswith("FB 4 (official): NO_ASSIGNMENT") for x in lines)
