import json

import pytest
from pyspark.sql import functions as F

from quillstone.functions import isolation
from quillstone.operators import models
from quillstone.operators.log import EventLog, Store, consume_authorisation, row_guard
from quillstone.sources import mail, raw_store
from quillstone.streaming import ingest

SOURCE = "The quick brown fox jumps over the lazy dog near the river bank today."


def isolate(spark, body, comment=None):
    df = spark.createDataFrame([(body, comment)], "b string, c string")
    return tuple(isolation.isolate_source(df, "b", "c").first().isolated)


def test_source_isolation(spark):
    assert isolate(spark, f"LIKE\nSOURCE:\n{SOURCE}") == (True, "explicit_source_section", SOURCE, None)
    assert isolate(spark, f"hm\n---- Forwarded message ----\n{SOURCE}")[1] == "forwarded_email"
    assert isolate(spark, f"SOURCE:\n{SOURCE}\nSOURCE:\nx")[3] == "AMBIGUOUS_MARKER" and isolate(spark,
        "SOURCE:\nshort")[3] == "NO_CONTENT_AFTER_MARKER"
    assert isolate(spark, f"hm\n> {SOURCE}") == (True, "quoted_original", SOURCE, None) and isolate(spark,
        f"hm\n> {SOURCE}\nand")[3] == "INTERLEAVED_QUOTES"
    assert isolate(spark, None)[3] == "EMPTY_BODY" and isolate(spark, "just text")[3] == "NO_BOUNDARY"


def test_pasted_source_needs_an_aligned_comment(spark):
    body = f"LIKE\n\nLove the hidden asset value here, cheap stock.\n\n{SOURCE}\n\n{SOURCE}"
    assert isolate(spark, body, "Like. Love the hidden asset value here, cheap stock") == (True, "inline_pasted_source",
        f"{SOURCE}\n\n{SOURCE}", None)
    assert isolate(spark, body)[3] == "NO_COMMENT" and isolate(spark, body, "pass")[3] == "COMMENT_IS_VERDICT_ONLY"
    assert isolate(spark, body, "nothing in common with it whatsoever")[3] == "COMMENT_NOT_ALIGNED"
    assert isolate(spark, "MAYBE.\nonly one", "only one")[3] == "NO_PARAGRAPH_BREAK" and isolate(spark, "LIKE\n\nfine words\n\ntiny",
        "fine words")[3] == "TOO_LITTLE_SOURCE"


def test_mail_listing_and_messages(spark):
    spark.dataSource.register(mail.MailListing)
    read = lambda u: spark.read.format("mail_listing").option("client", "tests.fake_mail:make").option("unauthenticated",
        u).load()
    got = {r.message_id: r.sender_authenticated for r in mail.with_authentication(read("true"), read("false")).collect()}
    assert got == {"m1": "AUTHENTICATED", "m2": "UNAUTHENTICATED"}
    df = spark.createDataFrame([("m", "", "<p>ü", ["a", "b"]), ("n", None, None, None)],
        "message_id string, text string, html string, recipients array<string>")
    rows = {r.message_id: r for r in mail.as_messages(df).collect()}
    assert (rows["m"].body_raw, rows["m"].body_format, rows["m"].recipients, rows["m"].size_bytes) == ("<p>ü", "html", "a, b", 5)
    assert (rows["n"].body_raw, rows["n"].body_format, rows["n"].recipients) == ("", "none", "")


def test_raw_store_writes_once(spark, tmp_path):
    root = f"file://{tmp_path}/raw"
    pages = spark.createDataFrame([("s/1", "a b", "<p>"), ("s/1", "a b", "<p>"), ("t", None, "<q>")],
        "source_name string, external_id string, html string")
    raw_store.save_raw(pages.limit(2), root)
    raw_store.save_raw(pages, root)
    stored = raw_store.read_raw(spark, root)
    assert {r.html for r in raw_store.intact(stored).collect()} == {"<p>", "<q>"}
    with pytest.raises(Exception, match="isn't what its hash says: s"):
        raw_store.intact(stored.withColumn("html", F.concat("html", F.when(F.col("source_name") == "s/1", "!").otherwise("")))).collect()
    assert stored.count() == 2 and stored.filter(F.col("path").startswith("s_1/a_b/")).count() == 1


EVENTS = "message_id string, status string"


def test_log_is_idempotent_and_latest_wins(spark, tmp_path):
    log = EventLog(spark, f"file://{tmp_path}/log", {"messages": EVENTS, "status": EVENTS})
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], EVENTS)
    assert log.append_new("messages", rows, ["message_id"]).count() == 2
    assert log.append_new("messages", rows.union(spark.createDataFrame([("c", "z")], EVENTS)), ["message_id"]).count() == 1
    for s in ("UNPARSED", "PARSED"):
        log.commit(status=spark.createDataFrame([("a", s)], EVENTS))
    assert [r.status for r in log.current("status", ["message_id"]).collect()] == ["PARSED"] and log.table("messages").count() == 3
    log.snapshot("routine-1")
    with pytest.raises(RuntimeError):
        log.commit(expect=1, messages=rows)
    with pytest.raises(RuntimeError):
        row_guard(2, 3)


def test_ids_continue_in_order(spark, tmp_path):
    log = EventLog(spark, f"file://{tmp_path}/log", {"t": "id long, v string"})
    log.commit(t=spark.createDataFrame([(7, "z")], "id long, v string"))
    rows = spark.createDataFrame([(f"v{i:03d}",) for i in reversed(range(50))], "v string")
    got = log.with_ids("t", rows, "id", ["v"]).orderBy("id").collect()
    assert [r.id for r in got] == list(range(8, 58)) and [r.v for r in got] == sorted(r.v for r in got)


def test_authorisation_is_used_once(spark, tmp_path):
    schema = "version_number int, decision string, consumed boolean"
    log = EventLog(spark, f"file://{tmp_path}/log", {"decisions": schema, "versions": "version_number int"})
    log.commit(decisions=spark.createDataFrame([(1, "RETRAIN", False), (2, "ACCEPT", False)], schema))
    new = spark.createDataFrame([(3,)], "version_number int")
    consume_authorisation(log, "decisions", 1, versions=new)
    assert log.table("versions").count() == 1
    for v in (1, 2):
        with pytest.raises(PermissionError):
            consume_authorisation(log, "decisions", v, versions=new)


def test_stream_equals_batch_over_several_runs(spark, tmp_path):
    schema, src = "message_id string, status string", tmp_path / "in"
    src.mkdir()
    rows = [[("a", "1"), ("b", "1"), ("a", "1")], [("b", "2"), ("c", "1")]]
    for i, part in enumerate(rows):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"message_id": m, "status": s}) for m, s in part))
        q = ingest.drain(ingest.unique(ingest.message_stream(spark, str(src), schema), "message_id"), f"{tmp_path}/out", f"{tmp_path}/ck")
        q.awaitTermination(120)
    got = sorted(r.message_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted({m for part in rows for m, _ in part})


def answers():
    def call(prompt, budget):
        if prompt == "long" and budget < 2000:
            raise models.Truncated
        return {"bad": "{", "odd": '{"a": 1}', "long": '{"a": "x", "b": 1}'}.get(prompt, '{"b": 2, "a": "y"}')
    return call


def test_model_answers_become_statuses(spark):
    df = spark.createDataFrame([("ok",), ("bad",), ("odd",), ("long",)], "p string")
    got = {r.p: (r.status, r.answer) for r in models.apply_model(df, "p", answers, {"a": str}).collect()}
    assert got == {"ok": ("OK", '{"a": "y"}'), "bad": ("RESPONSE_PARSE_ERROR", None), "odd": ("VALIDATION_ERROR", None),
        "long": ("OK", '{"a": "x"}')}


def test_forms_are_checked_without_quoting_values():
    good = {"event_type": "FEEDBACK", "verdict": "LIKE", "confidence": 1, "extra": "gone", "concerns": ["x"]}
    assert models.problems_of(good, models.FEEDBACK_EVENT) == [] and "extra" not in models.filled(good, models.FEEDBACK_EVENT)
    bad = good | {"verdict": "secret", "confidence": True, "concerns": [1], "event_type": None}
    assert models.problems_of(bad, models.FEEDBACK_EVENT) == ["event_type: missing", "verdict: not allowed", "concerns: no list of texts",
        "confidence: no float"]
    schema = models.json_schema(models.PREDICTION)
    assert "key_reasons" not in schema["required"] and schema["properties"]["confidence"] == {"type": "string",
        "enum": ["HIGH", "MEDIUM", "LOW"]}

    class Broken(Exception):
        status_code = 503

    def raising(e):
        def call(prompt, budget):
            raise e
        return call

    assert models.generate(raising(Broken("x")), "p", {}) == ("RETRYABLE_ERROR", None,
        "Broken HTTP 503") and models.generate(raising(ValueError("secret")), "p", {}) == ("PROVIDER_ERROR", None, "ValueError")
    assert models.generate(lambda p, b: " ", "p", {}).status == "EMPTY_RESPONSE" and models.provider_detail(Broken("secret")) == "Broken HTTP 503"


def test_forms_have_bounds():
    form = models.repair_fields(["key_reasons"])
    assert models.problems_of({"key_reasons": ["x" * 300] * 2}, form) == [] and models.problems_of({}, form) == []
    assert models.problems_of({"key_reasons": ["x"] * 3}, form) == ["key_reasons: too many items"]
    assert models.problems_of({"key_reasons": ["x", "y" * 301]}, form) == ["key_reasons.1: too long"]
    assert models.problems_of({"key_reasons": "x"}, form) == ["key_reasons: no list of texts"]
    schema = models.json_schema(form)
    assert schema["properties"] == {"key_reasons": {"type": "array", "items": {"type": "string", "maxLength": 300}, "maxItems": 2}}
    assert models.json_schema(form, simple=True)["properties"]["key_reasons"] == {"type": "array", "items": {"type": "string"}}
    worst = json.dumps({f: ["x" * models.REPAIR_CHARS] * models.REPAIR_ITEMS for f in models.PREDICTION if f.startswith("key") or f.startswith("crit")})
    assert len(worst) / 4 < 1024 / 2  # some four characters a token: it fits the budget twice


def test_schemas_that_are_rejected_become_simpler():
    seen = []

    def call(prompt, budget, schema):
        seen.append(schema)
        if schema is not None and "enum" in json.dumps(schema):
            raise models.SchemaRejected
        return json.dumps({"confidence": "HIGH" if schema else "?"})

    call.takes_schema = True
    form = {"confidence": ("HIGH", "LOW")}
    assert models.generate(call, "p", form).status == "OK" and len(seen) == 2 and "enum" not in json.dumps(seen[1])

    def none(prompt, budget, schema):
        if schema is not None:
            raise models.SchemaRejected
        return '{"confidence": "MIDDLE"}'  # what a schema would have ruled out is still found

    none.takes_schema = True
    assert models.generate(none, "p", form) == ("VALIDATION_ERROR", None, "confidence: not allowed")


def test_repairs_are_asked_once_for_what_is_missing(spark):
    def long():
        calls = []

        def call(prompt, budget):
            calls.append(prompt)
            if prompt == "cut" or len(calls) > 9:
                raise models.Truncated
            return json.dumps({"key_reasons": ["r" * 5000] * 50 if prompt == "long" else ["r"], "key_concerns": ["c"]})
        return call

    df = spark.createDataFrame([("ok", ["key_reasons"]), ("long", ["key_reasons", "key_concerns"]), ("cut", ["key_reasons"])], "p string, gaps array<string>")
    got = {r.p: r for r in models.apply_model(df.coalesce(1), "p", long, lambda r: models.repair_fields(list(r["gaps"])), attempts=1).collect()}
    assert json.loads(got["ok"].answer) == {"key_reasons": ["r"]} and (got["long"].status, got["long"].detail) == ("VALIDATION_ERROR",
        "key_reasons: too many items") and got["cut"].status == "TRUNCATED"


def reader():
    def call(prompt, budget):
        event = {"event_type": "FEEDBACK", "verdict": "LIKE", "confidence": 0.9}
        return json.dumps({"events": {"one": [event], "two": [event, event | {"confidence": 0.1}], "none": []}.get(prompt, "nonsense")})
    return call


def test_messages_are_read_as_events(spark):
    df = spark.createDataFrame([(x, x) for x in ("one", "two", "none", "odd")], "message_id string, body string")
    events, outcomes = models.feedback_events(df, "body", reader)
    assert sorted((r.message_id, r.event_index, r.verdict, r.review_reason) for r in events.collect()) == [("one", 0, "LIKE", None),
        ("two", 0, "LIKE", None), ("two", 1, "LIKE", "LOW_CONFIDENCE")]
    assert {r.message_id: r.status for r in outcomes.collect()} == {"one": "PARSED", "two": "NEEDS_REVIEW", "none": "NO_FEEDBACK",
        "odd": "ERROR"}


def test_a_store_is_made_once_and_guards_its_rows(spark, tmp_path):
    make = lambda version=1: Store(spark, f"file://{tmp_path}/s", {"messages": EVENTS}, "messages", version)
    with pytest.raises(FileNotFoundError):
        make().open()
    log = make().create()
    with pytest.raises(FileExistsError):
        make().create()
    log.commit(messages=spark.createDataFrame([("a", "x"), ("b", "y")], EVENTS))
    make().open()
    assert make().daily_snapshot("2026-01-01") and make().daily_snapshot("2026-01-01") is None and make().daily_snapshot("2026-01-02")
    assert make(2).open().table("messages").count() == 2
    with pytest.raises(RuntimeError, match="newer"):
        make().open()
    record = make(2)._record()
    make(2)._write(record | {"rows": 3})
    with pytest.raises(RuntimeError, match="fewer"):
        make(2).open()


def test_every_query_is_registered_without_the_llm_folder():
    import __spark_entry__ as entry
    from quillstone.plans.queries import ORACLES, QUERIES

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) and len(QUERIES) > 50
