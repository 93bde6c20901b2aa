"""Mail intake: a stream with offsets, fetches by tasks, each message stored once."""

import json

from quillstone.plans.workspace import Workspace
from quillstone.sources import mail


def write(path, n, bad=(), spoofed=()):
    path.write_text(json.dumps([{"message_id": f"m{i}", "thread_id": "t", "received_at": f"2026-01-{i + 1:02d}", "sender": "joe@x.org",
        "recipients": ["a", "b"], "subject": "s", "bad": i in bad, "spoofed": i in spoofed} for i in range(n)]))


def test_intake_goes_on_where_it_ended_and_stores_each_message_once(spark, tmp_path):
    box, client = tmp_path / "box.json", f"tests.fake_mail:inbox:{tmp_path / 'box.json'}"
    w, check = Workspace(spark, f"file://{tmp_path}/w"), f"file://{tmp_path}/check"
    w.store.create()
    fetches = lambda: sorted((tmp_path / "box.fetched").read_text().split())
    write(box, 5, bad={1}, spoofed={2})
    assert w.intake(client, check, "d1") == {"stored": 4, "failed": 1}
    rows = {r.message_id: r for r in w.messages().collect()}
    assert set(rows) == {"m0", "m2", "m3", "m4"} and rows["m0"].body_raw == "body of m0" and rows["m0"].feedback_parse_status == "UNPARSED"
    assert {m: r.sender_authenticated for m, r in rows.items()}["m2"] == "UNAUTHENTICATED" and rows["m3"].sender_authenticated == "AUTHENTICATED"
    assert [(r.message_id, r.error) for r in w.log.table("fetch_failures").collect()] == [("m1", "TimeoutError")]
    # The last page grew, a later one came, and what failed is tried again; nothing else is fetched a second time.
    write(box, 8)
    assert w.intake(client, check, "d2") == {"stored": 4, "failed": 0}
    assert sorted(r.message_id for r in w.messages().collect()) == [f"m{i}" for i in range(8)] and fetches() == sorted([f"m{i}" for i in range(8)] + ["m1"])
    before = w.log.seen()
    assert w.intake(client, check, "d3") == {"stored": 0, "failed": 0} and w.log.table("messages").count() == 8
    # A stream that lost its checkpoint lists everything anew and stores nothing twice.
    assert w.intake(client, f"{check}2", "d4") == {"stored": 0, "failed": 0} and len(fetches()) == 9 and w.log.seen() >= before
    assert w.log.table("messages").count() == 8


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    box, client = tmp_path / "box.json", f"tests.fake_mail:inbox:{tmp_path / 'box.json'}"
    write(box, 4)
    w = Workspace(spark, f"file://{tmp_path}/w")
    w.store.create()
    spark.dataSource.register(mail.MailListing)
    listed = mail.with_authentication(*[spark.read.format("mail_listing").option("client", client).load()] * 2)
    assert w._take_in(listed, client, "q#0", "d") == {"stored": 4, "failed": 0}
    seen = w.log.seen()
    assert w._take_in(listed, client, "q#0", "d") == {"stored": 0, "failed": 0} and w.log.seen() == seen


def test_a_task_fetches_a_chunk(spark, tmp_path, monkeypatch):
    box, client = tmp_path / "box.json", f"tests.fake_mail:inbox:{tmp_path / 'box.json'}"
    write(box, 20)
    monkeypatch.setattr(mail, "FETCH_CHUNK", 5)
    got = mail.fetched(spark.range(20).selectExpr("concat('m', id) AS message_id"), client)
    assert got.rdd.getNumPartitions() == 4 and {r.text for r in got.collect()} == {f"body of m{i}" for i in range(20)}
