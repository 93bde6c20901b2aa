import pytest
from pyspark.sql import functions as F

from quillstone import cli, config
from quillstone.functions import text
from quillstone.operators import evaluation, reports
from quillstone.plans.workspace import Workspace

ITEM = "position int, source_name string, company string, ticker string, overall_prediction string, confidence string, key_reasons array<string>, key_concerns array<string>, critical_questions array<string>, mispricing string, variant_perception string, upside string, business_quality string, downside string, canonical_url string"


def item(spark, *rows):
    return spark.createDataFrame([(i + 1, "src", c, t, "WATCH", "HIGH", ["a", "b", "c"], [], None, "x", "x", "x", "x", None,
        "http://u") for i, (c, t) in enumerate(rows)], ITEM)


def test_digest_body(spark):
    one = reports.digest_body(item(spark, ("Foo", "FO")), 5)
    assert one.startswith("Foo / FO / WATCH / HIGH confidence\nFor: a\nFor: b\nmispricing x, variant perception x, upside x, business quality x\nsrc\nhttp://u\n\n")
    assert "For: c" not in one and "Against" not in one and "\n  <rating>\n" in one and "STRONG LIKE, LIKE" in one
    two = reports.digest_body(item(spark, (None, "AB"), ("Bar", None)), 5)
    assert two.startswith("AB / WATCH") and "\n\nBar / WATCH" in two and "\n  AB - <rating>\n" in two
    reply = spark.createDataFrame([("AB - LIKE\nwhy", 2), ("LIKE\nwhy", 1)],
        "t string, n int").select(text.reply_blocks(F.col("t"), F.col("n")).alias("r"))
    assert [r.r.ok for r in reply.collect()] == [True, True]  # what the instructions ask for can be read
    assert reports.digest_subject("2026-01-02").startswith("Quillstone — new ideas worth attention")


def test_evaluation_report_and_refusal(spark):
    rows = evaluation.evaluation_rows(spark.createDataFrame([(1, "LIKE", "INVESTIGATE_NOW"), (2, "PASS", "PASS")],
        "feedback_id long, verdict string, overall_prediction string"))
    m, c = evaluation.metrics(rows), evaluation.confusion_matrix(rows)
    assert "exact: 2 of 2" in reports.evaluation_report(m, c, [("x", True)]) and "precision: 1.000" in reports.evaluation_report(m, c,
        [("x", True)])
    assert "exact" not in reports.evaluation_report(m, c, [("x", False)])


def test_config():
    env = {"QUILLSTONE_ALLOWED_SENDERS": " A@x.org, b@x.org,a@x.org", "QUILLSTONE_STRICT": "no"}
    c = config.load_config(env=env)
    assert c.allowed_senders == ("a@x.org", "b@x.org") and c.strict is False and c.data_dir == "data"
    with pytest.raises(config.ConfigError):
        config.load_config(("mail_client",), env)


def test_logging_is_set_up_once(tmp_path):
    log = config.setup_logging(str(tmp_path / "logs"))
    assert config.setup_logging(str(tmp_path / "logs")) is log and len(log.handlers) == 2 and not log.propagate
    log.warning("hello")
    assert "WARNING quillstone: hello" in (tmp_path / "logs/quillstone.log").read_text()
    for h in list(log.handlers):
        h.close()
        log.removeHandler(h)


@pytest.mark.parametrize("name", ["status", "evaluate", "audit"])
def test_reports_run_on_the_projections(spark, name):
    assert len(cli.report(spark, name, "/root/testdata/sf0.001").splitlines()) >= 5


def test_listings_say_what_they_leave_out(spark, monkeypatch):
    monkeypatch.setattr(cli, "SHOWN_ROWS", 3)
    assert cli.shown(spark.range(5)).splitlines() == ["{'id': 0}", "{'id': 1}", "{'id': 2}", "... 2 more rows"]
    assert len(cli.shown(spark.range(3)).splitlines()) == 3


def test_list(capsys):
    assert cli.main(["list"]) == 0 and "binary_metrics" in capsys.readouterr().out


def test_store_commands(spark, tmp_path):
    root = f"file://{tmp_path}/store"

    def parsed(*args):
        return cli.on_store(spark, cli.build_parser().parse_args([args[0], "--root", root, *args[1:]]))

    assert "made a store" in parsed("init")
    with pytest.raises(FileExistsError):
        parsed("init")
    w = Workspace(spark, root)
    rows = [("m1", "PARSED"), ("m2", "NEEDS_REVIEW"), ("m3", "ERROR")]
    messages = spark.createDataFrame(rows, "message_id string, feedback_parse_status string")
    events = spark.createDataFrame([(1, "m1", 0, "XX", "FEEDBACK", False), (2, "m2", 0, "YY", "UNCLEAR", False)], "feedback_id long, message_id string, event_index int, ticker string, event_type string, excluded_from_learning boolean")
    w.log.commit(messages=w._formed("messages", messages), feedback=w._formed("feedback", events))
    assert "'n_messages': 3" in parsed("store-status") and "YY | UNCLEAR" in parsed("show-review")
    assert parsed("exclude", "--about", "xx", "--at", "t") == "changed: 1" and parsed("include", "--feedback-id", "1", "--at", "t") == "changed: 1"
    assert parsed("approve", "m2", "--at", "t") == "approved" and parsed("approve", "m3", "--at", "t") == "nothing to approve"
    assert parsed("requeue", "--message-id", "m3", "--at", "t") == "requeued: 1" and "routine-d1" in parsed("backup", "--at", "d1") and "one of this day" in parsed("backup", "--at", "d1")
    assert "'n_official': 0" in parsed("store-audit", "9") and parsed("show-repairs") == "" and parsed("show-predictions") == ""
    with pytest.raises(ValueError, match="either"):
        parsed("exclude", "--at", "t")
    assert parsed("version-status").startswith("version: None") and parsed("snapshots").splitlines()[-1].startswith("routine-d1")
    rules = tmp_path / "rules.txt"
    rules.write_text("100% upside")
    sha = parsed("freeze-rules", "--rules", str(rules))
    assert w.artifact(sha) == "100% upside" and parsed("restore", "routine-d1") == "restored routine-d1" and w.log.table("artifacts").count() == 0
    assert parsed("preview-digest", "1") == "nothing to send"
