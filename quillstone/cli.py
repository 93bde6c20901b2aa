"""python -m quillstone.cli: lists the registered queries, runs one, explains its plan, prints a report, or works on a store."""

from __future__ import annotations

import argparse
import importlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import audit, digest, evaluation, feedback, labels, reports
from quillstone.operators.storage import materialize
from quillstone.plans.projections import projection
from quillstone.plans.queries import CHECKPOINT, QUERIES, TASTE
from quillstone.plans.workspace import Workspace

#: Rows of a listing that are shown.
SHOWN_ROWS = 200


def _loaded(name: str):
    """What module:name names, as a model's factory."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


#: Commands on a store: what they do, their arguments, and what does it, as (workspace, arguments) to a text.
STORE = {
    "init": ("make a new store", {}, None),
    "store-status": ("messages by state, judgments and broken invariants", {}, lambda w, a: shown(w.status())),
    "take-in": ("store new mail of a client", {"--client": str, "--checkpoint": str, "--at": str}, lambda w, a: str(w.intake(a.client, a.checkpoint, a.at))),
    "parse-mail": ("read pending messages; --model reads those that no form fits", {"--sender": str, "--at": str, "--model": _loaded},
        lambda w, a: shown(w.parse_mail([a.sender], a.at, a.model))),
    "collect": ("store fetched pages, a Parquet table", {"--pages": str, "--source": str, "--at": str},
        lambda w, a: shown(w.collect(w.spark.read.parquet(a.pages), a.source, a.at).groupBy("action").count())),
    "extract": ("have a model read new documents", {"--source": str, "--at": str, "--model": _loaded},
        lambda w, a: shown(w.extract(a.source, a.model, a.at).groupBy("status").count())),
    "freeze-rules": ("store the permanent rules, a text file; says their hash", {"--rules": str}, lambda w, a: w.freeze("rules", Path(a.rules).read_text())),
    "screen": ("have a model screen ready documents, or one of them", {"version": int, "--rules-sha256": str, "--at": str, "--model": _loaded, "--external-id": str},
        lambda w, a: shown(w.screen(a.version, a.rules_sha256, F.col("raw_text"), a.model, a.at, external_id=a.external_id).groupBy("status").count())),
    "preview-digest": ("the digest that would be sent now", {"version": int}, lambda w, a: preview(w, a.version)),
    "show-review": ("messages in review with their events", {}, lambda w, a: under_review(w)),
    "exclude": ("take judgments out of learning", {"--about": str, "--feedback-id": int, "--at": str}, lambda w, a: excluded(w, a, True)),
    "include": ("take judgments back into learning", {"--about": str, "--feedback-id": int, "--at": str}, lambda w, a: excluded(w, a, False)),
    "requeue": ("put messages in error or review back in the queue", {"--message-id": str, "--at": str},
        lambda w, a: f"requeued: {w.requeue(a.at, None if a.message_id is None else [a.message_id])}"),
    "approve": ("approve a message in review", {"message_id": str, "--at": str}, lambda w, a: "approved" if w.approve(a.message_id, a.at) else "nothing to approve"),
    "show-repairs": ("narrative repairs of current screenings", {}, lambda w, a: shown(w.repairs())),
    "show-predictions": ("blind predictions beside the judgments that came after", {}, lambda w, a: shown(w.shadow_results())),
    "store-audit": ("the hold-out audit of a version's checkpoint", {"checkpoint": int}, lambda w, a: shown(w.audit(a.checkpoint))),
    "remediation": ("what to do about the hold-out", {"checkpoint": int}, lambda w, a: "\n".join(w.remediation(a.checkpoint))),
    "version-status": ("the newest version, its hold-out and what may be built", {}, lambda w, a: "\n".join(f"{k}: {v}" for k, v in w.version_status().items())),
    "evaluate-version": ("hold a version against its hold-out", {"version": int, "--rules": str},
        lambda w, a: w.evaluation_report(a.version, Path(a.rules).read_text())),
    "decide": ("record what an evaluation led to", {"version": int, "--decision": str, "--reason": str, "--rules-sha256": str, "--at": str},
        lambda w, a: str(w.decide(a.version, a.decision, a.reason, a.rules_sha256, a.at))),
    "backup": ("a routine snapshot, at most one a day", {"--at": str}, lambda w, a: w.store.daily_snapshot(a.at) or "there is one of this day"),
    "snapshots": ("what can be restored, newest first", {}, lambda w, a: "\n".join(f"{s['label']} (batch {s['seq']})" for s in w.log.snapshots())),
    "restore": ("go back to a snapshot; what came since is kept aside", {"label": str}, None),
}
#: Arguments that may be left out.
OPTIONAL = ("--about", "--feedback-id", "--message-id", "--external-id", "--model")


def shown(df: DataFrame) -> str:
    """Rows as text, and how many more there are."""
    rows = df.limit(SHOWN_ROWS + 1).collect()
    more = [f"... {df.count() - SHOWN_ROWS} more rows"] if len(rows) > SHOWN_ROWS else []
    return "\n".join([*(str(r.asDict(True)) for r in rows[:SHOWN_ROWS]), *more])


def under_review(w: Workspace) -> str:
    waiting = feedback.under_review(w.messages(), w.feedback())
    return "\n".join([shown(waiting), shown(feedback.events_of(w.feedback(), waiting).select(labels.feedback_label(True).alias("event")))])


def excluded(w: Workspace, args: argparse.Namespace, how: bool) -> str:
    ids = None if args.feedback_id is None else [args.feedback_id]
    return f"changed: {w.exclude(args.at, args.about, ids, excluded=how)}"


def preview(w: Workspace, version: int) -> str:
    """The next digest; nothing is sent or recorded."""
    chosen = materialize(w.digest(version))
    return reports.digest_body(chosen, digest.DIGEST_SIZE) if chosen.limit(1).count() else "nothing to send"


def on_store(spark: SparkSession, args: argparse.Namespace) -> str:
    """What a command of STORE says, after doing it."""
    w = Workspace(spark, args.root)
    if args.command == "init":
        w.store.create()
        return f"made a store at {args.root}"
    if args.command == "restore":  # before the row guard, which may be why
        w.store.restore(args.label)
        return f"restored {args.label}"
    w.store.open()
    return STORE[args.command][2](w, args)


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillstone", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the registered queries")
    for name, what in (("run", "show a query's first rows"), ("explain", "show a query's physical plan")):
        q = sub.add_parser(name, help=what)
        q.add_argument("query", choices=sorted(QUERIES))
        q.add_argument("--data", required=True, help="folder of the parquet tables")
        q.add_argument("--limit", type=int, default=20)
    for name in ("status", "evaluate", "audit"):
        sub.add_parser(name, help=f"the {name} report").add_argument("--data", required=True)
    for name, (what, arguments, _) in STORE.items():
        q = sub.add_parser(name, help=what)
        q.add_argument("--root", required=True, help="folder of the store")
        for flag, kind in arguments.items():
            q.add_argument(flag, type=kind, **({"required": flag not in OPTIONAL} if flag.startswith("--") else {}))
    return p


def report(spark: SparkSession, command: str, data: str) -> str:
    view = lambda name: projection(spark, data, f"p_{name}")
    if command == "status":
        row = QUERIES["status_counts"](spark, data).first().asDict()
        return "\n".join([*(f"{k}: {v}" for k, v in row.items()), f"violations: {QUERIES['invariant_violations'](spark, data).count()}"])
    if command == "evaluate":
        rows = evaluation.evaluation_rows(evaluation.asof_predictions(view("judgments"), view("screenings"), TASTE))
        return reports.evaluation_report(evaluation.metrics(rows), evaluation.confusion_matrix(rows),
            [("judgments with a prediction", True)])
    rows = audit.validity_problems(audit.roles(view("feedback"), view("messages"), CHECKPOINT).withColumn("screening_id",
        F.col("source_id")))
    held = rows.filter(F.col("role").isin("official", "candidate"))
    groups = audit.duplicate_groups(held)
    return reports.audit_report(audit.audit_summary(rows, groups), held, audit.group_report(groups, audit.identity_keys(held)), at_most=20)


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = SparkSession.builder.appName("quillstone").getOrCreate()
    if args.command == "run":
        QUERIES[args.query](spark, args.data).show(args.limit, truncate=80)
    elif args.command == "explain":
        QUERIES[args.query](spark, args.data).explain("formatted")
    elif args.command in STORE:
        print(on_store(spark, args))
    else:
        print(report(spark, args.command, args.data))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
