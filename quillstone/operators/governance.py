"""Whether an evaluation counts, what it found as a durable record, and when a new version may be built."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.exprs import VERDICTS
from quillstone.operators.audit import HOLDOUT_SIZE

DECISIONS = ("RETRAIN", "ACCEPT")
LEAST_TRAINING_RECORDS = 15
#: Members of a hold-out that an evaluation takes.
MOST_MEMBERS = 10 * HOLDOUT_SIZE


@dataclass(frozen=True)
class Version:
    version_number: int
    checkpoint_feedback_id: int
    artifact_sha256: str
    build_unlocked: bool = False


def gate_checks(latest: Version, requested: int, artifact: bytes | None, summary: DataFrame, n_duplicate_groups: int, members: DataFrame,
        decided: bool = False) -> list[tuple[str, bool]]:
    """Named checks in order; an evaluation counts if all hold. summary: one row of audit_summary(); members: official rows with
    verdict, overall_prediction and n_prompt_versions (prompt versions among the screenings before the judgment), screening_prompt_version."""
    s = summary.first()
    known = F.coalesce(F.col("verdict").isin(*VERDICTS),
        F.lit(False)) & F.col("overall_prediction").isNotNull() & (F.coalesce("n_prompt_versions", F.lit(1)) == 1)
    m = members.agg(F.count("*").alias("n"), F.count_if(~known).alias("bad"),
        F.count_distinct("screening_prompt_version").alias("prompts")).first()
    intact = artifact is not None and hashlib.sha256(artifact).hexdigest() == latest.artifact_sha256
    return [
        ("version is the latest", requested == latest.version_number), ("artifact is intact", intact),
        ("version is frozen or unlocked by a decision", not latest.build_unlocked or decided),
        ("hold-out is complete", s.n_official == HOLDOUT_SIZE), ("members are valid and unique",
        s.n_valid_unique == HOLDOUT_SIZE and s.n_unique == HOLDOUT_SIZE), ("no candidates", s.n_candidates == 0),
        ("no duplicate groups", n_duplicate_groups == 0), ("no problems", s.n_problem_rows == 0),
        ("every member has a label and one earlier prediction", m.bad == 0), ("one prompt version", m.n == 0 or m.prompts == 1)]


def decision_record(latest: Version, members: DataFrame, metrics: DataFrame, rules_sha256: str, decision: str, reason: str,
        recorded_at: str) -> dict:
    """The record of a decision, with a fingerprint of the evaluation's inputs and results; decision and reason aren't part of it.

    members: the hold-out's rows (feedback_id, actual, overall_prediction, screening_id, screening_prompt_version), all of
    which the fingerprint covers; more than MOST_MEMBERS are refused.
    """
    if decision not in DECISIONS:
        raise ValueError(f"unknown decision {decision!r}")
    rows = members.orderBy("feedback_id").limit(MOST_MEMBERS + 1).collect()
    if len(rows) > MOST_MEMBERS:
        raise ValueError(f"more than {MOST_MEMBERS} members of a hold-out")
    prompts = {r.screening_prompt_version for r in rows}
    m = metrics.first().asDict()
    found = {k: m[k] for k in ("n", "exact_correct", "tp", "fp", "tn", "fn", "recall", "balanced_accuracy", "hc_hit", "hc_actual")}
    evaluated = {
        "taste_version": latest.version_number, "checkpoint_feedback_id": latest.checkpoint_feedback_id,
        "artifact_sha256": latest.artifact_sha256, "screen_rules_sha256": rules_sha256,
        "screening_prompt_version": prompts.pop() if len(prompts) == 1 else None,
        "holdout": [[r.feedback_id, r.actual, r.overall_prediction, r.screening_id] for r in rows], "metrics": found}
    fingerprint = hashlib.sha256(json.dumps(evaluated, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return {k: v for k, v in evaluated.items() if k not in ("holdout", "metrics")} | found | {"decision": decision, "reason": reason,
        "recorded_at": recorded_at, "holdout_count": len(rows), "evaluation_fingerprint": fingerprint}


def may_build(n_training: int, n_holdout: int, latest: Version | None, open_retrain: bool) -> str | None:
    """Why a new version can't be built, or None. The first needs records only; later ones a full hold-out and a recorded, unused decision."""
    if n_training < LEAST_TRAINING_RECORDS:
        return "TOO_FEW_RECORDS"
    if latest is None:
        return None
    if n_holdout < HOLDOUT_SIZE:
        return "HOLDOUT_INCOMPLETE"
    return None if latest.build_unlocked and open_retrain else "NOT_AUTHORISED"
