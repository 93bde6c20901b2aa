"""Narratives of screenings and their one-shot repairs.

A screening that says WATCH or INVESTIGATE_NOW must give reasons, concerns and questions. What it lacks may be filled by
one repair; the screening itself never changes, and its effective narrative is a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import NARRATIVE, merged_narrative, narrative_gaps, substantive
from quillstone.operators.sources import latest_repairs, latest_screening

#: Most characters of a stored reason, and the categories whose text may be shown.
REASON_CHARS = 200
REASON_CODES = ("PROVIDER_ERROR", "RESPONSE_PARSE_ERROR", "VALIDATION_ERROR", "EMPTY_RESPONSE", "UNKNOWN_ERROR", "STILL_INCOMPLETE")


def effective(screenings: DataFrame, repairs: DataFrame) -> DataFrame:
    """screenings with their narrative as it is to be read: each field's own content, or where it has none the latest successful repair's."""
    fix = latest_repairs(repairs).select("screening_id", *[F.col(c).alias(f"__{c}") for c in NARRATIVE])
    merged = {c: merged_narrative(F.col(c), F.col(f"__{c}")) for c in NARRATIVE}
    return screenings.join(fix, "screening_id", "left").withColumns(merged).drop(*[f"__{c}" for c in NARRATIVE])


def with_gaps(screenings: DataFrame) -> DataFrame:
    """Adds gaps, the narrative fields that the prediction needs and lacks, and gap, whether there are any."""
    return screenings.withColumn("gaps", narrative_gaps(F.col("overall_prediction"), *[F.col(c) for c in NARRATIVE])).withColumn("gap",
        F.size("gaps") > 0)


def repairable(screenings: DataFrame, repairs: DataFrame) -> DataFrame:
    """Screenings with gaps that no repair was tried for."""
    return with_gaps(screenings).filter("gap").join(repairs.select("screening_id").distinct(), "screening_id", "left_anti")


def sanitized_reason(code: Column, detail: Column) -> Column:
    """CODE: detail, shortened; made of categories alone, never of a provider's text."""
    return F.substring(F.concat_ws(": ", code, detail), 1, REASON_CHARS)


def shown_reason(reason: Column) -> Column:
    """A stored reason if it begins with a known category; others are LEGACY, and none is null."""
    known = F.lit(False)
    for code in REASON_CODES:
        known = known | reason.startswith(code)
    return F.when(reason.isNull(), F.lit(None)).when(known, reason).otherwise("LEGACY")


def judged_repairs(answers: DataFrame) -> DataFrame:
    """Repair rows from one answer for each screening with gaps.

    answers: screening_id, overall_prediction, gaps, the own narrative, answer (struct of NARRATIVE, null if the call
    failed), code and detail of the failure. Only fields that were missing are taken from an answer. status: REPAIRED,
    STILL_INCOMPLETE or FAILED; the latter give nothing.
    """
    given = {c: F.when(F.array_contains("gaps", c),
        substantive(F.col("answer").getField(c))).otherwise(F.array().cast("array<string>")) for c in NARRATIVE}
    rows = answers.withColumns({f"__{c}": F.coalesce(v, F.array().cast("array<string>")) for c, v in given.items()})
    left = narrative_gaps(F.col("overall_prediction"), *[merged_narrative(F.col(c), F.col(f"__{c}")) for c in NARRATIVE])
    rows = rows.withColumn("__left", left)
    failed = F.col("answer").isNull()
    status = F.when(failed, "FAILED").when(F.size("__left") > 0, "STILL_INCOMPLETE").otherwise("REPAIRED")
    reason = F.when(failed, sanitized_reason(F.coalesce("code", F.lit("UNKNOWN_ERROR")), F.col("detail"))).when(F.size("__left") > 0,
        sanitized_reason(F.lit("STILL_INCOMPLETE"), F.array_join("__left", ", ")))
    return rows.select("screening_id", status.alias("status"), F.col("gaps").alias("missing_fields"),
        *[F.col(f"__{c}").alias(c) for c in NARRATIVE], reason.alias("reason"))


def repair_listing(screenings: DataFrame, repairs: DataFrame) -> DataFrame:
    """Every repair of each source's newest screening, with what came back, the shown reason and whether the effective narrative is whole now."""
    newest = latest_screening(screenings)
    state = with_gaps(effective(newest, repairs)).select("screening_id", "source_id", (~F.col("gap")).alias("complete"))
    came = F.filter(F.array(*[F.when(F.size(substantive(F.col(c))) > 0, c) for c in NARRATIVE]), lambda x: x.isNotNull())
    reason = shown_reason(F.col("reason")) if "reason" in repairs.columns else F.lit(None).cast("string")
    return repairs.select("screening_id", "repair_id", "status", came.alias("returned"), reason.alias("reason")).join(state, "screening_id")


def audit(screenings: DataFrame, repairs: DataFrame) -> DataFrame:
    """How many screenings of each prediction have a gap of their own, and how many still have one with repairs."""
    own = with_gaps(screenings).select("screening_id", F.col("gap").alias("own_gap"))
    now = with_gaps(effective(screenings, repairs)).join(own, "screening_id")
    return now.groupBy("overall_prediction").agg(F.count("*").alias("n"), F.count_if("own_gap").alias("n_own_gap"),
        F.count_if("gap").alias("n_gap"))
