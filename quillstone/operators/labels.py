"""How rows are named where people read them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.exprs import none_if_blank, review_ref

#: What a blind review may show of a source: facts of the text, nothing that a screening said.
REVIEW_FIELDS = (
    "business_summary", "core_thesis", "why_mispriced", "future_earnings_change", "upside_case",
    "downside_or_key_risks", "catalysts", "what_must_be_true", "evidence_of_market_misunderstanding", "known_unknowns",
)


def _text(c: str, missing: str = "-") -> Column:
    return F.coalesce(none_if_blank(F.col(c).cast("string")), F.lit(missing))


def idea_pair() -> Column:
    """ticker / company, a dash for what is unknown."""
    return F.concat_ws(" / ", _text("ticker"), _text("company"))


def source_label() -> Column:
    """Ticker and company as far as known, else the title, else the document's id."""
    known = F.concat_ws(" | ", *[none_if_blank(F.col(c)) for c in ("ticker", "company")])
    return F.coalesce(none_if_blank(known), none_if_blank(F.col("source_title")), F.col("external_id").cast("string"))


def feedback_label(with_confidence: bool = False) -> Column:
    """One judgment in a line: its id, idea, kind, verdict and comment."""
    idea = F.coalesce(none_if_blank(F.col("ticker")), none_if_blank(F.col("company")), F.lit("-"))
    parts = [F.concat(F.lit("FB "), F.col("feedback_id").cast("string")), idea, _text("event_type"), _text("verdict")]
    if with_confidence:
        parts.append(F.coalesce(F.format_number("confidence", 2), F.lit("-")))
    return F.concat_ws(" | ", *parts, _text("user_comment"))


def holdout_refs() -> tuple[Column, Column]:
    """References of a hold-out row's assignment and screening; a dash where there is none."""
    return F.coalesce(review_ref("BR", F.col("assignment_id")), F.lit("-")), F.coalesce(review_ref("SR", F.col("screening_id")), F.lit("-"))


def holdout_name() -> Column:
    """A hold-out row by its assignment, or by its own number without one."""
    return F.coalesce(review_ref("BR", F.col("assignment_id")), F.concat(F.lit("FB "), F.col("feedback_id").cast("string")))


def review_item() -> Column:
    """A source as a blind review shows it."""
    when = F.coalesce(none_if_blank(F.col("source_date")), none_if_blank(F.col("discovered_at")))
    facts = [F.concat(F.lit(f"{f.replace('_', ' ')}: "), none_if_blank(F.col(f))) for f in REVIEW_FIELDS]
    lines = F.array(review_ref("BR", F.col("assignment_id")), idea_pair(), _text("source_name"), when, *facts, F.col("canonical_url"))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")
