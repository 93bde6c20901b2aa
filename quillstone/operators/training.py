"""The training corpus that preferences are learned from, and the documents made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.exprs import none_if_blank

#: What an event's JSON holds beside its own columns.
DETAILS = ("positive_reasons", "concerns", "not_a_concern")
_JSON = ", ".join(f"{c} array<string>" for c in DETAILS)
#: Candidate rules that are kept of a build, and the levels of their confidence.
MOST_RULES, LEVELS = 5, ("HIGH", "MEDIUM", "LOW")


def training_records(feedback: DataFrame) -> DataFrame:
    """feedback_id, event_type, verdict, ticker, company, user_comment and DETAILS as arrays; JSON that can't be read gives empty ones."""
    read = F.from_json("parsed_json", _JSON)
    return feedback.select("feedback_id", "event_type", "verdict", "ticker", "company", "user_comment",
                           *[F.coalesce(read.getField(c), F.array().cast("array<string>")).alias(c) for c in DETAILS])


def label_of(*columns: str, missing: str) -> Column:
    """The first of some columns that isn't blank."""
    return F.coalesce(*[none_if_blank(F.col(c)) for c in columns], F.lit(missing))


def record_texts(records: DataFrame) -> DataFrame:
    """(feedback_id, text): a record as a few lines of text, one for each thing that is known of it."""
    line = lambda name, v: F.concat(F.lit(f"{name} = "), v)
    several = lambda c: F.when(F.size(c) > 0, line(c, F.array_join(c, " | ")))
    lines = F.array(line("idea", label_of("ticker", "company", missing="?")), line("kind", F.col("event_type")),
        line("verdict", label_of("verdict", missing="none")),
                    line("comment", none_if_blank(F.col("user_comment"))), *[several(c) for c in DETAILS])
    return records.select("feedback_id", F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n").alias("text"))


def corpus(records: DataFrame, most: int) -> str:
    """The texts of the records in order, as one prompt. Prompts are small: more than most records is an error, not a cut."""
    rows = record_texts(records).orderBy("feedback_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} training records")
    return "\n\n".join(f"[{i}]\n{r.text}" for i, r in enumerate(rows, 1))


def valid_rules(rules: DataFrame) -> DataFrame:
    """Candidate rules (rule, evidence, reusability, confidence) that say something, with a known confidence, surest first, at most MOST_RULES."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("confidence"))
    return rules.filter((F.trim("rule") != "") & (rank > 0)).orderBy(rank, "rule").limit(MOST_RULES)


def preference_document(version: str, date: str, n_records: int, body: str) -> str:
    return f"# Preferences {version}\n\nMade {date} from {n_records} judgments.\n\n{body.strip()}\n"


def rules_document(version: str, date: str, rules: DataFrame) -> str:
    """Proposals for a person to take over or not; nothing reads this file back."""
    found = valid_rules(rules).collect()  # at most MOST_RULES
    each = "".join(f"\n{i}. {r.rule}\n   seen in: {r.evidence}\n   holds elsewhere: {r.reusability}\n   confidence: {r.confidence}\n" for i,
        r in enumerate(found, 1))
    return f"# Proposed rules for {version}, {date}\n{each or chr(10) + 'None.' + chr(10)}"
