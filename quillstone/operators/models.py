"""Model calls as pluggable functions over the rows that need them; nothing here talks to a network.

A model is made by a factory on each executor, once for each task and only if the task has rows. Its answers are checked
against a schema; a failure becomes a status on the row, never a lost row.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ATTEMPTS, BUDGET_GROWTH = 3, 1.5
#: What is added to a prompt whose answer was of no use.
REMINDER = "\n\nYour last answer could not be used: it was cut short or had another form. Be brief and keep to the form."


@dataclass(frozen=True)
class Items:
    """A list of at most most texts of at most chars characters each."""

    most: int
    chars: int


class Answer(NamedTuple):
    """What came of a call: OK and the checked JSON, or a category and a detail made of names of types and fields."""

    status: str
    answer: str | None = None
    detail: str | None = None


_RATING = ("Strong", "Plausible", "Weak", "Unknown")
_TEXTS = ("company", "ticker", "business_summary", "core_thesis", "why_mispriced", "future_earnings_change", "upside_case",
          "downside_or_key_risks", "catalysts", "what_must_be_true", "evidence_of_market_misunderstanding", "known_unknowns")
# What models are asked for. A field is a type, a tuple of allowed texts, list (of texts), Items, or a pair (one of those, default).
EXTRACTED_IDEA = dict.fromkeys(_TEXTS, str)
PREDICTION = {
    "overall_prediction": ("INVESTIGATE_NOW", "WATCH", "PASS", "INSUFFICIENT_INFORMATION"), "mispricing": _RATING,
    "variant_perception": _RATING,
    "upside": ("Potentially sufficient", "Probably insufficient", "Unknown"), "business_quality": _RATING,
    "downside": ("Attractive", "Acceptable", "Problematic", "Unknown"),
    "key_reasons": [list, []], "key_concerns": [list, []], "critical_questions": [list, []], "confidence": ("HIGH", "MEDIUM", "LOW"),
}
FEEDBACK_EVENT = {
    "event_type": ("FEEDBACK", "NEW_IDEA", "MISSED_IDEA", "UNCLEAR"),
    "verdict": [("STRONG_LIKE", "LIKE", "MAYBE", "PASS", "STRONG_PASS"), None], "ticker": [str, None], "company": [str, None],
    "novelty": [("NEW", "KNOWN", "UNKNOWN"), None], "user_comment": [str, ""], "positive_reasons": [list, []], "concerns": [list, []],
    "not_a_concern": [list, []], "confidence": float,
}
CANDIDATE_RULE = {"rule": str, "evidence": str, "reusability": str, "confidence": ("HIGH", "MEDIUM", "LOW")}
#: Most items of a list and characters of an item in a narrative repair; of the three fields only those that are missing are asked for.
REPAIR_ITEMS, REPAIR_CHARS = 2, 300


class Truncated(RuntimeError):
    """The answer ran into its token limit."""


class Transient(RuntimeError):
    """A failure that a later run may not meet."""


class SchemaRejected(RuntimeError):
    """The provider doesn't take the schema, as too complex, say; the same request can't succeed."""


class ModelFailure(RuntimeError):
    """A call that failed for good. code is a category; detail holds names of types and fields, never a provider's text."""

    def __init__(self, code: str, detail: str | None = None):
        super().__init__(code if detail is None else f"{code}: {detail}")
        self.code, self.detail = code, detail


def is_transient(e: BaseException) -> bool:
    """Time-outs, lost connections, rate limits and server errors; anything else needs a person first."""
    status = getattr(e, "status_code", None)
    return isinstance(e, (Transient, TimeoutError, ConnectionError)) or isinstance(status, int) and (status == 429 or status >= 500)


def provider_detail(e: BaseException) -> str:
    status = getattr(e, "status_code", None)
    return type(e).__name__ + (f" HTTP {status}" if isinstance(status, int) else "")


def repair_fields(missing: list[str]) -> dict:
    """The form of a narrative repair that asks for the missing fields alone."""
    return {f: [Items(REPAIR_ITEMS, REPAIR_CHARS), []] for f in missing}


def json_schema(fields: dict, simple: bool = False) -> dict:
    """A strict JSON schema of a form, for models that take one. simple: without bounds and lists of allowed values; answers are
    checked against the form in any case."""
    def kind(t) -> dict:
        if isinstance(t, _Nested):
            return {"type": "array", "items": json_schema(t.fields, simple)}
        if isinstance(t, Items):
            return {"type": "array", "items": {"type": "string"} if simple else {"type": "string", "maxLength": t.chars}} | (
                {} if simple else {"maxItems": t.most})
        if isinstance(t, list):
            inner = kind(t[0])
            return {"anyOf": [inner, {"type": "null"}]} if t[1] is None else inner
        if isinstance(t, tuple):
            return {"type": "string"} if simple else {"type": "string", "enum": list(t)}
        return {list: {"type": "array", "items": {"type": "string"}}, str: {"type": "string"}, float: {"type": "number"},
            int: {"type": "integer"}, bool: {"type": "boolean"}, dict: {"type": "object"}}[t]

    return {"type": "object", "additionalProperties": False, "required": [f for f, t in fields.items() if not isinstance(t, list)],
        "properties": {f: kind(t) for f, t in fields.items()}}


def problems_of(answer: dict, fields: dict) -> list[str]:
    """field: what is wrong with it, for each field that doesn't fit. Values are never quoted."""
    out = []
    for name, t in fields.items():
        optional = isinstance(t, list)
        t, value = (t[0] if optional else t), answer.get(name)
        if value is None:
            out += [] if optional else [f"{name}: missing"]
        elif isinstance(t, _Nested):
            whole = isinstance(value, list) and all(isinstance(x, dict) for x in value)
            out += [f"{name}.{i}.{p}" for i, x in enumerate(value) for p in problems_of(x,
                t.fields)] if whole else [f"{name}: no list of objects"]
        elif isinstance(t, Items):
            whole = isinstance(value, list) and all(isinstance(x, str) for x in value)
            out += [f"{name}: no list of texts"] if not whole else [f"{name}: too many items"] if len(value) > t.most else [
                f"{name}.{i}: too long" for i, x in enumerate(value) if len(x) > t.chars]
        elif isinstance(t, tuple):
            out += [] if value in t else [f"{name}: not allowed"]
        elif t is list:
            out += [] if isinstance(value, list) and all(isinstance(x, str) for x in value) else [f"{name}: no list of texts"]
        elif not isinstance(value, (int, float) if t is float else t) or isinstance(value, bool) and t is not bool:
            out.append(f"{name}: no {t.__name__}")
    return out


def filled(answer: dict, fields: dict) -> dict:
    """The fields alone, with their defaults; what else an answer holds is dropped."""
    def value(f: str, t):
        v = answer.get(f)
        if isinstance(t, _Nested):
            return [filled(x, t.fields) for x in v]
        return v if v is not None else t[1] if isinstance(t, list) else None

    return {f: value(f, t) for f, t in fields.items()}


def checked(text: str | None, fields: dict) -> Answer:
    """A text held against a form. It is taken as it is or not at all; nothing is mended."""
    if not (text or "").strip():
        return Answer("EMPTY_RESPONSE")
    try:
        answer = json.loads(text)
    except json.JSONDecodeError:
        return Answer("RESPONSE_PARSE_ERROR", None, "malformed JSON")
    bad = problems_of(answer, fields) if isinstance(answer, dict) else ["no object"]
    if bad:
        return Answer("VALIDATION_ERROR", None, "; ".join(bad[:3]))
    return Answer("OK", json.dumps(filled(answer, fields), sort_keys=True, ensure_ascii=False))


def _asked(call: Callable, prompt: str, budget: int, fields: dict) -> str:
    """The text of one call. A call that takes schemas (takes_schema) gets the form's, and where that is rejected a simpler one, then none."""
    if not getattr(call, "takes_schema", False):
        return call(prompt, budget)
    for schema in (json_schema(fields), json_schema(fields, simple=True)):
        try:
            return call(prompt, budget, schema)
        except SchemaRejected:
            continue
    return call(prompt, budget, None)


def generate(call: Callable[..., str], prompt: str, fields: dict, budget: int = 1024, attempts: int = ATTEMPTS) -> Answer:
    """Up to attempts calls, again only for truncated answers, with a larger budget, or for answers of another form.

    status: OK; EMPTY_RESPONSE, RESPONSE_PARSE_ERROR, VALIDATION_ERROR or TRUNCATED of the last attempt; RETRYABLE_ERROR
    for what a later run may not meet; PROVIDER_ERROR for anything else that the call raises.
    """
    last = Answer("UNKNOWN_ERROR")
    for _ in range(attempts):
        try:
            last = checked(_asked(call, prompt, budget, fields), fields)
        except Truncated:
            last, budget = Answer("TRUNCATED", None, "output limit reached"), int(budget * BUDGET_GROWTH)
        except Exception as e:  # whatever a provider raises becomes a status; the row isn't lost
            return Answer("RETRYABLE_ERROR" if is_transient(e) else "PROVIDER_ERROR", None, provider_detail(e))
        if last.status == "OK":
            return last
    return last


def drafted(call: Callable[..., str], prompt: str, fields: dict | None = None, budget: int = 4096, attempts: int = ATTEMPTS,
        tried: Callable[[int, str], None] | None = None) -> str | dict:
    """One text, or with fields one checked object, on the driver: up to attempts calls for answers that are truncated, empty or of
    another form, with a reminder after the same prompt. A failed call is not repeated. Raises ModelFailure; tried(attempt, category)
    hears of each attempt that was of no use."""
    last = Answer("UNKNOWN_ERROR")
    for attempt in range(1, attempts + 1):
        try:
            asked = prompt if attempt == 1 else prompt + REMINDER
            text = _asked(call, asked, budget, fields) if fields else call(asked, budget)
            last = checked(text, fields) if fields else Answer("OK", (text or "").strip()) if (text or "").strip() else Answer("EMPTY_RESPONSE")
        except Truncated:
            last = Answer("TRUNCATED", None, "output limit reached")
        except Exception as e:
            raise ModelFailure("PROVIDER_ERROR", provider_detail(e)) from e
        if last.status == "OK":
            return json.loads(last.answer) if fields else last.answer
        if tried:
            tried(attempt, last.status)
    raise ModelFailure(last.status, "; ".join(filter(None, [last.detail, f"{attempts} attempts"])))


def _ddl(fields: dict) -> str:
    def kind(t) -> str:
        t = t[0] if isinstance(t, list) else t
        return "array<string>" if isinstance(t, Items) else "string" if isinstance(t, tuple) else {list: "array<string>", str: "string", float: "double", int: "long", bool: "boolean",
            dict: "map<string,string>"}[t]

    return ", ".join(f"{f} {kind(t)}" for f, t in fields.items())


def checked_json(answer: Column, fields: dict) -> Column:
    """The answer's JSON as a struct of its fields."""
    return F.from_json(answer, _ddl(fields))


def feedback_events(messages: DataFrame, prompt: str, factory: Callable[[], Callable[[str, int], str]]) -> tuple[DataFrame, DataFrame]:
    """(events, outcomes) of a model's reading of messages.

    A message gives any number of events; it needs review if one of them does. outcomes: message_id and status: PARSED,
    NO_FEEDBACK, NEEDS_REVIEW, RETRYABLE_ERROR or ERROR. Events keep their whole JSON.
    """
    from quillstone.functions.exprs import review_reason
    from quillstone.operators.storage import materialize

    answered = materialize(apply_model(messages.select("message_id", prompt), prompt, factory, {"events": _EVENTS}))  # a call is made once
    read = answered.select("message_id", "status", F.from_json("answer",
        f"events array<struct<{_ddl(FEEDBACK_EVENT).replace(' ', ':').replace(',:', ',')}>>").getField("events").alias("events"))
    events = read.select("message_id", F.posexplode("events").alias("event_index", "e")).select(
        "message_id", "event_index", "e.*", F.to_json("e").alias("parsed_json"),
        review_reason(F.col("e.event_type"), F.col("e.verdict"), F.col("e.confidence")).alias("review_reason"))
    doubt = events.groupBy("message_id").agg(F.bool_or(F.col("review_reason").isNotNull()).alias("doubt"))
    outcome = (F.when(F.col("status") == "RETRYABLE_ERROR", "RETRYABLE_ERROR").when(F.col("status") != "OK",
        "ERROR").when(F.coalesce(F.size("events"), F.lit(0)) <= 0, "NO_FEEDBACK")
               .when(F.coalesce("doubt", F.lit(False)), "NEEDS_REVIEW").otherwise("PARSED"))
    return events, read.join(doubt, "message_id", "left").select("message_id", outcome.alias("status"))


class _Nested:
    """A list of objects of one form."""

    def __init__(self, fields: dict):
        self.fields = fields


_EVENTS = _Nested(FEEDBACK_EVENT)
CANDIDATE_RULES = {"rules": _Nested(CANDIDATE_RULE)}


def apply_model(rows: DataFrame, prompt: str, factory: Callable[[], Callable[..., str]], fields: dict | Callable[[dict], dict],
        attempts: int = ATTEMPTS, budget: int = 1024) -> DataFrame:
    """rows with status, answer (JSON) and detail. fields: the form, or a function that gives that of a row. Put the anti-join against
    what is already answered before this, not after."""
    schema = StructType([*rows.schema.fields, *[StructField(c, StringType()) for c in Answer._fields]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        for b in batches:
            call = call or factory()
            forms = [fields(r) for r in b.to_dict("records")] if callable(fields) else [fields] * len(b)
            made = [generate(call, p, f, budget, attempts) for p, f in zip(b[prompt], forms, strict=True)]
            yield b.assign(**{c: [m[i] for m in made] for i, c in enumerate(Answer._fields)})

    return rows.mapInPandas(run, schema)


def screening_prompt(*fields: tuple[str, str]):
    """A labelled line for each (label, column); blank values read (not stated)."""
    from quillstone.functions.text import labelled_or

    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), labelled_or(F.col(c))) for label, c in fields])
