"""Column expressions: normalisation, label maps, safe ratios and small text rules. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verdicts in order of liking, and the prediction class that each one corresponds to.
VERDICTS = ("STRONG_LIKE", "LIKE", "MAYBE", "PASS", "STRONG_PASS")
PREDICTIONS = ("INVESTIGATE_NOW", "WATCH", "PASS", "INSUFFICIENT_INFORMATION")
CLASS_OF_VERDICT = {"STRONG_LIKE": "INVESTIGATE_NOW", "LIKE": "INVESTIGATE_NOW", "MAYBE": "WATCH", "PASS": "PASS", "STRONG_PASS": "PASS"}
SIGN_OF_VERDICT = {"STRONG_LIKE": "positive", "LIKE": "positive", "MAYBE": "neutral", "PASS": "negative", "STRONG_PASS": "negative"}
SIGN_OF_PREDICTION = {"INVESTIGATE_NOW": "positive", "WATCH": "neutral", "PASS": "negative"}
POSITIVE = ("INVESTIGATE_NOW", "WATCH")
REVIEW_CONFIDENCE = 0.5


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value's expression in the plan once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def none_if_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def norm_ticker(c: Column) -> Column:
    """Stripped, without one leading $, upper case; blank is null."""
    return none_if_blank(F.upper(F.regexp_replace(strip(c), r"^\$", "")))


def norm_company(c: Column) -> Column:
    """Without punctuation, white space collapsed, lower case; blank is null."""
    bare = F.regexp_replace(c, r"(?U)[^\w\s]", "")
    return none_if_blank(F.lower(strip(F.regexp_replace(bare, r"(?U)\s+", " "))))


def mapped(c: Column, values: dict[str, str]) -> Column:
    """The value's image; null where it has none."""
    out = F.lit(None).cast("string")
    for k, v in reversed(values.items()):
        out = F.when(c == k, v).otherwise(out)
    return out


def verdict_class(c: Column) -> Column:
    return mapped(c, CLASS_OF_VERDICT)


def categorical_match(verdict: Column, prediction: Column) -> Column:
    """Whether verdict and prediction have one sign; null if either has none."""
    return mapped(verdict, SIGN_OF_VERDICT) == mapped(prediction, SIGN_OF_PREDICTION)


def normalize_label(verdict: Column) -> Column:
    return F.upper(strip(F.replace(F.coalesce(verdict, F.lit("")), F.lit("_"), F.lit(" "))))


def ratio(n: Column, d: Column) -> Column:
    """n / d as double; null where d is 0."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def review_reason(event_type: Column, verdict: Column, confidence: Column) -> Column:
    """Why an event needs review, or null; an unknown confidence is no reason."""
    return (F.when(event_type == "UNCLEAR", "UNCLEAR_EVENT").when(confidence < REVIEW_CONFIDENCE, "LOW_CONFIDENCE")
            .when((event_type == "FEEDBACK") & verdict.isNull(), "MISSING_VERDICT"))


def eligible_for_evaluation(event_type: Column, verdict: Column) -> Column:
    return F.coalesce((event_type == "FEEDBACK") & verdict_class(verdict).isNotNull(), F.lit(False))


def sender_address(raw: Column) -> Column:
    """The address of a mail header: inside angle brackets, else the whole; stripped, lower case."""
    inside = F.regexp_extract(raw, r"<([^<>]*)>", 1)
    return F.lower(strip(F.when(inside != "", inside).otherwise(raw)))


def body_of(text: Column, html: Column) -> Column:
    """struct(body, format): the text, else the html, else an empty body; empty counts as absent."""
    made = lambda b, f: F.struct(b.alias("body"), F.lit(f).alias("format"))
    return F.when(F.length(text) > 0, made(text, "text")).when(F.length(html) > 0, made(html, "html")).otherwise(made(F.lit(""), "none"))


def review_ref(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), number.cast("string"))


def parse_review_ref(prefix: str, text: Column) -> Column:
    """The number of a reference such as BR-12, in any case; null if it isn't one."""
    return F.expr("try_cast(null as bigint)") if text is None else F.regexp_extract(strip(text), rf"(?i)^{prefix}-(\d+)$",
        1).try_cast("bigint")


def first_of(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


def looks_like_test(*parts: Column, markers: tuple[str, ...] = ("test", "smoke", "dummy", "fixture", "sample", "example")) -> Column:
    """Whether any marker occurs in the joined, lower-cased parts."""
    text = F.lower(F.concat_ws(" ", *parts))
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def idempotency_key(date: Column, ids: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of date|id-id-..., ids in numeric order."""
    joined = F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), "-")
    return F.substring(F.sha2(F.concat_ws("|", date, joined), 256), 1, 32)


def safe_component(c: Column) -> Column:
    """A path component: other characters than letters, digits, _ and - become _; empty becomes unknown."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9_-]", "_")
    return F.when(out == "", "unknown").otherwise(out)


def artifact_path(source_name: Column, external_id: Column, content_hash: Column) -> Column:
    return F.concat(safe_component(source_name), F.lit("/"), safe_component(external_id), F.lit("/"), safe_component(content_hash),
        F.lit(".html"))
