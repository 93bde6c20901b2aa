"""How well stored predictions agree with later judgments: as-of lookup, outcome classes, metrics, text scans.

A judgment is held against the newest screening of its source and version that existed at that time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.exprs import POSITIVE, PREDICTIONS, categorical_match, ratio, verdict_class
from quillstone.functions.text import NARRATIVE
from quillstone.operators.joins import asof_join
from quillstone.operators.storage import literal_rows

ACTUAL = PREDICTIONS[:3]
INSUFFICIENT = "INSUFFICIENT_INFORMATION"
#: Shares beyond which class balance is worth a warning.
DEGENERATE, LOW, HIGH = 0.9, 0.25, 0.75

# Text categories and the patterns that put a text into them.
HURDLES = (
    ("3x-style multiple", r"(?i)(?<![\w.])~?\s*(?:2\s*-\s*)?3\s*x(?![a-z])"),
    ("three-bagger", r"(?i)three[\s-]+bagger"),
    ("effective hurdle", r"(?i)effective\s+hurdle"),
)
PERMANENT_FRAMING = r"100\s*%"
THEMES = (
    ("no clear reason for mispricing", (r"no clear reason", r"no (?:specific |clear )?reason (?:for|why)", r"unclear (?:why|reason)")),
    ("large cap / well covered", (r"large[\s-]cap", r"well[\s-]covered", r"widely (?:followed|covered)")),
    ("relative value", (r"relative[\s-]value",)),
    ("NAV / book discount", (r"\bNAV\b", r"book value", r"(?:discount|trades?) (?:to|below) (?:book|NAV)")),
    ("insufficient upside", (r"insufficient upside", r"limited upside", r"upside (?:is )?(?:too )?(?:small|limited|insufficient)")),
    ("no edge", (r"\bno (?:informational |variant |clear )?edge\b",)),
    ("cyclical", (r"\bcyclical",)),
    ("takeout dependent", (r"take-?out",)),
)


def asof_predictions(judgments: DataFrame, screenings: DataFrame, taste_version: int) -> DataFrame:
    """Each judgment with the screening it is held against (null columns if there was none)."""
    s = screenings.filter(F.col("taste_version") == taste_version).select("source_id", "screening_id", "created_at", "overall_prediction",
        "screening_prompt_version")
    return asof_join(judgments, s, ["source_id"], "judged_at", "created_at", ["screening_id"], prefix="")


def kind(actual: Column, predicted: Column) -> Column:
    """The outcome; the first that fits."""
    return (F.when(predicted == INSUFFICIENT, "unscored").when(predicted == actual,
        "correct").when(actual.isin(*POSITIVE) & (predicted == "PASS"), "false_negative")
            .when((actual == "PASS") & predicted.isin(*POSITIVE), "false_positive").otherwise("severity_mismatch"))


def error_bucket(verdict: Column, actual: Column, predicted: Column) -> Column:
    """1 (costliest) to 8 (correct)."""
    missed = F.when(verdict == "STRONG_LIKE", 1).when(verdict == "LIKE", 2).when(verdict == "MAYBE", 3).otherwise(7)
    return (F.when(predicted == actual, 8).when(predicted == "PASS",
        missed).when(verdict.isin("STRONG_LIKE", "LIKE") & (predicted == "WATCH"), 4)
            .when(verdict.isin("PASS", "STRONG_PASS") & (predicted == "INVESTIGATE_NOW"),
            5).when(verdict.isin("PASS", "STRONG_PASS") & (predicted == "WATCH"), 6).otherwise(7))


def evaluation_rows(predictions: DataFrame) -> DataFrame:
    """Judgments with a known label and a prediction: adds actual, kind, bucket and sign_matches."""
    rows = predictions.withColumn("actual", verdict_class(F.col("verdict"))).filter("actual IS NOT NULL AND overall_prediction IS NOT NULL")
    p = F.col("overall_prediction")
    return rows.withColumns({"kind": kind(F.col("actual"), p), "bucket": error_bucket(F.col("verdict"), F.col("actual"), p),
        "sign_matches": categorical_match(F.col("verdict"), p)})


def confusion_matrix(rows: DataFrame) -> DataFrame:
    """One row for each actual class that occurs, one column for each prediction. The classes are given, so no pass looks for them."""
    counts = rows.groupBy("actual").pivot("overall_prediction", list(PREDICTIONS)).count().na.fill(0)
    return counts.select("actual", *[F.col(p).alias(f"predicted_{p.lower()}") for p in PREDICTIONS])


def metrics(rows: DataFrame) -> DataFrame:
    """One row of counts and ratios from one pass; a ratio is null where its denominator is 0.

    Insufficient predictions count as wrong in exact_correct and stay out of tp, fp, tn and fn.
    """
    a, p = F.col("actual"), F.col("overall_prediction")
    yes, said, scored = a.isin(*POSITIVE), p.isin(*POSITIVE), p != INSUFFICIENT
    n = rows.agg(
        F.count("*").alias("n"), F.count_if(p == a).alias("exact_correct"), F.count_if(scored).alias("n_scored"),
        F.count_if(scored & yes & said).alias("tp"),
        F.count_if(scored & ~yes & said).alias("fp"), F.count_if(scored & ~yes & ~said).alias("tn"),
        F.count_if(scored & yes & ~said).alias("fn"),
        F.count_if(a == "INVESTIGATE_NOW").alias("hc_actual"),
        F.count_if((a == "INVESTIGATE_NOW") & (p == "INVESTIGATE_NOW")).alias("hc_hit"),
        F.count_if(p == "PASS").alias("n_pass_predicted"), F.count_if(a == "PASS").alias("n_pass_actual"),
        F.count_if(yes).alias("n_positive_actual"))
    c = F.col
    n = n.select("*", ratio(c("tp"), c("tp") + c("fp")).alias("precision"), ratio(c("tp"), c("tp") + c("fn")).alias("recall"),
        ratio(c("tn"), c("tn") + c("fp")).alias("specificity"),
                 ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"), ratio(c("hc_hit"), c("hc_actual")).alias("hc_recall"),
                 ratio(c("n_pass_predicted"), c("n")).alias("pass_predicted_share"),
                 ratio(c("n_pass_actual"), c("n")).alias("pass_actual_share"),
                 ratio(c("n_positive_actual"), c("n")).alias("positive_actual_share"))
    return n.withColumn("balanced_accuracy", (c("recall") + c("specificity")) / 2)


def balance_warnings(m: DataFrame) -> DataFrame:
    """(warning) rows for a one-row metrics frame."""
    share = F.col("positive_actual_share")
    found = F.array(F.when(F.col("pass_predicted_share") >= DEGENERATE, "ALMOST_ALL_PASS"), F.when(share < LOW, "FEW_POSITIVES"),
        F.when(share > HIGH, "MANY_POSITIVES"))
    return m.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("warning"))


def error_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket", "kind").agg(F.count("*").alias("n"), F.min("feedback_id").alias("first_feedback_id"))


def text_items(rows: DataFrame, row_id: str, fields: tuple[str, ...] = NARRATIVE) -> DataFrame:
    """(row_id, field, field_no, item_no, text): the non-blank texts of several list columns with their place, in one pass over the rows."""
    def placed(n: int, name: str) -> Column:
        return F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda t, i: F.struct(F.lit(n).alias("field_no"),
            i.alias("item_no"), F.lit(name).alias("field"), t.alias("text")))

    each = F.flatten(F.array(*[placed(n, f) for n, f in enumerate(fields)]))
    return rows.select(row_id, F.inline(each)).filter("text IS NOT NULL AND NOT text RLIKE '(?U)^\\\\s*$'")


def _has_theme(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.rlike(text, F.lit("(?i)" + "|".join(f"(?:{p})" for p in patterns)))


def theme_rows(items: DataFrame, row_id: str) -> DataFrame:
    """(theme_no, theme, row_id): which rows have a text with one of a theme's patterns, each once. Every text is matched once a theme."""
    hits = F.filter(F.array(*[F.when(_has_theme(F.col("text"), p), F.struct(F.lit(i).alias("theme_no"), F.lit(name).alias("theme")))
        for i, (name, p) in enumerate(THEMES)]), lambda x: x.isNotNull())
    return items.select(row_id, F.inline(hits)).distinct()


def theme_counts(texts: DataFrame, row_id: str, text: str) -> DataFrame:
    """(theme, n_rows): in how many rows of a table with one text a row, and a unique row_id, a theme is found. One pass, no shuffle of rows."""
    one = texts.agg(*[F.count_if(_has_theme(F.col(text), p)).alias(f"t{i}") for i, (_, p) in enumerate(THEMES)])
    pairs = F.array(*[F.struct(F.lit(name).alias("theme"), F.col(f"t{i}").alias("n_rows")) for i, (name, _) in enumerate(THEMES)])
    return one.select(F.explode(pairs).alias("x")).select("x.*")


def theme_report(items: DataFrame, row_id: str, named: int = 20) -> DataFrame:
    """(theme_no, theme, n_rows, refs): every theme with the number of its rows, and the first named of their ids in order."""
    rows = theme_rows(items, row_id)
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("theme_no").orderBy(row_id))).filter(F.col("n") <= named)
    refs = first.groupBy("theme_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row_id)), lambda x: x.cast("string")), ", ").alias("refs"))
    every = literal_rows(items.sparkSession, [(i, name) for i, (name, _) in enumerate(THEMES)], "theme_no int, theme string")
    n = rows.groupBy("theme_no").agg(F.count("*").alias("n_rows"))
    return every.join(n, "theme_no", "left").join(refs, "theme_no", "left").select("theme_no", "theme", F.coalesce("n_rows",
        F.lit(0)).alias("n_rows"), F.coalesce("refs", F.lit("")).alias("refs"))


def excerpt(text: Column, start: Column, length: Column, radius: int = 80, limit: int = 180) -> Column:
    """The text around a match (start counts from 1), white space collapsed, with an ellipsis where it is cut."""
    a = F.greatest(start - radius, F.lit(1))
    b = F.least(start + length + radius, F.length(text) + 1)
    bare = F.trim(F.regexp_replace(F.substring(text, a, b - a), r"(?U)\s+", " "))
    return F.substring(F.concat(F.when(a > 1, "…").otherwise(""), bare, F.when(b <= F.length(text), "…").otherwise("")), 1, limit)


def hurdle_hits(items: DataFrame, row_id: str) -> DataFrame:
    """Rows of text_items() with a hurdle: categories in the order in which they are met (by place, then pattern), the field and excerpt of the
    first match, and whether any text of the row frames it as permanent."""
    t, place = F.col("text"), [F.col("field_no"), F.col("item_no")]
    at = lambda p: F.regexp_instr(t, F.lit(p))
    found = F.filter(F.array(*[F.when(at(p) > 0, F.struct(*place, F.lit(i).alias("i"), F.lit(name).alias("category"),
        F.col("field").alias("field"), excerpt(t, at(p), F.length(F.regexp_substr(t, F.lit(p)))).alias("excerpt"))) for i, (name, p) in
        enumerate(HURDLES)]), lambda x: x.isNotNull())
    rows = items.select(row_id, found.alias("found"), F.rlike(t, F.lit(PERMANENT_FRAMING)).alias("framed"))
    # At most one hit of each category is kept of a row, so what meets in a group is bounded.
    hit = F.struct("x.field_no", "x.item_no", "x.i", "x.category", "x.field", "x.excerpt")
    best = rows.select(row_id, F.explode("found").alias("x")).groupBy(row_id, "x.i").agg(F.min(hit).alias("h"))
    hits = best.groupBy(row_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list("h")), lambda h: h["category"]), ", ").alias("categories"),
        F.min("h").alias("first"))
    framed = rows.groupBy(row_id).agg(F.bool_or("framed").alias("permanent_framing"))
    return hits.join(framed, row_id).select(row_id, "categories", F.col("first.field").alias("field"), F.col("first.excerpt").alias("excerpt"),
        "permanent_framing")


def rule_excerpts(text: Column) -> Column:
    """The first six lines with a percentage, each at most 220 characters."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.transform(F.slice(F.filter(lines, lambda x: x.rlike(r"\d+\s*%")), 1, 6), lambda x: F.substring(x, 1, 220))


def prompt_versions(predictions: DataFrame, screenings: DataFrame, taste_version: int) -> DataFrame:
    """Judgments whose screenings up to then came from more than one prompt version. One row each, whatever the number of screenings."""
    s = screenings.filter(F.col("taste_version") == taste_version).select("source_id", "screening_prompt_version", "created_at")
    first = s.groupBy("source_id", "screening_prompt_version").agg(F.min("created_at").alias("first_at"))
    seen = predictions.join(first, "source_id").filter("first_at <= judged_at").groupBy("feedback_id").agg(F.count("*").alias("n_prompt_versions"))
    return seen.filter("n_prompt_versions > 1")
