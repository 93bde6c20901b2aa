"""Text that goes out or is shown: digests, status and audit reports. Texts of many rows are column expressions; only reports of a fixed size reach the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.exprs import VERDICTS, first_of
from quillstone.functions.text import PRODUCT, substantive
from quillstone.operators.evaluation import rule_excerpts

RULE = "=" * 24
DIMENSIONS = ("mispricing", "variant_perception", "upside", "business_quality", "downside")
#: How many reasons, concerns and questions of an idea a digest shows.
SHOWN = (("key_reasons", "For", 2), ("key_concerns", "Against", 2), ("critical_questions", "Open", 1))


def digest_subject(date: str, product: str = PRODUCT) -> str:
    """Replies are recognised by this subject: text.is_digest_reply_subject()."""
    return f"{product.capitalize()} — new ideas worth attention — {date}"


def idea_label() -> Column:
    """What an idea is called where it is replied to: its ticker, else its company."""
    return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("ticker", "company")])


def _told(items: Column, name: str, n: int) -> Column:
    return F.transform(first_of(F.coalesce(items, F.array().cast("array<string>")), n), lambda x: F.concat(F.lit(f"{name}: "), x))


def digest_item() -> Column:
    """One idea's text, from the columns of a screened source: a line of facts, the narrative, the ratings, the address."""
    known = lambda c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))
    head = F.concat_ws(" / ", known("company"), known("ticker"), known("overall_prediction"),
        F.concat(known("confidence"), F.lit(" confidence")))
    told = [_told(F.col(c), name, n) for c, name, n in SHOWN]
    ratings = F.array_join(F.filter(F.array(*[F.concat(F.lit(f"{d.replace('_', ' ')} "), known(d)) for d in DIMENSIONS]),
        lambda x: x.isNotNull()), ", ")
    return F.array_join(F.concat(F.array(head), *told, F.filter(F.array(ratings, known("source_name"), known("canonical_url")),
        lambda x: x.isNotNull() & (x != ""))), "\n")


def reply_instructions(labels: list[str]) -> str:
    """How a reply must look for functions.text.reply_blocks() to read it: one idea takes a bare rating, several take labelled ones."""
    ratings = ", ".join(v.replace("_", " ") for v in VERDICTS)
    form = "<rating>" if len(labels) == 1 else f"{next(iter(labels), 'NAME')} - <rating>"
    return f"{RULE}\nAnswer with\n  {form}\n  <why, in as many lines as you like>\n<rating> is one of {ratings}." + ("" if len(labels) == 1 else "\nIdeas that you leave out stay unrated.")


def digest_body(selected: DataFrame, size: int) -> str:
    """The digest of the selected ideas (with position); at most size rows reach the driver."""
    rows = selected.select("position", digest_item().alias("text"), idea_label().alias("label")).orderBy("position").limit(size).collect()
    return "\n\n".join([*(r.text for r in rows), reply_instructions([r.label for r in rows])])


def number(x: float | None) -> str:
    return "N/A" if x is None else f"{x:.3f}"


def evaluated_line() -> Column:
    """One line of a judgment and the prediction that it is held against."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return F.concat_ws(" | ", F.concat(F.lit("FB "), known("feedback_id")), F.concat(known("company"), F.lit(" ("), known("ticker"), F.lit(")")),
        F.concat(F.lit("SR-"), known("screening_id"), F.lit(", prompt "), known("screening_prompt_version")),
        F.concat(F.lit("said "), known("overall_prediction")), F.concat(F.lit("judged "), known("verdict"), F.lit(" = "), known("actual")), F.col("kind"))


def rationale_lines() -> Column:
    """What the judgment and the screening gave as their reasons: the comment, the ratings and the narrative, a line each."""
    ratings = F.concat_ws(", ", *[F.concat(F.lit(f"{d.replace('_', ' ')} "), F.coalesce(F.col(d), F.lit("-"))) for d in (*DIMENSIONS, "confidence")])
    told = [F.concat(F.lit(f"    {name}: "), F.when(F.size(substantive(F.col(c))) > 0, F.array_join(substantive(F.col(c)), " | ")).otherwise("none stored"))
        for c, name, _ in SHOWN]
    comment = F.coalesce(F.when(F.col("user_comment") != "", F.col("user_comment")), F.lit("none recorded"))
    return F.concat_ws("\n", F.concat(F.lit("    comment: "), comment), F.concat(F.lit("    ratings: "), ratings), *told)


def error_report(rows: DataFrame, hits: DataFrame, themes: DataFrame, rules_text: str, at_most: int = 200) -> str:
    """Errors of an evaluation, costliest first, with the rationale of false negatives and positives, and what their texts have in common.

    rows: evaluation_rows() with the screening's ratings and narrative; hits: hurdle_hits() of them; themes: theme_report()
    of the false negatives. At most at_most rows of each part are shown, with how many there are.
    """
    def part(title: str, texts: DataFrame, *order) -> list[str]:
        n = texts.count()
        shown = [r.text for r in texts.orderBy(*order).limit(at_most).select("text").collect()]
        return ["", f"{title}: {n}", *shown, *([f"... and {n - at_most} more"] if n > at_most else [])]

    line = rows.withColumn("text", F.concat(F.lit("  "), evaluated_line()))
    out = part("rows by cost", line, "bucket", "feedback_id")
    for kind in ("false_negative", "false_positive"):
        out += part(kind.replace("_", " "), line.filter(F.col("kind") == kind).withColumn("text", F.concat("text", F.lit("\n"), rationale_lines())), "feedback_id")
    met = hits.join(rows.select("feedback_id", "kind"), "feedback_id").withColumn("text", F.concat(F.lit("  FB "), F.col("feedback_id").cast("string"),
        F.lit(" | "), "kind", F.lit(" | "), "categories", F.lit(" in "), F.col("field"), F.lit(': "'), "excerpt", F.lit('"'),
        F.when(F.col("permanent_framing"), " (beside a percentage of 100)").otherwise("")))
    out += ["", "thresholds of the rules:", *(f"  > {x}" for x in rows.sparkSession.range(1).select(rule_excerpts(F.lit(rules_text)).alias("x")).first().x)]
    out += part("screenings that speak of a hurdle", met, "feedback_id")
    found = themes.filter("n_rows > 0").orderBy("theme_no").collect()  # a row for each theme
    return "\n".join([*out, "", "themes of the false negatives:", *(f"  {r.theme}: {r.n_rows} (FB {r.refs})" for r in found)])


def evaluation_report(metrics: DataFrame, matrix: DataFrame, checks: list[tuple[str, bool]]) -> str:
    """The evaluation's report, or only its checks where one fails. One row of metrics and three of the matrix reach the driver."""
    out = ["CHECKS", *[f"  {'ok' if ok else 'FAILED'}  {name}" for name, ok in checks]]
    if not all(ok for _, ok in checks):
        return "\n".join([*out, "", "The evaluation doesn't count."])
    m, cells = metrics.first(), {r.actual: r.asDict() for r in matrix.collect()}
    out += ["", f"exact: {m.exact_correct} of {m.n}; scored: {m.n_scored}", f"tp {m.tp}, fp {m.fp}, tn {m.tn}, fn {m.fn}"]
    out += [f"{name}: {number(m[name])}" for name in ("precision", "recall", "specificity", "balanced_accuracy", "f1", "hc_recall")]
    columns = [c for c in matrix.columns if c != "actual"]
    out += ["", "\t".join(["actual", *columns]), *["\t".join([a, *[str(cells.get(a, {}).get(c,
        0)) for c in columns]]) for a in ("INVESTIGATE_NOW", "WATCH", "PASS")]]
    return "\n".join(out)


def audit_report(summary: DataFrame, problem_rows: DataFrame, groups: DataFrame, at_most: int = 100) -> str:
    """The audit's report; at most at_most problem rows and groups are shown, with how many there are in all."""
    s = summary.first()
    out = [f"official {s.n_official}, candidates {s.n_candidates}, superseded {s.n_superseded}, other {s.n_other}",
        f"unique ideas {s.n_unique}, valid and unique {s.n_valid_unique}, replacements needed {s.replacements_needed}",
        f"clean: {'yes' if s.clean else 'no'}"]
    bad = problem_rows.filter(F.size("problems") > 0)
    out += ["", f"rows with problems: {bad.count()}",
        *[f"  FB {r.feedback_id}: {', '.join(r.problems)}" for r in bad.orderBy("feedback_id").limit(at_most).collect()]]
    out += ["", f"groups of one idea: {groups.count()}",
        *[f"  {r.component}: {r.n_members} rows, {r.level} {r.value}" for r in groups.orderBy("component").limit(at_most).collect()]]
    return "\n".join(out)
