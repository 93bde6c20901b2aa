"""Document quality rules: a threshold table compiled into one Spark projection (no user functions).

Cases: null text is an empty text (no words: base_failed, not kept); a text of any length is read whole and
handled inside its own row, so no shuffle and no skew arise; repeated rows are judged alike, one result each;
columns of the input other than the text are carried along only if asked for, and of these one that has the name of a
result gives way to the result; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Characters that begin a list item.
BULLETS = ("-", "*", "•")
#: Frequent function words of English, German, French and Spanish, all ASCII.
STOP_WORDS = (
    "a an and are as at be by for from has in is it not of on or that the this to was with "
    "auf das dem den der des die ein eine im mit nicht sich und von zu "
    "avec dans de des du en est et il la le les que qui un une "
    "con del el las los no para por se su"
).split()
WINDOW = 5
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20


@dataclass(frozen=True)
class Rule:
    """Passes where low * denominator <= 1000 * numerator <= high * denominator; a None bound is open. Integers only."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None

    def passes(self) -> Column:
        n, d = F.col(self.numerator) * 1000, F.col(self.denominator)
        tests = [n >= d * self.low] * (self.low is not None) + [n <= d * self.high] * (self.high is not None)
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out

    def sql(self) -> str:
        tests = [f"1000*{self.numerator} >= {self.low}*{self.denominator}"] * (self.low is not None)
        tests += [f"1000*{self.numerator} <= {self.high}*{self.denominator}"] * (self.high is not None)
        return "(" + " AND ".join(tests) + ")"


#: The threshold table; bounds are in thousandths.
RULES = (
    Rule("word_length", "word_chars", "n_words", 1500, 25000),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 250),
    Rule("shouting", "n_exclamations", "n_words", None, 400),
    Rule("stop_words", "n_stop_words", "n_words_beyond", 15, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 300),
)


#: A stop word counts in lower case or with its first letter a capital.
STOP_FORMS = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
#: A text of so many words needs no stop word.
STOP_FREE = 50
#: Names of the results, which columns carried along give way to.
RESULTS = ("n_words word_chars n_symbols n_dup_lines n_repeat_words n_exclamations n_stop_words n_words_beyond n_lines n_bullet_lines n_ellipsis_lines "
           "base_failed kept failed_rules").split()


def _removed(text: Column, chars: str) -> Column:
    rest = text
    for c in chars:
        rest = F.replace(rest, F.lit(c))
    return (F.length(text) - F.length(rest)).cast("long")


def quality_metrics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the kept columns and the counts that the rules use."""
    keep = tuple(c for c in keep if c.lower() not in RESULTS)
    t, words, n = F.col("__t"), F.col("__words"), F.size("__words")
    out = docs.select(F.struct(F.lit(0).alias("none"), *keep).alias("__row"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    out = out.select("*", words_of(t).alias("__words"), F.split(t, "\n").alias("__lines"))
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(WINDOW)]))
    out = out.select("*", F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")).alias("__h"),
                     F.filter("__lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__full"))
    # Windows that all hash apart are all different; only other texts have their windows sorted and compared in full.
    windows = F.array_sort(F.transform(starts, lambda i: F.struct(
        F.element_at("__h", i).alias("h"), F.concat_ws(" ", F.slice(words, i, WINDOW)).alias("w"), i.alias("i"))))
    apart = F.size(F.array_distinct("__h")) == F.size("__h")
    out = out.select("*", F.when(apart, F.array().cast(f"array<struct<h:bigint,w:string,i:int>>")).otherwise(windows).alias("__s"))
    m = F.size("__s")
    twins = F.zip_with(F.slice("__s", 1, m - 1), F.slice("__s", 2, m - 1), lambda a, b: F.when(
        (a["h"] == b["h"]) & (a["w"] == b["w"]), F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    found = F.when(m > 1, F.array_sort(F.array_distinct(F.flatten(twins)))).otherwise(F.array().cast("array<int>"))
    out = out.select("*", found.alias("__p"))
    k = F.size("__p")
    covered = F.aggregate(F.zip_with(F.slice("__p", 1, k - 1), F.slice("__p", 2, k - 1), lambda a, b: F.least(b - a, F.lit(WINDOW))),
                          F.lit(WINDOW).cast("long"), lambda s, x: s + x)
    long = lambda c: c.cast("long")
    return out.select(
        *[F.col("__row").getField(c).alias(c) for c in keep], long(n).alias("n_words"),
        long(F.length(F.array_join(words, ""))).alias("word_chars"),
        _removed(t, SYMBOLS).alias("n_symbols"), long(F.size("__full") - F.size(F.array_distinct("__full"))).alias("n_dup_lines"),
        F.when(k > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        _removed(t, "!").alias("n_exclamations"), long(F.size(F.filter(words, lambda w: w.isin(*STOP_FORMS)))).alias("n_stop_words"),
        long(F.greatest(n - STOP_FREE, F.lit(0))).alias("n_words_beyond"), long(F.size("__full")).alias("n_lines"),
        long(F.size(F.filter("__full", lambda x: F.substring(F.ltrim(x), 1, 1).isin(*BULLETS)))).alias("n_bullet_lines"),
        long(F.size(F.filter("__full", lambda x: F.rtrim(x).endswith("...")))).alias("n_ellipsis_lines"),
    )


def apply_rules(metrics: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed, kept and failed_rules (names, in table order) in one projection."""
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    kept = ~base
    for r in rules:
        kept = kept & r.passes()
    names = F.filter(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return metrics.select("*", base.alias("base_failed"), kept.alias("kept"), F.concat_ws(",", names).alias("failed_rules"))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Metrics and verdict for every row of docs."""
    return apply_rules(quality_metrics(docs, text, keep), rules)


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for quality_rules() over documents."""
    ws, stop = r"[\x20\x09-\x0D]+", ", ".join(f"'{w}'" for w in STOP_FORMS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{ws}'), lambda w: w <> '') AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS r FROM documents),
w AS (SELECT r, i, array_to_string(words[i:i+4], ' ') AS win FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM w) WHERE c > 1),
rep AS (SELECT r, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_exclamations,
  CAST(len(list_filter(words, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words, CAST(greatest(len(words) - {STOP_FREE}, 0) AS BIGINT) AS n_words_beyond, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(list_filter(lines, lambda x: ltrim(x)[1] IN ('-', '*', '•'))) AS BIGINT) AS n_bullet_lines,
  CAST(len(list_filter(lines, lambda x: ends_with(rtrim(x), '...'))) AS BIGINT) AS n_ellipsis_lines
  FROM d LEFT JOIN rep USING (r))
SELECT *, (n_words < {MIN_WORDS} OR 100*n_repeat_words > {MAX_REPEATED_PERCENT}*n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100*n_repeat_words > {MAX_REPEATED_PERCENT}*n_words) AND {' AND '.join(r.sql() for r in rules)} AS kept,
  array_to_string(list_filter([{', '.join(f"CASE WHEN NOT {r.sql()} THEN '{r.name}' END" for r in rules)}], lambda x: x IS NOT NULL), ',') AS failed_rules
FROM m"""
