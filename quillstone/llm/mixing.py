"""Mixing sources to target weights by Poisson replication.

A source of n rows with target share w of a corpus of total rows gets the mean repetition rate w * total / n. Each
document's copies are drawn by inverting the Poisson distribution of that mean at a uniform number that a hash of seed
and document id gives, so a document's count depends on nothing else and any executor can redo it. Documents are then
exploded by their counts and dealt out in the order of a second hash.

Cases: a null source is a source of its own; a null id hashes as an empty text; repeated rows are counted and drawn
each (the same id draws the same count); weights of sources that have no rows are ignored and the rest rescaled;
sources without a weight get none of the copies; an empty table gives an empty result. Rows are carried unchanged in a
struct, so no name of theirs can clash, whatever their length. Only one row a source is ever joined to the documents; a hot source needs no salt, since counts
are pre-aggregated and the join is a broadcast up to MAX_BROADCAST_SOURCES sources and a skew-split join beyond. Rows that
share an id, null ones among them, have the same place; the global shuffle deals them out by their number as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import default_parallelism, literal_rows, materialize, spread, whole

SEED = "mix-1"
#: Power of a source's rows that its target weight follows, where no weights are given.
TEMPERATURE = 0.5
#: Rates with more rows than this are joined by shuffle. A row takes some 100 bytes and its table of probabilities.
MAX_BROADCAST_SOURCES = 20_000
BITS = 52


def hash_bits(*parts: Column) -> Column:
    """The first 52 bits of the md5 of the parts, joined by colons, as long."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source") -> DataFrame:
    """One row a source: source, n, rate. Sources are counted in one pass and written, as their rates are used more than once."""
    n = materialize(docs.groupBy(docs[source].alias("source")).agg(F.count("*").alias("n")))
    if weights is None:
        n = n.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE)))
    else:
        given = literal_rows(docs.sparkSession, [(k, float(v)) for k, v in weights.items()], "given string, weight double")
        n = n.join(given, F.col("source").eqNullSafe(F.col("given")), "left").select("source", "n",
            F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = n.agg(F.sum("n").alias("total"), F.sum("weight").alias("weights"))
    rate = F.round(F.coalesce(F.try_divide(F.col("weight") * F.col("total"), F.col("weights") * F.col("n")), F.lit(0.0)), 9)
    return n.join(F.broadcast(total)).select("source", "n", rate.alias("rate"))  # total has one row


def _with_tables(rates: DataFrame) -> DataFrame:
    """Adds low and cdf, the Poisson distribution function at low, low + 1, ... to where it is 1 in double precision."""
    rate, spread = F.col("rate"), 12 * F.sqrt("rate") + 30
    out = rates.withColumn("low", F.greatest(F.lit(0), F.floor(rate - spread)).cast("int")).withColumn("high",
        F.ceil(rate + spread).cast("int"))
    log_factorial = F.when(F.col("low") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest("low", F.lit(1))), F.lit(0.0), lambda s,
        k: s + F.ln(k))).otherwise(0.0)
    first = F.exp(-rate + F.when(F.col("low") > 0, F.col("low") * F.ln(rate)).otherwise(0.0) - log_factorial)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["cdf"], F.array(s["c"] + p)).alias("cdf"))

    table = F.aggregate(F.sequence(F.col("low") + 1, F.col("high")), start, step)["cdf"]
    return out.select("source", "rate", "low", table.alias("cdf"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: str = SEED, source: str = "source",
        doc_id: str = "doc_id") -> DataFrame:
    """Once for each copy: row, a struct of all columns of docs; copy (1, 2, ...); place, its place in the global shuffle; number, the row's own."""
    rates = _with_tables(source_rates(docs, weights, source))
    many = rates.limit(MAX_BROADCAST_SOURCES + 1).count() > MAX_BROADCAST_SOURCES
    u = (hash_bits(F.lit(seed), docs[doc_id]) + F.lit(0.5)) / F.lit(float(2**BITS))
    rows = docs.select(whole(docs).alias("row"), docs[source].alias("of"), docs[doc_id].alias("id"), u.alias("u"),
        F.monotonically_increasing_id().alias("number"))
    drawn = rows.join(rates if many else F.broadcast(rates), F.col("of").eqNullSafe(F.col("source")))
    n = F.when(F.col("rate") > 0, F.col("low") + F.size(F.filter("cdf", lambda c: c <= F.col("u")))).otherwise(0)
    copies = drawn.select("row", "id", "number", n.alias("n")).filter("n > 0").select("row", "id", "number",
        F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    return copies.select("row", "copy", hash_bits(F.lit(seed), F.col("id"), F.col("copy")).alias("place"), "number")


def shuffled(mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Deals mixed rows out by a hash of place and number, and orders each part by place: a global shuffle."""
    n = default_parallelism(mixed.sparkSession)
    return mixed.repartition(n, "place", "copy", "number").sortWithinPartitions("place", F.col("row").getField(doc_id), "copy")


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mixed and shuffled copies with the columns of docs alone."""
    return spread(shuffled(mix(docs, **how)))


def oracle(seed: str = SEED) -> str:
    def bits(*parts: str) -> str:
        return f"CAST('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, {BITS // 4}) AS BIGINT)"

    return f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), {TEMPERATURE}) AS weight FROM documents GROUP BY source),
r AS (SELECT source, n, round(weight * sum(n) OVER () / (sum(weight) OVER () * n), 9) AS rate FROM n),
p(source, rate, k, p, c) AS (SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM p WHERE k < rate + 12 * sqrt(rate) + 30),
d AS (SELECT doc_id, source, ({bits(f"'{seed}'", "coalesce(CAST(doc_id AS VARCHAR), '')")} + 0.5) / CAST({2**BITS} AS DOUBLE) AS u FROM documents),
cdf AS (SELECT source, list(c ORDER BY k) AS cdf FROM p GROUP BY source),
c AS (SELECT doc_id, d.source, len(list_filter(cdf, lambda x: x <= u)) AS n FROM d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source),
e AS (SELECT doc_id, source, unnest(range(1, n + 1)) AS copy FROM c)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, {bits(f"'{seed}'", "coalesce(CAST(doc_id AS VARCHAR), '')", "CAST(copy AS VARCHAR)")} AS shuffle_order FROM e"""
