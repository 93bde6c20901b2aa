"""Importance resampling of documents towards a target distribution of hashed n-grams.

Words and word pairs (runs of 1 to LONGEST consecutive words, joined by one space) are hashed by the CRC-32 of their
UTF-8 bytes into BUCKETS buckets. A bucket's gain says how much more frequent it is in the target than in the corpus,
both smoothed by one; a document's weight is the mean gain of its features. Gumbel noise, seeded by the document's id,
turns the largest scores into a draw without replacement.

Bytes are read by a vectorised automaton, straight from Arrow's UTF-8 buffers and without a Python object for each
word: a lookup table classifies (and lower-cases) each byte, differences of the classes give the word boundaries, and a
table-driven CRC advances over all words of a block at once, one byte of each a step. The CRC of a run goes on from the
state that the run before it ended in. The few words longer than LONG bytes are left to zlib, which has the same CRC.

Two passes read the texts: one sums both histograms (each task sends at most BUCKETS rows, the driver receives BUCKETS
sums), one weighs. Weighed rows are small; they are written, sorted by ranges of their score and written again with
their place, so that ranks come from places and one count for each range: nothing is ranked in one task, however many
documents share a score.

Cases: null and empty texts have no feature and the weight 0; a null id is seeded as an empty text; repeated rows count
and are weighed each, and of rows of equal score and id any comes first; with an empty target every bucket only has its
smoothing; an empty table gives an empty result; a text of any length is read whole; kept columns are carried in a
struct and give way to the results where names clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import (
    PLACE_BITS,
    byte_blocks,
    byte_runs,
    in_order,
    literal_rows,
    materialize,
    short_batches,
    spread,
    whole,
)

BUCKETS, LONGEST, SEED = 10_000, 2, 7
#: Documents with fewer words aren't drawn; percent of the others that are.
LEAST_WORDS, PERCENT = 20, 25
#: Bytes of text that the automaton reads at once (a longer text is read alone), and of words that it steps through.
BLOCK_BYTES, LONG = 4_000_000, 48
RESULTS = ("n_features", "weight", "score", "rank")
_SUMS = "bucket int, background long, target long"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: what it is lower-cased to (0: no part of a word), and the CRC-32 of it as a state's lowest byte."""
    byte = np.arange(256)
    digit, upper, lower = (byte >= 0x30) & (byte <= 0x39), (byte >= 0x41) & (byte <= 0x5A), (byte >= 0x61) & (byte <= 0x7A)
    folded = np.where(digit | lower | (byte >= 0x80), byte, np.where(upper, byte + 0x20, 0)).astype(np.uint8)
    crc = byte.astype(np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1).astype(np.uint32)
    return folded, crc


FOLDED, STEP = _tables()
ONES = np.uint32(0xFFFFFFFF)


def _over(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return (state >> np.uint32(8)) ^ STEP[(state ^ byte) & np.uint32(0xFF)]


class Words:
    """The words of a block of texts: bytes lower-cased, where words start and how long they are, and each text's share of them."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        """data: the bytes of all texts; ends: where each text ends in them."""
        self.data = FOLDED[data]
        self.start, stop = byte_runs(self.data != 0, ends)
        self.length = stop - self.start
        upto = np.searchsorted(self.start, ends, side="left")
        self.per_text = np.diff(upto, prepend=0)
        self.text = np.repeat(np.arange(len(ends)), self.per_text)
        # Longest first, so that the words which still have a byte at a step are a leading slice.
        self.by_length = np.argsort(-np.minimum(self.length, LONG + 1), kind="stable")
        self.still = np.searchsorted(-self.length[self.by_length].clip(max=LONG + 1), -np.arange(1, LONG + 1), side="right")

    def advance(self, state: np.ndarray) -> np.ndarray:
        """The CRC state of each word's bytes, from a state of each."""
        out = state[self.by_length]
        start = self.start[self.by_length]
        n_long = int(np.searchsorted(-self.length[self.by_length].clip(max=LONG + 1), -LONG, side="left"))
        for k, n in enumerate(self.still):
            if n <= n_long:
                break
            out[n_long:n] = _over(out[n_long:n], self.data[start[n_long:n] + k])
        for i in range(n_long):
            word = self.data[start[i] : start[i] + self.length[self.by_length[i]]]
            out[i] = zlib.crc32(word, int(out[i] ^ ONES)) ^ 0xFFFFFFFF
        back = np.empty_like(out)
        back[self.by_length] = out
        return back

    def features(self, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of every run of up to longest words and the text that it is in."""
        state, number = np.full(len(self.start), ONES, np.uint32), np.arange(len(self.start))
        found, of = [], []
        for n in range(longest):
            if n:  # the run that ended at the word before goes on, within a text
                state = np.concatenate([state[:1], _over(state[:-1], 0x20)])
            state = self.advance(state)
            ok = number >= n
            ok[n:] &= self.text[n:] == self.text[: len(self.text) - n]
            found.append(((state ^ ONES)[ok] % np.uint32(buckets)).astype(np.int64))
            of.append(self.text[ok])
        return np.concatenate(found), np.concatenate(of)


def _blocks(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    for first, data, ends in byte_blocks(texts, BLOCK_BYTES):
        yield first, Words(data, ends)


def _histogram(batches: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of a task by bucket; the second column says whether a text is the target's."""
    sums = np.zeros((2, buckets), np.int64)
    for batch in batches:
        target = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, words in _blocks(batch.column(0)):
            bucket, of = words.features(longest, buckets)
            sums += np.bincount(bucket + buckets * target[first + of], minlength=2 * buckets).reshape(2, buckets)
    some = np.flatnonzero(sums.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[0][some]), pa.array(sums[1][some])],
        ["bucket", "background", "target"])


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """A gain for each bucket: floor(1000 * ln of its smoothed share in target (text) over that in docs (text))."""
    read = docs.select("text", F.lit(False).alias("target")).union(target.select("text", F.lit(True)))
    sums = read.mapInArrow(partial(_histogram, longest=longest, buckets=buckets), _SUMS).groupBy("bucket").agg(
        F.sum("background").alias("background"), F.sum("target").alias("target")).collect()  # at most as many rows as buckets
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in sums:
        s[r.bucket], t[r.bucket] = r.background, r.target
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weigh(batches: Iterator[pa.RecordBatch], shared, longest: int) -> Iterator[pa.RecordBatch]:
    gain = shared.value
    for batch in batches:
        n, words, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for first, block in _blocks(batch.column(2)):
            bucket, of = block.features(longest, len(gain))
            size = len(block.per_text)
            count, at = np.bincount(of, minlength=size), np.argsort(of, kind="stable")
            total = np.concatenate([[0], np.cumsum(gain[bucket[at]])])
            ends = np.cumsum(count)
            part = slice(first, first + size)
            n[part], words[part] = count, block.per_text
            weight[part] = np.where(count > 0, (total[ends] - total[ends - count]) // np.maximum(count, 1), 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (n, words, weight))],
            ["row", "id", "n_features", "n_words", "weight"])


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the SHA-256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def _placed(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with place, 0, 1, ... in the order given: a range's rows go on from the number of rows in the ranges before."""
    found, part = in_order(rows, *order), F.shiftright("__at", PLACE_BITS).cast("int")
    before, starts = 0, []
    for r in sorted(found.groupBy(part.alias("part")).count().collect()):  # one row for each range
        starts.append((r[0], before - (r[0] << PLACE_BITS)))
        before += r[1]
    if not starts:
        return found.withColumn("place", F.lit(0).cast("long")).drop("__at")
    shift = literal_rows(rows.sparkSession, starts, "__part int, __shift long")
    return found.join(F.broadcast(shift), part == F.col("__part")).withColumn("place", F.col("__at") + F.col("__shift")).drop("__at",
        "__part", "__shift")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, keep: tuple[str, ...] = ("doc_id",),
        least_words: int = LEAST_WORDS, seed: int = SEED, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """keep, n_features, weight, score and rank for every row of docs (doc_id, text). rank is 1, 2, ... by falling score, then
    doc_id, for the drawn: percent of the rows that have least_words words or more, rounded down; null for the others."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(gains(docs, target, longest, buckets))
    keep = [c for c in keep if c.lower() not in RESULTS]
    read = docs.select(F.struct(F.lit(0).alias("none"), F.struct(*keep).alias("kept")).alias("row"), F.col("doc_id").alias("id"), "text")
    schema = T.StructType([read.schema["row"], read.schema["id"], *[T.StructField(c, T.LongType()) for c in ("n_features", "n_words",
        "weight")]])
    weighed = read.mapInArrow(partial(_weigh, shared=shared, longest=longest), schema)
    rows = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    able = rows.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranked = _placed(able, F.desc("score"), F.asc_nulls_first("id"))
    ranked = ranked.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place")
    others = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).select(*[F.col("row.kept").getField(c).alias(c) for c in keep], *RESULTS)


def resample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents, whole rows of docs with all their columns, in no order."""
    packed = docs.select(whole(docs).alias("row"), "doc_id", "text")
    return spread(importance_resample(packed, target, keep=("row",), **how).filter("rank IS NOT NULL"))


def oracle(percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    shift = "xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = "CAST('0x' || substr(h, CAST(i AS INTEGER), 2) AS BIGINT)"
    # The CRC's table by its rule; each distinct run is hashed once.
    return rf"""
WITH RECURSIVE e(k, s, n) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT k, {shift}, n + 1 FROM e WHERE n < 8),
tbl AS (SELECT list(s ORDER BY k) AS t FROM e WHERE n = 8),
texts AS (SELECT row_number() OVER () AS id, doc_id, text, 0 AS side FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, 1 FROM benchmark),
w AS (SELECT id, doc_id, side, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT id, side, unnest(w) AS f FROM w
  UNION ALL SELECT id, side, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) > 1),
fs AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)),
crc AS (SELECT f, CAST(xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: {byte}), lambda s, x: xor(s >> 8, t[1 + (xor(s, x) & 255)]), 4294967295),
  4294967295) % {buckets} AS BIGINT) AS b FROM fs, tbl),
c AS (SELECT id, side, b, count(*) AS n FROM runs JOIN crc USING (f) GROUP BY id, side, b),
g AS (SELECT b, sum(CASE side WHEN 0 THEN n ELSE 0 END) AS s, sum(CASE side WHEN 1 THEN n ELSE 0 END) AS t FROM c GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (sum(CAST(s AS DOUBLE)) OVER () + {buckets}) / ((CAST(s AS DOUBLE) + 1) * (sum(CAST(t AS DOUBLE)) OVER () + {buckets})))) AS BIGINT) AS gain FROM g),
m AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight FROM c JOIN gain USING (b) WHERE side = 0 GROUP BY id),
d AS (SELECT w.id, w.doc_id, len(w.w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(w.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN m USING (id) WHERE side = 0),
s AS (SELECT *, weight + CAST(floor(-1000.0 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM d),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS able FROM s WHERE words >= {least_words})
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN rank <= (able * {percent}) // 100 THEN CAST(rank AS BIGINT) END AS rank FROM s LEFT JOIN r USING (id)"""
