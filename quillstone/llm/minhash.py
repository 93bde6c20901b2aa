"""Near-duplicate detection by min-max hashing, with links confirmed on full shingle sets.

A document's set holds the 64-bit hashes of its distinct k-word shingles. Each random permutation gives two signature
values, the minimum and the maximum, so a signature of 2p values needs p evaluations a shingle; each value agrees with
the Jaccard similarity as its probability, and the two of one permutation are slightly negatively correlated, which
lowers the variance of the banded signature. BAND_ROWS values make a band key; there are as many bands as keep the
chance to miss a pair right at the threshold below MISS.

Equal sets become one class first. Each bucket of a band key is compared with its first member, which joins the copies
of one text into one component. Where other members are still in different components, a bucket of at most SMALL_BUCKET
of them is compared in its task, signature against signature and then set against set, and only links that join
components leave it; a larger one goes on with more pivots, twice as many in each round, until what is left is small. So
no link that could join components goes untested, and no bucket is expanded into its pairs. Candidates are dropped by
set sizes and by an estimate from the signatures DEVIATIONS standard deviations below the threshold (for a pair right at
it, a chance of some 3e-7 besides the banding's MISS); the rest is compared on full sets. For that, a pivot's candidates
are dealt out by pivot and a salt: the pivot's text comes once to each such part and is held while the candidates stream
by, so neither its text nor its candidates meet in one task. Components come from alternating large-star and small-star
steps on tables in the shared folder.

Cases: null and blank texts have an empty set and link to nothing; a text of fewer than k words is one shingle; equal
texts, and repeated rows, fall into one class; rows of one id and different texts are one node of the graph; a null id
keeps its row, unlinked, with a null component; an empty table gives an empty result; near_duplicates() ignores other
columns. deduplicate() carries them, whatever their names; of the rows of one component one stays, also where rows are
repeated or share an id; every row without words stays, and every row with a null id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import MAX_BROADCAST_IDS, default_parallelism, materialize, release, short_batches, spread, whole
from quillstone.operators.joins import components_of

BAND_ROWS, MISS = 7, 1e-6
#: Members and shingles of a bucket that one task compares; larger buckets go on with pivots.
SMALL_BUCKET, SMALL_SHINGLES = 2048, 4_000_000
#: How far below the threshold, in standard deviations, a signature's estimate rules a pair out.
DEVIATIONS = 5
#: Classes of equal sets that are broadcast; of more, only those with HOT_CLASS rows or more are, and the rest joined by shuffle.
MAX_BROADCAST_CLASSES, HOT_CLASS = 1_000_000, 10_000
#: Parts, at least, that the candidates of one pivot can be dealt into.
SALTS = 64
#: Words whose hashes a worker remembers.
CACHE = 250_000
_MIX = np.random.default_rng(20240607)
_WEIGHTS = _MIX.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, k: int, cache: dict) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        import xxhash

        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    ids = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = len(ids) - k + 1
    acc = ids[:n] * _WEIGHTS[0]
    for i in range(1, k):
        acc += ids[i : i + n] * _WEIGHTS[i]
    return np.unique(_mixed(acc))


def bands_for(threshold: float) -> int:
    """An even number, so that the permutations, which give two values each, come out even."""
    return 2 * math.ceil(math.log(MISS) / math.log(1 - threshold**BAND_ROWS) / 2)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(977)
    return rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """min, max of each permutation, in turn."""
    low, high = np.full(len(flips), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(flips), np.uint64)
    for i in range(0, len(shingles), 2048):
        h = (shingles[i : i + 2048, None] ^ flips) * factors
        np.minimum(low, h.min(0), out=low)
        np.maximum(high, h.max(0), out=high)
    return np.stack([low, high], 1).ravel()


def _sign(batches: Iterator[pa.RecordBatch], k: int, bands: int) -> Iterator[pa.RecordBatch]:
    cache, (flips, factors) = _WordHash(), _permutations(bands * BAND_ROWS // 2)
    rows = _WEIGHTS[16 : 16 + BAND_ROWS]
    tags = _mixed(np.arange(1, bands + 1, dtype=np.uint64) * _WEIGHTS[40])
    for batch in batches:
        n, fp1, fp2, keys, sigs = [], [], [], [], []
        for text in batch.column(1).cast(pa.large_binary()).to_pylist():
            s = shingle_set(text, k, cache)
            n.append(len(s))
            fp1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
            fp2.append(int(_mixed(s * _WEIGHTS[50]).sum(dtype=np.uint64).view(np.int64)))
            if len(s):
                v = signature(s, flips, factors)
                keys.append((_mixed((v.reshape(bands, BAND_ROWS) * rows).sum(1, dtype=np.uint64)) + tags).view(np.int64))
                sigs.append((v >> np.uint64(40)).astype(np.uint8).tobytes())
            else:
                keys.append(np.empty(0, np.int64))
                sigs.append(b"")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()),
            pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                                         ["doc_id", "n_shingles", "fp1", "fp2", "keys", "sig"])


def _least_agreeing(percent: int, values: int) -> float:
    t = percent / 100
    return (t - DEVIATIONS * math.sqrt(t * (1 - t) / values)) * values


def _likely(batches: Iterator[pa.RecordBatch], percent: int, values: int) -> Iterator[pa.RecordBatch]:
    """Candidates whose signatures agree often enough."""
    least = _least_agreeing(percent, values)
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, values) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((a == b).sum(1) >= least))


def _common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others, none empty."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat(one[at] == flat, np.cumsum([0, *map(len, others[:-1])]))


def _within(bucket: pa.Table, k: int, percent: int, values: int) -> pa.Table:
    """Links that join components in one small bucket (key, doc_id, component, sig, keys, text), found on full sets.

    A pair is looked at in the bucket of the first band that it shares, and only while its components differ.
    """
    cache, least, m = _WordHash(), _least_agreeing(percent, values), bucket.num_rows
    ids, of = bucket.column("doc_id").to_numpy(), bucket.column("component").to_numpy().copy()
    sig = np.frombuffer(b"".join(bucket.column("sig").to_pylist()), np.uint8).reshape(m, values)
    keys = bucket.column("keys").combine_chunks().flatten().to_numpy().reshape(m, -1)
    before = keys[:, : int(np.nonzero(keys[0] == bucket.column("key")[0].as_py())[0][0])]
    texts, sets, links = bucket.column("text"), {}, []

    def full(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_set(texts[i].cast(pa.large_binary()).as_py(), k, cache)
        return sets[i]

    for i in range(m - 1):
        rest = np.nonzero(of[i + 1 :] != of[i])[0] + i + 1
        rest = rest[(sig[rest] == sig[i]).sum(1) >= least]
        rest = rest[~(before[rest] == before[i]).any(1)]
        for a in range(0, len(rest), 512):
            some = [int(j) for j in rest[a : a + 512] if of[j] != of[i]]
            if some:
                both, sizes = _common(full(i), [full(j) for j in some]), np.array([len(full(j)) for j in some])
                for j in np.array(some)[100 * both >= percent * (len(full(i)) + sizes - both)]:
                    if of[j] != of[i]:
                        links.append((ids[i], ids[j]))
                        of[of == of[j]] = of[i]
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})


def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs with 100 * |A and B| >= percent * |A or B| on full sets. Rows (a, salt, b, text) come sorted, the pivot's own (b is null) first: one, or several where its id has several texts."""
    cache, pivot, own, opened = _WordHash(), None, [], False
    for batch in batches:
        good = []
        for a, salt, b, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).cast(pa.large_binary()).to_pylist(),
                strict=True):
            found = shingle_set(text, k, cache)
            if b is None:
                own = [*own, found] if (pivot, opened) == ((a, salt), True) else [found]
                pivot, opened = (a, salt), True
                good.append(False)
                continue
            if pivot != (a, salt):
                raise ValueError("a candidate came without its pivot")
            opened = False
            both = [len(np.intersect1d(x, found, assume_unique=True)) for x in own]
            good.append(any(n > 0 and 100 * n >= percent * (len(x) + len(found) - n) for n, x in zip(both, own, strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in ids (one column, id)."""
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return materialize(docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["id"], "left_semi"))


def _links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int, bands: int) -> DataFrame:
    """Which of the pairs (a, b) of a pivot and a candidate are links; materialized."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("sig").alias(f"sig_{x}"),
        F.col("n_shingles").alias(f"n_{x}"))
    sized = pairs.distinct().join(side("a"), "a").join(side("b"),
        "b").filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", "sig_a", "sig_b")
    likely = materialize(sized.mapInArrow(partial(_likely, percent=percent, values=bands * BAND_ROWS), "a long, b long"))
    texts = _texts_of(docs, likely.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    tests = likely.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(max(SALTS, default_parallelism(docs.sparkSession)))))
    pivots = tests.select("a", "salt").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "salt",
        F.lit(None).cast("long").alias("b"), "text")
    others = tests.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", "b", "text")
    dealt = pivots.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    out = materialize(dealt.mapInArrow(partial(_confirm, k=k, percent=percent), "a long, b long"))
    release(likely, texts)
    return out


def _united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.union(x)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) and kept (doc_id = component_id) for every row of docs (doc_id, text)."""
    short_batches(docs.sparkSession)
    docs, bands = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), bands_for(percent / 100)
    signed = materialize(docs.mapInArrow(partial(_sign, k=k, bands=bands),
        "doc_id long, n_shingles long, fp1 long, fp2 long, keys array<long>, sig binary"))
    known = signed.filter("doc_id IS NOT NULL")
    fps = ["n_shingles", "fp1", "fp2"]
    classes = materialize(known.filter("n_shingles > 0").groupBy(*fps).agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")))
    reps = materialize(known.join(classes.select(*fps, F.col("rep").alias("doc_id")), [*fps, "doc_id"],
        "left_semi").dropDuplicates(["doc_id", *fps]))
    # Rows of one id and different texts are one node: their classes are linked.
    same_id = known.filter("n_shingles > 0").groupBy("doc_id").agg(F.count_distinct(*fps).alias("c")).filter("c > 1").select("doc_id")
    same = known.join(same_id, "doc_id").join(classes, fps).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")

    entries = reps.select("doc_id", "n_shingles", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("most")).filter("pivot <> most").select("key",
        "pivot")
    buckets = materialize(entries.join(shared, "key"))
    links = [_links(buckets.filter("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")), reps, docs, k,
        percent, bands)]

    def within(bucket: pa.Table) -> pa.Table:
        return _within(bucket, k, percent, bands * BAND_ROWS)

    rest, pivots = buckets.filter("doc_id <> pivot").select("key", "doc_id", "n_shingles"), 32
    components = components_of(_united([same, *links]))
    while True:
        labelled = rest.join(components, rest["doc_id"] == components["node"], "left").select("key", "doc_id", "n_shingles",
            F.coalesce("component", "doc_id").alias("component"))
        split = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m"),
            F.sum("n_shingles").alias("n")).filter("x <> y")
        small = (F.col("m") <= SMALL_BUCKET) & (F.col("n") <= SMALL_SHINGLES)
        open_rows = materialize(labelled.drop("n_shingles").join(split.select("key", small.alias("small")), "key"))
        few, many = open_rows.filter("small"), open_rows.filter("NOT small")
        ids = few.select(F.col("doc_id").alias("id")).distinct()
        whole = _texts_of(docs, ids).join(reps.select("doc_id", "sig", "keys"), "doc_id")
        found = few.drop("small").join(whole, "doc_id").select("key", "doc_id", "component", "sig", "keys",
            "text").groupBy("key").applyInArrow(within, "a long, b long")
        found = [materialize(found)]
        more = many.limit(1).count() > 0
        if more:
            chosen = many.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(pivots))).groupBy("key",
                "salt").agg(F.min_by(F.struct("doc_id", "component"), "doc_id").alias("p")).select("key", "p.doc_id", "p.component")
            others = many.select("key", F.col("doc_id").alias("b"), F.col("component").alias("cb"))
            tests = chosen.join(others, "key").filter("doc_id <> b AND component <> cb").select(F.col("doc_id").alias("a"), "b")
            found.append(_links(tests, reps, docs, k, percent, bands))
            rest = materialize(many.join(chosen.select("key", "doc_id"), ["key", "doc_id"],
                "left_anti").join(reps.select("doc_id", "n_shingles"), "doc_id").select("key", "doc_id", "n_shingles"))
            pivots *= 2
        new = [x for x in found if x.limit(1).count()]
        if new:
            links += new
            release(components)
            components = components_of(_united([same, *links]))
        release(open_rows)
        if not more:
            break
    release(reps, buckets)
    linked = classes.join(components, classes["rep"] == components["node"], "left").select(*fps, "m", "rep",
        F.coalesce("component", "rep").alias("component_id"))
    # A class of one row that is its own component needs no mention: such rows keep their own id.
    placed = _with_class(signed.select("doc_id", *fps), linked.filter("m > 1 OR component_id <> rep").drop("rep"), fps)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _with_class(rows: DataFrame, linked: DataFrame, fps: list[str]) -> DataFrame:
    """rows with the component_id of their class, null where linked has none. A class of very many rows is never a shuffle key."""
    linked = materialize(linked)
    if linked.limit(MAX_BROADCAST_CLASSES + 1).count() <= MAX_BROADCAST_CLASSES:
        return rows.join(F.broadcast(linked.drop("m")), fps, "left")
    hot, cold = linked.filter(F.col("m") >= HOT_CLASS).drop("m"), linked.filter(F.col("m") < HOT_CLASS).drop("m")
    first = rows.join(F.broadcast(hot), fps, "left")  # at most a HOT_CLASS-th of the rows
    rest = first.filter("component_id IS NULL").drop("component_id").join(cold, fps, "left")
    return first.filter("component_id IS NOT NULL").unionByName(rest)


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with all their columns; of the rows of one component one stays."""
    verdict = near_duplicates(docs.select(docs[doc_id].alias("doc_id"), docs["text"]), k,
        percent).filter("doc_id IS NOT NULL AND n_shingles > 0")
    # Ids that go, and kept ids that have several rows, all of which are in one component.
    decided = verdict.groupBy(F.col("doc_id").alias("id")).agg(F.bool_and("kept").alias("kept"),
        F.count("*").alias("c")).filter("NOT kept OR c > 1")
    decided = materialize(decided.select("id", F.when(F.col("kept"), "several").otherwise("gone").alias("what")))
    few = decided.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    wordless = ~F.coalesce(docs["text"].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.select(whole(docs).alias("row"), docs[doc_id].cast("long").alias("of"), wordless.alias("wordless"))
    rows = rows.join(F.broadcast(decided) if few else decided, F.col("of") == F.col("id"), "left")
    stay = rows.filter("what IS NULL OR wordless").select("row")
    if decided.filter("what = 'several'").limit(1).count():
        several = rows.filter("what = 'several' AND NOT wordless")
        stay = stay.union(several.groupBy("of").agg(F.min_by("row", F.xxhash64(F.col("row").getField("text"))).alias("row")).select("row"))
    return spread(stay)


def oracle(k: int = 3, percent: int = 85) -> str:
    """Brute force over all pairs that share a shingle, for small tables only."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) >= {k} THEN range(1, len(w) - {k - 2}) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= {percent} * (p.n + q.n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.reached = u.a)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id, doc_id = min(reached) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""
