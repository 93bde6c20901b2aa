"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over the presence of words and word beginnings. Features are screened by their document counts
over all labelled rows: those that are significantly more frequent in toxic documents stay, together with identity
terms. Sentences' identity terms are then swapped for another term of their group, and the squared change of the logit
between a document and its counterfactual is part of the loss, which drives the weights of identity terms together and,
as both sides of a swap occur in clean text, towards nothing: neutral mentions of a group don't raise the score.

Fitting the weights reads a bounded sample of at most about TRAIN_ROWS labelled rows, chosen by a hash of the id; the
document counts cover all of them. Scoring reads whole texts.

Cases: null and empty texts have no feature and get the score of the intercept; rows whose label is null are not
learned from; several labels of one id count as that many rows; with no labels, or labels of one class, every score is
the share of toxic labels (0 if there are none); a text of any length is read whole; equal scores have no order; repeated rows
are scored alike; an empty documents table gives an empty result; other columns are ignored. Labels,
language, source and id are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import short_batches

#: Terms that may stand for one another, by group.
IDENTITY = {
    "gender": "woman man women men girl boy female male lady gentleman mother father frau mann femme homme mujer hombre".split(),
    "religion": "muslim christian jewish hindu buddhist atheist catholic protestant sikh".split(),
    "origin": "african asian european american mexican indian chinese german french spanish arab immigrant foreigner".split(),
    "orientation": "gay straight lesbian bisexual heterosexual homosexual queer".split(),
    "ability": "blind deaf disabled autistic sighted hearing".split(),
    "age": "young old elderly teenage".split(),
    "color": "black white brown".split(),
}
GROUP_OF = {term: terms for terms in IDENTITY.values() for term in terms}
PREFIXES = (4, 5, 6)
#: Screening: least toxic documents, z value and ratio of frequencies.
LEAST_DOCS, LEAST_Z, LEAST_RATIO = 4, 5.0, 3.0
#: Bound of the sample the weights are fitted on; weights of the ridge and the counterfactual penalty.
TRAIN_ROWS, RIDGE, COUNTERFACTUAL = 20_000, 2e-5, 4.0
THRESHOLD = 0.7
#: Ids that are broadcast; counts and words that a worker remembers.
MAX_BROADCAST_IDS, HELD, CACHE = 2_000_000, 400_000, 250_000
_RUNS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_RUNS.findall((text or "").lower()))


def features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def swapped(found: set[str], turn: int = 1) -> set[str] | None:
    """The words with every identity term swapped for the one turn places on in its group; None without such a term."""
    terms = found & GROUP_OF.keys()
    if not terms:
        return None
    return (found - terms) | {GROUP_OF[t][(GROUP_OF[t].index(t) + turn) % len(GROUP_OF[t])] for t in terms}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(held: dict) -> pa.RecordBatch:
        names = list(held[0].keys() | held[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()),
            *(pa.array([held[c][x] for x in names], pa.int64()) for c in (1, 0))], ["feature", "toxic", "clean"])

    held = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            held[label].update({f for w in words(text.as_py()) for f in features(w)})
            if len(held[0]) + len(held[1]) > HELD:
                yield emit(held)
                held = {0: Counter(), 1: Counter()}
    yield emit(held)


def screen(train: DataFrame, n1: int, n0: int) -> list[str]:
    """Features of toxic documents, from the counts over all of train (text, toxic), n1 of it toxic and n0 clean, and the identity terms."""
    if not n1 or not n0:
        return []
    c = train.select("text", "toxic").mapInArrow(_count,
        "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("x"), F.sum("clean").alias("y"))
    p1, p0, p = F.col("x") / n1, F.col("y") / n0, (F.col("x") + F.col("y")) / (n1 + n0)
    z = (p1 - p0) / F.sqrt(p * (1 - p + 1e-9) * (1 / n1 + 1 / n0))
    good = c.filter(F.col("x") >= LEAST_DOCS).withColumn("z", z).filter((F.col("z") >= LEAST_Z) & (p1 >= LEAST_RATIO * p0))
    kept = [r[0] for r in good.orderBy(F.desc("z"), "feature").collect()]  # all that pass: a part of the vocabulary
    return kept + sorted({"=" + t for t in GROUP_OF} - set(kept))


def _encode(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """label, features present, and those of the counterfactual (null without identity terms)."""
    number = {f: i for i, f in enumerate(names)}
    at = lambda found: sorted({number[f] for w in found for f in features(w) if f in number})
    for batch in batches:
        own, other = [], []
        for text in batch.column(0):
            found = words(text.as_py())
            turned = swapped(found)
            own.append(at(found))
            other.append(None if turned is None else at(turned))
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, kind), pa.array(other, kind)], ["label", "own", "other"])


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([i for r in rows for i in r], np.int64)


def fit_weights(labels: list[int], own: list[list[int]], other: list[list[int] | None], size: int, penalty: float = COUNTERFACTUAL,
        steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept: logistic loss + RIDGE * |w|^2 + penalty * mean squared change of the logit over counterfactual pairs."""
    y, n = np.array(labels, float), len(labels)
    r, k = _flat(own)
    has = [i for i, o in enumerate(other) if o is not None]
    # A pair differs only in features that one side lacks.
    gone = [sorted(set(own[i]) - set(other[i])) for i in has]
    come = [sorted(set(other[i]) - set(own[i])) for i in has]
    (gr, gk), (cr, ck) = _flat(gone), _flat(come)
    w, b = np.zeros(size), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        logit = b + np.bincount(r, w[k], n)
        error = (1 / (1 + np.exp(-logit)) - y) / n
        g = np.bincount(k, error[r], size) + 2 * RIDGE * w
        if has:
            change = np.bincount(gr, w[gk], len(has)) - np.bincount(cr, w[ck], len(has))
            g += 2 * penalty / len(has) * (np.bincount(gk, change[gr], size) - np.bincount(ck, change[cr], size))
        gb = error.sum()
        rate = 0.1 * (1 - 0.9 * t / steps)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, float(b)


def fit(train: DataFrame, penalty: float = COUNTERFACTUAL) -> tuple[dict[str, float], float]:
    """Weights by feature and the intercept, from train (doc_id, text, toxic)."""
    train = train.filter("toxic IS NOT NULL").select("doc_id", "text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    n = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}  # needs ids alone, no texts
    toxic, total = n.get(1, 0), sum(n.values())
    names = screen(train, toxic, total - toxic)
    if not names:
        share = toxic / total if total else 0.0
        return {}, float("-inf") if share == 0 else float("inf") if share == 1 else float(np.log(share / (1 - share)))
    u = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(5)), F.lit(1_000_000)) / 1_000_000
    rows = train.filter(u < min(1.0, TRAIN_ROWS / total)).select("text", "toxic").mapInArrow(partial(_encode, names=names),
        "label int, own array<int>, other array<int>").toArrow()
    w, b = fit_weights(*(rows.column(c).to_pylist() for c in ("label", "own", "other")), len(names), penalty)
    return {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-6}, b


class _Found(dict):
    """Word to the numbers of its features that have a weight."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        self[word] = out = tuple(self.number[f] for f in features(word) if f in self.number)
        return out


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    weights, intercept = shared.value
    found, values = _Found({f: i for i, f in enumerate(weights)}), list(weights.values())
    for batch in batches:
        scores = []
        for text in batch.column(1):
            present = {i for x in map(found.__getitem__, words(text.as_py())) for i in x}
            scores.append(intercept + sum(values[i] for i in sorted(present)))
        with np.errstate(over="ignore"):
            s = 1 / (1 + np.exp(-np.array(scores, float)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"])


def classify(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text), learned from labels (doc_id, toxic)."""
    short_batches(docs.sparkSession)
    given = labels.select(F.col("doc_id").alias("__id"), "toxic").filter("__id IS NOT NULL")
    few = given.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    train = docs.select("doc_id", "text").join(F.broadcast(given) if few else given, F.col("doc_id") == F.col("__id"))
    model = fit(train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
        (F.lit(False) if held_out is None else held_out).alias("held_out"))
    return rows.mapInArrow(partial(_score, shared=docs.sparkSession.sparkContext.broadcast(model)),
        "doc_id long, held_out boolean, score double, predicted int")
