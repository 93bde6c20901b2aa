"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability in each language. A word's probability in a language is the
sum over all its segmentations into pieces of the product of their probabilities, which a forward algorithm gives, and
a text's log probability is the sum over its words. Words are runs of letters, lower-cased, with a leading word mark.
Piece probabilities are learned by expectation maximisation with the same lattice (forward and backward).

Fitting reads a bounded sample: about SAMPLE_DOCS documents a language, chosen by a hash of the id, and
all of their words. Every language that occurs is learned; a model takes
some 0.3 MB for each of them. Scoring reads whole texts.

The score is the posterior probability (equal priors) that EVIDENCE_WORDS words of the text's mean evidence would give,
or all its words if they are fewer, so it does not saturate with length.

Cases: null, empty and letterless texts are `und` with score 0; ties go to the language that sorts first; unknown
characters have a small fixed probability, the same in each language; words of any length are scored in linear time;
repeated rows are scored alike; without any labelled row every text is `und`; an empty table gives an empty result;
identify() ignores other columns, keep_identified() carries them in a struct, so no name can clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillstone.llm.common import short_batches, whole

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE_DOCS = 300
EVIDENCE_WORDS, ROUNDS = 12, 4
#: Probability of a character outside the vocabulary; shares of the pooled and the uniform distribution in each language's.
UNKNOWN, POOLED, UNIFORM = 1e-7, 0.02, 0.002
MARK, LONGEST, VECTOR_LENGTH = "▁", 16, 32
#: Characters that are looked at together; probabilities that a worker remembers.
CHUNK_CHARS, CACHE_CELLS = 1_000_000, 1_000_000
_RUNS = re.compile(r"[^\W\d_]+")
_BASE, _SPREAD, _SLOT_BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 20


def words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    low = (text or "").lower()
    found = _RUNS.findall(low)
    if low.isascii():
        return found
    return [w for w in found if w.isalpha() or any(map(str.isalpha, w))]  # not numerals alone, such as superscripts


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces, lower-cased, of letters with or without a leading word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    return sorted(p for p in found if 0 < len(p) <= LONGEST and re.fullmatch(rf"{MARK}?[^\W\d_]*", p))


class Lattice:
    """Segmentations of words into pieces. Piece ids follow the given order; then come unknown (a single character) and none."""

    def __init__(self, pieces: list[str]):
        self.n, self.unknown, self.none = len(pieces), len(pieces), len(pieces) + 1
        self.lengths = sorted({len(p) for p in pieces} | {1})
        self.slot_hash, self.slot_id = np.zeros(2**_SLOT_BITS + 64, np.uint64), np.full(2**_SLOT_BITS + 64, self.none, np.int32)
        for i, p in enumerate(pieces):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in p:
                    h = h * _BASE + np.uint64(ord(c))
                s = int((h * _SPREAD) >> np.uint64(64 - _SLOT_BITS))
            while self.slot_hash[s]:
                s += 1
            self.slot_hash[s], self.slot_id[s] = h, i

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        slot = ((h * _SPREAD) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        at = self.slot_hash[slot]
        out = np.where(at == h, self.slot_id[slot], self.none).astype(np.int32)
        left = np.nonzero((at != h) & (at != 0))
        while len(left[0]):
            slot[left] += 1
            at = self.slot_hash[slot[left]]
            hit = at == h[left]
            out[tuple(x[hit] for x in left)] = self.slot_id[slot[left]][hit]
            left = tuple(x[~hit & (at != 0)] for x in left)
        return out

    def edges(self, chars: np.ndarray) -> dict[int, np.ndarray]:
        """Piece ids by length: ids[l][:, i] is the piece of length l that starts at character i, or none."""
        out, h, width = {}, np.zeros(chars.shape, np.uint64), chars.shape[1]
        for length in range(1, min(LONGEST, width) + 1):
            h = h[:, : width - length + 1] * _BASE + chars[:, length - 1 :]
            if length in self.lengths:
                out[length] = self._lookup(h)
        out[1] = np.where(out[1] == self.none, np.int32(self.unknown), out[1])
        return out

    def forward(self, ids: dict[int, np.ndarray], p: np.ndarray) -> np.ndarray:
        """alpha[:, j]: probability of the first j characters, over all segmentations, for each column of p."""
        n, width = ids[1].shape
        alpha = np.zeros((n, width + 1, p.shape[1]))
        alpha[:, 0] = 1
        for j in range(1, width + 1):
            for length, x in ids.items():
                if length <= j:
                    alpha[:, j] += alpha[:, j - length] * p[x[:, j - length]]
        return alpha

    def log_probabilities(self, found: list[str], p: np.ndarray) -> np.ndarray:
        """Log probability of each word in each column of p."""
        out = np.empty((len(found), p.shape[1]))
        order = sorted(range(len(found)), key=lambda i: len(found[i]))
        at = 0
        while at < len(order):
            length = len(found[order[at]])
            if length > VECTOR_LENGTH:
                for i in order[at:]:
                    out[i] = self._long(found[i], p)
                break
            chunk = max(1, 120_000 // (length + 2))
            part = order[at : at + chunk]
            part = [i for i in part if len(found[i]) <= min(VECTOR_LENGTH, max(length + 2, 8))]
            alpha = self.forward(self.edges(characters([found[i] for i in part])), p)
            out[part] = np.log(alpha[np.arange(len(part)), [len(found[i]) + 1 for i in part]])
            at += len(part)
        return out

    def _long(self, word: str, p: np.ndarray) -> np.ndarray:
        """As forward(), for one word of any length, rescaled at each step."""
        total, window = np.zeros(p.shape[1]), [np.ones(p.shape[1])]
        text = MARK + word
        for a in range(0, len(text), 4096):
            ids = self.edges(np.array([list(map(ord, text[max(0, a - LONGEST) : a + 4096]))], np.uint64))
            base = max(0, a - LONGEST)
            for j in range(a + 1, min(len(text), a + 4096) + 1):
                new = sum(window[-length] * p[x[0, j - length - base]] for length,
                    x in ids.items() if length <= len(window) and j - length >= base)
                scale = np.where(new > 0, new, 1)
                total += np.log(scale)
                window = [w / scale for w in window[-LONGEST + 1 :]] + [new / scale]
        return total


    def long_flows(self, word: str, p: np.ndarray) -> np.ndarray:
        """Expected piece counts of one word of any length, by forward and backward sums of logarithms; p has one column."""
        text = MARK + word
        n, out = len(text), np.zeros(self.n + 2)
        ids = {length: x[0] for length, x in self.edges(np.array([list(map(ord, text))], np.uint64)).items()}
        with np.errstate(divide="ignore"):
            steps = {length: np.log(p[x, 0]) for length, x in ids.items()}
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0
        for j in range(1, n + 1):
            alpha[j] = np.logaddexp.reduce([alpha[j - x] + s[j - x] for x, s in steps.items() if x <= j])
        for j in range(n - 1, -1, -1):
            beta[j] = np.logaddexp.reduce([s[j] + beta[j + x] for x, s in steps.items() if j + x <= n])
        for length, x in ids.items():
            flow = np.exp(alpha[: len(x)] + steps[length] + beta[length : length + len(x)] - alpha[n])
            out += np.bincount(x, flow, self.n + 2)
        return out


def characters(found: list[str]) -> np.ndarray:
    """Code points of words with their word mark, padded with 0."""
    width = max(map(len, found))
    out = np.zeros((len(found), width + 1), np.uint64)
    out[:, 0] = ord(MARK)
    out[:, 1:] = np.array(found, dtype=f"<U{width}").view(np.uint32).reshape(len(found), width)
    return out


def fit_language(lattice: Lattice, counts: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Expected piece counts of one language after some rounds of expectation maximisation."""
    p = np.full((lattice.n + 2, 1), 1 / lattice.n)
    p[lattice.unknown], p[lattice.none] = UNKNOWN, 0
    expected = np.zeros(lattice.n + 2)
    short = sorted((w for w in counts if len(w) <= VECTOR_LENGTH), key=len)
    chunks = [short[i : i + 4000] for i in range(0, len(short), 4000)]
    long = sorted(w for w in counts if len(w) > VECTOR_LENGTH)
    ready = [(lattice.edges(characters(c)), np.array([len(w) + 1 for w in c]), np.array([counts[w] for w in c], float)) for c in chunks]
    for _ in range(rounds):
        expected[:] = 0
        for ids, ends, freq in ready:
            alpha = lattice.forward(ids, p)[:, :, 0]
            beta = np.zeros_like(alpha)
            rows = np.arange(len(ends))
            beta[rows, ends] = 1
            for j in range(alpha.shape[1] - 1, -1, -1):
                for length, x in ids.items():
                    if j + length < alpha.shape[1]:
                        beta[:, j] += p[x[:, j], 0] * beta[:, j + length]
            weight = freq / np.maximum(alpha[rows, ends], 1e-300)
            for length, x in ids.items():
                flow = alpha[:, : x.shape[1]] * p[x, 0] * beta[:, length:] * weight[:, None]
                expected += np.bincount(x.ravel(), flow.ravel(), lattice.n + 2)
        for w in long:
            expected += counts[w] * lattice.long_flows(w, p)
        total = expected[: lattice.n].sum()
        p[: lattice.n, 0] = (expected[: lattice.n] + 1e-3) / (total + 1e-3 * lattice.n)
    return expected[: lattice.n]


def fit_model(pieces: list[str], counts: dict[str, dict[str, int]]) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the probability of each piece (rows) in each language (columns)."""
    lattice, languages = Lattice(pieces), sorted(counts)
    if not languages:
        return [], np.zeros((lattice.n + 2, 0))
    own = np.stack([fit_language(lattice, counts[x]) for x in languages], 1)
    own /= np.maximum(own.sum(0), 1e-9)
    p = np.empty((lattice.n + 2, len(languages)))
    p[: lattice.n] = (1 - POOLED - UNIFORM) * own + POOLED * own.mean(1, keepdims=True) + UNIFORM / lattice.n
    p[lattice.unknown], p[lattice.none] = UNKNOWN, 0
    return languages, p


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.setdefault(lang, Counter()).update(words(text))
        rows = [(x, w, n) for x, c in found.items() for w, n in c.items()]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())],
            ["lang", "word", "n"])


def sample_counts(train: DataFrame) -> dict[str, dict[str, int]]:
    """Word counts by language of the bounded sample of train (doc_id, text, lang)."""
    train = train.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, SAMPLE_DOCS / n))])
    u = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1_000_000
    some = train.filter(u < F.coalesce(share[F.col("lang")], F.lit(0.0))).select("lang", "text")
    counted = some.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    out: dict[str, dict[str, int]] = {x: {} for x in sizes}
    for r in counted.orderBy("lang", "word").toArrow().to_pylist():  # the words of the sampled rows
        out[r["lang"]][r["word"]] = r["n"]
    return {x: c for x, c in out.items() if c}


class _Index(dict):
    """Word to row number; new words are listed."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = out = len(self)
        self.new.append(word)
        return out


def _predict(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The first column of each batch, with lang_pred and score; the text is the second column, or else a field of the first."""
    pieces, languages, p = shared.value
    lattice, index, known = Lattice(pieces), _Index(), np.empty((0, p.shape[1]))
    for batch in batches:
        langs, scores, pending, size = [], [], [], 0

        def flush() -> None:
            nonlocal known, index, pending, size
            if index.new and languages:
                fresh = lattice.log_probabilities(index.new, p)
                if len(index) > len(known):
                    known = np.concatenate([known, np.empty((max(len(index) - len(known), len(known) // 2), p.shape[1]))])
                known[len(index) - len(index.new) : len(index)] = fresh
                index.new = []
            for ids in pending:
                if not len(ids) or not languages:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total = known[ids].sum(0)
                best = int(total.argmax())
                odds = (total - total[best]) * (min(len(ids), EVIDENCE_WORDS) / len(ids))
                langs.append(languages[best])
                scores.append(float(1 / np.exp(odds).sum()))
            pending, size = [], 0
            if len(index) * max(1, p.shape[1]) > CACHE_CELLS:
                index, known = _Index(), np.empty((0, p.shape[1]))

        for text in batch.column(1) if batch.num_columns > 1 else batch.column(0).field("text"):
            text = text.as_py()
            found = words(text)
            pending.append(np.fromiter(map(index.__getitem__, found), np.int64, len(found)))
            size += len(text or "")
            if size > CHUNK_CHARS:
                flush()
        flush()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
            ["row", "lang_pred", "score"])


def _model(spark: SparkSession, train: DataFrame, vocabulary: str):
    short_batches(spark)
    pieces = load_pieces(vocabulary)
    return spark.sparkContext.broadcast((pieces, *fit_model(pieces, sample_counts(train))))


def _predicted(rows: DataFrame, train: DataFrame, vocabulary: str) -> DataFrame:
    """rows (row, a struct; text, if it isn't in the struct) to row, lang_pred and score."""
    schema = StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(partial(_predict, shared=_model(rows.sparkSession, train, vocabulary)), schema)


def keep_identified(docs: DataFrame, train: DataFrame, least: float, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of docs whose language is identified with a score of least or more, with all their columns; lang is the identified one."""
    found = _predicted(docs.select(whole(docs).alias("row")), train,
        vocabulary).filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns])


def identify(docs: DataFrame, train: DataFrame, held_out: Column | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs (doc_id, text), learned from train (doc_id, text, lang)."""
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"))
    return _predicted(docs.select(row.alias("row"), "text"), train, vocabulary).select("row.doc_id", "row.held_out", "lang_pred", "score")
