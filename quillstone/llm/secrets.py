"""Secret scans: fixed patterns, and a character convolutional network over every candidate and its context.

Three patterns give the base findings: an assignment to a name of secrets (the whole match is the span), an access key
id and a long run of hex digits. Candidates are all runs of token characters that mix digits and letters, or many
capitals, wherever they stand. A network reads each candidate with what stands before and after it: one-hot characters,
a convolution, maxima over the context and maxima and means over the candidate, a hidden layer and a logit. A candidate
longer than a window is read in windows that overlap, and the largest logit counts, so no part goes unread. Candidates
whose calibrated probability reaches the threshold of their length are found, unless a base finding covers them.

Training takes labelled findings of two origins: tokens and look-alikes made by rule (FORMS, OTHERS) in made contexts, and
all different candidates of the whole corpus, labelled by whether a base pattern covers them, with the name in front hidden
in half of them, so that the network learns what a secret looks like rather than the patterns. However many the corpus has,
those of one label weigh CORPUS_WEIGHT findings together at most, so that those made by rule keep their say. Windows are
dealt to shards by their hash; in each of ROUNDS rounds every shard goes on from the same parameters over its windows and
those made by rule, and the mean of what the shards come to is where the next round begins. A third of all is kept for
calibration, by counts over all of it: Platt scaling, then for each range of lengths, of the thresholds that find at least
LEAST_RECALL of the secrets, the one with the fewest errors. Logits are floored to a grid, so these counts are a small table
and are exactly what the scan gives. Scanning reads every whole text.

Cases: null and empty texts have no finding; repeated rows are scanned each; equal starts are ordered by kind, as listed;
a text of any length is read whole; an empty table gives an empty result; without labelled candidates in the corpus those
made by rule remain. Rows are carried in a struct, so no name can clash.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import byte_blocks, byte_runs, materialize, release, short_batches, spread, whole

# Patterns, in bytes, with the least length of what counts in them.
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "learned")
#: Candidates: least length; capitals that stand in for digits, and the length it takes then.
LEAST, CAPITALS, LEAST_CAPITALS = 12, 4, 20
#: What the network reads: bytes before, of a window of the candidate (and the step of windows), and behind.
BEFORE, WINDOW, STEP, BEHIND = 24, 48, 32, 8
#: Sizes of the network: character codes, embedding, width and number of filters, hidden units.
CODES, EMBED, WIDTH, FILTERS, HIDDEN = 98, 10, 4, 24, 16
EPOCHS, BATCH, RATE, DECAY = 14, 64, 4e-3, 1e-4
MADE, CORPUS_WEIGHT = 1400, 600
#: Training over shards: rounds (of EPOCHS / ROUNDS epochs), windows of a shard up to MOST_SHARDS of them, beyond which shards grow.
ROUNDS, SHARD_WINDOWS, MOST_SHARDS = 7, 4000, 64
#: Steps of the grid of logits, and the largest one.
GRID, MOST_LOGIT = 64, 32
LENGTHS, LEAST_RECALL = (20, 36), 0.95
BLOCK_BYTES = 2_000_000
FINDINGS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"

_BYTE = np.arange(256)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_UPPER, _LOWER = (_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 97) & (_BYTE <= 122)
_TOKEN = _DIGIT | _UPPER | _LOWER | np.isin(_BYTE, list(b"+/_.=-"))
_HEX = _DIGIT | ((_BYTE >= 97) & (_BYTE <= 102))
#: Byte to code: 0 outside of the text, 1 any other byte (also beyond ASCII), 2 to 96 printable ones, 97 white space.
_CODE = np.where((_BYTE >= 33) & (_BYTE < 127), _BYTE - 31, np.where(np.isin(_BYTE, list(b" \t\n\x0b\x0c\r")), 97, 1)).astype(np.uint8)
_ENDS = b".-/_+"


# ---- labelled findings made by rule ----

_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_SYLLABLES = "ka lo mi ten ra so ver in da el tor an pi us re con mar al bi str ound ing ion ta le".split()


def _some(rng: random.Random, letters: str, low: int, high: int | None = None) -> str:
    return "".join(rng.choices(letters, k=rng.randint(low, high or low)))


def _word(rng: random.Random) -> str:
    return "".join(rng.choices(_SYLLABLES, k=rng.randint(2, 4)))


#: Shapes of secrets that providers document: a beginning, letters, and least and most length of the rest.
FORMS = (
    ("ghp_", _ALNUM, 36, 36), ("github_pat_", _ALNUM + "_", 50, 82), ("glpat-", _ALNUM + "_-", 20, 20), ("xoxb-", _ALNUM + "-", 40, 56),
    ("sk_live_", _ALNUM, 24, 34), ("sk-", _ALNUM, 40, 48), ("AIza", _ALNUM + "_-", 35, 35), ("AKIA", _ALNUM[:26] + "234567", 16, 16),
    ("npm_", _ALNUM, 36, 36), ("eyJ", _ALNUM + "_-.", 60, 150), ("", _ALNUM + "+/", 40, 40), ("", _ALNUM + "_-", 20, 44), ("", _ALNUM, 12, 24),
    ("", "0123456789abcdef", 24, 64), ("", _ALNUM[:26] + "0123456789", 20, 32),
)
_INTRO = ("Authorization: Bearer ", "pwd: ", "pass=", "export KEY=", "client_key = '", "credential: ", "auth=", "login with ", "key \"",
    "private: ", "x-auth: ", "use the key ", "", "")


def _other(rng: random.Random) -> str:
    """A look-alike: a run of token characters that is no secret."""
    n = lambda low, high: str(rng.randint(low, high))
    w = lambda: _word(rng)
    return rng.choice((
        lambda: f"mail{n(1, 99)}.{w()}.com", lambda: f"{w()}/{w()}/{w()}{n(1, 99)}.html", lambda: f"{n(1990, 2030)}-{n(10, 12)}-{n(10, 28)}T{n(10, 23)}",
        lambda: f"{w()}-{w()}-{n(1, 999)}", lambda: f"{w()}_{w()}_{n(1, 99)}", lambda: f"v{n(0, 9)}.{n(0, 99)}.{n(0, 99)}-beta{n(1, 9)}",
        lambda: w().capitalize() + w().capitalize() + w().capitalize() + n(1, 99), lambda: f"/usr/lib/{w()}{n(1, 9)}/{w()}.so",
        lambda: f"{n(10, 99)}.{n(1000, 9999)}/{w()}.{n(1000, 9999)}", lambda: f"www.{w()}{n(1, 9)}.org/{w()}", lambda: f"{w()}.{n(10, 99)}.{w()}",
        lambda: "-".join(_some(rng, "0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), lambda: f"ISBN-{n(100, 999)}-{n(10000, 99999)}-X",
        lambda: f"{w()}{w()}{w()}{n(1, 2030)}", lambda: f"{w()}...{w()}{n(1, 9)}", lambda: f"{n(1, 99)}th-{w()}-{w()}", lambda: "=" * rng.randint(12, 40) + "1a"))()


def made_findings(rng: random.Random, n: int) -> list[tuple[bytes, int, int, int]]:
    """Text, start and end of the candidate in it, and whether it is a secret (1 or 0)."""
    out = []
    while len(out) < n:
        label, before = len(out) % 2, " ".join(_word(rng) for _ in range(rng.randint(0, 4)))
        if label:
            begin, letters, low, high = rng.choice(FORMS)
            value, intro = begin + _some(rng, letters, low, high), rng.choice(_INTRO)
            if not begin and not intro and len(value) < 24:
                continue  # a short one without any sign is no one's finding
        else:
            value, intro = _other(rng), rng.choice(("see ", "in ", "at ", "file ", "id ", "from ", "@", "", "", "", "version: ", "name="))
        if not is_candidate(value.encode()):
            continue
        text = f"{before} {intro}".lstrip().encode()
        out.append((text + value.encode() + rng.choice((b" ", b". ", b"'\n", b'" ', b"", b", ")) + _word(rng).encode(), len(text),
            len(text) + len(value), label))
    return out


# ---- candidates ----

def is_candidate(run: bytes) -> bool:
    """Whether a run of token characters is one, without the marks at its ends."""
    run = run.strip(_ENDS)
    x = np.frombuffer(run, np.uint8)
    digits, letters = _DIGIT[x].sum(), (_UPPER | _LOWER)[x].sum()
    return len(run) >= LEAST and bool(letters) and (bool(digits) or (len(run) >= LEAST_CAPITALS and _UPPER[x].sum() >= CAPITALS))


def candidates(data: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Byte positions of every candidate in a block of texts."""
    start, stop = byte_runs(_TOKEN[data], ends)
    at = np.flatnonzero(stop - start >= LEAST)
    start, stop = start[at], stop[at]
    count = lambda kind: np.concatenate([[0], np.cumsum(kind[data], dtype=np.int32)])
    digits, upper = count(_DIGIT), count(_UPPER)
    at = np.flatnonzero((digits[stop] > digits[start]) | (upper[stop] - upper[start] >= CAPITALS))
    out = []
    for a, b in zip(start[at].tolist(), stop[at].tolist(), strict=True):
        run = data[a:b].tobytes()
        if is_candidate(run):
            a += len(run) - len(run.lstrip(_ENDS))
            out.append((a, a + len(run.strip(_ENDS))))
    return out


def windows(data: np.ndarray, low: int, high: int, start: int, end: int) -> list[np.ndarray]:
    """Codes of the candidate at start to end of the text at low to high: one row for each window of it, with the context."""
    out = []
    for a in range(start, max(start + 1, end - WINDOW + STEP), STEP):
        row = np.zeros(BEFORE + WINDOW + BEHIND, np.uint8)
        b = min(end, a + WINDOW)
        for to, x, y in ((BEFORE - min(BEFORE, a - low), max(low, a - BEFORE), a), (BEFORE, a, b), (BEFORE + WINDOW, b, min(high, b + BEHIND))):
            row[to : to + y - x] = _CODE[data[x:y]]
        out.append(row)
        if b == end:
            break
    return out


# ---- the network ----

def _shapes() -> dict[str, tuple]:
    return {"embed": (CODES, EMBED), "conv": (WIDTH * EMBED, FILTERS), "conv_b": (FILTERS,), "dense": (4 * FILTERS + 1, HIDDEN),
        "dense_b": (HIDDEN,), "out": (HIDDEN,), "out_b": ()}


@lru_cache(1)
def _regions() -> tuple[np.ndarray, ...]:
    """For each place of the convolution, whether it is part of what stands before, in or behind the candidate."""
    place = np.arange(BEFORE + WINDOW + BEHIND - WIDTH + 1)
    inside = (place >= BEFORE - 1) & (place < BEFORE + WINDOW)
    return place < BEFORE - 1, inside, place >= BEFORE + WINDOW - WIDTH + 1


def forward(p: dict, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of rows of codes, and what the gradient needs."""
    n, length = codes.shape
    x = p["embed"][codes] * (codes > 0)[..., None]
    columns = np.concatenate([x[:, k : length - WIDTH + 1 + k] for k in range(WIDTH)], axis=2)
    y = np.maximum(columns @ p["conv"] + p["conv_b"], 0)
    full = (codes[:, BEFORE : BEFORE + WINDOW] > 0).sum(1)
    before, inside, behind = _regions()
    own = np.arange(WINDOW + 1)[None, :] <= full[:, None]  # places that touch the candidate
    y_in = y[:, inside][:, : WINDOW + 1] * own[:, : inside.sum(), None]
    pools = [y[:, before].argmax(1), y_in.argmax(1), y[:, behind].argmax(1)]
    take = lambda z, at: np.take_along_axis(z, at[:, None, :], 1)[:, 0]
    mean = y_in.sum(1) / np.maximum(full, 1)[:, None]
    h = np.concatenate([take(y[:, before], pools[0]), take(y_in, pools[1]), take(y[:, behind], pools[2]), mean, (full / WINDOW)[:, None]], 1)
    z = np.maximum(h @ p["dense"] + p["dense_b"], 0)
    return z @ p["out"] + p["out_b"], (codes, columns, y, own, full, pools, h, z)


def backward(p: dict, kept: tuple, error: np.ndarray) -> dict:
    """Gradients of the parameters, from those of the logits."""
    codes, columns, y, own, full, pools, h, z = kept
    before, inside, behind = (np.flatnonzero(r) for r in _regions())
    g = {"out": z.T @ error, "out_b": error.sum()}
    dz = np.outer(error, p["out"]) * (z > 0)
    g["dense"], g["dense_b"] = h.T @ dz, dz.sum(0)
    dh = dz @ p["dense"].T
    dy, rows, cols = np.zeros_like(y), np.arange(len(y))[:, None], np.arange(FILTERS)[None, :]
    for i, region in enumerate((before, inside, behind)):
        np.add.at(dy, (rows, region[pools[i]], cols), dh[:, i * FILTERS : (i + 1) * FILTERS])
    mean = (dh[:, 3 * FILTERS : 4 * FILTERS] / np.maximum(full, 1)[:, None])[:, None, :]
    dy[:, inside] += mean * own[:, : len(inside), None]
    dy *= y > 0
    flat = dy.reshape(-1, FILTERS)
    g["conv"], g["conv_b"] = columns.reshape(len(flat), -1).T @ flat, flat.sum(0)
    dcol, dx = dy @ p["conv"].T, np.zeros((*codes.shape, EMBED))
    for k in range(WIDTH):
        dx[:, k : k + y.shape[1]] += dcol[..., k * EMBED : (k + 1) * EMBED]
    dx *= (codes > 0)[..., None]
    at = codes.ravel()
    g["embed"] = np.stack([np.bincount(at, dx[..., e].ravel(), CODES) for e in range(EMBED)], 1)
    return g


def start(rng: np.random.Generator) -> dict:
    """Parameters p with Adam's means m and v and its number of steps t."""
    p = {k: rng.normal(0, 0.3 if k == "embed" else (2 / max(s[0], 1)) ** 0.5, s) if len(s) > 1 or k == "out" else np.zeros(s)
        for k, s in ((k, s) for k, s in _shapes().items())}
    return {"p": p, "m": {k: np.zeros(x.shape) for k, x in p.items()}, "v": {k: np.zeros(x.shape) for k, x in p.items()}, "t": 0}


def advance(state: dict, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray, rng: np.random.Generator, some: range, epochs: int) -> dict:
    """The state after some of the epochs of Adam on the weighted logistic loss."""
    p, m, v, t = (dict(state["p"]), dict(state["m"]), dict(state["v"]), state["t"])
    for epoch in some:
        order = rng.permutation(len(codes))
        for a in range(0, len(codes), BATCH):
            at, t = order[a : a + BATCH], t + 1
            logit, kept = forward(p, codes[at])
            g = backward(p, kept, weights[at] * (1 / (1 + np.exp(-logit)) - labels[at]) / len(at))
            rate = RATE * (1 - epoch / epochs)
            for k in p:
                d = g[k] + DECAY * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return {"p": p, "m": m, "v": v, "t": t}


def train(codes: np.ndarray, labels: np.ndarray, seed: int = 1, epochs: int = EPOCHS) -> dict:
    """Parameters that are fitted by Adam to the logistic loss."""
    rng = np.random.default_rng(seed)
    return advance(start(rng), codes, labels, np.ones(len(codes)), rng, range(epochs), epochs)["p"]


def _packed(state: dict) -> bytes:
    return np.concatenate([np.ravel(state[x][k]) for x in "pmv" for k in _shapes()] + [[state["t"]]]).tobytes()


def _mean_state(packed: list[bytes]) -> dict:
    """The state whose numbers are the means of those of the packed ones."""
    x, at, out = np.mean([np.frombuffer(b) for b in packed], axis=0), 0, {}
    for part in "pmv":
        out[part] = {}
        for k, shape in _shapes().items():
            n = int(np.prod(shape))
            out[part][k] = x[at : at + n].reshape(shape)
            at += n
    return {**out, "t": round(float(x[at]))}


def logits(p: dict, found: list[list[np.ndarray]]) -> np.ndarray:
    """The largest logit over each candidate's windows, floored to the grid."""
    if not found:
        return np.zeros(0)
    rows, first = np.concatenate(found), np.cumsum([0, *map(len, found)])[:-1]
    each = np.concatenate([forward(p, rows[a : a + 256])[0] for a in range(0, len(rows), 256)])
    return np.clip(np.floor(np.maximum.reduceat(each, first) * GRID) / GRID, -MOST_LOGIT, MOST_LOGIT)


def platt(logit: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and intercept of the logistic function from logits to probabilities, by Newton steps on smoothed labels."""
    weights = np.ones(len(logit)) if weights is None else weights
    n1, n0 = (weights * labels).sum(), (weights * (1 - labels)).sum()
    want = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, b = np.stack([logit, np.ones(len(logit))], 1), np.array([1.0, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-x @ b))
        hessian = (x * (weights * q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2)
        b = b - np.linalg.solve(hessian, x.T @ (weights * (q - want)) + 1e-6 * (b - [1, 0]))
    return float(b[0]), float(b[1])


def band(length: np.ndarray) -> np.ndarray:
    """The range of lengths that a candidate belongs to."""
    return np.searchsorted(LENGTHS, length, side="right")


def thresholds(score: np.ndarray, labels: np.ndarray, lengths: np.ndarray, recall: float = LEAST_RECALL,
        weights: np.ndarray | None = None) -> list[float]:
    """For each range of lengths: of the thresholds that find at least this share of its secrets, the one with the fewest errors (the
    least of equals); one half where it has no secret. Errors and shares are by weight."""
    weights, out = np.ones(len(score)) if weights is None else weights, []
    for i in range(len(LENGTHS) + 1):
        yes, no = ((band(lengths) == i) & (labels == y) for y in (1, 0))
        if not yes.any():
            out.append(0.5)
            continue
        at = np.unique(score[yes])
        above = lambda own: np.append(np.cumsum(weights[own][np.argsort(score[own], kind="stable")][::-1])[::-1], 0)[
            np.searchsorted(np.sort(score[own]), at)]  # noqa: B023
        found, wrong, every = above(yes), above(no), weights[yes].sum()
        errors = np.where(found >= recall * every - 1e-9, np.round(every - found + wrong, 9), np.inf)
        out.append(float(at[np.argmin(errors)]))
    return out


class Model:
    """A trained network with its calibration; made on the driver, broadcast to tasks. corpus: what else it learns from, if anything."""

    def __init__(self, findings: list[tuple[bytes, int, int, int]], seed: int = 1, corpus: Corpus | None = None):
        rng = random.Random(seed)
        findings = rng.sample(findings, len(findings))
        rows = [windows(np.frombuffer(t, np.uint8), 0, len(t), a, b) for t, a, b, _ in findings]
        labels, lengths = np.array([f[3] for f in findings]), np.array([f[2] - f[1] for f in findings])
        held = np.arange(len(findings)) % 3 == 0
        fit = [i for i in range(len(findings)) if not held[i]]
        codes, own = np.concatenate([rows[i] for i in fit]).reshape(-1, BEFORE + WINDOW + BEHIND), np.concatenate(
            [np.full(len(rows[i]), labels[i]) for i in fit])
        self.p = corpus.train(codes, own, seed) if corpus else train(codes, own, seed)
        logit, weights = logits(self.p, [rows[i] for i in np.flatnonzero(held)]), np.ones(held.sum())
        labels, lengths = labels[held], lengths[held]
        if corpus:
            more = corpus.calibration(self.p)
            logit, labels, lengths, weights = (np.concatenate(x) for x in zip((logit, labels, lengths, weights), more, strict=True))
        self.slope, self.intercept = platt(logit, labels, weights)
        self.held, self.held_weights = (self._calibrated(logit), labels, lengths), weights
        self.thresholds = thresholds(*self.held, weights=weights)

    def _calibrated(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * logit + self.intercept)))

    def score(self, found: list[list[np.ndarray]]) -> np.ndarray:
        return self._calibrated(logits(self.p, found))

    def accepts(self, score: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return score >= np.array(self.thresholds)[band(lengths)]


# ---- scanning ----

def base_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """Byte spans of the two patterns that need a regular expression."""
    low, out = raw.lower(), []
    if any(n in low for n in NAMES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(raw) if len(m[1]) >= LEAST_ASSIGN]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(raw) if len(m[0]) >= LEAST_ACCESS]
    return out


def _read(data: np.ndarray, ends: np.ndarray) -> tuple[list[list[tuple[int, int, str]]], list[tuple[int, int, int]]]:
    """For each text of a block its base spans, and all candidates as (text, start, end); byte positions in the block."""
    starts = np.concatenate([[0], ends[:-1]])
    base = [[(a + x, a + y, kind) for x, y, kind in base_spans(data[a:b].tobytes())] for a, b in zip(starts.tolist(), ends.tolist(),
        strict=True)]
    a, b = byte_runs(_HEX[data], ends)
    at = np.flatnonzero(b - a >= LEAST_HEX)
    for x, y, i in zip(a[at].tolist(), b[at].tolist(), np.searchsorted(ends, a[at], side="right").tolist(), strict=True):
        base[i].append((x, y, "hex"))
    found = candidates(data, ends)
    of = np.searchsorted(ends, [f[0] for f in found], side="right").tolist() if found else []
    return base, [(i, *f) for i, f in zip(of, found, strict=True)]


def _covered(spans: list[tuple[int, int, str]], a: int, b: int) -> bool:
    return any(x < b and a < y for x, y, _ in spans)


def _scan(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    for batch in batches:
        out = []
        for _, data, ends in byte_blocks(batch.column(1), BLOCK_BYTES):
            base, found = _read(data, ends)
            low = np.concatenate([[0], ends[:-1]]).tolist()
            high = ends.tolist()
            score = model.score([windows(data, low[i], high[i], a, b) for i, a, b in found])
            good = model.accepts(score, np.array([b - a for _, a, b in found], np.int64))
            each = [[] for _ in base]
            for (i, a, b), s, ok in zip(found, score.tolist(), good.tolist(), strict=True):
                each[i].append((a, b, s, ok))
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
            for i, spans in enumerate(base):
                rows = [(a, KINDS.index(k), b, max((s for x, y, s, _ in each[i] if x < b and a < y), default=None)) for a, b, k in spans]
                rows += [(a, len(BASE), b, s) for a, b, s, ok in each[i] if ok and not _covered(spans, a, b)]
                zero = points[low[i]]
                out.append([{"kind": KINDS[k], "start": int(points[a] - zero), "end": int(points[b] - zero),
                    "score": s} for a, k, b, s in sorted(rows, key=lambda r: r[:3])])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["row", "findings"])


# ---- labelled findings of the corpus ----

def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corpus candidates with their context, labelled by the base patterns: bytes, start, end, label."""
    for batch in batches:
        out = []
        for _, data, ends in byte_blocks(batch.column(0), BLOCK_BYTES):
            base, found = _read(data, ends)
            for i, a, b in found:
                low = max(int(ends[i - 1]) if i else 0, a - BEFORE)
                high = min(int(ends[i]), b + BEHIND)
                out.append((data[low:high].tobytes(), a - low, b - low, int(_covered(base[i], a, b))))
        cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["context", "start", "end", "label"])


def _finding_windows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, list[np.ndarray]]]:
    """Key, label, length and windows of each finding; what stands in front is hidden in half of those that are secrets."""
    for r in batch.to_pylist():
        text, rng = r["context"], random.Random(r["key"])
        if r["label"] and rng.random() < 0.5:
            text = b" ".join(_word(rng).encode() for _ in range(6))[: r["start"]].ljust(r["start"]) + text[r["start"] :]
        yield r["key"], r["label"], r["end"] - r["start"], windows(np.frombuffer(text, np.uint8), 0, len(text), r["start"], r["end"])


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each window of a finding: key, at (its number), label, codes."""
    for batch in batches:
        out = [(key, i, label, w.tobytes()) for key, label, _, found in _finding_windows(batch) for i, w in enumerate(found)]
        cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(cols, ["key", "at", "label", "codes"])


def _logit_rows(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Logit (a place on the grid), label and range of lengths of each finding."""
    for batch in batches:
        found = list(_finding_windows(batch))
        step = np.round(logits(shared.value, [f[3] for f in found]) * GRID).astype(np.int64)
        cols = [step, np.array([f[1] for f in found], np.int64), band(np.array([f[2] for f in found], np.int64)).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["step", "label", "band"])


def _round(rows: pa.Table, shared) -> pa.Table:
    """The state that a shard comes to in one round, over its windows and those made by rule."""
    state, made, made_labels, weight, seed, some = shared.value
    rows = rows.sort_by([("key", "ascending"), ("at", "ascending")])
    shard, labels = rows.column("shard")[0].as_py(), rows.column("label").to_numpy()
    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(rows), -1)
    weights = np.array([weight[y] / max((labels == y).sum(), 1) for y in (0, 1)])[labels]
    new = advance(state, np.concatenate([made, codes]), np.concatenate([made_labels, labels]), np.concatenate([np.ones(len(made)), weights]),
        np.random.default_rng([seed, shard, some.start]), some, EPOCHS)
    return pa.table({"shard": pa.array([shard], pa.int64()), "state": pa.array([_packed(new)], pa.binary())})


def _rounds(shared):
    return lambda rows: _round(rows, shared)


class Corpus:
    """All different candidates of docs (text), written: a third of them for calibration, the windows of the others in shards."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        found = docs.select("text").mapInArrow(_labelled, "context binary, start long, end long, label long").distinct()
        self.found = materialize(found.withColumn("key", F.xxhash64("context", "start", "end", "label")))
        held = F.pmod("key", F.lit(3)) == 0
        self.held = self.found.filter(held)
        coded = materialize(self.found.filter(~held).mapInArrow(_coded, "key long, at long, label long, codes binary"))
        self.n = {r.label: r["count"] for r in coded.groupBy("label").count().collect()}
        self.shards = min(MOST_SHARDS, -(-sum(self.n.values()) // SHARD_WINDOWS))
        self.windows = coded.withColumn("shard", F.pmod(F.xxhash64("key", "at"), F.lit(max(self.shards, 1))))
        self._coded = coded

    def train(self, made: np.ndarray, labels: np.ndarray, seed: int) -> dict:
        """Parameters fitted to the windows made by rule and all of the corpus."""
        if not self.n:
            return train(made, labels, seed)
        weight = [min(self.n.get(y, 0), CORPUS_WEIGHT * 2 // 3) for y in (0, 1)]
        state = start(np.random.default_rng(seed))
        for i in range(ROUNDS):
            some = range(EPOCHS * i // ROUNDS, EPOCHS * (i + 1) // ROUNDS)
            shared = self.spark.sparkContext.broadcast((state, made, labels, weight, seed, some))
            each = self.windows.repartition(self.shards, "shard").groupBy("shard").applyInArrow(_rounds(shared), "shard long, state binary").collect()
            state = _mean_state([bytes(r.state) for r in sorted(each, key=lambda r: r.shard)])  # at most MOST_SHARDS rows
            shared.unpersist()
        return state["p"]

    def calibration(self, p: dict) -> tuple[np.ndarray, ...]:
        """Logits, labels, lengths (one of each range) and weights of all that was held out, equal ones as one row."""
        shared = self.spark.sparkContext.broadcast(p)
        rows = self.held.mapInArrow(partial(_logit_rows, shared=shared), "step long, label long, band long").groupBy("step", "label",
            "band").count().orderBy("step", "label", "band").collect()  # at most the grid's places, for each label and range
        step, label, at, n = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 4).T
        total = np.bincount(label, n, 2)
        weight = np.minimum(1, CORPUS_WEIGHT / 3 / np.maximum(total, 1))[label] * n
        return step / GRID, label, np.array([0, *LENGTHS])[at], weight

    def release(self) -> None:
        release(self.found, self._coded)


def fit(docs: DataFrame, seed: int = 1) -> Model:
    """A model of all candidates of docs (text), and of findings made by rule."""
    short_batches(docs.sparkSession)
    corpus = Corpus(docs)
    model = Model(made_findings(random.Random(seed), MADE), seed, corpus)
    corpus.release()
    return model


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns of docs (doc_id, text) as the struct row, and findings: kind, start, end (in characters) and score of each, by start."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    read = docs.select(whole(docs).alias("row"), "text")
    return read.mapInArrow(partial(_scan, shared=shared), T.StructType([read.schema["row"], *T.StructType.fromDDL(f"findings {FINDINGS}")]))


def redact(scanned: DataFrame) -> DataFrame:
    """The rows that scan() read, with each finding in text replaced by its kind in brackets."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    piece = lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int"))

    def step(s: Column, f: Column) -> Column:
        new = F.concat(s["out"], piece(s["at"], f["start"]), F.lit("["), f["kind"], F.lit("]"))
        return F.struct(F.greatest(s["at"], f["end"]).alias("at"), F.when(f["start"] >= s["at"], new).otherwise(s["out"]).alias("out"))

    done = F.aggregate("findings", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step)
    out = F.when(F.size("findings") > 0, F.concat(done["out"], piece(done["at"], F.length(text).cast("long")))).otherwise(F.col("row.text"))
    return spread(scanned.select(F.col("row").withField("text", out).alias("row")))


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans."""
    written = lambda kinds: F.array_join(F.transform(F.filter("findings", lambda f: f["kind"].isin(*kinds)),
        lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    n = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("row.doc_id", *map(n, BASE), F.sha2(written(BASE), 256).alias("base_sha256"), written(KINDS).alias("spans"))
