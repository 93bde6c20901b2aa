"""Secret scans: base spans against plain patterns, the network against numeric gradients and unseen findings."""

import hashlib
import random
import re

import numpy as np
import pytest

from quillstone.llm import queries, secrets

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_base(text):
    text, out = text or "", []
    for n, (pattern, group, least) in enumerate(((ASSIGN, 1, 8), (re.compile("AKIA[A-Z0-9]+"), 0, 16), (re.compile("[0-9a-f]+"), 0, 32))):
        out += [(m.start(), n, m.end(), secrets.BASE[n]) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


@pytest.fixture(scope="module")
def model():
    return secrets.Model(secrets.made_findings(random.Random(1), secrets.MADE))


def texts():
    rng = random.Random(5)
    bits = ["token", "TOKEN", "api_key", "apikey", "ſecret", "passwd", "toKen", ":", "=", " ", "'", '"', "abcdefgh", "abc", "AKIA", "A" * 12,
        "AKIAZ9", "0123456789abcdef" * 2, "deadbeef" * 3, "é", "😀", "\n", "hunter2hunter2", "."]
    out = [None, "", " ", "token = \"" + "ab01" * 10 + "\" x", "é" * 50 + " password:'longenough1'", "token: secret: abcdefgh1"]
    out += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    return out + ["a " * 100_000 + "secret=" + "Zq9_" * 30, "f" * 50_000, ("f" * 31 + "g") * 500]


def test_base_spans_match_plain_patterns(spark, model):
    given = texts()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(given)] + [(1, given[3], "clash")], "doc_id long, text string, findings string")
    scanned = secrets.scan(df, model)
    got = secrets.digests(scanned).collect()
    assert len(got) == len(given) + 1
    for r in got:
        text = given[3] if r.doc_id == 1 and r.n_assign else given[r.doc_id]
        want = plain_base(text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in secrets.BASE]
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("learned")] == want
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
    assert scanned.select("row.findings").distinct().collect() == [("clash",)]
    assert secrets.digests(secrets.scan(df.limit(0), model)).count() == 0


def test_candidates_match_a_plain_search():
    for text in texts():
        raw = (text or "").encode()
        data = np.frombuffer(raw, np.uint8)
        want = []
        for m in re.finditer(rb"[A-Za-z0-9+/_.=-]+", raw):
            if secrets.is_candidate(m[0]):
                a = m.start() + len(m[0]) - len(m[0].lstrip(b".-/_+"))
                want.append((a, a + len(m[0].strip(b".-/_+"))))
        assert secrets.candidates(data, np.array([len(raw)])) == want


def test_windows_cover_every_character_of_a_candidate():
    rng = random.Random(3)
    for n in [12, 47, 48, 49, 79, 80, 81, 500]:
        text = b"before it " + bytes(rng.choice(b"abcXYZ019") for _ in range(n)) + b" and behind"
        data = np.frombuffer(text, np.uint8)
        rows = secrets.windows(data, 0, len(text), 10, 10 + n)
        covered = set()
        for i, row in enumerate(rows):
            a = 10 + i * secrets.STEP
            own = row[secrets.BEFORE : secrets.BEFORE + secrets.WINDOW]
            k = int((own > 0).sum())
            assert np.array_equal(own[:k], secrets._CODE[data[a : a + k]])
            covered |= set(range(a, a + k))
        assert covered == set(range(10, 10 + n))
        first = rows[0][: secrets.BEFORE]
        assert (first[: secrets.BEFORE - 10] == 0).all() and np.array_equal(first[-10:], secrets._CODE[data[:10]])


def test_gradients_are_numeric_ones():
    found = secrets.made_findings(random.Random(3), 24)
    codes = np.concatenate([secrets.windows(np.frombuffer(t, np.uint8), 0, len(t), a, b)[:1] for t, a, b, _ in found])
    labels, rng = np.array([f[3] for f in found]), np.random.default_rng(0)
    p = secrets.train(codes, labels, epochs=2)

    def loss(q):
        z = secrets.forward(q, codes)[0]
        return np.mean(np.logaddexp(0, z) - labels * z)

    z, kept = secrets.forward(p, codes)
    g = secrets.backward(p, kept, (1 / (1 + np.exp(-z)) - labels) / len(labels))
    for name, x in p.items():
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in np.shape(x))
            up, down = {**p, name: np.array(x, float)}, {**p, name: np.array(x, float)}
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - np.asarray(g[name])[at]) < 1e-7, name


def test_calibration_and_thresholds(model):
    score, labels, lengths = model.held
    for i, t in enumerate(model.thresholds):
        own = secrets.band(lengths) == i
        yes, no = score[own & (labels == 1)], score[own & (labels == 0)]
        assert (yes >= t).mean() >= secrets.LEAST_RECALL
        errors = lambda x: (yes < x).sum() + (no >= x).sum()  # noqa: B023, E731
        assert errors(t) == min(errors(x) for x in yes if (yes >= x).mean() >= secrets.LEAST_RECALL)
    assert abs(score.mean() - labels.mean()) < 0.03
    assert secrets.thresholds(np.array([0.9, 0.8, 0.1]), np.array([1, 1, 0]), np.array([15, 15, 15])) == [0.8, 0.5, 0.5]


def test_unseen_findings_are_told_apart(model):
    found = secrets.made_findings(random.Random(77), 2000)
    score = model.score([secrets.windows(np.frombuffer(t, np.uint8), 0, len(t), a, b) for t, a, b, _ in found])
    ok, labels = model.accepts(score, np.array([b - a for _, a, b, _ in found])), np.array([f[3] for f in found])
    assert ok[labels == 1].mean() > 0.97 and ok[labels == 0].mean() < 0.02


def test_secrets_that_no_pattern_knows_are_found_and_redacted(spark, model):
    key = "ghp_" + "aZ3kQ9" * 6
    docs = spark.createDataFrame([(1, f"é login with {key} now. token = \"{'0a' * 20}\" end"), (2, "write to abc.17@mail8.example.com in v1.2.3-beta4"),
        (3, None)], "doc_id long, text string")
    scanned = secrets.scan(docs, model)
    got = {r.row.doc_id: r.findings for r in scanned.collect()}
    assert [(f.kind, f.start, f.end) for f in got[1]][:2] == [("learned", 13, 53), ("assign", 59, 108)] and got[2] == [] and got[3] == []
    assert {r.doc_id: r.text for r in secrets.redact(scanned).collect()} == {1: "é login with [learned] now. [assign]\" end",
        2: "write to abc.17@mail8.example.com in v1.2.3-beta4", 3: None}


def test_model_of_the_corpus_leaves_addresses_alone(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    fitted = secrets.fit(docs)
    assert secrets.fit(docs).thresholds == fitted.thresholds  # the same each time
    got = secrets.digests(secrets.scan(docs, fitted)).filter("spans LIKE '%learned%'")
    assert got.count() == 0 and secrets.fit(docs.limit(0)).thresholds


def test_every_candidate_of_the_corpus_counts(spark, monkeypatch):
    """More candidates than any sample would take are all trained on or held out, over several shards; copies are one."""
    rng = random.Random(9)
    key = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    texts = [f"token = {key(30)} and so" if i % 2 else f"see mail{i}.{key(8)}.example.com here" for i in range(1600)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:400])] + [(9999, None)], "doc_id long, text string")
    monkeypatch.setattr(secrets, "SHARD_WINDOWS", 300)
    monkeypatch.setattr(secrets, "ROUNDS", 2)
    monkeypatch.setattr(secrets, "EPOCHS", 4)
    corpus = secrets.Corpus(docs)
    plain = set()
    for t in texts:
        raw = t.encode()
        for a, b in secrets.candidates(np.frombuffer(raw, np.uint8), np.array([len(raw)])):
            plain.add((raw[max(0, a - secrets.BEFORE) : b + secrets.BEHIND], b - a))
    assert {(bytes(r.context), r.end - r.start) for r in corpus.found.collect()} == plain and len(plain) >= 1600
    held = corpus.held.count()
    assert held > 400 and held + corpus.windows.select("key").distinct().count() == len(plain) and corpus.shards >= 4
    model = secrets.Model(secrets.made_findings(random.Random(1), 300), 1, corpus)
    step, labels, _, weights = corpus.calibration(model.p)
    assert abs(weights[labels == 1].sum() - min(secrets.CORPUS_WEIGHT / 3, corpus.held.filter("label = 1").count())) < 1e-6
    again = secrets.Model(secrets.made_findings(random.Random(1), 300), 1, secrets.Corpus(docs))
    assert model.thresholds == again.thresholds and len(step)


def test_weights_count_as_repeats():
    score, labels, lengths = np.array([0.9, 0.8, 0.3, 0.7, 0.1]), np.array([1, 1, 1, 0, 0]), np.array([15] * 5)
    n = np.array([30, 5, 1, 4, 9])
    full = tuple(np.repeat(x, n) for x in (score, labels, lengths))
    assert secrets.thresholds(score, labels, lengths, weights=n.astype(float)) == secrets.thresholds(*full)
    assert np.allclose(secrets.platt(score, labels, n.astype(float)), secrets.platt(full[0], full[1]))
