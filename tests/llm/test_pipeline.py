"""The pipeline's stages: each one's output from the output of the one before, against plain Python; odd rows and names."""

import math
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillstone.llm import decontam, langid, mixing, sharding
from quillstone.llm.common import materialize
from tests.llm.test_corpus import brute_components, plain_kd_tree, poisson_count

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside.
CLASHING = ("row", "id", "copy", "place", "rate", "n", "u", "of", "node", "key", "what", "size", "shard", "lang_pred", "score", "__id",
    "__lang", "__rate", "__source", "__copy", "__order", "__u", "__n")


@pytest.fixture(scope="module")
def documents(spark):
    """Short documents of the smallest table, with copies, repeated rows, null ids and texts, and one very long text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = docs.filter("length(text) < 1500")
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").filter("text IS NOT NULL").limit(3).select((F.col("item_id") + 9000).alias("doc_id"), F.concat(F.lit("the and of it is said that "), "text").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    few = own.limit(12)
    odd = spark.createDataFrame([(-1, "12 34", None, None, 5), (-2, None, None, None, None),
        (None, "the cat and the dog are in the house of the man", "en", "web", 1),
        (-3, "the house and the garden of it " * 40_000, None, "web", 1)], docs.schema)
    more = few.withColumn("doc_id", F.col("doc_id") + 5000)
    return materialize(own.unionByName(few).unionByName(more).unionByName(leak).unionByName(odd))


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_every_stage_matches_plain_python(spark, documents, monkeypatch):
    stages, docs = dict(corpus_pipeline.STAGES), documents
    assert list(stages) == ["language ID", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights",
        "sharding"]

    def run(name):
        nonlocal docs
        before, docs = rows_of(docs), materialize(stages[name](spark, docs, SF))
        return before, rows_of(docs) if name != "sharding" else docs.collect()

    before, after = run("language ID")
    pieces = langid.load_pieces()
    learned = documents.filter(corpus_pipeline.fold(F.col("doc_id"), 5) != 0)
    languages, p = langid.fit_model(pieces, langid.sample_counts(learned))
    lattice, known, want = langid.Lattice(pieces), {}, []
    for d, t, _, s, n in before:
        own = Counter(langid.words(t))
        new = [w for w in own if w not in known]
        known.update(zip(new, lattice.log_probabilities(new, p) if new else [], strict=True))
        total = [sum(n * float(known[w][c]) for w, n in own.items()) for c in range(len(languages))]
        if own:
            best, m = max(range(len(languages)), key=lambda c: total[c]), sum(own.values())
            if 1 / sum(math.exp((x - total[best]) * min(m, langid.EVIDENCE_WORDS) / m) for x in total) >= corpus_pipeline.LEAST_SCORE:
                want.append((d, t, languages[best], s, n))
    assert Counter(after) == Counter(want) and len(after) < len(before)

    before, after = run("MinHash near-dedup")
    component = brute_components([(d, t) for d, t, *_ in before], 5, 80)
    kept = Counter(d for d in {r[0] for r in before} if d is not None and component[d] == d) + Counter([None] * sum(r[0] is None for r in before))
    assert Counter(r[0] for r in after) == kept and set(after) <= set(before) and len(after) < len(before)

    before, after = run("benchmark decontamination")
    items = [decontam.normalise((r.text or "").encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = lambda t: any(i and decontam.myers(i, t)[0] <= decontam.budget(len(i)) for i in items)
    clean = {t: not found(decontam.normalise((t or "").encode())) for t in {r[1] for r in before} if len(t) < 100_000}
    assert Counter(after) == Counter(r for r in before if clean.get(r[1], True)) and len(after) < len(before)

    before, after = run("mixing sources to target weights")
    n = Counter(r[3] for r in before)
    weights = {s: x**mixing.TEMPERATURE for s, x in n.items()}
    rate = {s: round(w * len(before) / (sum(weights.values()) * n[s]), 9) for s, w in weights.items()}
    want = Counter()
    for r in before:
        want[r] += poisson_count(rate[r[3]], r[0])
    assert Counter(after) == +want

    monkeypatch.setattr(sharding, "SLACK", 0.0)
    monkeypatch.setattr(sharding, "GROUP_SLACK", 1e9)
    before, after = run("sharding")
    shards = plain_kd_tree([(d, t, lang, s, n) for d, t, lang, s, n in before], corpus_pipeline.SHARDS)
    assert Counter((r.doc_id, r.lang, r.source, r.size, r.shard) for r in after) == Counter((d, lang, s, len((t or "").encode()) + 1,
        shards[t or ""]) for d, t, lang, s, _ in before)
    for s in range(corpus_pipeline.SHARDS):
        assert sorted(r.slot for r in after if r.shard == s) == list(range(sum(r.shard == s for r in after)))


def test_stages_take_empty_tables_and_clashing_columns(spark, documents):
    clashing = documents.filter("doc_id >= 0 AND doc_id < 40 OR doc_id IS NULL").select("*",
        *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    for docs in (clashing, clashing.limit(0), documents.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, docs, SF))
            if name != "sharding":
                assert out.columns == docs.columns, name
                assert all(r[c] == i for r in out.collect() for i, c in enumerate(CLASHING) if c in docs.columns)
            docs = out if name != "sharding" else docs
        assert out.count() == docs.count()


def test_run_joins_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.filter("shard IS NULL OR slot IS NULL").count() == 0 and out.count() > 100
