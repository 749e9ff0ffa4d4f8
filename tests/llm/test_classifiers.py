"""Toxicity and quality: held-out accuracy, edge cases, the parts of both models."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketscope.llm import quality_model, queries, toxicity

SF01 = "/root/testdata/sf0.01"


def scored(spark, query, label, parts, held, sf=SF01):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col(label).alias("label"))
    rows = query(spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    got = rows.collect()
    assert len(got) == n
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held)
        assert 0 <= r.score <= 1
    return {r.doc_id: r for r in got}, {r.doc_id: r.label for r in labels.collect()}


def rank_quality(scores, labels):
    """Share of pairs (label 1, label 0) that the scores order right; ties count half."""
    pos, neg = scores[labels == 1], scores[labels == 0]
    return np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])


def test_quality_on_held_out_documents(spark):
    rows, labels = scored(spark, queries.op10_quality_model, "quality", 4, 2)
    held = [d for d in labels if rows[d].held_out]
    s, y = np.array([rows[d].score for d in held]), np.array([labels[d] for d in held])
    assert rank_quality(s, y) > 0.95
    assert np.mean([rows[d].predicted == labels[d] for d in held]) > 0.93
    assert all(r.predicted == (r.score >= 0.7) for r in rows.values())


def test_toxicity_on_held_out_documents(spark):
    rows, labels = scored(spark, queries.op5_toxicity, "toxic", 5, 0, "/root/testdata/sf0.1")
    held = [d for d in labels if rows[d].held_out]
    s, y = np.array([rows[d].score for d in held]), np.array([labels[d] for d in held])
    assert rank_quality(s, y) > 0.95
    assert np.mean([rows[d].predicted == labels[d] for d in held]) > 0.97
    assert all(r.predicted == (r.score >= 0.5) for r in rows.values())


@pytest.fixture(scope="module")
def small(spark):
    """Clean and toxic documents of invented words, with labels; also a null label and a null id."""
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(200):
        text = list(rng.choice(words, 40))
        if i % 3 == 0:
            for j in rng.integers(0, 40, 3):
                text[j] = ["zorgle", "blaxxid", "quibnat"][j % 3]
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(i % 3 == 0), int(i % 3 != 0)))
    rows += [(900, None, "x"), (901, "", "x"), (None, "zorgle you blaxxid", "x"), (3, rows[3][1], "x"), (902, "zorgle " * 20000, "x")]
    labels += [(900, None, None), (901, 0, None), (None, 1, 1)]
    return (spark.createDataFrame(rows, "doc_id long, text string, score string"),
            spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))


def test_toxicity_learns_words_and_handles_odd_rows(spark, small):
    docs, labels = small
    got = toxicity.score(docs, labels, "toxic", F.col("doc_id") % 5 != 0).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert all((by[i] >= 0.5) == (i % 3 == 0) for i in range(200))
    assert by[900] < 0.5 and by[901] < 0.5
    assert toxicity.score(docs.limit(0), labels, "toxic", F.lit(True)).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.limit(0), "toxic", F.lit(True)).collect()} == {0.0}


def test_toxicity_of_a_handful_of_rows(spark):
    docs = spark.createDataFrame([(1, "nice words here"), (2, "you stupid idiot"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels, "toxic", F.lit(True)).collect()}
    assert set(got) == {1, 2, 3} and all(0 <= s <= 1 for s in got.values())
    only = toxicity.score(docs, labels.filter("toxic = 1"), "toxic", F.lit(True)).collect()
    assert {r.score for r in only} == {1.0}


def test_toxicity_features():
    lexicon, stems = {b"idiot": 3.0}, {b"lowei": 4.0}
    f = dict(zip(toxicity.FEATURES, toxicity.features(b"You IDIOT! an id10t and loweiart sooooo", lexicon, stems)))
    assert f["lexicon"] == pytest.approx(1 / 7) and f["stems"] == pytest.approx(1 / 7)
    assert f["near_you"] == 1.0 or f["near_you"] == 0.5
    assert f["mixed"] == pytest.approx(1 / 7) and f["mixed_hits"] == pytest.approx(1 / 7)
    assert f["stretched"] > 0 and f["exclamations"] > 0 and f["shouts"] > 0
    assert toxicity.features(None, lexicon, stems) == toxicity.features(b"", lexicon, stems)
    assert len(toxicity.features(b"", lexicon, stems)) == len(toxicity.FEATURES)


def test_capitals_are_counted():
    i = toxicity.FEATURES.index("capitals")
    assert toxicity.features(b"ABCDE abcde", {}, {})[i] > toxicity.features(b"Abcde abcde", {}, {})[i] >= 0


def test_quality_handles_odd_rows(spark, small, odd, none):
    docs, labels = small
    model = quality_model.train(docs, labels, "quality", F.col("doc_id") % 4 != 2, sample_rows=50)
    for df in (docs, odd):
        got = quality_model.score(df, model).collect()
        assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
        kept = quality_model.keep_good(df, model, 0.5)
        assert kept.columns == df.columns and kept.count() == sum(r.score >= 0.5 for r in got)
    assert quality_model.score(none, model).count() == 0
    nothing = quality_model.train(docs, labels.limit(0), "quality", F.lit(True))
    assert nothing == 1.0 and {r.score for r in quality_model.score(docs, nothing).collect()} == {1.0}
    assert quality_model.train(docs, labels.withColumn("quality", F.lit(0)), "quality", F.lit(True)) == 0.0


def test_gradients():
    """Against differences of the loss."""
    rng = np.random.default_rng(1)
    x, counts, y = rng.normal(size=(9, 5)), np.array([2, 1, 4, 2]), np.array([1.0, 0, 1, 0])
    weight = np.array([1.0, 2, 1, 3])
    model = quality_model.Model(x)

    def loss():
        s = model.forward(x, counts)["score"]
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / weight.sum()
    g = model.gradients(model.forward(x, counts), y, weight)
    for name, p in model.p.items():
        flat, own = p.reshape(-1), g[name].reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            keep = flat[i]
            flat[i] = keep + 1e-6
            up = loss()
            flat[i] = keep - 1e-6
            down = loss()
            flat[i] = keep
            assert own[i] == pytest.approx((up - down) / 2e-6, abs=1e-6), name


def test_attention_finds_the_passage_that_tells():
    rng = np.random.default_rng(2)
    words = [b"word%d" % i for i in range(200)]

    def text(junk):
        passages = [b" ".join(rng.choice(words, 64)) for _ in range(5)]
        if junk:
            passages[3] = b" ".join([b"### !!!"] * 32)
        return b" ".join(passages)
    texts = [text(i % 2) for i in range(120)]
    x, counts = quality_model.encode(texts)
    y = np.array([1.0 - i % 2 for i in range(120)])
    model = quality_model.Model(x).fit(x, counts, y)
    assert ((model.score(texts) >= 0.5) == (y == 1)).all()
    a = model.forward(*quality_model.encode([text(1)]))["a"]
    assert a.argmax() == 3 and a[3] > 2 / 5


def test_encoding_does_not_depend_on_neighbours():
    texts = [b"one two three", None, b"", b" ".join([b"x"] * 1000), b"last"]
    x, counts = quality_model.encode(texts)
    assert counts.tolist() == [1, 1, 1, 16, 1]
    alone = np.concatenate([quality_model.encode([t])[0] for t in texts])
    assert np.array_equal(x, alone)


def bags_fitted(spark, monkeypatch, docs, labels, **options):
    """The passages of each document that the quality model is fitted on, by label."""
    seen = {}

    def fit(self, x, counts, y, **_):
        assert len(x) == counts.sum()
        seen.update({v: sorted(counts[y == v].tolist()) for v in (0, 1)})
        return self
    monkeypatch.setattr(quality_model.Model, "fit", fit)
    quality_model.train(spark.createDataFrame(docs, "doc_id long, text string"),
                        spark.createDataFrame(labels, "doc_id long, quality int"), "quality", F.lit(True), **options)
    return seen


def test_training_documents_are_whole(spark, monkeypatch):
    docs = [(1, "w " * (64 * 1000)), (2, "w " * (64 * 200 + 1)), (3, None), (4, "x")]
    labels = [(1, 0), (2, 1), (3, 0), (4, 1)]
    assert bags_fitted(spark, monkeypatch, docs, labels) == {0: [1, 1000], 1: [1, 201]}
    few = bags_fitted(spark, monkeypatch, [(i, "w " * 640) for i in range(40)], [(i, i % 2) for i in range(40)], sample_passages=100)
    assert few == {0: [10] * 5, 1: [10] * 5}


def test_training_sample_holds_few_rows_of_a_hot_id(spark, monkeypatch):
    docs = [(1, f"text {i % 90}") for i in range(180)] + [(2, "y")]
    got = bags_fitted(spark, monkeypatch, docs, [(1, 0), (1, 0), (2, 1), (2, 1)], sample_rows=7)
    assert got == {0: [1] * 7, 1: [1]}
