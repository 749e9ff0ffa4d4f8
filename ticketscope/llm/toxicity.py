"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

1. A bounded sample of labelled rows (`sample_rows` of each label, by a hash of doc_id; only rows
   that the caller gives as training rows) is joined with the texts.
2. The lexicon is a fixed seed list plus the words and stems that these rows show to be far more
   frequent in toxic documents (document counts, smoothed log odds).
3. Every whole text gets dense features: lexicon densities (words, stems, weighted, in the densest
   window), nearness of lexicon words to the second person, capitals, punctuation, and rates of
   obfuscated words (letters mixed with digits or signs, stretched letters), also looked up
   in the lexicon once cleaned.
4. Spark ML's GBTClassifier is fitted on three quarters of the sample, IsotonicRegression turns
   its margin into a probability on the last quarter (rows are first summed per rounded margin).
   If either part lacks a label, as with a handful of rows, both use the whole sample.

Null texts count as empty and get the score of the features of an empty text. Labels that are
null are left out. Rows that repeat a doc_id are scored each. Without labelled rows of both
kinds the scores are the share of toxic ones (0 without any). An empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketscope.llm.common import as_bytes, batch_of, store

SAMPLE_ROWS = 4000
LEXICON_SIZE = 2000
LEAST_DOCS = 5
STEM_CHARS = 5
NEAR_WORDS = 5
DENSE_WORDS = 25
TREES, DEPTH = 20, 4

#: Seed lexicon (fixed values).
SEEDS = ("asshole", "bastard", "bitch", "clown", "coward", "crap", "creep", "cretin", "damn", "disgusting", "dumb",
         "dumbass", "fool", "freak", "garbage", "hate", "idiot", "idiotic", "imbecile", "jerk", "kill", "liar", "loser",
         "lowlife", "moron", "moronic", "pathetic", "pig", "scum", "shit", "stupid", "trash", "ugly", "useless", "vermin",
         "worthless", "fuck", "fucking", "dreck", "dummkopf", "idiotisch", "abschaum", "connard", "salaud", "imbécile",
         "cabrón", "estúpido", "imbécil", "basura", "mierda")
#: Second person in English, German, French and Spanish (fixed values).
YOU = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "euch", "euer", "tu", "toi",
       "ton", "tes", "vous", "votre", "vos", "usted", "ustedes", "tú", "ti", "tus", "vosotros")

_PUNCT = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_MIXED = re.compile(rb"[a-z\x80-\xff]+[0-9@$*!._\-]+[a-z\x80-\xff]+[0-9@$*!._\-a-z\x80-\xff]*")
_LEET = bytes.maketrans(b"0134578@$!", b"oieastbasi")
_STRETCHED = re.compile(rb"([a-z])\1\1+")

FEATURES = ["lexicon", "lexicon_distinct", "stems", "weighted", "densest", "near_you", "you", "capitals", "shouts",
            "exclamations", "questions", "other_marks", "mixed", "mixed_hits", "stretched", "log_words"]


def tokens(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_PUNCT).split() if text else []


def features(text: bytes | None, lexicon: dict[bytes, float], stems: dict[bytes, float]) -> list[float]:
    text = text or b""
    words = tokens(text)
    n = max(1, len(words))
    distinct = set(words)
    known = distinct & lexicon.keys()
    by_stem = {w for w in distinct if w[:STEM_CHARS] in stems} - known
    you = distinct & _YOU
    places = weight = stem_places = near = densest = 0
    if known or by_stem:
        at = [i for i, w in enumerate(words) if w in known or w in by_stem]
        hits = np.array(at)
        weight = sum(lexicon.get(words[i], 0) or stems.get(words[i][:STEM_CHARS], 0) for i in at)
        stem_places = sum(words[i] in by_stem for i in at)
        places = len(at) - stem_places
        densest = int((np.searchsorted(hits, hits + DENSE_WORDS) - np.arange(len(hits))).max())
        if you:
            said = np.array([i for i, w in enumerate(words) if w in you])
            after = np.searchsorted(said, hits)
            gap = np.minimum(np.abs(said[np.minimum(after, len(said) - 1)] - hits), np.abs(said[np.maximum(after - 1, 0)] - hits))
            near = float((gap <= NEAR_WORDS).mean())
    low = text.lower()
    mixed = _MIXED.findall(low)
    cleaned = [re.sub(rb"[^a-z\x80-\xff]", b"", m.translate(_LEET)) for m in mixed]
    raw = text.split()
    m = max(1, len(raw))
    letters = max(1, len(text.translate(None, _NOT_UPPER)))
    marks = {c: text.count(c) for c in b"!?"}
    other = sum(map(text.count, b",.;:\"'()-"))
    return [places / n, float(len(known)), stem_places / n, weight / n, float(densest), near,
            sum(words.count(w) for w in you) / n, (letters - 1) / max(1, len(text)), sum(map(bytes.isupper, raw)) / m,
            marks[33] / m, marks[63] / m, other / m, len(mixed) / m,
            sum(w in lexicon or w[:STEM_CHARS] in stems for w in cleaned) / m,
            len(_STRETCHED.findall(low)) / m, float(np.log1p(len(words)))]


_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_YOU = frozenset(w.encode() for w in YOU)


def _feature_batches(batches: Iterator[pa.RecordBatch], words, names: list[str]) -> Iterator[pa.RecordBatch]:
    lexicon, stems = words.value
    for b in batches:
        rows = [features(t, lexicon, stems) for t in as_bytes(batch_of(b, "text"))]
        yield pa.RecordBatch.from_arrays([*(batch_of(b, c) for c in names), pa.array(rows, pa.list_(pa.float64()))],
                                         names=[*names, "features"])


def with_features(rows: DataFrame, words) -> DataFrame:
    """All columns but text, and the array `features`; `words` is a broadcast (lexicon, stems)."""
    names = [c for c in rows.columns if c != "text"]
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("features", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(partial(_feature_batches, words=words, names=names), schema)


def sample(labels: DataFrame, label: str, training: Column, rows: int) -> DataFrame:
    """(doc_id, label, part): up to `rows` labelled training rows of each label, by a hash of
    doc_id; part 0 of 4 is for calibration. Bounded by 2 * rows."""
    known = labels.filter(training & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col(label).cast("int").alias("label"), F.xxhash64(F.lit(7), "doc_id").alias("turn"))
    picked = [known.filter(F.col("label") == v).orderBy("turn", "doc_id").limit(rows) for v in (0, 1)]
    return picked[0].union(picked[1]).select("doc_id", "label", F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(4)).alias("part"))


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def out():
        rows = [(w, stem, seen[0][k], seen[1][k]) for k in seen[0].keys() | seen[1].keys() for w, stem in [k]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4,
                                          (pa.binary(), pa.bool_(), pa.int64(), pa.int64()))],
                                          names=["word", "stem", "clean", "toxic"])
    for b in batches:
        for text, label in zip(as_bytes(batch_of(b, "text")), batch_of(b, "label").to_pylist()):
            words = set(tokens(text))
            seen[label].update((w, False) for w in words)
            seen[label].update((s, True) for s in {w[:STEM_CHARS] for w in words if len(w) >= STEM_CHARS})
        if len(seen[0]) + len(seen[1]) > 500_000:
            yield out()
            seen = (Counter(), Counter())
    yield out()


def lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> tuple[dict[bytes, float], dict[bytes, float]]:
    """Words and stems with their log odds, from rows (text, label); at most `size` each."""
    counts = rows.select("text", "label").mapInArrow(_word_batches, "word binary, stem boolean, clean long, toxic long") \
        .groupBy("word", "stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    odds = F.log((F.col("toxic") + 0.5) / (F.lit(totals.get(1, 0)) + 1.0)) - F.log((F.col("clean") + 0.5) / (F.lit(totals.get(0, 0)) + 1.0))
    best = counts.filter(F.col("toxic") >= LEAST_DOCS).withColumn("odds", odds).filter(F.col("odds") > 2.5)
    found = {False: {w.encode(): 3.0 for w in SEEDS}, True: {}}
    for stem in (False, True):
        # a bounded list: `size` entries at most
        for r in best.filter(F.col("stem") == stem).orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "word").limit(size).collect():
            found[stem][bytes(r["word"])] = float(r["odds"])
    return found[False], found[True]


def score(docs: DataFrame, labels: DataFrame, label: str, training: Column, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, score): the calibrated probability of label 1 for every document."""
    spark = docs.sparkSession
    chosen = store(sample(labels, label, training, sample_rows), "toxic-sample")
    texts = store(chosen.join(docs.select("doc_id", "text"), "doc_id"), "toxic-texts")
    parts = {(r[0], r[1]) for r in texts.select("label", F.col("part") > 0).distinct().collect()}  # at most four
    if len({label for label, _ in parts}) < 2:
        return docs.select("doc_id", F.lit(float((1, True) in parts or (1, False) in parts)).alias("score"))
    fit, calibrate = ("part > 0", "part = 0") if len(parts) == 4 else ("true", "true")
    words = spark.sparkContext.broadcast(lexicon(texts.filter(fit)))
    train = store(with_features(texts, words), "toxic-features").withColumn("features", array_to_vector("features"))
    trees = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5, maxMemoryInMB=64).fit(
        train.filter(fit))
    margin = F.round(vector_to_array("rawPrediction")[1], 2)
    steps = (trees.transform(train.filter(calibrate)).groupBy(margin.alias("margin"))
             .agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight")))
    curve = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="score").fit(steps)
    rows = with_features(docs.select("doc_id", "text"), words).withColumn("features", array_to_vector("features"))
    scored = curve.transform(trees.transform(rows).withColumn("margin", margin))
    return scored.select("doc_id", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))
