"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of `PASSAGE_WORDS` words. Every passage of every whole text is
encoded: frequencies of pairs of character classes, and word statistics, go through a learned
tanh layer. Gated attention (tanh times sigmoid, softmax over the passages of a document) learns
from document labels alone which passages tell, and the attention-weighted representation is
scored. So a document with a junk passage among good ones can be told without passage labels.

The model is fitted with numpy on a bounded sample of whole labelled documents: of each label, by a
hash of doc_id, `sample_rows` of the rows that the caller gives as training rows, or as many as
reach half of `sample_passages` if that is fewer. So what the driver gets is bounded by the
passages and two documents, and no text is thinned. Rows of the same doc_id, label and text are
taken once. Scoring runs over all documents and all their passages, in batches of bounded size.

A null or blank text is a bag of one empty passage. Null labels are left out. Rows that repeat a
doc_id are scored each. Without labelled rows of both kinds the scores are 1 (0 if all known labels
are 0). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.llm.common import WORD, as_bytes, batch_of, hands_back, slices, store

PASSAGE_WORDS = 64
SAMPLE_ROWS = 2000
SAMPLE_PASSAGES = 1 << 18  # 185 MB of features
HIDDEN, GATE = 24, 16
EPOCHS, BATCH_DOCS, RATE = 30, 64, 0.01
CHUNK_BYTES = 2 << 20

#: Character classes: other punctuation, lower, upper, digit, space, and signs of their own; the
#: rest of the bytes (beyond ASCII) is a class as well.
_SIGNS = b".,!?|"
CLASSES = 8 + len(_SIGNS)


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for c in range(256):
        ch = chr(c)
        if c in _SIGNS:
            table[c] = 8 + _SIGNS.index(c)
        elif c > 127:
            table[c] = 1
        elif ch.islower():
            table[c] = 2
        elif ch.isupper():
            table[c] = 3
        elif ch.isdigit():
            table[c] = 4
        elif ch.isspace():
            table[c] = 5
        elif ch in "#*$%&<>":
            table[c] = 6
        elif ch in "'\"-:;()":
            table[c] = 7
    return table


_TABLE = _class_table()
WIDTH = CLASSES * CLASSES + 7


def encode(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Passage features of all texts, and the number of passages of each text."""
    passages, stats, counts = [], [], []
    for text in texts:
        words = text.split() if text else []
        counts.append(max(1, -(-len(words) // PASSAGE_WORDS)))
        for i in range(0, max(1, len(words)), PASSAGE_WORDS):
            own = words[i:i + PASSAGE_WORDS]
            n = max(1, len(own))
            lengths = list(map(len, own))
            mean = sum(lengths) / n
            low = [w.lower() for w in own]
            stats.append((len(own) / PASSAGE_WORDS, len(set(low)) / n, sum(map(bytes.__eq__, low, low[1:])) / n,
                          mean / 10, max(lengths, default=0) / 40, sum(map(bytes.isupper, own)) / n, sum(map(bytes.istitle, own)) / n))
            passages.append(b" ".join(own) + b"\n")
    data = np.frombuffer(b"".join(passages), np.uint8)
    sizes = np.fromiter(map(len, passages), np.int64, len(passages))
    classes = _TABLE[data]
    pair = classes[:-1] * CLASSES + classes[1:]
    owner = np.repeat(np.arange(len(passages)), sizes)
    inside = owner[:-1] == owner[1:]
    grid = np.bincount((owner[:-1] * (CLASSES * CLASSES) + pair)[inside], minlength=len(passages) * CLASSES * CLASSES)
    grid = np.sqrt(grid.reshape(len(passages), -1) / np.maximum(sizes, 1)[:, None])
    return np.hstack([grid, np.array(stats)]).astype(np.float32), np.array(counts, np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Passage encoder, gated attention and classifier."""

    def __init__(self, x: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 0.02

        def draw(a, b):
            return rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {"W": draw(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE),
                  "w": draw(GATE, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "d": np.zeros(1)}

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        p, starts = self.p, np.concatenate([[0], np.cumsum(counts)])[:-1]
        bag = np.repeat(np.arange(len(counts)), counts)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "bag": bag, "starts": starts,
                "score": _sigmoid(z @ p["c"] + p["d"])}

    def gradients(self, f: dict, y: np.ndarray, weight: np.ndarray) -> dict:
        p, bag = self.p, f["bag"]
        out = (f["score"] - y) * weight / weight.sum()
        g = {"c": f["z"].T @ out, "d": np.array([out.sum()])}
        dz = (out[:, None] * p["c"])[bag]
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["starts"])[bag])
        g["w"] = (f["t"] * f["s"]).T @ de
        dt = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2)
        ds = de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        g["V"], g["U"] = f["h"].T @ dt, f["h"].T @ ds
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        g["W"], g["b"] = f["x"].T @ dh, dh.sum(axis=0)
        return g

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 4) -> Model:
        """Adam on the log loss; both labels weigh the same, weights decay slightly."""
        rng = np.random.default_rng(seed)
        starts = np.concatenate([[0], np.cumsum(counts)])
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(q) for k, q in self.p.items()}
        step = 0
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs) + 1e-4
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH_DOCS):
                pick = order[i:i + BATCH_DOCS]
                rows = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in pick])
                g = self.gradients(self.forward(x[rows], counts[pick]), y[pick], weight[pick])
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
                    if self.p[k].ndim == 2:
                        self.p[k] *= 1 - 0.01 * rate
        return self

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        return self.forward(*encode(texts))["score"]


@hands_back
def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in slices(b, "text", CHUNK_BYTES):
            x, counts = encode(as_bytes(batch_of(part, "text")))
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [batch_of(part, "doc_id"), batch_of(part, "label"),
                 pa.array([x[e - n:e].tobytes() for e, n in zip(ends, counts)], pa.binary())],
                names=["doc_id", "label", "x"])


def _sample(docs: DataFrame, chosen: DataFrame, sample_rows: int, sample_passages: int) -> DataFrame:
    """(doc_id, label, text) of the sample's documents. Rows of the chosen doc_ids are put in order
    by short keys; only the texts of those taken are read."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("same"))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    keys = ["label", "turn", "doc_id", "same"]
    rows = (chosen.join(texts, "doc_id").groupBy(*keys)
            .agg(F.max(F.greatest(F.ceil(words / PASSAGE_WORDS), F.lit(1))).alias("passages")))
    taken = []
    for v in (0, 1):
        total = 0
        for row in rows.filter(F.col("label") == v).orderBy(*keys).limit(sample_rows).collect():
            if 2 * total >= sample_passages:
                break
            total += row["passages"]
            taken.append((row["label"], row["doc_id"], row["same"]))
    picked = docs.sparkSession.createDataFrame(taken, "label int, doc_id long, same long")
    return (texts.join(F.broadcast(picked), ["doc_id", "same"]).groupBy("doc_id", "label", "same")
            .agg(F.min("text").alias("text")).select("doc_id", "label", "text"))


def train(docs: DataFrame, labels: DataFrame, label: str, training: Column, sample_rows: int = SAMPLE_ROWS,
          sample_passages: int = SAMPLE_PASSAGES):
    """A Model fitted on at most `sample_rows` whole documents of each label, or the constant score
    that the known labels allow."""
    known = labels.filter(training & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col(label).cast("int").alias("label"), F.xxhash64(F.lit(11), "doc_id").alias("turn"))
    picked = [known.filter(F.col("label") == v).orderBy("turn", "doc_id").limit(sample_rows) for v in (0, 1)]
    chosen = store(picked[0].union(picked[1]).distinct(), "quality-sample")  # bounded: may be broadcast
    rows = (_sample(docs, chosen, sample_rows, sample_passages)
            .mapInArrow(_sample_batches, "doc_id long, label int, x binary").orderBy("doc_id", "x").toArrow())
    y = rows["label"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return 0.0 if len(y) and not y.any() else 1.0
    bags = [np.frombuffer(v, np.float32).reshape(-1, WIDTH) for v in rows["x"].to_pylist()]
    x = np.concatenate(bags)
    return Model(x).fit(x, np.array([len(b) for b in bags]), y)


@hands_back
def _score_batches(batches: Iterator[pa.RecordBatch], model, keep: float | None) -> Iterator[pa.RecordBatch]:
    model = model.value
    for b in batches:
        for part in slices(b, "text", CHUNK_BYTES):
            if isinstance(model, float):
                scores = np.full(part.num_rows, model)
            else:
                scores = model.score(as_bytes(batch_of(part, "text"))).astype(float)
            if keep is None:
                yield pa.RecordBatch.from_arrays([batch_of(part, "doc_id"), pa.array(scores)], names=["doc_id", "score"])
            else:
                yield part.filter(pa.array(scores >= keep))


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score) of every document."""
    run = partial(_score_batches, model=docs.sparkSession.sparkContext.broadcast(model), keep=None)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model, least: float) -> DataFrame:
    """The documents that score at least `least`, all columns."""
    run = partial(_score_batches, model=docs.sparkSession.sparkContext.broadcast(model), keep=least)
    return docs.mapInArrow(run, docs.schema)
