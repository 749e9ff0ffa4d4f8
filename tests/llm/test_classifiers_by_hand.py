"""Both classifiers against plain Python: features a word at a time, trees walked node by node, isotonic
pooling, passages a byte at a time, attention a passage at a time. Only the fitted numbers are shared."""

import math
import re
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketscope.llm import quality_model, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark, odd):
    """The documents of the smallest tables, and odd rows with texts that use every feature."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [(-1, "You IDIOT! an id10t, you stup1d m0r0n?? SOOO baaad"), (-2, "idiot " * 3000 + "you " * 40), (-3, "ÄÖ Straße! #*$ <b> | É"),
            (-4, "\x1c\x00 a\x1db \x7f"), (-5, "!"), (-1, "You IDIOT! an id10t, you stup1d m0r0n?? SOOO baaad")]
    return docs.unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(more, "doc_id long, text string"))


def key(row):
    return row[0] is None, row[0] or 0, row[1]


def plain_features(text, lexicon, stems):
    text = text or ""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w.encode() for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", low)]
    you = [i for i, w in enumerate(words) if w.decode() in toxicity.YOU]
    exact = [i for i, w in enumerate(words) if w in lexicon]
    by_stem = [i for i, w in enumerate(words) if w not in lexicon and w[:5] in stems]
    hits = sorted(exact + by_stem)
    n, size = max(1, len(words)), max(1, len(text.encode()))
    weight = sum(lexicon.get(words[i], 0) or stems.get(words[i][:5], 0) for i in hits)
    here = set(hits)
    densest = max((sum(j in here for j in range(i, i + toxicity.DENSE_WORDS)) for i in hits), default=0)
    said = set(you)
    near = sum(any(j in said for j in range(i - toxicity.NEAR_WORDS, i + toxicity.NEAR_WORDS + 1)) for i in hits)
    raw = [w for w in re.split(r"[ \t\n\r\x0b\x0c]+", text) if w]
    m = max(1, len(raw))
    shouts = sum(bool(re.search("[A-Z]", w)) and not re.search("[a-z]", w) for w in raw)
    upper = len(re.findall("[A-Z]", text))
    mixed = re.findall(r"[a-z\x80-\U0010ffff]+[0-9@$*!._\-]+[a-z\x80-\U0010ffff]+[0-9@$*!._\-a-z\x80-\U0010ffff]*", low)
    signs = dict(zip("0134578@$!", "oieastbasi"))
    cleaned = [re.sub(r"[^a-z\x80-\U0010ffff]", "", "".join(signs.get(c, c) for c in w)).encode() for w in mixed]
    return [len(exact) / n, len({words[i] for i in exact}), len(by_stem) / n, weight / n, densest, near / max(1, len(hits)),
            len(you) / n, max(0, upper - 1) / size, shouts / m, text.count("!") / m, text.count("?") / m,
            sum(text.count(c) for c in ",.;:\"'()-") / m, len(mixed) / m,
            sum(w in lexicon or w[:5] in stems for w in cleaned) / m, len(re.findall(r"([a-z])\1\1+", low)) / m, math.log1p(len(words))]


def walk(tree, x):
    """The prediction of a tree, from the text that describes its nodes."""
    taken = 0  # depth up to which the conditions hold
    for line in tree.toDebugString.splitlines()[1:]:
        depth = (len(line) - len(line.lstrip())) - 2
        if depth > taken:
            continue
        got = re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if got:
            at, sign, limit = int(got[1]), got[2], float(got[3])
            if (x[at] <= limit) == (sign == "<="):
                taken = depth + 1
        else:
            return float(line.split("Predict: ")[1])
    raise AssertionError("no leaf")


def pooled(points):
    """Isotonic regression by pooling neighbours out of order: (place, value) of each point."""
    blocks = []
    for x, y, w in sorted(points):
        blocks.append([w, y, [x]])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, y2, x2 = blocks.pop()
            w1, y1, x1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * y1 + w2 * y2) / (w1 + w2), x1 + x2])
    return [(x, y) for _, y, xs in blocks for x in xs]


def test_toxicity_by_hand(spark, texts, monkeypatch):
    seen = {}

    def spy(name, real):
        class Estimator:
            def __init__(self, **options):
                self.own = real(**options)

            def fit(self, df):
                seen[name] = self.own.fit(df)
                seen[name + "-rows"] = df.collect()
                return seen[name]
        return Estimator
    find = toxicity.lexicon
    monkeypatch.setattr(toxicity, "GBTClassifier", spy("trees", toxicity.GBTClassifier))
    monkeypatch.setattr(toxicity, "IsotonicRegression", spy("curve", toxicity.IsotonicRegression))
    monkeypatch.setattr(toxicity, "lexicon", lambda rows: seen.setdefault("words", find(rows)))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.score(texts, labels, "toxic", F.lit(True)).collect()
    words, trees = seen["words"], list(zip(seen["trees"].treeWeights, seen["trees"].trees))
    curve = pooled([(r.margin, r.label, r.weight) for r in seen["curve-rows"]])

    def plain(text):
        x = plain_features(text, *words)
        margin = sum(w * walk(t, x) for w, t in trees)
        margin = float(Decimal(repr(margin)).quantize(Decimal("0.01"), ROUND_HALF_UP))
        return float(np.clip(np.interp(margin, *zip(*curve)), 0, 1))
    rows = texts.collect()
    for r in rows:
        assert toxicity.features(None if r.text is None else r.text.encode(), *words) == pytest.approx(plain_features(r.text, *words))
    want = sorted(((r.doc_id, plain(r.text)) for r in rows), key=key)
    have = sorted(((r.doc_id, r.score) for r in got), key=key)
    assert [d for d, _ in have] == [d for d, _ in want]
    assert [s for _, s in have] == pytest.approx([s for _, s in want], abs=1e-9)
    assert len({round(s, 6) for _, s in want}) > 1


def kind(c):
    ch = chr(c)
    if ch in ".,!?|":
        return 8 + ".,!?|".index(ch)
    if c > 127:
        return 1
    for code, signs in ((2, "abcdefghijklmnopqrstuvwxyz"), (3, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (4, "0123456789"),
                        (5, " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"), (6, "#*$%&<>"), (7, "'\"-:;()")):
        if ch in signs:
            return code
    return 0


def plain_passages(text):
    words = [w for w in re.split(rb"[ \t\n\r\x0b\x0c]+", (text or "").encode()) if w]
    out = []
    for i in range(0, max(1, len(words)), 64):
        own = words[i:i + 64]
        data = b" ".join(own) + b"\n"
        grid = [0.0] * 169
        for a, b in zip(data, data[1:]):
            grid[kind(a) * 13 + kind(b)] += 1 / len(data)
        n = max(1, len(own))
        low = [w.lower() for w in own]
        out.append([math.sqrt(v) for v in grid] + [
            len(own) / 64, len(set(low)) / n, sum(low[j] == low[j + 1] for j in range(len(low) - 1)) / n,
            sum(len(w) for w in own) / n / 10, max([len(w) for w in own], default=0) / 40,
            sum(w.isupper() for w in own) / n, sum(w.istitle() for w in own) / n])
    return out


def plain_quality(text, model):
    p, told, votes = model.p, [], []
    for x in plain_passages(text):
        x = np.clip((np.array(x) - model.mean) / model.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        gate = 1 / (1 + np.exp(-(h @ p["U"])))
        told.append(h)
        votes.append(math.exp(float((np.tanh(h @ p["V"]) * gate) @ p["w"])))
    z = sum(v * h for v, h in zip(votes, told)) / sum(votes)
    return 1 / (1 + math.exp(-float(z @ p["c"] + p["d"][0])))


def test_quality_by_hand(spark, texts):
    model = quality_model.train(texts, spark.read.parquet(f"{SF}/labels.parquet"), "quality", F.lit(True))
    have = sorted(((r.doc_id, r.score) for r in quality_model.score(texts, model).collect()), key=key)
    want = sorted(((r.doc_id, plain_quality(r.text, model)) for r in texts.collect()), key=key)
    assert [d for d, _ in have] == [d for d, _ in want]
    assert [s for _, s in have] == pytest.approx([s for _, s in want], abs=1e-4)
    assert min(s for _, s in want) < 0.5 < max(s for _, s in want)
