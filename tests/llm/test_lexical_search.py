"""Ranked lexical search against a plain scan of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ticketscope.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, best=10):
    held = [(d, Counter(w), len(w)) for d, w in ((d, terms(t)) for d, t in docs) if w]
    n_docs, n_words = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) for w in asked}
        for d, c, n in held:
            m = 100 - 75 + 75 * n * n_docs // n_words
            s = sum(k * weight[w] * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, k in asked.items())
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:best])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_tables(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    expected = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got(ls.search(docs, bench)) == expected


@pytest.mark.parametrize("block", [1 << 16, 12])
def test_odd_rows(spark, odd, none, block):
    asked = [("q1", "words in a shared LINE"), ("q1", "words in a shared LINE"), (None, "text Häuser häuser"), ("empty", ""), ("null", None),
             ("unknown", "zzzzz"), ("all", "same words in this text here one two the the the")]
    items = spark.createDataFrame([(*r, 1.0) for r in asked], "item_id string, text string, score double")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(ls.search(odd, items, block)) == plain(rows, asked)
    assert ls.search(none, items, block).collect() == []
    assert ls.search(odd, items.limit(0), block).collect() == []


def test_ties_and_one_text_in_a_third_of_the_rows(spark):
    r = random.Random(3)
    rows = [(i, "copy of one text") for i in range(200)] + [
        (200 + i, " ".join(r.choice("copy one alpha beta gamma delta text".split()) for _ in range(r.randrange(1, 40)))) for i in range(400)]
    r.shuffle(rows)
    items = [(1, "copy of one text"), (2, "alpha beta beta"), (3, "text of gamma")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ls.search(docs, spark.createDataFrame(items, "item_id long, text string"))) == plain(rows, items)


def test_buckets_lose_nothing(spark, monkeypatch):
    """Small buckets with thresholds from earlier ones, against all products; every bound prunes something."""
    monkeypatch.setattr(ls, "BUCKET_DOCS", 8)
    r = np.random.default_rng(5)
    n, n_terms = 600, 60
    held = [np.sort(r.choice(n_terms, r.integers(1, 25), replace=False)) for _ in range(n)]
    impact = [r.integers(1, 200_000, len(h)) for h in held]
    items = ls.Items([(i, [b"%d" % t for t in r.choice(n_terms, r.integers(1, 12))]) for i in range(40)])
    names = sorted(items.terms, key=items.terms.get)
    number = {int(w): i for i, w in enumerate(names)}
    weight = r.integers(1, 9000, len(names))
    query = ls.Query(items, weight)
    held = [(np.array([number[t] for t in h if t in number], np.int64), np.array([v for t, v in zip(h, x) if t in number], np.int64))
            for h, x in zip(held.copy(), impact)]
    square = np.array([(x * x).sum() for _, x in held])
    order = np.argsort(-square)
    heaps, floor = {}, np.zeros(len(items.rows), np.int64)
    for at in range(0, n, 8):
        some = order[at:at + 8]
        ls.Bucket(some, square[some], np.array([len(held[d][0]) for d in some]), np.concatenate([held[d][0] for d in some]),
                  np.concatenate([held[d][1] for d in some])).search(query, heaps, floor)
    for i in range(len(items.rows)):
        a, b = query.start[i], query.start[i + 1]
        dense = np.zeros(len(names), np.int64)
        dense[query.term[a:b]] = query.value[a:b]
        scores = sorted((-int((dense[t] * x).sum()), d) for d, (t, x) in enumerate(held))
        assert heaps.get(i, []) == [s for s in scores[:10] if s[0] < 0]
