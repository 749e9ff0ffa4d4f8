"""Winnowing against a plain version of it."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from ticketscope.llm import winnowing

TOKEN = re.compile(r"[^\x20\x09-\x0D]{1,16}")


def plain_prints(text, k, w):
    """(hash, position) in order."""
    words = TOKEN.findall(text or "")
    grams = []
    for i in range(max(len(words) - k + 1, 1) if words else 0):
        h = 42
        for word in words[i:i + k]:
            h = xxhash.xxh64(word.encode(), seed=h).intdigest()
        grams.append(h >> 32)
    out = []
    for s in range(max(len(grams) - w + 1, 1) if grams else 0):
        least = min((g, -(s + j)) for j, g in enumerate(grams[s:s + w]))
        one = (least[0], -least[1])
        if not out or out[-1] != one:
            out.append(one)
    return out


def plain_digest(found):
    return hashlib.sha256(",".join(str((h << 31) + 2**31 - 2 - p) for h, p in found).encode()).hexdigest()


def like(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_compared(rows, k, w):
    rows = [(d, t or "") for d, t in rows]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 2
        edit = text[:len(text) - cut] + after[:cut]
        own, new = plain_prints(text, k, w), plain_prints(edit, k, w)
        out.append((doc, len(text), hashlib.sha256(edit.encode()).hexdigest(), plain_digest(own), plain_digest(new),
                    like(own, new), like(own, plain_prints(after, k, w)), len(own)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("k,w", [(5, 8), (1, 1), (3, 5), (2, 17), (4, 3)])
def test_prints(spark, k, w):
    r = random.Random(k * w)
    texts = [None, "", " \t\n", "one", "ab" * 40, "é😀" * 50, "x " * 200, "a b " * 90]
    texts += [" ".join(r.choice(["a", "bb", "ccc", "déf", "long" * 9]) for _ in range(n)) for n in [*range(1, 40), 400]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.select("doc_id", winnowing.prints(F.col("text"), k, w).alias("p")).select(
        "doc_id", F.transform("p", winnowing.hash_of).alias("h"), F.transform("p", winnowing.position_of).alias("at")).collect()
    for row in rows:
        assert list(zip(row.h, row.at)) == plain_prints(texts[row.doc_id], k, w), texts[row.doc_id]


def test_shared_runs_are_found(spark):
    r = random.Random(5)
    words = [f"w{r.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(30):
        at = r.randrange(380)
        rows.append((i, " ".join(f"o{i}x{j}" for j in range(r.randrange(30))) + " " + " ".join(words[at:at + 12]) + f" tail{i}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(100, " ".join(words))], "doc_id long, text string")
    found = winnowing.passages(docs, asked).collect()
    assert {x.doc_id for x in found} == set(range(30))
    for x in found:
        assert words[x.query_position:x.query_position + 5] == rows[x.doc_id][1].split()[x.position:x.position + 5]


def test_neighbours(spark, odd, docs):
    for df, kw in ((odd, {}), (odd, {"range_rows": 1}), (odd, {"range_rows": 3, "most_ranges": 2}), (docs, {"range_rows": 16})):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert got(winnowing.compared(df, **kw)) == plain_compared(rows, winnowing.GRAM, winnowing.WINDOW), kw


def test_one_row_and_none(spark, none):
    assert winnowing.compared(none).collect() == []
    one = spark.createDataFrame([(7, "a b c d e f g h i j k l m n")], "doc_id long, text string")
    assert got(winnowing.compared(one)) == plain_compared([(7, "a b c d e f g h i j k l m n")], 5, 8)


def test_a_third_of_all_rows_alike(spark):
    rows = [(None, "same text in every row")] * 300 + [(i, f"text {i} of its own, with words") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(winnowing.compared(df, range_rows=20)) == plain_compared(rows, 5, 8)


def test_no_python_on_the_way(spark, docs):
    plan = winnowing.compared(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
