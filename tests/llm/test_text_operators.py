"""Quality rules, line dedup and decontamination against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketscope.llm import decontaminate, line_dedup, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i:i + 8])].append(i)
    cover = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def test_counts(docs, odd):
    for df in (docs, odd):
        rows = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                for r in quality_rules.measured(df).collect()}
        assert rows == {(r.doc_id, *plain_counts(r.text)) for r in df.select("doc_id", "text").collect()}


def test_repeat_words_edges():
    w = [b"a"] * 9
    assert quality_rules.repeat_words(w) == 9
    assert quality_rules.repeat_words(w[:8]) == 0
    assert quality_rules.repeat_words(b"a b c d e f g h x a b c d e f g h".split()) == 16


def test_sketch_quantiles(spark):
    rng = np.random.default_rng(1)
    values = rng.lognormal(0, 1, 4000)
    rows = spark.createDataFrame([("en", "s", int(v * 1000), 1000) + (0,) * 6 for v in values],
                                 ["lang", "source", *quality_rules.COUNTS[2:3], "n_words", "word_chars", "n_dup_lines",
                                  "n_repeat_words", "n_lines", "n_shouts", "n_marks"])
    sk = quality_rules.sketch(rows)
    halves = quality_rules.sketch(rows.limit(1000)).unionByName(quality_rules.sketch(rows.subtract(rows.limit(0)).limit(0)))
    assert halves.agg(F.sum("docs")).first()[0] == 1000 * len(quality_rules.RATES)
    q = quality_rules.quantiles(quality_rules.merge(sk, ["lang"]), ["lang"], {"m": 0.5, "h": 0.9}).filter(
        "rate = 'symbols_per_word'").first()
    exact = np.sort((values * 1000).astype(int) / (1000 + quality_rules.RATES["symbols_per_word"][2]))
    for got, share in ((q.m, 0.5), (q.h, 0.9)):
        want = exact[int(np.ceil(share * len(exact))) - 1]
        assert abs(got - want) <= 0.0101 * want


def test_merge_is_exact(docs):
    rows = quality_rules.measured(docs)
    parts = quality_rules.sketch(rows.filter("doc_id % 2 = 0")).union(quality_rules.sketch(rows.filter("doc_id % 2 = 1")))
    by = ["lang", "source"]
    assert sorted(quality_rules.merge(parts, by).collect()) == sorted(
        quality_rules.merge(quality_rules.sketch(rows), by).collect())


def test_judge(spark, docs, odd, none):
    got = quality_rules.judge(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and not r.broken)
    assert quality_rules.judge(odd).count() == odd.count()
    assert quality_rules.judge(none).count() == 0


def test_judge_catches_junk_in_its_group(spark):
    good = [(i, " ".join(f"wort{(i * 7 + j) % 97}" for j in range(60 + i % 9)), "de", "s") for i in range(300)]
    junk = [(1000 + i, " ".join(f"wort{(i * 7 + j) % 97}###" for j in range(60)), "de", "s") for i in range(30)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(good + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i, *_ in good)
    assert not any(got[i].kept for i, *_ in junk)


def plain_dedup(rows):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
    last = 2**63 - 1
    holders = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(last if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2
                or min(holders[key(x)]) == (last if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return collections.Counter(out)


def as_rows(df):
    return collections.Counter(tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_line_dedup(docs, odd, none):
    for df in (docs, odd, none):
        assert as_rows(line_dedup.dedup_lines(df)) == plain_dedup(pairs(df))


def test_line_index_is_reversible(spark, docs):
    cut = docs.agg(F.expr("percentile_approx(doc_id, 0.5)")).first()[0]
    first, second = docs.filter(f"doc_id <= {cut}"), docs.filter(f"doc_id > {cut}")
    empty = line_dedup.LineIndex.empty(spark)
    whole = empty.insert(first).insert(second)
    assert as_rows(whole.dedup(docs)) == plain_dedup(pairs(docs))
    back = whole.delete(second.select("doc_id"))
    assert as_rows(back.dedup(first)) == plain_dedup(pairs(first))
    assert sorted(back.refs.collect()) == sorted(empty.insert(first).refs.collect())
    other = whole.delete(first.select("doc_id"))  # the smallest holders go: their lines come back in others
    assert as_rows(other.dedup(second)) == plain_dedup(pairs(second))
    assert as_rows(back.insert(second).dedup(docs)) == plain_dedup(pairs(docs))


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    keys = rng.integers(-2**63, 2**63 - 1, 20000)
    f = line_dedup.CuckooFilter.sized(len(keys))
    f.insert(keys)
    assert not f.full and f.contains(keys).all()
    others = rng.integers(-2**63, 2**63 - 1, 20000)
    assert f.contains(others).mean() < 0.01
    f.delete(keys[:10000])
    f = line_dedup.CuckooFilter.load(f.dump())
    assert f.contains(keys[10000:]).all() and f.contains(keys[:10000]).mean() < 0.01
    tiny = line_dedup.CuckooFilter.sized(1)
    tiny.insert(keys[:200])
    assert tiny.full and tiny.contains(others).all()  # too small: lets everything pass


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return ITEM_WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_report(docs, items):
    grams = collections.defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            grams[tuple(w[i:i + 13])].add(str(item) if item is not None else "null")
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        w, hit, ids = plain_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := grams.get(tuple(w[i:i + n])):
                    hit |= set(range(i, i + n))
                    ids |= found
        out.append((doc, len(w), len(hit), tuple(sorted(ids)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return collections.Counter(out)


def report_rows(df):
    return collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"shard_words": 500, "block_words": 100}])
def test_decontamination(spark, docs, odd, options):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    items = [tuple(r) for r in bench.collect()]
    extra = [(900, "same words in THIS text"), (None, "shared line"), (901, ""), (902, None), (900, "häuser über straßen " * 6)]
    more = bench.union(spark.createDataFrame(extra, bench.schema))
    for df in (docs.select("doc_id", "text"), odd):
        got = report_rows(decontaminate.report(df, more, **options))
        assert got == plain_report(pairs(df), items + extra)
    assert any(n for *_, n in plain_report(pairs(docs), items))


def test_decontamination_keeps_columns(spark, odd, none):
    bench = spark.createDataFrame([(1, "same words in this text here")], "item_id long, text string")
    kept = decontaminate.remove_contaminated(odd, bench)
    assert kept.columns == odd.columns
    assert kept.count() == odd.count() - 3
    assert decontaminate.remove_contaminated(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.report(none, bench).count() == 0


def test_longest_match(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho"
    docs = spark.createDataFrame([(1, "before it " + item.upper() + " after"), (2, "gamma delta epsilon only"), (3, "none")],
                                 "doc_id long, text string")
    got = {r.doc_id: (r.longest_words, r.longest_at, r.longest_item) for r in decontaminate.report(
        docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: (17, 2, "7"), 2: (3, 0, "7"), 3: (0, -1, None)}


def plain_longest(docs, items):
    """By brute force: most words, first in the text, least item name."""
    named = [(str(item) if item is not None else "null", plain_words(text)) for item, text in items]
    out = []
    for doc, text in docs:
        w, best = plain_words(text), (0, 1, None)
        for name, own in named:
            for a in range(len(w)):
                for b in range(len(own)):
                    n = 0
                    while a + n < len(w) and b + n < len(own) and w[a + n] == own[b + n]:
                        n += 1
                    if n and (-n, a, name) < (-best[0], -best[1], best[2] or ""):
                        best = (n, -a, name)
        out.append((doc, best[0], -best[1], best[2]))
    return collections.Counter(out)


LONGEST_OPTIONS = [{}, {"shard_words": 40}, {"block_words": 10}, {"shard_words": 1, "block_words": 1}]


@pytest.mark.parametrize("options", LONGEST_OPTIONS)
def test_longest_match_in_every_copy(spark, options):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho"
    rows = [(i, f"w{i} {item} v{i}") for i in range(6)] + [(9, "delta epsilon then pi rho")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(8, "other " + item), (7, item), (6, "pi rho")], "item_id long, text string")
    got = {r.doc_id: (r.longest_words, r.longest_at, r.longest_item) for r in decontaminate.report(docs, items, **options).collect()}
    assert got == {i: (17, 1, "7") for i in range(6)} | {9: (2, 0, "7")}


@pytest.mark.parametrize("options", LONGEST_OPTIONS)
def test_longest_match_by_brute_force(spark, options):
    rng = np.random.default_rng(12)
    texts = [" ".join(rng.choice(list("abcde"), size)) for size in rng.integers(0, 30, 90)]
    items = [(int(i), t) for i, t in enumerate(texts[:30])] + [(None, "a b"), (3, "c c c"), (40, None), (41, "zz a zz")]
    docs = list(enumerate(texts[10:] + texts[:20] + ["a b c zz", "none here"]))
    got = collections.Counter((r.doc_id, r.longest_words, r.longest_at, r.longest_item) for r in decontaminate.report(
        spark.createDataFrame(docs, "doc_id long, text string").coalesce(2),
        spark.createDataFrame(items, "item_id long, text string"), **options).collect())
    assert got == plain_longest(docs, items)


def test_repeated_windows_take_linear_time():
    import time
    block = decontaminate.Block([("1", [b"same"] * 1200)] + [(str(i), [b"same"] * 40) for i in range(2, 40)], 13)

    class Held:
        value = block
    start = time.time()
    (n, hit, items, longest, at, name), other = decontaminate._search_shard(
        [b"same " * 20_000, b"same " * 12 + b"and others"], [Held], 13)
    assert (n, hit, len(items), longest, at, name) == (20_000, 20_000, 39, 1200, 0, "1")
    assert other == (14, 0, [], 12, 0, "1")
    assert time.time() - start < 5  # a loop over windows times places took minutes


def test_many_blocks_with_repeated_items(spark):
    rng = np.random.default_rng(4)
    vocabulary = np.array(list("abcdefgh"))
    items = [(i % 20, " ".join(rng.choice(vocabulary, size))) for i, size in enumerate(rng.integers(1, 40, 60))]
    items += items[:20]
    docs = [(i, " ".join(rng.choice(vocabulary, 30)) + " " + items[i][1]) for i in range(50)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(repr, decontaminate.report(df, bench).collect()))
    assert whole == sorted(map(repr, decontaminate.report(df, bench, block_words=7, shard_words=50).collect()))
    with pytest.raises(ValueError, match="most_bytes"):
        decontaminate.report(df, bench, most_bytes=100)


def test_suffix_array_order():
    rng = np.random.default_rng(5)
    codes = rng.integers(1, 4, 300).astype(np.uint64)
    order = decontaminate.suffix_array(codes, 300)
    assert order.tolist() == sorted(range(300), key=lambda i: codes[i:].tolist())


def plain_judge(rows):
    """Verdicts from sorted weighted values: rates, log buckets, quartiles of a source with its language and all, fences."""
    import functools
    import itertools
    import math
    from fractions import Fraction
    measured = [(r.doc_id, r.lang, r.source, dict(zip(quality_rules.COUNTS, quality_rules.measure(
        None if r.text is None else r.text.encode())))) for r in rows]

    def rate(c, name):
        top, bottom, more, *_ = quality_rules.RATES[name]
        return c[top] / (c[bottom] + more) if c[bottom] else 0.0
    step = math.log(1.01 / 0.99)

    def rounded(v):
        return 0.0 if v < quality_rules.LEAST else math.exp(math.ceil(math.log(v) / step) * step) * 0.99

    @functools.cache
    def fences(lang, source):
        near = [[m[3] for m in measured if same(m)] for same in (
            lambda m: m[1:3] == (lang, source), lambda m: m[1] == lang, lambda m: True)]
        limits = {}
        for name, (*_, spread, both) in quality_rules.RATES.items():
            v = sorted((rounded(rate(g, name)), Fraction(1 if level == 0 else quality_rules.PRIOR_DOCS, 1 if level == 0 else len(group)))
                       for level, group in enumerate(near) for g in group)
            total = sum(w for _, w in v)
            upto = list(itertools.accumulate(w for _, w in v))
            q1, q3 = (next(x for (x, _), u in zip(v, upto) if 4 * u >= k * total) for k in (1, 3))
            wide = quality_rules.REACH * max(q3 - q1, spread)
            limits[name] = (q1 - wide if both else -1.0, q3 + wide)
        return limits
    out = []
    for doc, lang, source, c in measured:
        broken = {name for name, (low, high) in fences(lang, source).items() if not low <= rate(c, name) <= high}
        failed = c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]
        out.append((doc, failed, not failed and not broken))
    return sorted(out, key=str)


def test_judge_by_brute_force(spark, odd):
    for df in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), odd):
        got = sorted(((r.doc_id, r.base_failed, r.kept) for r in quality_rules.judge(df).collect()), key=str)
        assert got == plain_judge(df.collect())


def test_thresholds_change_smoothly_with_size(spark):
    """One more row of a source moves its fences a little, at every size."""
    from ticketscope.llm.quality_rules import COUNTS, thresholds
    def rows(n):
        own = [("en", "s", *(100 if c == "n_words" else 400 + i if c == "word_chars" else 10 for c in COUNTS)) for i in range(n)]
        return own + [("en", "t", *(100 if c == "n_words" else 700 + i % 90 if c == "word_chars" else 10 for c in COUNTS)) for i in range(600)]
    schema = "lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    high = [{r.source: r.fences["chars_per_word"].high for r in thresholds(spark.createDataFrame(rows(n), schema)).collect()}["s"]
            for n in (198, 199, 200, 201, 202)]
    assert all(abs(a - b) < 0.2 for a, b in zip(high, high[1:])), high
