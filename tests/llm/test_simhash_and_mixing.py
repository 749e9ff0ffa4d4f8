import collections
import hashlib
import itertools
import math

import pytest
import xxhash
from pyspark.sql import functions as F

from ticketscope.llm import mixing, simhash


def plain_fingerprint(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = low.split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=2):
    """fingerprints -> smallest fingerprint reachable, by comparing all pairs."""
    prints = sorted(set(prints))
    up = {p: p for p in prints}

    def find(p):
        while up[p] != p:
            p = up[p]
        return p
    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {p: find(p) for p in prints}


def plain_near(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(prints)
    ids = collections.defaultdict(list)
    for (doc, _), p in zip(rows, prints):
        if doc is not None:
            ids[root[p]].append(doc)
    return collections.Counter((doc, p, min(ids[root[p]], default=None)) for (doc, _), p in zip(rows, prints))


def near_rows(df, **options):
    return collections.Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df, **options).collect())


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("tile_rows", [4096, 2])
def test_near_duplicates(docs, odd, none, tile_rows):
    for df in (docs, odd):
        assert near_rows(df, tile_rows=tile_rows) == plain_near(pairs(df))
    assert not near_rows(none)


@pytest.mark.parametrize("tile_rows", [4096, 5])
def test_dense_groups(spark, tile_rows):
    """Many prints within few bits of each other, chains, and lone ones."""
    base = [0, (1 << 64) - 1, 0x0F0F0F0F12345678]
    prints = {b ^ (1 << i) ^ (1 << j) for b in base for i in range(0, 64, 3) for j in range(1, 64, 5)}
    prints |= {0xAAAA << k for k in range(40)} | {sum(1 << i for i in range(k)) for k in range(0, 64, 2)}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    table = spark.createDataFrame([(s,) for s in signed], "fp long").repartition(5)
    edges = simhash.links(table, 2, tile_rows)
    found = {r.node % 2**64: r.root for r in simhash.components(edges).collect()}
    want = plain_components(prints)
    groups = collections.defaultdict(set)
    for p in prints:
        groups[found.get(p, p if p < 2**63 else p - 2**64)].add(p)
    expected = collections.defaultdict(set)
    for p, r in want.items():
        expected[r].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    assert edges.count() < 40 * len(prints)  # no list of all pairs


def test_keep_one(docs, odd):
    for df in (docs, odd):
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        near = plain_near(pairs(df))
        root = plain_components(p for _, p, _ in near)
        assert kept.count() == len(set(root.values()))
        assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {c for _, _, c in near if c is not None}


def test_long_text_fingerprint():
    text = " ".join(f"w{i * i % 7919}" for i in range(50000))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def plain_targets(sizes, weights, budget, most):
    """Give out the budget round by round until no source is above its limit."""
    left, target, open_ = budget * sum(sizes.values()), {}, set(sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    while open_:
        share = {s: left * w[s] / sum(w[t] for t in open_) for s in open_}
        above = {s for s in open_ if share[s] >= most * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def test_mix(docs, odd):
    for df in (docs, odd):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        sizes, taken, target = collections.Counter(), collections.Counter(), {}
        for r in rows:
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            target[r.source] = r.target
            assert 0 <= r.taken <= 2 * r.size and all(0 <= p <= 1 for p in r.positions)
            assert (r.taken > 0) == bool(r.positions)
        want = plain_targets(sizes, (5, 2, 1), 1.5, 2)
        for s in sizes:
            assert math.isclose(target[s], want[s], abs_tol=1e-6)
            assert taken[s] == math.floor(target[s])
            assert {r.source_size for r in rows if r.source == s} == {sizes[s]}


def test_mix_is_stable(docs):
    a = sorted(map(str, mixing.mix(docs).collect()))
    assert a == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_positions_follow_the_schedule(spark):
    """Words due by a time are the integral of the schedule up to it."""
    rows = [(i, "w " * 50, s) for s in "abc" for i in range(ord(s) * 1000, ord(s) * 1000 + 400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source, schedule in zip("abc", mixing.SCHEDULES):
        own = [r for r in got if r.source == source]
        for t in (0.2, 0.5, 0.9):
            def area(upto):
                return sum((min(t1, upto) - t0) * (a + a + (b - a) * (min(t1, upto) - t0) / (t1 - t0)) / 2
                           for (t0, a), (t1, b) in zip(schedule, schedule[1:]) if t0 < upto)
            due = sum(50 for r in own for p in r.positions if p < t)
            assert abs(due - own[0].target * area(t) / area(1)) <= 100


def test_training_order(docs, odd, none):
    for df in (docs, odd):
        plan = collections.Counter()
        for r in mixing.mix(df).collect():
            plan[r.doc_id] += len(r.positions)
        copies = mixing.training_order(df)
        assert copies.columns == df.columns
        got = collections.Counter(r.doc_id for r in copies.select("doc_id").collect())
        assert got == +plan
    assert mixing.training_order(none).count() == 0
    assert mixing.mix(none).count() == 0


@pytest.fixture(scope="module")
def hot(spark):
    """Null ids for all rows but a few, one id for a third of the others, rows alike in every column."""
    rows = [(None if i % 3 else i % 2, f"w{i % 5} " * (i % 7), "ab"[i % 2], i % 4) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(5)


def test_hot_ids_in_mix(hot):
    """Starts by a plain running sum over (hash, size): rows of one id and size are told by nothing else."""
    rows = mixing.mix(hot).collect()
    got = collections.Counter((r.doc_id, r.source, r.size, r.taken) for r in rows)
    target = {r.source: (r.source_size, math.floor(r.target)) for r in rows}
    want = collections.Counter()
    for s, (whole, goal) in target.items():
        def key(r):
            return hashlib.md5(f"20:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), r.size
        start = 0
        for r in sorted((r for r in rows if r.source == s), key=key):
            want[r.doc_id, s, r.size, sum(max(0, min(r.size, goal - whole * e - start)) for e in (0, 1))] += 1
            start += r.size
    assert got == want


def test_training_order_of_rows_alike(hot):
    plan = collections.Counter()
    for r in mixing.mix(hot).collect():
        plan[r.doc_id, r.source, r.size] += len(r.positions)
    copies = mixing.training_order(hot)
    assert copies.columns == hot.columns
    rows = [tuple(r) for r in copies.collect()]
    got = collections.Counter((d, s, len(t.split())) for d, t, s, _ in rows)
    assert got == +plan
    held = collections.Counter(tuple(r) for r in hot.collect())
    assert all(n <= 2 * held[r] for r, n in collections.Counter(rows).items())


def test_no_python_in_mix(docs):
    plan = mixing.mixed(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert F.col("x") is not None
