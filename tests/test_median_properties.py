"""Property test: the two-scan median equals NumPy's median per group."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from ticketscope.operators.median import aggregate_with_median, median_of_counts

values = st.one_of(st.integers(-5, 5).map(float),                     # heavy ties
                   st.floats(-1e6, 1e6, allow_nan=False, width=64))
rows = st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), values),
                min_size=1, max_size=300)


@settings(max_examples=5, deadline=None)
@given(rows)
def test_exact_median_matches_numpy(spark, data):
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r.m for r in aggregate_with_median(df, ["k"], [], "v", "m", accuracy=50).collect()}
    groups = {}
    for k, v in data:
        groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, vs in groups.items():
        s = sorted(vs)
        lo, hi = s[(len(s) - 1) // 2], s[len(s) // 2]
        exp = lo if lo == hi else 0.5 * lo + 0.5 * hi
        assert got[k] == exp or np.isclose(got[k], np.median(vs), rtol=0, atol=1e-9), k


@settings(max_examples=4, deadline=None)
@given(rows, st.sampled_from([1, 2, 7]))
def test_narrowing_matches_numpy(spark, data, window_values):
    """A bracket of nearly everything and windows of a few values: the passes find the middle."""
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r.m for r in aggregate_with_median(df, ["k"], [], "v", "m", accuracy=5, window_values=window_values).collect()}
    whole = aggregate_with_median(df, [], [], "v", "m", accuracy=5, window_values=window_values).first().m
    groups = {}
    for k, v in data:
        groups.setdefault(k, []).append(v)
    for k, vs in [*groups.items()]:
        assert np.isclose(got[k], np.median(vs), rtol=0, atol=1e-9), k
    assert np.isclose(whole, np.median([v for _, v in data]), rtol=0, atol=1e-9)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", None]), st.one_of(st.none(), st.floats(-9, 9)), st.integers(1, 50)), min_size=1, max_size=80))
def test_median_of_counts(spark, data):
    df = spark.createDataFrame(data, "k string, v double, n long")
    got = {r.k: r.m for r in median_of_counts(df, ["k"], "v", "n", "m", window_values=3).collect()}
    groups = {}
    for k, v, n in data:
        if v is not None:
            groups.setdefault(k, []).extend([v] * n)
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert np.isclose(got[k], np.median(vs), rtol=0, atol=1e-9), k


def test_a_million_values_in_one_group(spark):
    """Candidates are narrowed until a window holds a hundred of them."""
    df = spark.range(1_000_000).select(((F.col("id") * 48271) % 2147483647).cast("double").alias("v"))
    got = aggregate_with_median(df, [], [], "v", "m", accuracy=20, window_values=100).first().m
    assert got == df.agg(F.median("v")).first()[0]
