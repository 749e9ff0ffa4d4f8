import math

import numpy as np
from pyspark.sql import functions as F

from helpers import edge_raw
from ticketscope.operators import metrics as M
from ticketscope.operators.clean import clean
from ticketscope.operators.filters import TicketFilter
from ticketscope.operators.median import aggregate_with_median


def cleaned(spark):
    return clean(edge_raw(spark))


def test_kpi_policies(spark):
    c = cleaned(spark)
    ex = M.kpi(c).first()
    hours = [r.response_hours for r in c.collect() if r.response_hours is not None]
    assert ex.tickets == len(hours)
    assert ex.med_hrs == float(np.median(hours))
    assert math.isclose(ex.pct_within, sum(h <= 24 for h in hours) / len(hours))
    met = M.kpi(c, open_tickets="met").first()
    br = M.kpi(c, open_tickets="breached").first()
    assert met.tickets == br.tickets == c.count()
    assert met.pct_within > br.pct_within


def test_kpi_empty_filter(spark):
    r = M.kpi(cleaned(spark), TicketFilter(boroughs=["NOWHERE"])).first()
    assert (r.med_hrs, r.pct_within, r.tickets) == (None, None, 0)


def test_filter_semantics(spark):
    c = cleaned(spark)
    # end date inclusive: a ticket created 23:59:59 local on the 15th is in [15th, 15th]
    one_day = TicketFilter(start="2024-01-15", end="2024-01-15").apply(c)
    assert {r.unique_key for r in one_day.collect()} == {"midnight", "holiday"}
    assert TicketFilter().apply(c).count() == c.count()           # empty lists: no filter
    assert TicketFilter(boroughs=[""]).apply(c).count() == 1


def test_top_types_tie_break_and_nulls(spark):
    c = cleaned(spark)
    out = M.top_types(c, topn=5).collect()
    assert out[0].complaint_type == "Noise"
    assert any(r.complaint_type is None for r in out)             # null key kept as a group


def test_dimension_values_skip_null_and_empty(spark):
    vals = [r.borough for r in M.dimension_values(cleaned(spark), "borough").collect()]
    assert vals == ["QUEENS"]


def test_seasonality_weekday_order(spark):
    out = M.by_weekday(cleaned(spark)).collect()
    order = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    names = [r.dow_name for r in out]
    assert names == sorted(names, key=order.index)


def _skewed(spark, n_hot=60000):
    """One hot group holding most rows, ties, a null key and small groups."""
    hot = spark.range(n_hot).select(F.lit("hot").alias("k"),
                                    ((F.col("id") * 7919) % 10007 / F.lit(13.0)).alias("v"))
    ties = spark.range(501).select(F.lit("ties").alias("k"), F.lit(2.5).alias("v"))
    small = spark.range(40).select(F.lit(None).cast("string").alias("k"),
                                   (F.col("id") * 1.5).alias("v"))
    nulls = spark.range(5).select(F.lit("allnull").alias("k"), F.lit(None).cast("double").alias("v"))
    return hot.unionByName(ties).unionByName(small).unionByName(nulls)


def test_exact_median_equals_inline_and_numpy(spark):
    df = _skewed(spark)
    inline = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    sel = {r.k: r.m for r in aggregate_with_median(df, ["k"], [], "v", "m", accuracy=300).collect()}
    assert sel.pop("allnull") is None and inline.pop("allnull") is None
    assert sel == inline
    pdf = df.toPandas()
    for k, g in pdf.groupby("k", dropna=False):
        if k == "allnull":
            continue
        key = None if (isinstance(k, float) and math.isnan(k)) else k
        assert math.isclose(inline[key], float(np.median(g["v"])), rel_tol=0, abs_tol=1e-12)


def test_global_median_even_count(spark):
    df = spark.range(10000).select((F.col("id") % 997 * 0.25).alias("v"))
    got = aggregate_with_median(df, [], [F.count(F.lit(1)).alias("n")], "v", "m").first()
    exp = df.agg(F.median("v").alias("m")).first().m
    assert got.n == 10000 and got.m == exp


def test_exact_median_of_groups_larger_than_the_sketch(spark):
    """200,000 values a group: the bracket is narrower than the group, the result still exact."""
    df = spark.range(400_000).select((F.col("id") % 2).alias("k"), F.rand(3).alias("v"))
    got = aggregate_with_median(df, ["k"], [F.count(F.lit(1)).alias("n")], "v", "m", accuracy=500)
    ref = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.median("v").alias("m"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ref.collect()))


def test_export_type_breaches_of_null_keys(spark):
    from ticketscope.operators.exports import export_type_breaches
    df = spark.createDataFrame([(None, "a", 1.0, False), (None, "a", 2.0, True)],
                               "unique_key string, complaint_type string, response_hours double, within_sla boolean")
    assert tuple(export_type_breaches(df).first()) == ("a", 0, 1, None)


def test_approx_median_is_close(spark):
    df = _skewed(spark)
    exact = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    approx = {r.k: r.m for r in aggregate_with_median(df, ["k"], [], "v", "m",
                                                      method="approx").collect()}
    rng = df.where(F.col("k") == "hot").agg(F.max("v") - F.min("v")).first()[0]
    assert abs(approx["hot"] - exact["hot"]) <= rng * 0.01


def test_raw_window_is_a_superset_of_the_local_filter(spark):
    raw = edge_raw(spark)
    for flt in (TicketFilter(start="2024-01-15", end="2024-01-15"),
                TicketFilter(start="2024-01-16"), TicketFilter(end="2024-01-12")):
        narrowed = flt.apply(clean(raw.where(flt.raw_predicate())))
        full = flt.apply(clean(raw))
        assert sorted(r.unique_key for r in narrowed.collect()) == \
            sorted(r.unique_key for r in full.collect())
    assert TicketFilter(boroughs=["X"]).raw_predicate() is None
