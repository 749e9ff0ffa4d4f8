import pytest
from pyspark.sql import functions as F

from helpers import SF001
from helpers import edge_raw
from ticketscope.operators import quality as Q
from ticketscope.operators import sampling as SP
from ticketscope.operators.clean import clean
from ticketscope.operators.filters import TicketFilter
from ticketscope.sources import fixtures as FX


def report(df, **kw):
    return {r.gate: (r.violations, r.ok) for r in Q.quality_report(df, **kw).collect()}


def test_gates_on_edge_rows(spark):
    rep = report(clean(edge_raw(spark)), min_rows=1000)
    assert rep["required_columns"] == (0, True)
    assert rep["unique_key"] == (1, False)               # one surplus duplicate row
    assert rep["non_negative_hours"] == (1, False)
    assert rep["min_rows"] == (1000 - 12, False)


def test_missing_columns_and_enforce(spark):
    c = clean(edge_raw(spark)).drop("borough", "dow_name")
    assert report(c)["required_columns"] == (2, False)
    with pytest.raises(Q.QualityError):
        Q.enforce(c)
    ok = clean(edge_raw(spark)).dropDuplicates(["unique_key"]).where(
        F.coalesce(F.col("response_hours"), F.lit(0.0)) >= 0)
    Q.enforce(ok)


def test_sample_view_order_limit_and_columns(spark):
    c = clean(FX.raw_tickets_a(spark, SF001))
    cols = SP.sample_columns(c.columns)
    v = SP.sample_view(c, TicketFilter(boroughs=["ASIA"]), limit=50, sla_hours=48.0,
                       columns=cols + ["breach"])
    rows = v.collect()
    assert len(rows) == 50 and v.columns == cols + ["breach"]
    keys = [(r.created_dt, r.unique_key) for r in rows]
    assert keys == sorted(keys)
    with pytest.raises(ValueError):
        SP.sample_columns(c.columns, ["nope"])


def test_random_sample_is_uniform_size_and_repeatable(spark):
    c = clean(FX.raw_tickets_a(spark, SF001))
    a = SP.random_sample(c, n=100, seed=3)
    b = SP.random_sample(c, n=100, seed=3)
    ka = sorted(r.unique_key for r in a.collect())
    assert len(ka) == 100 and len(set(ka)) == 100
    assert ka == sorted(r.unique_key for r in b.collect())
    assert SP.random_sample(c, n=10 ** 6).count() == c.count()     # fewer rows than n: all


def test_random_sample_ignores_the_file_layout(spark):
    c = clean(FX.raw_tickets_a(spark, SF001))
    a = {r.unique_key for r in SP.random_sample(c, n=100, seed=3).collect()}
    assert a == {r.unique_key for r in SP.random_sample(c.repartition(13), n=100, seed=3).collect()}
    assert a != {r.unique_key for r in SP.random_sample(c, n=100, seed=4).collect()}


def test_first_rows_is_exact(spark):
    c = clean(FX.raw_tickets_a(spark, SF001))
    c = c.withColumn("created_dt", F.when(F.col("unique_key").cast("int") % 9 > 0, F.col("created_dt")))
    order = [F.col("created_dt").asc_nulls_last(), F.col("unique_key")]
    for n in (1, 137, 500, 999, 5000):
        got = [r.unique_key for r in SP.first_rows(c, n, F.to_date("created_dt"), order).collect()]
        assert got == [r.unique_key for r in c.orderBy(*order).limit(n).collect()], n


def test_sample_sink(spark, tmp_dir):
    from ticketscope.sources import storage as ST
    ST.write_clean_partitioned(clean(FX.raw_tickets_a(spark, SF001)), f"{tmp_dir}/{ST.PARTITIONED}")
    SP.write_sample(spark, tmp_dir, f"{tmp_dir}/sample", n=50)
    assert spark.read.parquet(f"{tmp_dir}/sample").count() == 50
