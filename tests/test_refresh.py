import datetime as dt
import os

import pytest

from helpers import EDGE_ROWS, SF001, edge_raw
from ticketscope.operators import quality as Q
from ticketscope.operators.clean import clean
from ticketscope.operators.quality import QualityError
from ticketscope.plans import refresh as RF
from ticketscope.sources import extract as E
from ticketscope.sources import fixtures as FX
from ticketscope.sources import summaries_io as SIO


def test_process_aborts_before_writing_on_failed_gates(spark, tmp_dir):
    raw = FX.raw_tickets_b(spark, SF001, full=True)              # duplicates, negative hours
    E.write_raw(raw, os.path.join(tmp_dir, "raw"), dt.date(1995, 1, 1))
    with pytest.raises(QualityError):
        RF.process(spark, os.path.join(tmp_dir, "raw"), os.path.join(tmp_dir, "clean"))
    published = os.path.join(tmp_dir, "clean")
    assert not os.path.exists(os.path.join(published, "processed"))
    assert not os.path.exists(os.path.join(published, "processed_part"))


def test_process_precompute_export(spark, tmp_dir):
    raw = FX.raw_tickets_a(spark, SF001)
    E.write_raw(raw, os.path.join(tmp_dir, "raw"), dt.date(2024, 1, 1))
    paths = RF.process(spark, os.path.join(tmp_dir, "raw"), os.path.join(tmp_dir, "clean"))
    assert set(paths) == {"single", "partitioned"}
    RF.precompute(spark, os.path.join(tmp_dir, "clean"), os.path.join(tmp_dir, "summaries"))
    s = SIO.read_summaries(spark, os.path.join(tmp_dir, "summaries"))
    assert set(s) == {"daily", "complaint_type", "dow_hour"}
    assert s["daily"].agg({"tickets": "sum"}).first()[0] == raw.count()
    out = RF.export(spark, os.path.join(tmp_dir, "clean"), os.path.join(tmp_dir, "exports"))
    assert all(os.path.isdir(p) for p in out.values())


def gates(df):
    return {r.gate: (r.violations, r.ok) for r in df.collect()}


def test_gates_of_the_write_are_those_of_the_table(spark, tmp_dir):
    edge_raw(spark).write.parquet(f"{tmp_dir}/raw")
    with pytest.raises(QualityError, match="non_negative_hours: 1; unique_key: 1"):
        RF.process(spark, f"{tmp_dir}/raw", f"{tmp_dir}/clean")
    got = gates(RF.read_report(spark, f"{tmp_dir}/clean"))
    assert got.pop("undated_rows") == (1, True)
    assert got == gates(Q.quality_report(clean(edge_raw(spark)), min_rows=0))
    assert sum(r[1] is None for r in EDGE_ROWS) == 1


def test_undated_rows_can_fail_the_run(spark, tmp_dir):
    good = edge_raw(spark).where("unique_key not in ('dup', 'neg')")
    good.repartition(3).write.parquet(f"{tmp_dir}/raw")
    with pytest.raises(QualityError, match="undated_rows: 1"):
        RF.process(spark, f"{tmp_dir}/raw", f"{tmp_dir}/clean", max_undated=0)
    assert not os.path.exists(f"{tmp_dir}/clean/processed_part")
    RF.process(spark, f"{tmp_dir}/raw", f"{tmp_dir}/clean", max_undated=1)
    assert all(r.ok for r in RF.read_report(spark, f"{tmp_dir}/clean").collect())


@pytest.mark.parametrize("pages", ["no creation column", "all null", "no rows"])
def test_gates_without_any_dated_row(spark, tmp_dir, pages):
    raw = edge_raw(spark)
    if pages == "no creation column":
        raw = raw.drop("created_date")
    elif pages == "all null":
        raw = raw.where("created_date is null")
    else:
        raw = raw.where("unique_key = 'none'")
    raw.write.parquet(f"{tmp_dir}/raw")
    with pytest.raises(QualityError, match="min_rows: 5"):
        RF.process(spark, f"{tmp_dir}/raw", f"{tmp_dir}/clean", min_rows=5)
    undated = {"no creation column": len(EDGE_ROWS), "all null": 1, "no rows": 0}[pages]
    assert gates(RF.read_report(spark, f"{tmp_dir}/clean"))["undated_rows"] == (undated, True)
