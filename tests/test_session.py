import datetime as dt

import pytest

from ticketscope.operators.filters import TicketFilter
from ticketscope.session import ensure_checkpoint_dir, scratch_dir


def test_checkpoint_folder_is_read_from_the_session_not_replaced(spark):
    before = spark.sparkContext.getCheckpointDir()
    assert before
    assert ensure_checkpoint_dir(spark) == before
    assert spark.sparkContext.getCheckpointDir() == before
    path = scratch_dir(spark, "t")
    assert path.startswith(before) and "/tables/t-" in path


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_partition_bounds_cover_whole_months():
    flt = TicketFilter(start=dt.date(2024, 1, 31), end=dt.date(2024, 3, 1))
    text = str(flt.partition_predicate())
    assert "202401" in text and "202403" in text
    assert TicketFilter().partition_predicate() is None
    try:
        TicketFilter(start="2024-02-01", end="2024-01-01")
    except ValueError:
        pass
    else:
        raise AssertionError("a reversed range must be rejected")
