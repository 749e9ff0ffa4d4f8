"""ticketscope — service-ticket response-time and SLA analytics on Spark.

Everything is expressed with the DataFrame API so Catalyst can push filters
and projections into the Parquet scan and pick the physical strategy.
"""

from ticketscope.operators.filters import TicketFilter
from ticketscope.session import build_session, scratch_dir

__all__ = ["TicketFilter", "build_session", "scratch_dir"]
