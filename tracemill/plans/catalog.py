"""All queries: importing this registers them."""

from tracemill.plans import captures, decisions, ledgers, reads, stored  # noqa: F401
from tracemill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
