"""The wide stack F05: registered after all the blocks it joins."""

from __future__ import annotations

from .base import query
from .features import wide, wide_sql


@query("f05_wide_stack", wide_sql())
def f05(spark, sf):
    """Timestamp, arrival, neighbour, runway, flow, related-strip and geometry blocks of every departure, joined by id."""
    return wide(spark, sf)
