"""Size checks in front of every explicit broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows up to which a dimension is sent to every executor.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when the row count is proven to be within ``limit``.

    ``rows`` is the bound the caller knows (a local table, a ``limit``). Without
    one there is no hint: adaptive execution measures the side at run time and
    broadcasts it below Spark's own size threshold, else the join is shuffled.
    """
    return F.broadcast(df) if rows is not None and rows <= limit else df
