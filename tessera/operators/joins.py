"""Joins against a side of a checked size, and in blocks of it beyond."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def in_blocks(queries: DataFrame, against: Callable[[DataFrame], DataFrame], rows: int = BROADCAST_ROWS) -> DataFrame:
    """against(block) for blocks of at most about rows rows of queries, each marked for broadcast: a join on a condition that
    is no equality holds the queries against all rows, a block at a time."""
    n = max(1, -(-queries.count() // rows))
    if n == 1:
        return against(F.broadcast(queries))
    block = F.pmod(F.xxhash64(*queries.columns), F.lit(n))
    return reduce(DataFrame.unionByName, [against(F.broadcast(queries.filter(block == k))) for k in range(n)])
