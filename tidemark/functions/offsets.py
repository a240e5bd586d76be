"""Arithmetic of offsets: bucket plans and shard predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def buckets(until: int, n: int, name: str) -> list[tuple[str, int, int]]:
    """(key, lo, hi): the offsets 0..until as n neighbouring ranges lo < offset <= hi.

    The last one takes the remainder; with fewer offsets than buckets the surplus is empty.
    """
    if n < 1:
        raise ValueError(f"a plan needs a bucket at least, not {n}")
    width = max(1, (until + 1) // n)
    edges = [min(until, k * width - 1) for k in range(n)] + [until]
    return [(f"{name}.bucket{k}", edges[k], edges[k + 1]) for k in range(n)]


def in_shard(column: str | Column, n: int, shard: int) -> Column:
    """Rows of one of n shards, by the offset's remainder."""
    return F.pmod(F.col(column) if isinstance(column, str) else column, F.lit(n)) == shard
