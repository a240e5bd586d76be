"""Applying change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_changes(target: DataFrame, keys: list[str], inserts: DataFrame | None = None, updates: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """``target`` with rows added, rows' columns replaced by key, and rows removed by key.

    A null in an update leaves the column as it was. The order is delete, update, insert.
    """
    out = target
    on = lambda side: [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    if deletes is not None:
        out = out.join(deletes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).distinct(), on(out), "left_anti")
    if updates is not None:
        values = [c for c in target.columns if c not in keys]
        new = updates.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(c).alias(f"_v_{c}") for c in values))
        joined = out.join(new, on(out), "left")
        out = joined.select(*(F.coalesce(F.col(f"_v_{c}"), F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns))
    return out if inserts is None else out.unionByName(inserts.select(*target.columns))
