"""Connected components of a link table, by alternating large and small stars.

Every round is two shuffles of the links that are left. A hub's minimum is
combined before its shuffle, and the join that spreads the minimum is one
that adaptive execution may split, so no key needs its links in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Written

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool, written: Written) -> DataFrame:
    """Links (u, v) with v < u turned into links to a nearby minimum."""
    if large:
        near = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links.select("u", "v")
    least = near.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).withColumn("m", F.least("w", "m"))
    # Written first: a join of two plain exchanges is one that adaptive execution can split at a hub.
    least = written.table(least, "least")
    joined = near.join(least, F.col("u") == F.col("w"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        both = F.explode_outer(F.array(F.col("v"), F.col("u")))
        out = joined.select(both.alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least node reachable, for every node of a link.

    Nulls and loops link nothing. The node type needs an order.
    """
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    ).distinct()
    held = Written(links.sparkSession)
    now, mark = held.table(now, "links"), None
    for _ in range(MAX_ROUNDS):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(now.select(F.col("v"), F.col("v")).distinct())
        mark = seen
        least, following = Written(links.sparkSession), Written(links.sparkSession)
        now = following.table(_star(_star(now, True, least), False, least), "links")
        least.drop()
        held.drop()
        held = following
    raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")
