"""Joins on order and on ranges, as equal joins on buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.sql import unique


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str], bucket: Column | str, right_time: str | None = None) -> DataFrame:
    """Each left row with ``columns`` of the latest right row of its key whose time is not later.

    ``bucket`` coarsens the time of either side (an expression over ``time``; it must not
    fall as time grows). A key's rows are ordered bucket by bucket, and each bucket gets the last right row of the
    ones before from a table with a row per key and bucket, so a hot key's
    history is not sorted in one task. Right rows with a null key or time match nothing;
    of right rows with one time, which counts is undefined.
    """
    right_time = right_time or time
    bucket = F.expr(bucket) if isinstance(bucket, str) else bucket
    b, side, value, at, last, carried = (unique(x) for x in ("bucket", "side", "value", "at", "last", "carried"))
    payload = F.struct(*(right[c] for c in columns))
    rows = left.select(F.struct(*left.columns).alias("row"), *(left[k].alias(f"k{i}") for i, k in enumerate(keys)), left[time].alias(at))
    facts = right.select(payload.alias(value), *(right[k].alias(f"k{i}") for i, k in enumerate(keys)), right[right_time].alias(at)).where(F.col(at).isNotNull())
    names = [f"k{i}" for i in range(len(keys))]
    place = lambda df, t: df.withColumnRenamed(at, time).withColumn(b, bucket).withColumnRenamed(time, at)
    rows, facts = place(rows, at).withColumn(side, F.lit(1)), place(facts, at).withColumn(side, F.lit(0))
    both = rows.unionByName(facts, allowMissingColumns=True)
    ordered = Window.partitionBy(*names, b).orderBy(at, side).rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn(last, F.last(value, ignorenulls=True).over(ordered)).where(F.col(side) == 1)
    # The last right row up to each bucket, from each bucket's own last one.
    ends = both.groupBy(*names, b).agg(F.max_by(value, F.when(F.col(side) == 0, F.col(at))).alias(last))
    before = F.last(last, ignorenulls=True).over(Window.partitionBy(*names).orderBy(b).rowsBetween(Window.unboundedPreceding, -1))
    carry = ends.select(*(F.col(n).alias(f"c_{n}") for n in names), F.col(b).alias(f"c_{b}"), before.alias(carried))
    joined = within.join(carry, [F.col(n).eqNullSafe(F.col(f"c_{n}")) for n in [*names, b]], "left")
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(n).isNotNull()
    found = F.when(whole & F.col(at).isNotNull(), F.coalesce(last, carried))
    return joined.withColumn(value, found).select("row.*", *(F.col(f"{value}.{c}").alias(c) for c in columns))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of a point and a range low <= point < high, by buckets of ``width``.

    A range is repeated for each bucket that it touches: choose a width near the
    ranges' usual length. Nulls match nothing.
    """
    b = unique("bucket")
    cut = lambda c: F.floor(c / F.lit(width))
    spread = ranges.where(F.col(low) < F.col(high)).withColumn(b, F.explode(F.sequence(cut(F.col(low)), cut(F.col(high)))))
    return points.withColumn(b, cut(F.col(point))).join(spread, b).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop(b)
