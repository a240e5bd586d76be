"""One row per key: the latest by an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.sql import unique
from tidemark.sources.table_format import OFFSET


def _greatest(rows: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """Of each key the row with the greatest order. Combined before the shuffle, so
    a hot key costs a row for each task."""
    top = unique("top")
    rest = [c for c in columns if c not in keys]
    value = F.struct(*rest) if rest else F.lit(0)
    best = rows.groupBy(*keys).agg(F.max_by(value, order).alias(top))
    return best.select(*(F.col(c) if c in keys else F.col(top)[c].alias(c) for c in columns))


def _nulls_last(column: str) -> list[Column]:
    return [F.col(column).isNotNull(), F.col(column)]


def latest_by_key(rows: DataFrame, keys: list[str], order: str = OFFSET) -> DataFrame:
    """For each key the row with the greatest ``order``, null last; null keys are a key."""
    return _greatest(rows, keys, F.struct(*_nulls_last(order)), rows.columns)


def dedup_latest(rows: DataFrame, keys: list[str], order_by: str | None = None) -> DataFrame:
    """The last row for each key: by ``order_by``, then by the rows' own order.

    Rows keep their order only through row-wise steps; :func:`row_wise` tells.
    Rows with a null in their key are all kept, since they equal nothing.
    """
    place, alone = unique("place"), unique("alone")
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    placed = rows.withColumn(place, F.monotonically_increasing_id())
    placed = placed.withColumn(alone, F.when(whole, F.lit(-1)).otherwise(F.col(place)))
    order = F.struct(*(_nulls_last(order_by) if order_by else ()), F.col(place))
    return _greatest(placed, [*keys, alone], order, [*rows.columns, alone]).select(*rows.columns)


#: Steps of an analysed plan that keep rows where they are.
_ROW_WISE = ("Project", "Filter", "SubqueryAlias")


def row_wise(before: DataFrame, after: DataFrame) -> bool:
    """Whether ``after`` is ``before`` through projections and filters alone, which keep the rows' order.

    Anything else, also what is not known, may deal rows anew.
    """
    try:
        start, step = (d._jdf.queryExecution().analyzed() for d in (before, after))
    except AttributeError:  # a session without a JVM beside it
        return False
    while not step.fastEquals(start):
        if step.getClass().getSimpleName() not in _ROW_WISE:
            return False
        step = step.child()
    return True
