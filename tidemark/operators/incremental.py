"""Running totals: what a batch adds to an aggregate, without reading the rest again."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.streaming.consumer import Consumer

#: How partial results of each kind are combined.
MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


@dataclass
class Total:
    """One output column: ``kind`` is sum, count, min or max of ``value``."""

    kind: str
    value: Column | str | None = None

    def of_row(self) -> Column:
        """What one row adds."""
        if self.kind not in MERGE:
            raise ValueError(f"{self.kind!r} cannot be merged from parts; use {', '.join(MERGE)}")
        v = None if self.value is None else F.expr(self.value) if isinstance(self.value, str) else self.value
        if self.kind == "count":
            return F.lit(1).cast("long") if v is None else F.when(v.isNotNull(), 1).otherwise(0).cast("long")
        return v


def _small(table, *span) -> bool:
    return hasattr(table, "small") and table.small(*span)


def merge_totals(running: DataFrame | None, batch: DataFrame, keys: list[str], totals: dict[str, Total], few: bool = False) -> DataFrame:
    """Running totals brought up to date by a batch's rows, in one aggregation.

    Rows are combined before the one shuffle there is; with ``few`` one task has them all and there is
    none. min and max hold for sources that only grow.
    """
    both = batch.select(*keys, *(t.of_row().alias(name) for name, t in totals.items()))
    if running is not None:
        both = running.select(*both.columns).unionByName(both)
    both = both.coalesce(1) if few else both
    return both.groupBy(*keys).agg(*(MERGE[t.kind](name).alias(name) for name, t in totals.items()))


class IncrementalAggregate:
    """A gold table kept up to date from a source's new rows.

    A step polls the source, shapes the batch (``prepare``: for example a join with a dimension as it is
    now), adds it to the sink's totals, and overwrites the sink
    together with the position, in one commit. Two steps of one name
    cannot both win: the commit expects the position that the step began with.
    """

    def __init__(self, source, sink, keys: list[str], totals: dict[str, Total], name: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d, start: str | int = "earliest", on_change: str = "warn"):
        from tidemark.streaming.checkpoint import SinkCheckpointStore

        self.sink, self.keys, self.totals, self.name, self.prepare = sink, keys, totals, name, prepare
        self.consumer = Consumer(source, name, SinkCheckpointStore(sink), start=start, on_change=on_change)

    def step(self) -> int | None:
        """Take in what is new; the offset reached, or None if nothing was."""
        stored = self.sink.read_offsets().get(self.name)
        if stored is not None and stored >= 0:
            self.consumer.seek(stored)
        before = self.consumer.position()
        batch = self.consumer.poll()
        if batch is None:
            return None
        running = self.sink.read() if self.sink.exists() else None
        few = _small(self.consumer.source, before, batch.offset) and (running is None or _small(self.sink))
        merged = merge_totals(running, self.prepare(batch.data), self.keys, self.totals, few)
        if not self.sink.exists():
            self.sink.create(merged.schema)
        self.sink.overwrite(merged, self.consumer.stored(batch.offset), {self.name: stored})
        self.consumer.seek(batch.offset)
        return batch.offset


def fingerprint(rows: DataFrame, columns: list[str]) -> str:
    """sha256 of the rows as comma-joined lines in order of the first column.

    For aggregates of a size that a report can have: the lines meet on one executor.
    """
    line = F.concat_ws(",", *(F.col(c).cast("string") for c in columns))
    one = rows.select(F.struct(F.col(columns[0]).alias("k"), line.alias("line")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("all"))
    found = one.select(F.sha2(F.array_join(F.transform("all", lambda x: x["line"]), "\n"), 256)).first()[0]
    return found or hashlib.sha256(b"").hexdigest()
