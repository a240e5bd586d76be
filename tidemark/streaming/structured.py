"""Structured Streaming queries that end in a table, exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.sources.table_format import TableFormat


def into(sink: TableFormat, name: str) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: rows and batch number are one commit of the sink.

    A batch that Spark sends again after a crash is found in the sink and passed over.
    """

    def write(rows: DataFrame, batch: int) -> None:
        done = sink.read_offsets().get(name)
        if done is None or batch > done:
            sink.append(rows, {name: batch}, {name: done})

    return write
