"""What the adapters share, over a stand-in for a table: fencing, minting again after a conflict, settings of one commit."""

import threading

import pytest
from pyspark.sql import functions as F

from tidemark.sources import adapters, log_table
from tidemark.sources.table_format import CommitConflict, StaleWriter


class ConcurrentAppendException(Exception):
    pass


class StandIn(adapters._SparkTable):
    """Rows and positions in lists; ``between`` runs after offsets are minted and before the commit."""

    def __init__(self, spark):
        super().__init__(spark, "_offset")
        self.rows, self.positions, self.version, self.between = [], {}, 0, []

    def exists(self):
        return bool(self.rows)

    def read_all(self):
        return self.spark.createDataFrame(self.rows, "_offset long, v long")

    def read_offsets(self):
        return dict(self.positions)

    def append(self, data, offsets=None, expect=None):
        def write(rows, base):
            seen = self.version
            found = [tuple(r) for r in rows.collect()]
            if self.between:
                self.between.pop()()
            if self.version != seen:
                raise ConcurrentAppendException("files were added")
            self.rows += found
            self.positions |= offsets or {}
            self.version += 1

        self._commit(data, expect, write)


def test_offsets_are_minted_again_after_a_conflict(spark, monkeypatch):
    monkeypatch.setattr(log_table.time, "sleep", lambda s: None)
    t = StandIn(spark)
    t.append(spark.range(3).toDF("v"), {"r": 1})
    t.between = [lambda: t.append(spark.range(10, 12).toDF("v"))]
    t.append(spark.range(20, 23, numPartitions=2).toDF("v"))
    assert sorted(t.rows) == [(0, 0), (1, 1), (2, 2), (3, 10), (4, 11), (5, 20), (6, 21), (7, 22)]
    t.between = [lambda: t.append(spark.range(1).toDF("v"))] * 20
    t.between = [lambda: setattr(t, "version", t.version + 1)] * 20
    with pytest.raises(CommitConflict):
        t.append(spark.range(1).toDF("v"))


def test_a_writer_that_was_overtaken_is_refused(spark, monkeypatch):
    monkeypatch.setattr(log_table.time, "sleep", lambda s: None)
    t = StandIn(spark)
    t.append(spark.range(1).toDF("v"), {"r": 1}, {"r": None})
    with pytest.raises(StaleWriter):
        t.append(spark.range(1).toDF("v"), {"r": 2}, {"r": None})
    t.between = [lambda: t.append(spark.range(1).toDF("v"), {"r": 5}, {"r": 1})]
    with pytest.raises(StaleWriter):  # the other run of the name commits while this one writes
        t.append(spark.range(1).toDF("v"), {"r": 2}, {"r": 1})
    t.append(spark.range(1).toDF("v"), {"r": 9}, {"r": log_table.ANY})
    assert t.positions == {"r": 9} and len(t.rows) == 3


def test_other_errors_are_not_tried_again(spark):
    t = StandIn(spark)
    calls = []

    def fails(rows, base):
        calls.append(1)
        raise ValueError("disk full")

    with pytest.raises(ValueError):
        t._commit(spark.range(1).toDF("v"), None, fails)
    assert calls == [1]


def test_positions_of_two_threads_stay_apart(spark):
    """The setting that carries positions belongs to the session; each commit must see its own."""
    t = object.__new__(adapters.DeltaFormat)
    t.spark, key, seen = spark, "spark.databricks.delta.commitInfo.userMetadata", []

    def commit(k):
        for _ in range(20):
            t._noting({f"r{k}": k}, lambda: seen.append((k, spark.conf.get(key))))

    threads = [threading.Thread(target=commit, args=(k,)) for k in range(4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert len(seen) == 80 and all(text == f'{{"{adapters.PREFIX}r{k}": "{k}"}}' for k, text in seen) and spark.conf.get(key, None) is None


def test_ranges(spark):
    t = StandIn(spark)
    assert t.latest_offset() is None
    t.append(spark.range(5).toDF("v"))
    rows, top = t.read_since(1, 3)
    assert sorted(r.v for r in rows.collect()) == [2, 3] and top == 3 and t.earliest_offset() == 0
    assert t.read_since(4)[1] == 4 and t.read_all().agg(F.max("_offset")).first()[0] == 4
