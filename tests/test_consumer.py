"""Consumers, where positions are kept, and changes that a cursor cannot see."""

import logging

import pytest
from pyspark.sql import functions as F

from tidemark import Consumer, JsonCheckpointStore, SinkCheckpointStore


@pytest.fixture
def source(spark, lake):
    lake.table("s").write(spark.createDataFrame([(i, 10 * i) for i in range(4)], "k long, value long"))
    return lake.source("s")


def more(spark, source, *ks):
    source.append(spark.createDataFrame([(k, 0) for k in ks], "k long, value long"))


@pytest.fixture(params=["json", "sink"])
def store(request, lake, tmp_path):
    return JsonCheckpointStore(str(tmp_path / "c" / "p.json")) if request.param == "json" else SinkCheckpointStore(lake.create("sink", "v long"))


def test_poll_commit_resume(spark, source, store):
    c = Consumer(source, "c", store, start="earliest")
    assert c.position() is None and c.lag() == 4
    batch = c.poll()
    assert batch.num_rows == 4 and batch.offset == 3 and c.position() is None
    assert sorted(batch.pandas()["k"]) == [0, 1, 2, 3] and batch.arrow().num_rows == 4
    assert c.poll().offset == 3  # nothing was committed
    c.commit()
    assert c.poll() is None and c.lag() == 0 and c.position() == 3
    c.commit()
    more(spark, source, 4)
    again = Consumer(source, "c", store, start="earliest")
    assert [r.k for r in again.poll().data.collect()] == [4]
    other = Consumer(source, "other", store, start="earliest")
    assert other.poll().num_rows == 5


def test_starts(spark, source, store, lake):
    assert Consumer(source, "a", store).poll() is None
    assert Consumer(source, "b", store, start=1).poll().num_rows == 2
    empty = lake.create("empty", "_offset long, v long")
    late = Consumer(empty, "e", store)
    assert late.position() is None and late.lag() == 0 and late.poll() is None
    for bad in ("soon", 1.5, True):
        with pytest.raises(ValueError):
            Consumer(source, "d", store, start=bad)


def test_latest_is_that_of_the_first_time(spark, source, store):
    assert Consumer(source, "c", store).poll() is None
    more(spark, source, 4, 5)
    assert Consumer(source, "c", store).poll().num_rows == 2


def test_positions_before_columns(spark, source, lake):
    sink = lake.source("later")
    c = Consumer(source, "c", SinkCheckpointStore(sink), start="earliest")
    c.save()
    assert not sink.exists() and sink.read_offsets() == {"c": -1} and sink.read_all().columns == []
    sink.append(c.poll().data)
    assert sink.exists() and sink.read().count() == 4 and sink.read_offsets() == {"c": -1}


def test_seek_reset_are_kept_only_when_saved(source, store):
    c = Consumer(source, "c", store, start="earliest")
    c.poll()
    c.commit()
    c.seek(1)
    assert c.poll().num_rows == 2 and Consumer(source, "c", store).position() == 3
    c.reset()
    assert c.poll().num_rows == 4
    c.reset()
    c.save()
    # A reset is not "never committed": it stays earliest whatever the start is.
    assert Consumer(source, "c", store, start="latest").poll().num_rows == 4


@pytest.mark.parametrize("change,seen", [("append", False), ("compact", False), ("delete", True), ("update", True), ("upsert", True), ("overwrite", True)])
@pytest.mark.parametrize("how", ["warn", "error", "ignore"])
def test_changes_in_place(spark, source, tmp_path, caplog, change, seen, how):
    more(spark, source, 9)
    c = Consumer(source, "c", JsonCheckpointStore(str(tmp_path / "p")), start="earliest", on_change=how)
    c.poll()
    c.commit()
    rows = spark.createDataFrame([(1, 5)], "k long, value long")
    {"append": lambda: more(spark, source, 5), "compact": source.compact, "delete": lambda: source.delete("k = 1"), "overwrite": lambda: source.overwrite(rows),
     "update": lambda: source.update("k = 1", {"value": F.lit(7)}), "upsert": lambda: source.upsert(rows, ["k"])}[change]()
    with caplog.at_level(logging.WARNING, "tidemark"):
        if seen and how == "error":
            with pytest.raises(RuntimeError, match="cannot capture"):
                c.poll()
        else:
            c.poll()
        c.poll()
    assert len(caplog.records) == (seen and how == "warn")


def test_changes_between_processes(spark, source, store):
    c = Consumer(source, "c", store, start="earliest", on_change="error")
    c.poll()
    c.commit()
    source.delete("k = 0")
    with pytest.raises(RuntimeError):
        Consumer(source, "c", store, on_change="error").poll()


def test_unknown_choice(source, store):
    with pytest.raises(ValueError):
        Consumer(source, "c", store, on_change="panic")


def test_updates_and_deletes_are_missed(spark, source, store):
    c = Consumer(source, "c", store, start="earliest", on_change="ignore")
    c.poll()
    c.commit()
    source.update("k = 1", {"value": F.lit(7)})
    source.delete("k = 3")
    assert c.poll() is None and c.lag() == 0
    more(spark, source, 8)
    assert [r.k for r in c.poll().data.collect()] == [8]


def test_positions_survive_in_the_sink(lake):
    sink = lake.create("t", "v long")
    store = SinkCheckpointStore(sink)
    store.set("a", 5)
    store.set("b", None)
    assert (store.get("a"), store.get("b"), store.get("c")) == (5, -1, None) and sink.read().count() == 0
