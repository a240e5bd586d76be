"""The commit log: atomic commits, minting, range reads, rewrites, races."""

import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import CommitConflict, LogTable, StaleWriter, TableFormat
from tidemark.sources import log_table as module


@pytest.fixture
def table(spark, tmp_path):
    return LogTable(spark, str(tmp_path / "t"))


def rows(spark, *values, schema="k string, value long"):
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)


def got(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_is_a_table_format(table):
    assert isinstance(table, TableFormat)


def test_missing_table(table):
    assert not table.exists() and table.read_all().columns == [] and table.read_offsets() == {}
    assert table.earliest_offset() is None and table.latest_offset() is None and table.marker() is None
    assert table.read_since(None)[1] is None and table.read_since(7)[1] == 7


def test_minting_is_dense_and_ordered(spark, table):
    table.append(spark.range(100, numPartitions=3).toDF("v"))
    table.append(spark.range(100, 130, numPartitions=4).toDF("v"))
    assert got(table.read_all(), "_offset", "v") == [(i, i) for i in range(130)]
    assert (table.earliest_offset(), table.latest_offset()) == (0, 129)
    assert table.read().columns == ["v"] and table.schema.names == ["_offset", "v"]


def test_range_reads(spark, table):
    for lo in range(0, 100, 20):
        table.append(spark.range(lo, lo + 20).toDF("v"))
    for lo, hi in [(None, None), (-1, None), (5, None), (5, 5), (5, 6), (19, 20), (38, 61), (98, None), (99, None), (None, 0), (40, 200)]:
        df, top = table.read_since(lo, hi)
        want = [v for v in range(100) if (lo is None or v > lo) and (hi is None or v <= hi)]
        assert got(df, "_offset", "v") == [(v, v) for v in want]
        assert top == (max(want) if want else lo) and table.count_since(lo, hi) == len(want)


def test_range_read_prunes_files(spark, table):
    for k in range(6):
        table.append(spark.range(10, numPartitions=1).toDF("v"))
    df, _ = table.read_since(24, 35)
    assert len(df.inputFiles()) == 2


def test_explicit_offsets_may_have_gaps(spark, table):
    table.append(rows(spark, (10, 1), (20, 2), (35, 3), schema="_offset long, v long"))
    table.append(rows(spark, 4, schema="v long"))
    assert got(table.read_all(), "_offset", "v") == [(10, 1), (20, 2), (35, 3), (36, 4)]
    assert table.read_since(None, 30)[1] == 20 and table.read_since(10, 19)[1] == 10
    assert table.count_since(10, 35) == 2 and table.read_since(35)[1] == 36


def test_dimension_table_gets_no_offsets(spark, table):
    table.create(T.StructType([T.StructField("country", T.StringType()), T.StructField("rate", T.DoubleType())]))
    table.append(rows(spark, ("US", 1.0), ("GB", 2.0), schema="country string, rate double"))
    table.upsert(rows(spark, ("GB", 3.0), ("DE", 4.0), schema="country string, rate double"), ["country"])
    assert table.read_all().columns == ["country", "rate"] and got(table.read_all()) == [("DE", 4.0), ("GB", 3.0), ("US", 1.0)]
    with pytest.raises(ValueError):
        table.read_since(None)


def test_columns_go_by_name_and_must_agree(spark, table):
    table.append(rows(spark, ("a", 1)))
    table.append(spark.createDataFrame([(2, "b")], "value int, k string"))
    assert got(table.read(), "k", "value") == [("a", 1), ("b", 2)]
    for bad in (rows(spark, "a", schema="k string"), rows(spark, ("a", 1, 2), schema="k string, value long, x long")):
        with pytest.raises(ValueError):
            table.append(bad)


def test_rows_and_position_are_one_commit(spark, table, monkeypatch):
    table.append(rows(spark, ("a", 1)), {"r": 5})
    monkeypatch.setattr(table.store, "put_if_absent", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.append(rows(spark, ("b", 2)), {"r": 6})
    monkeypatch.undo()
    again = LogTable(spark, table.path)
    assert got(again.read()) == [("a", 1)] and again.read_offsets() == {"r": 5}
    again.commit_offsets({"s": 1})
    assert LogTable(spark, table.path).read_offsets() == {"r": 5, "s": 1}


def test_fencing(spark, table):
    table.append(rows(spark, ("a", 1)), {"r": 5}, {"r": None})
    with pytest.raises(StaleWriter):
        table.append(rows(spark, ("a", 1)), {"r": 5}, {"r": None})
    table.append(rows(spark, ("b", 1)), {"r": 6}, {"r": 5})
    assert table.read().count() == 2


def test_writers_race(spark, tmp_path):
    """Six writers of one table: no row is lost, offsets stay dense."""
    path = str(tmp_path / "t")
    LogTable(spark, path).append(spark.createDataFrame([], "writer long, value long"))

    def write(w):
        t = LogTable(spark, path)
        for k in range(3):
            t.append(spark.range(20).select(F.lit(w).cast("long").alias("writer"), (F.col("id") + k * 20).alias("value")))

    threads = [threading.Thread(target=write, args=(w,)) for w in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    found = LogTable(spark, path).read_all()
    assert got(found, "_offset") == [(i,) for i in range(360)]
    assert found.select("writer", "value").distinct().count() == 360


def test_one_version_has_one_winner(tmp_path):
    from tidemark.sources.log_store import LocalStore

    store, won = LocalStore(), []

    def put(k):
        if store.put_if_absent(str(tmp_path / "log" / "1.json"), str(k).encode()):
            won.append(k)

    threads = [threading.Thread(target=put, args=(k,)) for k in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and store.read(str(tmp_path / "log" / "1.json")) == str(won[0]).encode()
    assert store.names(str(tmp_path / "log")) == ["1.json"]


def test_retry_gives_up(monkeypatch):
    monkeypatch.setattr(module.time, "sleep", lambda s: None)
    tries = []

    def lose():
        tries.append(1)
        raise CommitConflict

    with pytest.raises(CommitConflict):
        module.retrying(lose)
    assert len(tries) == module.TRIES


def test_upsert_rewrites_only_touched_files(spark, table):
    table.append(rows(spark, ("a", 1), ("b", 2)).coalesce(1))
    table.append(rows(spark, ("c", 3), (None, 4)).coalesce(1))
    untouched = [p for p, f in table.state().files.items() if f["min"] >= 2]
    table.upsert(rows(spark, ("a", 10), ("d", 40), (None, 50)), ["k"], {"r": 9})
    assert got(table.read_all().where("k is not null"), "k", "value", "_offset") == [("a", 10, 4), ("b", 2, 1), ("c", 3, 2), ("d", 40, 5)]
    assert table.read_all().where("k is null").count() == 2 and table.read_offsets() == {"r": 9}
    assert set(untouched) <= set(table.state().files)
    before = got(table.read().where("k is not null"))
    table.upsert(rows(spark, ("a", 10)), ["k"])
    assert got(table.read().where("k is not null")) == before


def test_delete_update_compact(spark, table):
    for k in "abcd":
        table.append(rows(spark, (k, 1), (k, 2)).coalesce(1))
    at = table.marker()
    table.compact(2)
    assert table.changes_since(at)[0] == [] and len(table.state().files) == 2
    table.delete("k = 'd' and value = 2")
    assert table.latest_offset() == 6 and table.high_water() == 7
    table.update("k = 'a'", {"value": F.col("value") * 10})
    assert got(table.read_all(), "_offset", "k", "value") == [(0, "a", 10), (1, "a", 20), (2, "b", 1), (3, "b", 2), (4, "c", 1), (5, "c", 2), (6, "d", 1)]
    assert table.changes_since(at)[0] == ["delete", "update"]
    table.append(rows(spark, ("e", 1)))
    assert table.latest_offset() == 8
    version = table.marker()
    table.delete("k = 'zz'")
    assert table.marker() == version


def test_null_condition_keeps_the_row(spark, table):
    table.append(rows(spark, ("a", None), ("b", 1)))
    table.delete("value = 1")
    assert got(table.read(), "k") == [("a",)]


def test_overwrite_and_versions(spark, table):
    table.append(rows(spark, ("a", 1)))
    table.overwrite(rows(spark, ("b", 2)), {"g": 3})
    assert got(table.read()) == [("b", 2)] and table.read_offsets() == {"g": 3}
    assert got(table.read_all(1).select("k", "value")) == [("a", 1)]
    with pytest.raises(ValueError):
        table.read_all(99)


def test_changes_between_versions(spark, table):
    table.append(rows(spark, ("a", 1), ("b", 2), ("c", 3)))
    at = table.marker()
    table.update("k = 'b'", {"value": F.lit(99)})
    table.delete("k = 'c'")
    table.append(rows(spark, ("d", 4)))
    inserts, updates, deletes, version = table.read_changes(at, ["k"])
    assert (got(inserts), got(updates), got(deletes), version) == ([("d", 4)], [("b", 99)], [("c", 3)], table.marker())


def test_saved_state_equals_the_log(spark, table, monkeypatch):
    monkeypatch.setattr(module, "CHECKPOINT", 3)
    for k in range(8):
        table.append(rows(spark, ("a", k)), {"r": k})
    table.delete("value = 2")
    assert any(n.endswith(".state") for n in table.store.names(f"{table.root}/_log"))
    again = LogTable(spark, table.path)
    assert again.state().__dict__ == table.state().__dict__ and again.read().count() == 7
    for n in Path(table.root, "_log").glob("*.state"):
        n.unlink()
    assert LogTable(spark, table.path).state().__dict__ == again.state().__dict__


def test_many_files_use_a_join(spark, table, monkeypatch):
    monkeypatch.setattr(module, "LITERAL_FILES", 2)
    monkeypatch.setattr(module, "FOOTERS", 0)
    table.append(spark.range(50, numPartitions=5).toDF("v"))
    assert got(table.read_all(), "_offset", "v") == [(i, i) for i in range(50)]
    table.append(rows(spark, (90, 1), schema="_offset long, v long"))
    assert table.latest_offset() == 90


def test_empty_appends_commit_positions(spark, table):
    table.append(rows(spark, ("a", 1)))
    table.append(rows(spark, ("a", 1)).where("false"), {"r": 1})
    assert table.read_offsets() == {"r": 1} and table.read().count() == 1
    entry = json.loads(table.store.read(table._entry(2)))
    assert entry["add"] == [] and entry["op"] == "append"


def test_hadoop_store(spark, tmp_path):
    from tidemark.sources.log_store import HadoopStore

    store, path = HadoopStore(spark), f"file://{tmp_path}/x/1.json"
    assert store.names(f"file://{tmp_path}/x") == [] and store.read(path) is None
    assert store.put_if_absent(path, b"\x00one") and not store.put_if_absent(path, b"two")
    assert store.read(path) == b"\x00one" and store.names(f"file://{tmp_path}/x") == ["1.json"]
    store.replace(path, b"three")
    assert store.read(path) == b"three" and store.names(f"file://{tmp_path}/x") == ["1.json"]


def test_old_changes_are_read_from_the_log(spark, table, monkeypatch):
    monkeypatch.setattr(module, "OPS", 2)
    table.append(rows(spark, ("a", 1), ("b", 2)))
    at = table.marker()
    for k in range(4):
        table.update("k = 'a'", {"value": F.lit(k + 7)})
    table.delete("k = 'b'")
    assert len(table.state().ops) == 2
    assert table.changes_since(at) == (["update"] * 4 + ["delete"], at + 5) and table.changes_since(at + 2)[0] == ["update", "update", "delete"]
    assert LogTable(spark, table.path).changes_since(None)[0] == ["update"] * 4 + ["delete"]


def test_upserts_read_only_files_that_may_have_their_keys(spark, table, monkeypatch):
    for k in "aceg":
        table.upsert(rows(spark, (k, 1), (f"{k}z", 1), (None, 0)).coalesce(1), ["k"])
    read = []
    scan = LogTable._scan
    monkeypatch.setattr(LogTable, "_scan", lambda self, paths, *a, **w: read.append(len(paths)) or scan(self, paths, *a, **w))
    table.upsert(rows(spark, ("c", 5), ("d", 6)), ["k"])
    assert read[0] == 1
    read.clear()
    table.upsert(rows(spark, ("h", 1)), ["k"])
    assert read == []
    monkeypatch.undo()
    assert got(table.read().where("k is not null")) == [("a", 1), ("az", 1), ("c", 5), ("cz", 1), ("d", 6), ("e", 1), ("ez", 1), ("g", 1), ("gz", 1), ("h", 1)]
    assert table.read().where("k is null").count() == 4


def test_states_wait_where_there_are_many_files(spark, table, monkeypatch):
    monkeypatch.setattr(module, "CHECKPOINT", 2)
    monkeypatch.setattr(module, "FILES_A_VERSION", 1)
    for k in range(12):
        table.append(rows(spark, ("a", k)))
    kept = [int(n[:20]) for n in table.store.names(f"{table.root}/_log") if n.endswith(".state")]
    assert kept and all(b - a >= a / 2 for a, b in zip(kept, kept[1:])) and LogTable(spark, table.path).read().count() == 12


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from tidemark.sources import scratch

    on = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master=master, applicationId="x"))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            scratch.scratch_root(on(master))
    assert scratch.scratch_root(on("local[4]")).startswith("file://")


def test_tables_of_other_stores(spark, tmp_path, monkeypatch):
    """As on a store that only Hadoop's file systems reach."""
    from tidemark.sources.log_store import HadoopStore

    monkeypatch.setattr(module, "store_for", lambda s, uri: (HadoopStore(s), uri))
    monkeypatch.setattr(module, "local_path", lambda uri: None)
    t = LogTable(spark, f"file://{tmp_path}/t")
    t.append(rows(spark, ("a", 1), ("b", 2)), {"r": 1})
    t.append(rows(spark, (9, "c", 3), schema="_offset long, k string, value long"))
    t.upsert(rows(spark, ("b", 20)), ["k"])
    again = LogTable(spark, f"file://{tmp_path}/t")
    assert got(again.read_all(), "_offset", "k", "value") == [(0, "a", 1), (9, "c", 3), (10, "b", 20)]
    assert again.read_offsets() == {"r": 1} and again.read_since(0)[1] == 10
