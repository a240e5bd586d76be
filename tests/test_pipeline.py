"""Models: incremental, exactly once, upserts, sessions, SQL, streaming sinks, gold by deltas."""

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import IncrementalAggregate, JsonCheckpointStore, LogTable, Pipeline, StaleWriter, Total, connect, dedup_latest, fingerprint, latest_by_key, session, sql
from tidemark.streaming.structured import into


def df(spark, *rows, schema="user_id long, value long"):
    return spark.createDataFrame(list(rows), schema)


def got(rows):
    return sorted(tuple(r) for r in rows.collect())


def test_readme_path(spark, lake):
    lake.table("db.events").write(df(spark, (1, 50), (2, 150), (3, 250)))
    seen = []

    @lake.model(source="db.events", sink="db.silver", start="earliest")
    def silver(d):
        seen.append(d.columns)
        return d.where("value > 100")

    assert silver.run(once=True) == 3 and silver.run(once=True) == 0
    assert got(lake.table("db.silver").read()) == [(2, 150), (3, 250)] and seen == [["user_id", "value"]]
    lake.write("db.events", pd.DataFrame({"user_id": [4], "value": [90]})).write(pa.table({"user_id": [5], "value": [500]}))
    assert silver.lag() == 2 and silver.run(once=True) == 2 and silver.position() == 4
    assert got(lake.table("db.silver").read()) == [(2, 150), (3, 250), (5, 500)]
    assert lake.source("db.silver").read_offsets() == {"silver": 4}
    assert lake.table("db.silver").format.path.endswith("/db/silver") and lake.exists("db.silver") and not lake.exists("nope")


def test_resume_from_the_sink_after_a_crash(spark, lake, tmp_path, monkeypatch):
    lake.table("s").write(df(spark, *((i, i) for i in range(100))))

    def model(db, **how):
        return Pipeline(db.source("s"), db.source("t"), lambda d: d, "copy", start="earliest", **how)

    p = model(lake)
    monkeypatch.setattr(p.consumer, "seek", lambda o: 1 / 0)  # dies right after the commit
    with pytest.raises(ZeroDivisionError):
        p.step()
    fresh = connect(spark, str(tmp_path / "lake"))
    assert model(fresh).step() == 0 and fresh.table("t").read().count() == 100
    # The contrast: positions beside the sink repeat the batch.
    store = JsonCheckpointStore(str(tmp_path / "p.json"))
    q = Pipeline(lake.source("s"), lake.source("u"), lambda d: d, "copy", start="earliest", checkpoint=store)
    monkeypatch.setattr(q.consumer, "save", lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        q.step()
    Pipeline(lake.source("s"), lake.source("u"), lambda d: d, "copy", start="earliest", checkpoint=store).step()
    assert lake.table("u").read().count() == 200


def test_two_runs_of_one_name(spark, lake):
    lake.table("s").write(df(spark, (1, 1)))
    a, b = (Pipeline(lake.source("s"), lake.source("t"), lambda d: d, "copy", start="earliest") for _ in range(2))
    a.step()
    with pytest.raises(StaleWriter):
        b.sink.append(df(spark, (1, 1)), {"copy": 0}, {"copy": None})
    b.consumer.seek(None)
    b.step()  # a position that was sought is written over the sink's
    assert lake.table("t").read().count() == 2


def test_batch_that_loses_all_rows_still_moves(spark, lake):
    lake.table("s").write(df(spark, (1, 1)))
    m = lake.model(source="s", sink="t", start="earliest", name="m")(lambda d: d.where("false"))
    assert m.run(once=True) == 1 and m.run(once=True) == 0 and lake.table("t").read().columns == ["user_id", "value"]


def test_max_batches_and_loops(spark, lake):
    lake.table("s").write(df(spark, (1, 1)))
    m = lake.model(source="s", sink="t", start="earliest", name="m")(lambda d: d)
    assert m.run(max_batches=1, idle_sleep=0) == 1


def test_upsert(spark, lake):
    lake.table("s").write(df(spark, ("K", 1), ("M", 100), schema="id string, value long"))
    m = lake.model(source="s", sink="t", start="earliest", mode="upsert", key="id", on_change="error", name="m")(lambda d: d)
    m.run(once=True)
    lake.table("s").write(df(spark, ("K", 2), ("K", 3), (None, 7), (None, 8), schema="id string, value long"))
    m.run(once=True)
    assert got(lake.table("t").read().where("id is not null")) == [("K", 3), ("M", 100)]
    assert lake.table("t").read().where("id is null").count() == 2
    assert lake.source("t").read_offsets()["m"] == 5


def test_upsert_keeps_the_last_of_many(spark, lake):
    rows = spark.range(5000, numPartitions=7).select((F.col("id") % 100).alias("k"), F.col("id").alias("v"))
    lake.table("s").write(rows)
    lake.model(source="s", sink="t", start="earliest", mode="upsert", key=["k"], name="m")(lambda d: d.where("v % 3 > 0").withColumn("w", F.lit(1))).run(once=True)
    want = rows.where("v % 3 > 0").groupBy("k").agg(F.max("v"))
    assert got(lake.table("t").read().select("k", "v")) == got(want)


def test_upsert_wants_an_order_after_a_shuffle(spark, lake):
    lake.table("s").write(df(spark, (1, 1), (1, 2)))
    grouped = lambda d: d.groupBy("user_id", "value").count().drop("count")
    with pytest.raises(ValueError, match="order_by"):
        lake.model(source="s", sink="t", start="earliest", mode="upsert", key="user_id", name="a")(grouped).run(once=True)
    last = W.partitionBy("user_id").orderBy("value")
    same = lambda f: f
    dealt = [
        lambda d: d.groupBy("value").applyInPandas(same, d.schema), lambda d: d.union(d.limit(0)), lambda d: d.withColumn("n", F.row_number().over(last)).drop("n"),
        lambda d: d.sortWithinPartitions("value"), lambda d: d.repartition(2), lambda d: d.distinct(), lambda d: d.join(d.select("value").distinct(), "value").select("user_id", "value"),
        lambda d: d.mapInPandas(same, d.schema), lambda d: spark.createDataFrame(d.toPandas()), lambda d: d.limit(1),
    ]
    for k, f in enumerate(dealt):
        with pytest.raises(ValueError, match="order_by"):
            lake.model(source="s", sink="t", start="earliest", mode="upsert", key="user_id", name=f"c{k}")(f).run(once=True)
    assert not lake.exists("t")
    row_wise = lambda d: d.alias("x").where("x.value < 9").withColumn("w", F.upper(F.lit("a"))).select("user_id", "value").filter("w = 'A'").withColumnRenamed("value", "v").select("user_id", F.col("v").alias("value"))
    lake.model(source="s", sink="u", start="earliest", mode="upsert", key="user_id", name="d")(row_wise).run(once=True)
    assert got(lake.table("u").read()) == [(1, 2)]
    lake.model(source="s", sink="t", start="earliest", mode="upsert", key="user_id", order_by="value", name="b")(grouped).run(once=True)
    assert got(lake.table("t").read()) == [(1, 2)]


def test_bad_modes(lake):
    with pytest.raises(ValueError, match="requires key"):
        lake.model(source="s", sink="t", mode="upsert")(lambda d: d)
    with pytest.raises(ValueError):
        lake.model(source="s", sink="t", mode="cdc")(lambda d: d)
    with pytest.raises(ValueError):
        connect(None, "/x", format="csv")
    with pytest.raises(ValueError):
        connect(None, "/x", checkpoint="db")


def test_other_formats_need_their_packages(spark, tmp_path):
    with pytest.raises(ImportError):
        connect(spark, str(tmp_path), format="delta").table("a.b").read()


def test_models_run_in_order_of_their_tables(spark, lake):
    lake.model(source="silver", sink="gold", start="earliest", name="second")(lambda d: d)
    lake.model(source="bronze", sink="silver", start="earliest", name="first")(lambda d: d)
    lake.table("bronze").write(df(spark, (1, 1)))
    assert [m.name for m in lake.ordered()] == ["first", "second"] and lake.run_all() == 2
    assert got(lake.table("gold").read()) == [(1, 1)]


def test_session_of_ones_own(spark, tmp_path):
    s = session(spark, lambda name: LogTable(spark, str(tmp_path / name)), checkpoint=str(tmp_path / "p.json"))
    s.table("a").write(df(spark, (1, 1)))
    m = s.model(source="a", sink="b", start="earliest", name="m")(lambda d: d)
    m.run(once=True)
    assert JsonCheckpointStore(str(tmp_path / "p.json")).get("m") == 0 and s.source("b").read_offsets() == {}
    assert s.source(s.source("a")) is s.source("a")


def test_sql_names_are_private(spark):
    spark.range(3).createOrReplaceTempView("t")
    assert sql("SELECT count(*) AS n FROM t JOIN u USING (id)", t=spark.range(10), u=spark.range(5)).first().n == 5
    assert spark.table("t").count() == 3 and "u" not in [t.name for t in spark.catalog.listTables()]
    later = sql("SELECT id FROM v", v=spark.range(4))
    assert later.count() == 4
    with pytest.raises(Exception):
        sql("SELECT * FROM nothing", v=spark.range(1))
    assert "v" not in [t.name for t in spark.catalog.listTables()]
    spark.catalog.dropTempView("t")
    assert sql("SELECT 1 AS one").first().one == 1


def test_gold_by_deltas_equals_a_recount(spark, lake):
    totals = {"total": Total("sum", "value"), "n": Total("count"), "least": Total("min", "value"), "most": Total("max", "value")}
    gold = IncrementalAggregate(lake.source("s"), lake.source("g"), ["user_id"], totals, "g")
    for k in range(4):
        lake.table("s").write(spark.range(50).select((F.col("id") % 7).alias("user_id"), (F.col("id") * (k + 1)).alias("value")))
        assert gold.step() == 50 * (k + 1) - 1
        assert gold.step() is None
    want = lake.table("s").read().groupBy("user_id").agg(F.sum("value"), F.count("*"), F.min("value"), F.max("value"))
    assert got(lake.table("g").read().select("user_id", "total", "n", "least", "most")) == got(want)
    names = ["user_id", "total", "n"]
    assert fingerprint(lake.table("g").read(), names) == fingerprint(want.toDF("user_id", "total", "n", "a", "b"), names)
    again = IncrementalAggregate(lake.source("s"), lake.source("g"), ["user_id"], totals, "g")
    assert again.step() is None
    with pytest.raises(ValueError):
        IncrementalAggregate(lake.source("s"), lake.source("h"), ["user_id"], {"a": Total("avg", "value")}, "h").step()


def test_latest(spark):
    rows = df(spark, (1, "a", 1), (1, "b", 3), (1, "c", 2), (2, "d", None), (None, "e", 1), (None, "f", 2), schema="k long, v string, _offset long")
    assert got(latest_by_key(rows, ["k"]).where("k is not null").select("k", "v")) == [(1, "b"), (2, "d")]
    assert latest_by_key(rows, ["k"]).columns == rows.columns and latest_by_key(rows, ["k"]).count() == 3
    assert got(dedup_latest(rows, ["k"], "_offset").where("k is not null").select("k", "v")) == [(1, "b"), (2, "d")]
    assert dedup_latest(rows, ["k"], "_offset").count() == 4


def test_streaming_batches_are_taken_once(spark, lake):
    write = into(lake.source("t"), "q")
    write(df(spark, (1, 1)), 0)
    write(df(spark, (1, 1)), 0)
    write(df(spark, (2, 2)), 1)
    assert got(lake.table("t").read()) == [(1, 1), (2, 2)] and lake.source("t").read_offsets() == {"q": 1}
