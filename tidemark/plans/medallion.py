"""The flagship plan: two bronze logs, two silver tables, one gold table kept by deltas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.incremental import IncrementalAggregate, Total
from tidemark.sources.table_format import OFFSET
from tidemark.streaming.pipeline import Session, connect

CAP = 100
TOTALS = {"total_cents": Total("sum", "cents"), "n_rows": Total("count")}


def bronze_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as a log: the event's number is its offset."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn(OFFSET, F.col("event_id"))


def bronze_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("country"))


def clean(events: DataFrame) -> DataFrame:
    return events.where((F.col("value") > 0) & (F.col("value") < CAP))


@dataclass
class Medallion:
    """The tables and steps of one run; ``cycle`` moves all of them on by one batch."""

    lake: Session

    def __post_init__(self) -> None:
        lake = self.lake

        @lake.model(source="bronze.events", sink="silver.events", start="earliest", name="silver_events")
        def silver_events(events):
            return clean(events)

        @lake.model(source="bronze.users", sink="silver.users", start="earliest", mode="upsert", key="user_id", name="silver_users")
        def silver_users(users):
            return users

        self.gold = IncrementalAggregate(
            lake.source("silver.events"), lake.source("gold.countries"), ["country"], TOTALS, "gold_countries", self._with_country
        )

    def _with_country(self, events: DataFrame) -> DataFrame:
        users = self.lake.table("silver.users").read()
        cents = F.round(F.col("value") * 100).cast("long").alias("cents")
        return events.select("user_id", cents).join(users, "user_id").select("country", "cents")

    def cycle(self) -> int | None:
        self.lake.models["silver_users"].run(once=True)
        self.lake.models["silver_events"].run(once=True)
        return self.gold.step()

    def result(self) -> DataFrame:
        return self.lake.table("gold.countries").read().select("country", "total_cents", "n_rows")


def medallion(spark: SparkSession, warehouse: str) -> Medallion:
    return Medallion(connect(spark, warehouse))


def parts(spark: SparkSession, sf_dir: str, cycles: int) -> list[DataFrame]:
    """The events as a first load of half of them and ``cycles`` deltas, by ranges of offsets."""
    events = bronze_events(spark, sf_dir)
    top = events.agg(F.max(OFFSET)).first()[0]
    edges = [-1, *(top // 2 + (top - top // 2) * k // cycles for k in range(cycles + 1))]
    return [events.where((F.col(OFFSET) > a) & (F.col(OFFSET) <= b)) for a, b in zip(edges, edges[1:], strict=False)]
