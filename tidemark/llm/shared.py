"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import remove_tree, scratch_path

#: White space of the word patterns: space, tab, \n, \v, \f, \r.
BLANKS = " \t\n\x0b\x0c\r"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage is cut at replicated files, so a lost executor costs nothing
    that was written.
    """
    spark = df.sparkSession
    uri = scratch_path(spark, label)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


class Written:
    """Tables on the way to a result, deleted together once that is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.uris = spark, []

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """As :func:`materialize`."""
        self.uris.append(scratch_path(self.spark, label))
        df.write.parquet(self.uris[-1])
        return self.spark.read.schema(df.schema).parquet(self.uris[-1])

    def drop(self) -> None:
        """Nothing may read them afterwards."""
        for uri in self.uris:
            remove_tree(self.spark, uri)
        self.uris = []


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Projections that Catalyst merges would otherwise evaluate an expression
    again for each element of a lambda that mentions it.
    """
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
