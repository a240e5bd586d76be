"""From raw documents to packed sequences: five stages, each one operator.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and its
result is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, packing, quality_rules, repeats, simhash
from tidemark.llm.shared import materialize, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    good = quality_rules.keep_good(docs)
    return good.withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_single(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(docs, threshold=repeats.PASSAGE_WORDS, unit="words")
    return cut.withColumn("n_chars", F.char_length("text").cast("long"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, added=True)


STAGES = [
    ("quality rules", rules),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: Fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
