"""One query for each operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, html_extract, nbsvm, oracles, packing, quality_rules, repeats, simhash, token_counts, warc
from tidemark.llm.shared import materialize, table
from tidemark.sources.scratch import scratch_path


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted, those labelled bad deleted, others revised to hold each line once.

    The second sending of a batch changes nothing.
    """
    docs = table(spark, sf_dir, "documents")
    counts = materialize(token_counts.count_tokens(docs, added=True), "token-counts")
    bad = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("id")).distinct()
    once = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    revised = docs.withColumn("text", F.when(F.col("text") != once, once)).where("text is not null")
    now = materialize(token_counts.count_tokens(revised, added=True).join(bad, "id", "left_anti"), "token-counts-revised")
    rollup = token_counts.Rollup(spark, scratch_path(spark, "rollup"))
    for _ in range(2):
        rollup.commit("load", lambda: token_counts.signed(counts, 1))
        rollup.commit("drop bad", lambda: token_counts.signed(counts.join(bad, "id", "left_semi"), -1))
        rollup.commit("lines once", lambda: token_counts.changes(counts.join(now.select("id"), "id", "left_semi"), now))
    return rollup.totals()


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{chat.CLOSE}{chat.OPEN}assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.read_back(chat.format_chats(rows))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), added=True)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's 400 bytes, and beside them how many words of each text are in repeated passages of 50 words."""
    return repeats.repeats(table(spark, sf_dir, "documents"), passage_words=repeats.PASSAGE_WORDS)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_chat": op2_chat,
        "op3_packing": op3_packing,
        "op4_html": op4_html,
        "op5_simhash": op5_simhash,
        "op6_nbsvm": op6_nbsvm,
        "op7_repeats": op7_repeats,
        "op8_quality_rules": op8_quality_rules,
        "op9_warc": op9_warc,
        "op10_decontamination": op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": oracles.chat_sql(), "op8_quality_rules": oracles.QUALITY_RULES, "op9_warc": oracles.WARC, "op10_decontamination": oracles.CONTAMINATION}
