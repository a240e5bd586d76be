"""Quality rules with cross-document line frequency (DataFrame functions only).

Each document gets base statistics from its own words and lines. Then lines
are normalised and hashed, distinct documents are counted per host and line,
lines found in more documents than the host's limit are taken out, and a
document that little is left of is rejected.

Scale. Word statistics stay inside the row. Only hashed lines are shuffled:
counts are combined before the shuffle, and the lines above the limit are
joined back on a salted key, since one line may occur in a third of all
documents.

Cases. A null text has no words and fails the base rules; a null host is a
host of its own. Copies of one text count as one document of a host, so a copied
document does not turn its own lines into boilerplate. Equal rows get equal
results, each its own. Other columns of the input, whatever their names, are
ignored by :func:`quality_rules` and kept by :func:`keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import BLANKS, let

WORD_GAP = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: A host's line is boilerplate beyond this many documents ...
MIN_DOCS = 20
#: ... and beyond this share of the host's distinct documents.
DOC_SHARE = 0.002
#: A document is depleted if fewer words are left, or a smaller share.
MIN_WORDS = 10
KEPT_SHARE = 0.2
SALTS = 64

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def _repeated(words: Column) -> Column:
    """Number of words inside windows that occur twice or more.

    Windows are compared by a 64-bit hash of their words. Rows whose hashes
    are all different, nearly all of them, stop there; otherwise the hashes
    are sorted with their places, neighbours compared, and the places covered
    are measured from one repeated window to the next.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(
            pairs,
            lambda p: F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(
                            p,
                            lambda x, k: F.struct(
                                x["i"].alias("i"),
                                (
                                    F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False))
                                    | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))
                                ).alias("twice"),
                            ),
                        ),
                        lambda y: y["twice"],
                    ),
                    lambda y: y["i"],
                )
            ),
        )
        return let(
            again,
            lambda a: F.aggregate(
                F.transform(a, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(a, k + 1) - i, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda s, x: s + x,
            ),
        )

    def counted(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
        )

    return F.when(F.size(words) > WINDOW, counted(words)).otherwise(F.lit(0).cast("long"))


def base_stats(text: Column) -> Column:
    """A struct of the statistics that need no other document."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated(w).alias("n_repeat_words"),
        ),
    )


def line_table(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """Each normalised line of each document with its place among all its lines and its word count.

    Lines without words are left out. Normalised: lower case, white space collapsed and trimmed, digits made 0.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    norm = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), WORD_GAP, " "), "[0-9]", "0"))
    placed = F.transform(F.split(body, "\n"), lambda x, i: F.struct(i.alias("pos"), norm(x).alias("line")))
    hashed = F.transform(
        F.filter(placed, lambda x: x["line"] != ""),
        lambda x: F.struct(
            x["pos"].alias("pos"), F.xxhash64(x["line"]).alias("h1"), F.hash(x["line"]).alias("h2"), F.size(F.split(x["line"], " ")).cast("long").alias("words")
        ),
    )
    # Hashes are made below the generator, once for each text: above it they would be made for each line.
    # It is the outer one since for an inner one Catalyst adds a filter that makes all lines again.
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("text_hash"), F.col(host).alias("host"), hashed.alias("lines"))
    return rows.select("id", "text_hash", "host", F.explode_outer("lines").alias("line")).where("line is not null").select(
        "id", "text_hash", "host", "line.*"
    )


def frequent_lines(lines: DataFrame, docs: DataFrame, text: str, host: str, min_docs: int, doc_share: float) -> DataFrame:
    """(host, h1, h2) of the lines above their host's limit."""
    hosts = (
        docs.groupBy(F.col(host).alias("host"))
        .agg(F.count_distinct(F.xxhash64(F.coalesce(F.col(text), F.lit("")))).alias("host_docs"))
        .withColumnRenamed("host", "of_host")
    )
    counts = lines.groupBy("host", "h1", "h2").agg(F.count_distinct("text_hash").alias("n_docs")).where(F.col("n_docs") > min_docs)
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).where(
        F.col("n_docs") > doc_share * F.col("host_docs")
    ).select("host", "h1", "h2")


def removed_words(docs: DataFrame, doc_id: str, text: str, host: str, min_docs: int, doc_share: float) -> DataFrame:
    """(id, host, text_hash, removed, places) of the documents that lose lines: their words and where they are."""
    lines = line_table(docs, doc_id, text, host)
    often = frequent_lines(lines, docs, text, host, min_docs, doc_share).select(
        F.col("host").alias("f_host"), F.col("h1").alias("f1"), F.col("h2").alias("f2"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("f_salt"),
    )
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("id", "text_hash"), F.lit(SALTS)).cast("int"))
    hit = salted.join(
        often,
        (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")) & (F.col("salt") == F.col("f_salt"))
        & F.col("host").eqNullSafe(F.col("f_host")),
    )
    return (
        hit.groupBy("id", "host", "text_hash", "pos").agg(F.max("words").alias("words"))  # equal rows have equal places
        .groupBy("id", "host", "text_hash").agg(F.sum("words").alias("removed"), F.collect_list("pos").alias("places"))
        .toDF("r_id", "r_host", "r_hash", "removed", "places")
    )


def _judged(
    docs: DataFrame, doc_id: str, text: str, host: str, min_docs: int, doc_share: float, min_words: int, kept_share: float
) -> DataFrame:
    """``docs`` with its columns under ``row`` and the verdict's columns."""
    body = F.coalesce(F.col(text), F.lit(""))
    # inline_outer keeps Catalyst from computing the statistics once per mention.
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"), F.col(host).alias("host"),
        F.xxhash64(body).alias("text_hash"), F.inline_outer(F.array(base_stats(F.col(text)))),
    )
    gone = removed_words(docs, doc_id, text, host, min_docs, doc_share)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_line_words_removed")
    return (
        rows.join(
            gone,
            F.col("id").eqNullSafe(F.col("r_id")) & F.col("host").eqNullSafe(F.col("r_host"))
            & F.col("text_hash").eqNullSafe(F.col("r_hash")),
            "left",
        )
        .withColumn("n_line_words_removed", F.coalesce("removed", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (left >= min_words) & (left >= kept_share * F.col("n_words")))
    )


def quality_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
    min_docs: int = MIN_DOCS, doc_share: float = DOC_SHARE, min_words: int = MIN_WORDS, kept_share: float = KEPT_SHARE,
) -> DataFrame:
    """One row per row of ``docs``: its id, statistics and verdict.

    ``base_failed``: under 10 words, or over 20 in 100 words repeated.
    ``kept``: base rules passed and enough left without frequent lines.
    """
    only = docs.select(doc_id, text, host)
    found = _judged(only, doc_id, text, host, min_docs, doc_share, min_words, kept_share)
    return found.select("id", *STATS, "base_failed", "kept", "n_line_words_removed").withColumnRenamed("id", doc_id)


def without_lines(text: Column, places: Column) -> Column:
    """``text`` without the lines at ``places``; null places take nothing out."""

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    return F.when(places.isNull(), text).otherwise(let(F.split(text, "\n"), rest))


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, their texts without their host's frequent lines.

    Other columns, also those that speak of the text's length, are as they were.
    """
    defaults = {"min_docs": MIN_DOCS, "doc_share": DOC_SHARE, "min_words": MIN_WORDS, "kept_share": KEPT_SHARE}
    kept = _judged(docs, doc_id, text, host, **(defaults | limits)).where("kept")
    return kept.select(*(without_lines(F.col("row")[c], F.col("places")).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
